"""What runs: the analysis registry, the result sink, the run log and the batch runner."""
