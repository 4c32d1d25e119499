"""Side-by-side checks: the analyses on the shared test tables, and the same in plain SQL."""
