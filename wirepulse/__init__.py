"""News-event analytics on Spark.

``sources``    raw tab-separated scan, landing, retention, landed-table scans
``functions``  column expressions and fixed lookup tables
``operators``  the nineteen analyses, their shared rollups and the serving views
``plans``      registry, result sink, run log and the batch runner
``streaming``  Structured Streaming forms of ingestion, detection and refresh
"""

__version__ = "0.1.0"
