"""tidemark: Parquet scans and UTC time-partitioned datasets, Spark-first."""

__version__ = "0.1.0"
