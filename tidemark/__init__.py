"""tidemark: Spark-first analytics over activity records and document corpora."""

__version__ = "0.1.0"
