"""tessera: a Spark-native engine for document ingestion, retrieval and citation analytics."""

__version__ = "0.1.0"
