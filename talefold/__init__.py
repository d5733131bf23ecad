"""talefold: a Spark-native engine for story corpora and retrieval analytics."""

__version__ = "0.1.0"
