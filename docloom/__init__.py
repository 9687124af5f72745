"""docloom: a Spark-native engine for question answering over document collections."""

__version__ = "0.1.0"
