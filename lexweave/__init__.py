"""lexweave: a Spark-native engine for text comparison and licence identification."""

__version__ = "0.1.0"
