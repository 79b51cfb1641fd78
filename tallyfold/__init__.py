"""tallyfold: a Spark-native engine that curates and searches loosely structured listings."""

__version__ = "0.1.0"
