"""quillon: a Spark-native data preparation, profiling and load engine."""

__version__ = "0.1.0"
