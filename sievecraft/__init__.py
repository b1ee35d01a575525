"""A Spark-native engine for curating and auditing media training datasets."""

__version__ = "0.1.0"
