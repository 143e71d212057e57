"""riskloom: a Spark-native engine for wide-snapshot risk analytics."""

__version__ = "0.1.0"
