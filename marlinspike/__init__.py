"""marlinspike: a Spark-native analytics engine for semi-structured opportunity postings."""

__version__ = "0.1.0"
