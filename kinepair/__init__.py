"""Motion-pair analytics on Spark: DataFrame operators over recorded vehicle tracks."""

__version__ = "0.1.0"
