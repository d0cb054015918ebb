"""orefold: source-code facts, metrics and snapshot data on Spark DataFrames."""

__version__ = "0.1.0"
