"""tidelog: a change-data engine expressed as Spark DataFrames."""

__version__ = "0.1.0"
