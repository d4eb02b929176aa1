"""prefloom: preparing and auditing human-preference data with Spark DataFrames."""

__version__ = "0.1.0"
