"""geoshroud: privacy-preserving cartographic graphs as Spark DataFrames."""

__version__ = "0.1.0"
