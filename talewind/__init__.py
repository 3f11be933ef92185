"""Narrative spread, actor network and coordination analytics on Spark DataFrames."""

__version__ = "0.1.0"
