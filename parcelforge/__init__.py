"""Spark jobs for property valuation at scale, plus training-data operators in ``parcelforge.llm``."""
