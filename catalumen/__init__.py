"""A media-catalogue analytics engine on PySpark DataFrames."""

__all__ = ["runtime"]
