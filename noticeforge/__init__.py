"""noticeforge: analytics over collected public notices, on PySpark."""

__version__ = "0.1.0"
