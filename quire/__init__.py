"""Spark-native analysis and navigation of libraries of books and HTML documents."""

__version__ = "0.1.0"
