"""dialex: analytics over dialogue and text corpora, written for Spark."""

__version__ = "0.1.0"
