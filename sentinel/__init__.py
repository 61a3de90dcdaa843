"""Privacy-aware threat detection on large labelled event tables, as Spark jobs."""

__version__ = "0.1.0"
