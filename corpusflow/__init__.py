"""corpusflow: files and tables to retrieval-ready chunks, as Spark jobs."""

__version__ = "0.1.0"
