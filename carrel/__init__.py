"""carrel: a Spark-first engine for document catalogues, search, privacy and ledgers."""

__version__ = "0.1.0"
