"""pactum: contract documents to typed, nested rows, on Spark."""

__version__ = "0.1.0"
