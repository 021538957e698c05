"""DataFrame operators for analysing retrieval systems and model experiments."""

__version__ = "0.1.0"
