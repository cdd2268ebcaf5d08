"""Multi-label text annotation, balancing, ensembling and evaluation on Spark."""

__version__ = "0.1.0"
