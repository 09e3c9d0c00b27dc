"""inclusio: survey-style tabular ML data preparation, search and audit on Spark."""

__version__ = "0.1.0"
