"""Transaction-label categorisation, evaluation and drift detection on Spark."""

__version__ = "0.1.0"
