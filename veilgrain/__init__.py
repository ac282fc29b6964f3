"""veilgrain: sensitive-data and detection-quality analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
