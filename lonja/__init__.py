"""lonja: market-data analytics on PySpark, written for the DataFrame API first."""

__version__ = "0.1.0"
