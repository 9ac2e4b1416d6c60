"""Log-incident analytics on Spark DataFrames: lines -> entries -> events -> anomalies -> incidents."""

__version__ = "0.1.0"
