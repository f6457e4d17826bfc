"""readloom: Spark-native analytics over molecularly barcoded sequencing reads."""

__version__ = "0.1.0"
