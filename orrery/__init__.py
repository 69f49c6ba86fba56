"""orrery: a Spark-native engine for visual-recommendation experiments and data preparation."""

__version__ = "0.1.0"
