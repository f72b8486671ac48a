"""turnscore: Spark-native scoring, evaluation and comparison of interview-turn data."""

__version__ = "0.1.0"
