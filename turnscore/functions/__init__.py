"""Column expressions (Column -> Column), all built-in Spark functions."""

from turnscore.functions import ordinal, stats, text  # noqa: F401
