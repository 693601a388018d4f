"""chronoloom - a Spark-first engine for daily time-series tables.

Every operator is a function from DataFrames to a DataFrame; nothing is executed until
the caller acts on the result, except where a docstring says that a (bounded) statistic
is gathered first.
"""

__version__ = "0.1.0"
