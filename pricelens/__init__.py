"""pricelens: price-history, review and buy-or-wait analytics on Spark.

Every operator is ``f(DataFrame, ...) -> DataFrame``: lazy, set-based over
all products at once, and built from Spark SQL expressions.
"""

__version__ = "0.1.0"
