"""tixpark: service-desk ticket analytics on Spark DataFrames.

Every operator is a function ``DataFrame(s) -> DataFrame`` built on the
public Spark SQL / ``pyspark.ml`` / Structured Streaming APIs.  Rules,
word lists and thresholds are parameters whose defaults are data in
``tixpark.functions.fixed``.
"""

__version__ = "0.1.0"
