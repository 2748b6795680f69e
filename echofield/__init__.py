"""echofield: Spark operators for influence spread and experiment analytics.

Every operator is a plain function from DataFrames to a DataFrame.  Nothing is
collected on the driver; the plan stays lazy until the caller acts on it.
"""

__version__ = "0.1.0"
