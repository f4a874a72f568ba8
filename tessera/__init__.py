"""tessera: tabular profiling, cleaning, encoding and regression modelling on Spark.

Everything is expressed with the DataFrame / SQL / ML APIs: fitted encoders
are DataFrames applied by joins, statistics are single-pass aggregations,
and the feature pipeline is fitted once per training set.
"""

__version__ = "0.1.0"
