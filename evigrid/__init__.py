"""evigrid: analytics over machine-produced answers, traces and judgements on Spark.

Every operator takes and returns DataFrames; nothing is collected unless its size is fixed.
"""

__version__ = "0.1.0"
