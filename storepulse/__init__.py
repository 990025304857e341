"""storepulse — retail order-risk, review, stock and catalogue analytics on Spark.

Every operator takes and returns DataFrames; the work is expressed with the DataFrame API,
Spark SQL functions, MLlib and Structured Streaming so Catalyst plans it and executors run it.
"""

from storepulse.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
