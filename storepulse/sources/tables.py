"""Table scans. Parquet folders here; a JDBC table or catalog table works the same way.

Scans return the lazy DataFrame; callers select columns and filter so that Catalyst pushes the
projection (``ReadSchema``) and predicates (``PushedFilters``) into the parquet reader.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
                    lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
                    **props) -> DataFrame:
    """JDBC variant of S5; partitioned reads when a numeric key and bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in props.items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", num_partitions))
    return reader.load()
