"""Stock monitoring (§2.1 S6–S7, §2.3 P6–P7, P20, §2.2 K7, §2.6 A11–A12, §2.7 W4, W7).

The alert cooldown (W7) is in ``operators.cooldown``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.functions.scalars import LOW_STOCK_THRESHOLD, stock_status
from storepulse.operators.cooldown import cooldown

__all__ = ["alert_candidates", "classify", "cooldown", "latest_snapshot", "stock_by_status", "stock_counts", "stock_status_distribution", "tracked_products"]


def stock_counts(stock: DataFrame, status: str = "status") -> DataFrame:
    """Total, in, low, out."""
    s = F.col(status)
    return stock.agg(F.count(F.lit(1)).alias("total"),
                     F.count_if(s == "IN_STOCK").alias("in_stock"),
                     F.count_if(s == "LOW_STOCK").alias("low_stock"),
                     F.count_if(s == "OUT_OF_STOCK").alias("out_of_stock"))


def stock_status_distribution(stock: DataFrame, status: str = "status") -> DataFrame:
    """Products per status, largest first."""
    return stock.groupBy(status).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(status))


def stock_by_status(stock: DataFrame, wanted: str, status: str = "status") -> DataFrame:
    """P20: the products of one status."""
    return stock.filter(F.col(status) == wanted)


def tracked_products(products: DataFrame, stock: str = "stock") -> DataFrame:
    """Products whose stock is tracked; a null stock is no zero."""
    return products.filter(F.col(stock).isNotNull())


def classify(stock: DataFrame, level: str = "stock", threshold: int = LOW_STOCK_THRESHOLD) -> DataFrame:
    """P7 as a column on a frame."""
    return stock.withColumn("status", stock_status(F.col(level), threshold))


def alert_candidates(stock: DataFrame, level: str = "stock_level", key: str = "product_id",
                     threshold: int = LOW_STOCK_THRESHOLD) -> DataFrame:
    """Low and out-of-stock observations as alerts keyed ``low_<id>`` / ``out_<id>``."""
    lvl = F.col(level)
    kind = F.when(lvl == 0, F.lit("out")).when(lvl <= threshold, F.lit("low"))
    return (stock.withColumn("level", kind).filter(F.col("level").isNotNull())
            .withColumn("alert_key", F.concat(F.col("level"), F.lit("_"), F.col(key).cast("string"))))


# ---- K7 helpers ---------------------------------------------------------------------------------

def latest_snapshot(history: DataFrame, key: str = "product_id", order: str = "checked_at") -> DataFrame:
    """Current table state from an append-only history: newest row per key (max aggregate)."""
    others = [c for c in history.columns if c != key]
    packed = history.groupBy(key).agg(F.max(F.struct(F.col(order).alias("_o"), *others)).alias("_r"))
    return packed.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])
