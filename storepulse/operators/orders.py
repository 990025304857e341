"""Order normalisation, dedup, customer history (§2.3 P1, §2.5 J3–J4, §2.6 A4, A13, §2.7 W3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.functions.scalars import ORDER_ID_PREFIX
from storepulse.operators.windows import first_by_key, prior_count, trailing_count


def order_quantity(items_col: str = "items"):
    """Σ items.quantity, a missing quantity counting 1."""
    return F.aggregate(F.coalesce(F.col(items_col), F.array()), F.lit(0),
                       lambda acc, i: acc + F.coalesce(i["quantity"], F.lit(1)))


def normalize_orders(raw: DataFrame) -> DataFrame:
    """Raw order-log record → enriched order (without velocity / new-customer)."""
    items = F.coalesce(F.col("items"), F.array())
    return raw.select(
        *[c for c in raw.columns if c in ("pos",)],
        F.concat(F.lit(ORDER_ID_PREFIX), F.col("order_id")).alias("order_id"),
        F.coalesce(F.col("email"), F.lit("unknown")).alias("customer_email"),
        F.concat(F.coalesce(F.col("first_name"), F.lit("")), F.lit(" "),
                 F.coalesce(F.col("last_name"), F.lit(""))).alias("customer_name"),
        F.coalesce(F.col("total"), F.lit(0.0)).cast("double").alias("amount"),
        order_quantity("items").cast("int").alias("quantity"),
        F.coalesce(F.col("payment_method"), F.lit("unknown")).alias("payment_method"),
        F.coalesce(F.col("country"), F.lit("US")).alias("card_country"),
        F.coalesce(F.col("country"), F.lit("US")).alias("shipping_country"),
        F.lit(0).alias("failed_attempts"),
        F.transform(items, lambda i: i["name"]).alias("products"),
        F.col("timestamp"),
    )


def dedup_orders(orders: DataFrame, key: str = "order_id", order: str = "pos") -> DataFrame:
    """First row per order id in file order (a null id is one key)."""
    return first_by_key(orders, key, order)


def enrich_orders(orders: DataFrame, ts: str = "ts", tiebreak: str = "order_id",
                  null_key: str | None = "unknown") -> DataFrame:
    """X1 batch form: velocity per email (W1, trailing hour) and as-of new-customer flag.

    A missing email shares the key ``null_key`` ('unknown', as the reference does); with
    ``null_key=None`` such orders are skipped by both windows and keep null enrichment."""
    if null_key is not None:
        keyed = orders.withColumn("customer_email", F.coalesce(F.col("customer_email"), F.lit(null_key)))
        with_v = trailing_count(keyed, "customer_email", ts, 3600, out="orders_last_hour")
        return is_new_asof(with_v, ts=ts, tiebreak=tiebreak)
    known = orders.filter(F.col("customer_email").isNotNull())
    enriched = is_new_asof(trailing_count(known, "customer_email", ts, 3600, out="orders_last_hour"),
                           ts=ts, tiebreak=tiebreak)
    unknown = (orders.filter(F.col("customer_email").isNull())
               .withColumn("orders_last_hour", F.lit(None).cast("int"))
               .withColumn("prior_orders", F.lit(None).cast("long"))
               .withColumn("is_new_customer", F.lit(None).cast("boolean")))
    return enriched.unionByName(unknown)


def is_new_asof(orders: DataFrame, key: str = "customer_email", ts: str = "ts",
                tiebreak: str = "order_id") -> DataFrame:
    """Earlier orders of the email at arrival; new ⇔ at most one earlier order."""
    out = prior_count(orders, key, ts, tiebreak, out="prior_orders")
    return out.withColumn("is_new_customer", F.col("prior_orders") <= 1)


def orders_per_customer(orders: DataFrame, key: str = "customer_email") -> DataFrame:
    """A4: number of stored orders per email (partial aggregation map-side)."""
    return orders.groupBy(key).agg(F.count(F.lit(1)).alias("n_orders"))


def is_new_current(orders: DataFrame, history: DataFrame, key: str = "customer_email",
                   history_key: str = "customer_email") -> DataFrame:
    """All stored orders of the email now; new ⇔ count ≤ 1 (none stored → new).

    One aggregate + left join replaces the reference's per-order lookup (N+1 queries)."""
    counts = orders_per_customer(history, history_key).withColumnRenamed(history_key, "_hk")
    joined = orders.join(counts, orders[key] == counts["_hk"], "left").drop("_hk")
    return (joined.withColumn("stored_orders", F.coalesce(F.col("n_orders"), F.lit(0)))
            .withColumn("is_new_customer", F.col("stored_orders") <= 1).drop("n_orders"))


def customer_segments(orders: DataFrame, key: str = "customer_email") -> DataFrame:
    """Advertised-only: New (1), Returning (2), Regular (3–9), VIP (≥10) by stored order count."""
    n = F.col("n_orders")
    return orders_per_customer(orders, key).withColumn(
        "segment", F.when(n <= 1, "New").when(n == 2, "Returning").when(n < 10, "Regular").otherwise("VIP"))
