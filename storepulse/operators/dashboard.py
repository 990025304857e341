"""Dashboard frames (§2.6 A5–A8, §2.8 T1–T8, §2.3 P17, P25).

Each frame is one DataFrame query. Global figures are single aggregates (partial per task, one
final row); top-k reports use ``orderBy().limit()``, which Spark plans as TakeOrderedAndProject
(each task keeps k rows, the driver merges k × tasks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storepulse.functions.scalars import ORDER_ID_PREFIX, currency, short
from storepulse.operators.windows import top_k_per_key


def overview_metrics(scored: DataFrame, status: str = "status", amount: str = "amount") -> DataFrame:
    """A5: revenue, orders, approved, review, blocked (status text tested by substring, F34)."""
    s = F.col(status)
    return scored.agg(
        F.sum(amount).cast("double").alias("revenue"),
        F.count(F.lit(1)).alias("orders"),
        F.count_if(s.contains("APPROVED")).alias("approved"),
        F.count_if(s.contains("REVIEW")).alias("review"),
        F.count_if(s.contains("FRAUD")).alias("blocked"))


def revenue_by_payment(orders: DataFrame, payment: str = "payment_method", amount: str = "amount") -> DataFrame:
    """Revenue per payment method (missing method → 'unknown')."""
    return (orders.groupBy(F.coalesce(F.col(payment), F.lit("unknown")).alias("payment_method"))
            .agg(F.sum(amount).cast("double").alias("revenue")))


def latest_fraud_scores(scores: DataFrame, n: int = 20, ts: str = "created_at", tiebreak: str = "order_id") -> DataFrame:
    """Newest ``n`` fraud scores."""
    return scores.orderBy(F.col(ts).desc(), F.col(tiebreak).desc()).limit(n)


def fraud_status_counts(latest: DataFrame, status: str = "status") -> DataFrame:
    """Count per status, descending."""
    return latest.groupBy(status).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(status))


def score_histogram(scores: DataFrame, col: str = "final_score", by: str = "status", bins: int = 20,
                    lo: float = 0.0, hi: float = 400.0) -> DataFrame:
    """Equal-width bins over the score domain [lo, hi) (rule scores reach at most 380), by status.

    Fixed bins need no global min/max pass; values outside the domain land in the edge bins."""
    width = (hi - lo) / bins
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(col) - lo) / width))).cast("int")
    return (scores.groupBy(F.col(by), b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_lo", (F.col("bin") * width + lo).cast("double"))
            .withColumn("bin_hi", ((F.col("bin") + 1) * width + lo).cast("double")))


def first_items(order_items: DataFrame, key: str, name: str, line: str, k: int) -> DataFrame:
    """The first ``k`` item names per order in the order of their lines (names among equal ones), as an array
    (exact for any display cut that fits in k items)."""
    top = top_k_per_key(order_items, key, [F.col(line).asc_nulls_first(), F.col(name).asc_nulls_first()], k, rank_col="_r")
    in_order = F.array_sort(F.collect_list(F.struct(F.col("_r"), F.col(name).alias("_name"))))
    return top.groupBy(key).agg(F.transform(in_order, lambda x: x["_name"]).alias("items"))


def recent_orders_table(orders: DataFrame, item_names: DataFrame, key: str = "order_key") -> DataFrame:
    """Display table: WOO-id, email, ``$#,##0.00`` amount, payment, items (each cut to 25,
    joined by ', ', cut to 40), ``score/100`` and status.

    ``item_names`` is (key, items array) in file order. Cutting to 40 needs at most 21 items
    (an empty name still adds ', '), so ``first_items(..., k=21)`` is exact."""
    o = orders.join(item_names, key, "left")
    items = F.transform(F.coalesce(F.col("items"), F.array().cast("array<string>")),
                        lambda x: short(F.coalesce(x, F.lit("")), 25))
    return o.select(
        F.concat(F.lit(ORDER_ID_PREFIX), F.col(key).cast("string")).alias("order"),
        F.coalesce(F.col("customer_email"), F.lit("unknown")).alias("email"),
        currency(F.col("amount")).alias("amount_text"),
        F.coalesce(F.col("payment_method"), F.lit("unknown")).alias("payment"),
        short(F.array_join(items, ", "), 40).alias("items_text"),
        F.concat(F.col("score").cast("string"), F.lit("/100")).alias("score_text"),
        F.col("status"))


def latest_order(orders: DataFrame, ts: str = "ts", tiebreak: str = "order_key") -> DataFrame:
    """The most recent order (one global ``max_by``; partial per task)."""
    cols = orders.columns
    return orders.agg(F.max_by(F.struct(*cols), F.struct(F.col(ts), F.col(tiebreak))).alias("_r")).select("_r.*")


def top_recommendations(recs: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` pairs with the largest similarity."""
    return recs.orderBy(F.col("similarity_score").desc(), F.col("source_position"), F.col("rank")).limit(n)


def nlargest_recommendations(recs: DataFrame, n: int = 10) -> DataFrame:
    """T4: the 10 largest of T2, first row on ties; display names cut to 25."""
    top = top_recommendations(recs, 50)
    return (top.orderBy(F.col("similarity_score").desc(), F.col("source_position"), F.col("rank")).limit(n)
            .withColumn("source_short", short("source_product", 25))
            .withColumn("recommended_short", short("recommended_product", 25)))


def lowest_stock(stock: DataFrame, n: int = 10, level: str = "stock", key: str = "product_id") -> DataFrame:
    """T5: the ``n`` products with the lowest stock."""
    return stock.orderBy(F.col(level).asc(), F.col(key).asc()).limit(n)
