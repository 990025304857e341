"""Sinks and table maintenance (§2.2 K1–K16).

Sink-row builders shape a DataFrame into a stored table's columns (with the reference's varchar
cuts); writers append with ``df.write``. Upsert and replace-by-key are expressed as joins so
they run distributed on any table format; ``MERGE INTO`` / dynamic partition overwrite are the
at-scale variants where the table format supports them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storepulse.functions.scalars import currency, numeric_order_id, parse_price, short

# K9: stored table schemas (surrogate ids dropped; created_at is passed in by the caller).
TABLE_SCHEMAS = {
    "orders": T.StructType([
        T.StructField("order_id", T.StringType()), T.StructField("customer_email", T.StringType()),
        T.StructField("customer_name", T.StringType()), T.StructField("amount", T.DoubleType()),
        T.StructField("quantity", T.IntegerType()), T.StructField("payment_method", T.StringType()),
        T.StructField("is_new_customer", T.BooleanType()), T.StructField("card_country", T.StringType()),
        T.StructField("shipping_country", T.StringType()), T.StructField("products", T.StringType()),
        T.StructField("order_timestamp", T.TimestampType()), T.StructField("created_at", T.TimestampType())]),
    "fraud_scores": T.StructType([
        T.StructField("order_id", T.StringType()), T.StructField("customer_email", T.StringType()),
        T.StructField("amount", T.DoubleType()), T.StructField("rule_score", T.IntegerType()),
        T.StructField("ml_score", T.IntegerType()), T.StructField("final_score", T.IntegerType()),
        T.StructField("status", T.StringType()), T.StructField("reasons", T.StringType()),
        T.StructField("created_at", T.TimestampType())]),
    "product_reviews": T.StructType([
        T.StructField("product_name", T.StringType()), T.StructField("review_text", T.StringType()),
        T.StructField("rating", T.DoubleType()), T.StructField("textblob_score", T.DoubleType()),
        T.StructField("textblob_sentiment", T.StringType()), T.StructField("vader_score", T.DoubleType()),
        T.StructField("vader_sentiment", T.StringType()), T.StructField("final_sentiment", T.StringType()),
        T.StructField("analyzed_at", T.TimestampType()), T.StructField("wp_comment_id", T.LongType())]),
    "products": T.StructType([
        T.StructField("product_name", T.StringType()), T.StructField("category", T.StringType()),
        T.StructField("price", T.DoubleType()), T.StructField("created_at", T.TimestampType())]),
    "recommendations": T.StructType([
        T.StructField("source_product", T.StringType()), T.StructField("recommended_product", T.StringType()),
        T.StructField("category", T.StringType()), T.StructField("price", T.StringType()),
        T.StructField("similarity_score", T.DoubleType()), T.StructField("rank", T.IntegerType()),
        T.StructField("created_at", T.TimestampType())]),
    "stock_levels": T.StructType([
        T.StructField("product_id", T.LongType()), T.StructField("product_name", T.StringType()),
        T.StructField("stock_level", T.IntegerType()), T.StructField("status", T.StringType()),
        T.StructField("checked_at", T.TimestampType())]),
}


def ensure_tables(spark: SparkSession, location: str, fmt: str = "parquet", database: str | None = None) -> list[str]:
    """K9: create each table if absent (``CREATE TABLE IF NOT EXISTS ... USING fmt LOCATION``), in ``database``,
    which is created if absent, or else the current one. Returns the tables' names."""
    made = []
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    for name, schema in TABLE_SCHEMAS.items():
        name = f"{database}.{name}" if database else name
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING {fmt} LOCATION '{location}/{name.split(".")[-1]}'")
        made.append(name)
    return made


def with_missing_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add each schema column that is absent, as a typed null."""
    out = df
    for f in schema.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once (empty ⇔ unique)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def to_topic(df: DataFrame, key: str | None = None) -> DataFrame:
    """K1: JSON value (and optional key) per row, ready for a Kafka or file sink."""
    cols = [F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value")]
    if key:
        cols.insert(0, F.col(key).cast("string").alias("key"))
    return df.select(*cols)


def orders_sink_rows(orders: DataFrame, created_at=None) -> DataFrame:
    """K2: products joined with ', ' and cut to 500; defaults quantity 1, new False, country US."""
    return orders.select(
        F.col("order_id"), F.col("customer_email"), F.col("customer_name"),
        F.coalesce(F.col("amount"), F.lit(0.0)).cast("double").alias("amount"),
        F.coalesce(F.col("quantity"), F.lit(1)).cast("int").alias("quantity"),
        F.col("payment_method"),
        F.coalesce(F.col("is_new_customer"), F.lit(False)).alias("is_new_customer"),
        F.coalesce(F.col("card_country"), F.lit("US")).alias("card_country"),
        F.coalesce(F.col("shipping_country"), F.lit("US")).alias("shipping_country"),
        short(F.array_join(F.coalesce(F.col("products"), F.array().cast("array<string>")), ", "), 500).alias("products"),
        F.col("ts").alias("order_timestamp") if "ts" in orders.columns else F.col("timestamp").alias("order_timestamp"),
        *([F.lit(created_at).alias("created_at")] if created_at is not None else []))


def fraud_sink_rows(scored: DataFrame, created_at=None) -> DataFrame:
    """K3: reasons joined with ', ' and cut to 1000."""
    return scored.select(
        "order_id", "customer_email",
        F.coalesce(F.col("amount"), F.lit(0.0)).cast("double").alias("amount"),
        F.coalesce(F.col("rule_score"), F.lit(0)).cast("int").alias("rule_score"),
        F.coalesce(F.col("ml_score"), F.lit(0)).cast("int").alias("ml_score"),
        F.coalesce(F.col("final_score"), F.lit(0)).cast("int").alias("final_score"),
        "status",
        short(F.array_join(F.coalesce(F.col("reasons"), F.array().cast("array<string>")), ", "), 1000).alias("reasons"),
        *([F.lit(created_at).alias("created_at")] if created_at is not None else []))


def catalog_sink_rows(catalog: DataFrame, name: str = "Name", category: str = "Categories",
                      price: str = "Regular price") -> DataFrame:
    """K4: name cut to 500, category to 100, parsed price; a bad price drops that row only."""
    out = catalog.select(short(F.coalesce(F.col(name).cast("string"), F.lit("nan")), 500).alias("product_name"),
                         short(F.coalesce(F.col(category).cast("string"), F.lit("nan")), 100).alias("category"),
                         parse_price(F.col(f"`{price}`")).alias("price"))
    return out.filter(F.col("price").isNotNull())


def review_sink_rows(reviews: DataFrame) -> DataFrame:
    """K5: product name cut to 500, text to 5000, with the sentiment columns."""
    cols = [short("product_name", 500).alias("product_name"), short("review_text", 5000).alias("review_text"),
            F.col("rating").cast("double").alias("rating"),
            "textblob_score", "textblob_sentiment", "vader_score", "vader_sentiment", "final_sentiment"]
    if "comment_id" in reviews.columns:
        cols.append(F.col("comment_id").cast("long").alias("wp_comment_id"))
    return reviews.select(*cols)


def recommendation_sink_rows(recs: DataFrame) -> DataFrame:
    """K6: cuts 500 / 500 / 100 / 50; price stays text."""
    return recs.select(short("source_product", 500).alias("source_product"),
                       short("recommended_product", 500).alias("recommended_product"),
                       short(F.col("category").cast("string"), 100).alias("category"),
                       short(F.col("price").cast("string"), 50).alias("price"),
                       F.col("similarity_score").cast("double").alias("similarity_score"),
                       F.col("rank").cast("int").alias("rank"))


def upsert_stock(current: DataFrame, batch: DataFrame, key: str = "product_id", order: str = "seq") -> DataFrame:
    """K7: insert new keys; on conflict update stock_level, status, checked_at but keep the stored
    product_name. Several batch rows for one key: the last (largest ``order``) wins.

    Batch dedup is a ``max_by`` aggregate (partial map-side, skew-safe); the merge is one full
    outer join on the key."""
    last = batch.groupBy(key).agg(F.max_by(F.struct("product_name", "stock_level", "status", "checked_at"),
                                           F.col(order)).alias("_b")).select(key, "_b.*")
    c, b = current.alias("c"), last.alias("b")
    merged = c.join(b, F.col(f"c.{key}") == F.col(f"b.{key}"), "full_outer")
    return merged.select(
        F.coalesce(F.col(f"c.{key}"), F.col(f"b.{key}")).alias(key),
        F.coalesce(F.col("c.product_name"), F.col("b.product_name")).alias("product_name"),
        F.when(F.col(f"b.{key}").isNotNull(), F.col("b.stock_level")).otherwise(F.col("c.stock_level")).alias("stock_level"),
        F.when(F.col(f"b.{key}").isNotNull(), F.col("b.status")).otherwise(F.col("c.status")).alias("status"),
        F.when(F.col(f"b.{key}").isNotNull(), F.col("b.checked_at")).otherwise(F.col("c.checked_at")).alias("checked_at"))


def replace_by_key(current: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """K8: every stored row of a key present in the batch is replaced by the batch's rows."""
    keys = batch.select(key).distinct()
    return current.join(keys, key, "left_anti").unionByName(batch.select(*current.columns))


def append(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Append sink (bulk partition writes)."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def save_model(model, path: str) -> None:
    """Persist the fitted pipeline (scalers, assembler with feature names, forest)."""
    model.write().overwrite().save(path)


def order_actions(scored: DataFrame, store_orders: DataFrame, store_key: str = "order_key",
                  store_ts: str = "ts") -> DataFrame:
    """K13 (+J10): hold action per non-approved order: numeric id from ``WOO-<n>``; an id not in the
    store falls back to the most recent store order. The store call itself is not made.

    The fallback is one global ``max_by`` value, computed once and passed as a literal."""
    flagged = scored.filter(F.col("status") != "APPROVED").withColumn(
        "numeric_id", numeric_order_id(F.col("order_id")).try_cast("long"))
    known = store_orders.select(F.col(store_key).cast("long").alias("_sid"))
    latest = store_orders.agg(F.max_by(F.col(store_key).cast("long"), F.struct(F.col(store_ts), F.col(store_key)))
                              ).first()[0]  # one value
    j = (flagged.join(known, flagged.numeric_id == known._sid, "left")
         .withColumn("_latest", F.lit(latest).cast("long")))
    label = F.when(F.col("status") == "FRAUD_BLOCKED", F.lit("FRAUD DETECTED")).otherwise(F.lit("REVIEW NEEDED"))
    return j.select(
        "order_id",
        F.coalesce(F.col("_sid"), F.col("_latest")).alias("target_order"),
        F.col("_sid").isNull().alias("fallback"),
        F.lit("on-hold").alias("new_status"),
        F.concat(label, F.lit(" - Score: "), F.col("final_score").cast("string"),
                 F.lit("/100. Pending admin review.")).alias("note"))


def _products_text(c="products"):
    return short(F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")),
                                          lambda x: F.coalesce(x.cast("string"), F.lit("None"))), ", "), 100)


def notification_outbox(scored: DataFrame, admin: str = "admin") -> DataFrame:
    """FRAUD_BLOCKED / REVIEW_NEEDED → admin fraud alert + customer "under review";
    APPROVED → customer confirmation + admin new-order notice. A customer row is skipped when the
    email is empty. One ``explode`` of a per-status array; no per-row Python."""
    oid = F.coalesce(F.col("order_id"), F.lit("N/A"))
    email = F.coalesce(F.col("customer_email"), F.lit(""))
    amount = F.coalesce(F.col("amount"), F.lit(0.0))
    msg = lambda kind, to, subject: F.struct(F.lit(kind).alias("template"), to.alias("recipient"),
                                            subject.alias("subject"))
    flagged = F.array(
        msg("fraud_alert", F.lit(admin), F.concat(F.lit("🚨 FRAUD ALERT — "), oid, F.lit(" — Score: "),
                                                  F.col("final_score").cast("string"), F.lit("/100"))),
        msg("under_review", email, F.concat(F.lit("⏳ Order Under Review — "), oid)))
    approved = F.array(
        msg("order_confirmation", email, F.concat(F.lit("✅ Order Confirmed — "), oid)),
        msg("admin_new_order", F.lit(admin), F.concat(F.lit("🛍️ New Order Received — "), oid, F.lit(" — "),
                                                      currency(amount))))
    msgs = F.when(F.col("status").isin("FRAUD_BLOCKED", "REVIEW_NEEDED"), flagged).otherwise(approved)
    return (scored.select("order_id", "status", _products_text().alias("products_text"), F.explode(msgs).alias("m"))
            .select("order_id", "status", "m.*", "products_text")
            .filter(F.col("recipient") != ""))


def stock_outbox(alerts: DataFrame, admin: str = "admin", keep: list[str] | None = None) -> DataFrame:
    """Low-stock (name cut to 40, level) and out-of-stock notices to the admin."""
    name40 = short(F.col("product_name"), 40)
    subject = F.when(F.col("level") == "low", F.concat(F.lit("⚠️ Low Stock Alert — "), name40)).otherwise(
        F.concat(F.lit("🚫 OUT OF STOCK — "), name40))
    return alerts.select(*(keep or []), "product_id", "level", F.lit(admin).alias("recipient"), subject.alias("subject"),
                         F.col("stock").alias("stock_level"))


def cancellation_outbox(orders: DataFrame, reason: str = "Suspicious activity detected",
                        admin: str = "admin") -> DataFrame:
    """One notice to the customer (if the email is set) and one to the admin per order."""
    oid = F.coalesce(F.col("order_id"), F.lit("N/A"))
    msgs = F.array(
        F.struct(F.lit("customer_cancelled").alias("template"),
                 F.coalesce(F.col("customer_email"), F.lit("")).alias("recipient"),
                 F.concat(F.lit("❌ Order Cancelled — "), oid).alias("subject")),
        F.struct(F.lit("admin_cancelled").alias("template"), F.lit(admin).alias("recipient"),
                 F.concat(F.lit("👨‍💼 Admin Cancelled Order — "), oid).alias("subject")))
    return (orders.select("order_id", F.explode(msgs).alias("m")).select("order_id", "m.*")
            .filter(F.col("recipient") != "").withColumn("reason", F.lit(reason)))


