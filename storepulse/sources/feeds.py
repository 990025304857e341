"""Feeds derived from the driver's tables, in the reference's record shapes (see FIXTURES.md §3).

Each feed is a lazy DataFrame over the parquet scans, so its work grows with the tables. The same
derivations are written as DuckDB SQL in ``storepulse.plans.oracle`` for the correctness check.

Amounts are whole numbers so sums are exact in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.operators.stock import tracked_products
from storepulse.operators.windows import prior_count, trailing_count
from storepulse.sources.tables import read_table

# Fixed mapping values (FIXTURES §3).
COUNTRY_BY_NATION_MOD8 = ["US", "CA", "GB", "AU", "DE", "FR", "IN", "BR"]
PAYMENT_BY_PRIORITY = [("1-URGENT", "stripe"), ("2-HIGH", "stripe"), ("3-MEDIUM", "paypal"),
                       ("4-NOT SPECIFIED", "cod"), ("5-LOW", "bacs")]
# Tiny lexicon for the sentiment scorer (M13); values are dyadic so sums are exact.
LEXICON = [("with", 1.0), ("this", 1.5), ("for", 0.5), ("was", -1.0), ("from", -1.5),
           ("that", -1.0), ("are", 0.5)]


# Added to some ids, which then need 64 bits.
FAR_STOCK_ID, FAR_REVIEW_ID = 5_000_000_000, 3_000_000_000


def _country(nation: Column) -> Column:
    out = None
    for i, code in enumerate(COUNTRY_BY_NATION_MOD8):
        cond = (nation % 8) == i
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
    return out


def _payment(priority: Column) -> Column:
    out = None
    for prio, method in PAYMENT_BY_PRIORITY:
        out = F.when(priority == prio, F.lit(method)) if out is None else out.when(priority == prio, F.lit(method))
    return out


def order_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ⋈ customer ⟕ (line count per order), before the per-customer windows.

    Line items are pre-aggregated by order key before the join (partial + final aggregation), so
    the join moves one row per order rather than one per line.
    """
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    customers = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    lines = (read_table(spark, sf_dir, "lineitem", ["l_orderkey"])
             .groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines")))
    joined = (orders.join(customers, orders.o_custkey == customers.c_custkey, "inner")
              .join(lines, orders.o_orderkey == lines.l_orderkey, "left"))
    country = _country(F.col("c_nationkey"))
    ts = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp"))
                            + (F.col("o_orderkey") % 86400) * F.lit(1_000_000))
    return joined.select(
        F.col("o_orderkey").alias("order_key"),
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("order_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("customer_email"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("customer_name"),
        F.floor(F.col("o_totalprice") / 250).cast("double").alias("amount"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("int").alias("quantity"),
        _payment(F.col("o_orderpriority")).alias("payment_method"),
        country.alias("card_country"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("US")).otherwise(country).alias("shipping_country"),
        F.when(F.col("o_orderkey") % 20 == 0, F.lit(3)).otherwise(F.lit(0)).cast("int").alias("failed_attempts"),
        ts.alias("ts"),
    )


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched order records (the reference's ``orders`` topic value), one row per order.

    ``is_new_customer``: the order is among the first two of the email (J3 as-of semantics);
    ``orders_last_hour``: trailing-hour count keyed by card country (W1).
    """
    base = order_base(spark, sf_dir)
    with_prior = prior_count(base, "customer_email", "ts", "order_key", out="prior_orders")
    with_new = with_prior.withColumn("is_new_customer", F.col("prior_orders") <= 1).drop("prior_orders")
    return trailing_count(with_new, "card_country", "ts", 3600, out="orders_last_hour")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_key, line, name, quantity) per line: line items named by their part, quantity 1 each."""
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"])
    parts = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    return (lines.join(parts, lines.l_partkey == parts.p_partkey, "left")
            .select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("p_name").alias("name"),
                    F.lit(1).cast("int").alias("quantity")))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows (``products.csv`` shape): position, Name, Categories, Regular price text."""
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"])
    return part.select(
        F.col("p_partkey").alias("position"),
        F.concat_ws(" ", F.col("p_name"), F.col("p_brand")).alias("name"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("$"), F.col("p_retailprice").cast("string")).alias("price"),
    )


def stock_now(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Stock feed snapshot: product id, stock text, name, price text (one row per product with a tracked stock).

    Some ids need 64 bits, and products whose stock is not tracked (a null) never reach the feed (P24). ``every``
    keeps the products that the feed otherwise marks as untracked, so only a missing stock leaves one out."""
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"])
    lines = (read_table(spark, sf_dir, "lineitem", ["l_partkey"])
             .groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_lines")))
    j = part.join(lines, part.p_partkey == lines.l_partkey, "left")
    stock = (F.col("p_size") - F.floor(F.coalesce(F.col("n_lines"), F.lit(0)) / 2)).cast("int")
    products = j.withColumn("stock", stock if every else F.when(F.col("p_size") % 10 != 7, stock))
    return tracked_products(products, "stock").select(
        F.when(F.col("p_partkey") % 100 == 3, F.col("p_partkey") + FAR_STOCK_ID).otherwise(F.col("p_partkey")).alias("product_id"),
        F.col("stock").cast("string").alias("stock_text"),
        F.concat_ws(" ", F.col("p_name"), F.col("p_brand")).alias("name"),
        F.col("p_retailprice").cast("string").alias("price_text"),
    )


def stock_feed_lines(spark: SparkSession, sf_dir: str, with_price: bool = True, every: bool = False) -> DataFrame:
    """The same snapshot rendered as ``id|stock|name|price`` (or ``id|stock|name``) text lines."""
    s = stock_now(spark, sf_dir, every)
    parts = [F.col("product_id").cast("string"), F.col("stock_text"), F.col("name")]
    if with_price:
        parts.append(F.col("price_text"))
    return s.select(F.concat_ws("|", *parts).alias("value"))


def stock_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock observations over time: product = user_id, level = floor(value/10), checked_at = ts."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])
    return ev.select(
        F.col("event_id"),
        F.col("user_id").alias("product_id"),
        F.concat(F.lit("Product "), F.col("user_id").cast("string")).alias("product_name"),
        F.floor(F.col("value") / 10).cast("int").alias("stock_level"),
        F.col("ts").cast("timestamp").alias("checked_at"),
    )


def review_id(c: str) -> Column:
    """Comment id of a document; some need 64 bits."""
    return F.when(F.col(c) % 50 == 7, F.col(c) + FAR_REVIEW_ID).otherwise(F.col(c))


def review_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store reviews: all documents; id, product (source), text with newlines as spaces, rating."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return docs.select(
        review_id("doc_id").alias("comment_id"),
        F.col("source").alias("product_name"),
        F.regexp_replace(F.col("text"), "[\r\n]", " ").alias("review_text"),
        ((F.col("doc_id") % 5) + 1).cast("int").alias("rating"),
    )


def review_feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review feed as ``comment_id|||name|||text|||rating`` text lines."""
    r = review_feed(spark, sf_dir)
    return r.select(F.concat_ws("|||", F.col("comment_id").cast("string"), F.col("product_name"),
                                F.replace(F.col("review_text"), F.lit("|||"), F.lit("")),
                                F.col("rating").cast("string")).alias("value"))


def saved_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews already stored: every third review of the feed."""
    return review_feed(spark, sf_dir).filter(F.col("comment_id") % 3 == 0)


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "term string, polarity double")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled transactions (creditcard shape): id, Time, V1..V28, Amount, Class."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    feats = [F.col("embedding")[i].cast("double").alias(f"V{i + 1}") for i in range(28)]
    return emb.select(
        F.col("vec_id").alias("id"),
        (F.col("vec_id") * 10).cast("double").alias("Time"),
        *feats,
        ((F.col("vec_id") * 37) % 1000).cast("double").alias("Amount"),
        F.when(F.col("label") == 0, F.lit(1)).otherwise(F.lit(0)).alias("Class"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_size"])
    return part.select(
        F.col("p_partkey").alias("ID"),
        F.when(F.col("p_size") > 5, F.lit("product")).otherwise(F.lit("page")).alias("post_type"),
        F.concat_ws(" ", F.col("p_name"), F.col("p_brand")).alias("name"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return docs.select(
        F.col("doc_id").alias("comment_ID"),
        F.col("text").alias("comment_content"),
        (F.col("doc_id") % 997 + 1).alias("comment_post_ID"),
        F.lit("review").alias("comment_type"),
        F.when(F.col("doc_id") % 4 != 0, F.lit("1")).otherwise(F.lit("0")).alias("comment_approved"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 1, F.lit(""))
        .otherwise((F.col("doc_id") % 6).cast("string")).alias("rating"),
    )


def order_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw order log (JSON lines) derived from the tables, with ``pos`` = line number order.

    Items are the order's lines named by part (quantity 1 each). Orders with key % 50 = 0 are
    written twice (planted duplicates) and orders with key % 97 = 0 are followed by a malformed
    line and a blank line, so the parser's drop rules are exercised on every scale.
    """
    base = order_base(spark, sf_dir)
    items = (order_items(spark, sf_dir).groupBy("order_key")
             .agg(F.sort_array(F.collect_list(F.struct("name", "quantity"))).alias("items")))
    rec = base.join(items, "order_key", "left")
    record = F.struct(
        F.col("order_key").cast("string").alias("order_id"),
        F.col("customer_email").alias("email"),
        F.lit("Customer").alias("first_name"),
        F.substring_index(F.col("customer_name"), " ", -1).alias("last_name"),
        F.col("amount").alias("total"),
        F.coalesce(F.col("items"), F.array().cast("array<struct<name:string,quantity:int>>")).alias("items"),
        F.col("payment_method"),
        F.col("card_country").alias("country"),
        F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    good = F.to_json(record)
    copies = F.when(F.col("order_key") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    lines = F.array(F.struct(F.lit(0).alias("k"), good.alias("value")))
    lines = F.when(F.col("order_key") % 97 == 0,
                   F.array_union(lines, F.array(F.struct(F.lit(2).alias("k"), F.lit("{\"order_id\": ").alias("value")),
                                                F.struct(F.lit(3).alias("k"), F.lit("").alias("value"))))
                   ).otherwise(lines)
    out = (rec.select("order_key", F.explode(copies).alias("copy"), lines.alias("_l"))
           .select("order_key", "copy", F.explode_outer("_l").alias("_x")))  # never empty; a plain explode would make the lines once more to check that
    out = out.filter((F.col("copy") == 0) | (F.col("_x.k") == 0))
    return out.select(
        (F.col("order_key") * 4 + F.col("copy") + F.col("_x.k")).alias("pos"),
        F.col("_x.value").alias("value"))
