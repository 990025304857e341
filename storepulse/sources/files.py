"""File and feed sources (§2.1 S1–S11).

Each parser takes a DataFrame of text lines (column ``value``), so the same code reads a file
(``spark.read.text``), a stream (``spark.readStream.text``) or lines derived from a table.
Malformed input is dropped row by row, as the reference's bare ``except`` does; nothing fails the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storepulse.functions.scalars import parse_stock

ORDER_LOG_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
    T.StructField("total", T.DoubleType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("quantity", T.IntegerType())]))),
    T.StructField("payment_method", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])

ENRICHED_ORDER_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("customer_email", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("is_new_customer", T.BooleanType()),
    T.StructField("orders_last_hour", T.IntegerType()),
    T.StructField("card_country", T.StringType()),
    T.StructField("shipping_country", T.StringType()),
    T.StructField("failed_attempts", T.IntegerType()),
    T.StructField("products", T.ArrayType(T.StringType())),
    T.StructField("timestamp", T.StringType()),
])

CATALOG_SCHEMA = T.StructType([
    T.StructField("Type", T.StringType()),
    T.StructField("Name", T.StringType()),
    T.StructField("Published", T.IntegerType()),
    T.StructField("Regular price", T.StringType()),
    T.StructField("Categories", T.StringType()),
    T.StructField("Images", T.StringType()),
    T.StructField("Short description", T.StringType()),
])

REVIEW_PAYLOAD_SCHEMA = T.StructType([T.StructField("data", T.StructType([
    T.StructField("reviews", T.ArrayType(T.StructType([
        T.StructField("review_comment", T.StringType()),
        T.StructField("review_star_rating", T.StringType())]))),
    T.StructField("products", T.ArrayType(T.StructType([T.StructField("asin", T.StringType())]))),
]))])


def transactions_schema(n_features: int = 28) -> T.StructType:
    return T.StructType([T.StructField("Time", T.DoubleType())]
                        + [T.StructField(f"V{i}", T.DoubleType()) for i in range(1, n_features + 1)]
                        + [T.StructField("Amount", T.DoubleType()), T.StructField("Class", T.IntegerType())])


# ---- S1: JSON-lines order log --------------------------------------------------------------

def parse_order_log(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Blank lines and lines that are not a JSON object are dropped; nested items kept.

    One parse per line: the schema carries a corrupt-record column, which is set exactly when
    the line does not parse, and the filter on it cannot go below the generator that holds the parsed line. Numbers are read as text first, so a total or quantity given as JSON
    text counts, and one that is no number is null without losing the order."""
    keep = keep or []
    as_text = {"total": T.StringType(), "items": T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "quantity")]))}
    schema = T.StructType([T.StructField(f.name, as_text.get(f.name, f.dataType)) for f in ORDER_LOG_SCHEMA.fields]
                          + [T.StructField("_corrupt", T.StringType())])
    trimmed = F.trim(F.col("value"))
    parsed = lines.filter(trimmed.startswith("{")).withColumn(
        "_o", F.explode_outer(F.array(F.from_json(F.col("value"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))))
    number = {"total": F.col("_o.total").try_cast("double"),
              "items": F.transform("_o.items", lambda x: F.struct(x["name"].alias("name"), x["quantity"].try_cast("double").try_cast("int").alias("quantity")))}
    return parsed.filter(F.col("_o._corrupt").isNull()).select(
        *keep, *[number.get(f.name, F.col(f"_o.{f.name}")).alias(f.name) for f in ORDER_LOG_SCHEMA.fields])


def read_order_log(spark: SparkSession, path: str) -> DataFrame:
    """S1 on a file or folder of JSON lines; the line number within the file is kept as ``pos``."""
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    return parse_order_log(lines, keep=["pos"])


def read_order_stream(spark: SparkSession, fmt: str = "kafka", schema: T.StructType = ENRICHED_ORDER_SCHEMA,
                      **options) -> DataFrame:
    """A stream of JSON values (Kafka topic at ``latest`` by default, or a file/text source)."""
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        reader = reader.option("startingOffsets", options.pop("startingOffsets", "latest"))
    for k, v in options.items():
        reader = reader.option(k, v)
    raw = reader.load()
    value = F.trim(F.col("value").cast("string"))
    with_corrupt = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    parsed = raw.filter(value.startswith("{")).select(
        F.from_json(value, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_o"))
    return parsed.filter(F.col("_o._corrupt").isNull()).select(*[F.col(f"_o.{f.name}").alias(f.name)
                                                                 for f in schema.fields])


# ---- S3/S4: CSV ------------------------------------------------------------------------------

def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """S3: catalogue CSV with a header; quoted fields may hold commas and newlines."""
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", True).schema(CATALOG_SCHEMA).csv(path))


def read_transactions(spark: SparkSession, path: str, n_features: int = 28) -> DataFrame:
    """Labelled numeric CSV (Time, V1..Vn, Amount, Class)."""
    return spark.read.option("header", True).schema(transactions_schema(n_features)).csv(path)


# ---- S6/S7: stock feed -----------------------------------------------------------------------

def parse_stock_feed(lines: DataFrame, with_price: bool = True, clamp_zero: bool | None = None) -> DataFrame:
    """S6 (monitor, ``id|stock|name|price``) or S7 (dashboard, ``id|stock|name``).

    S6: lines without ``|`` or with fewer than 3 fields are skipped; the price is taken from the
    last field so a name holding ``|`` stays whole (a stated divergence: the reference splits at
    most 3 times and drops such rows when the price text does not parse). Non-numeric id or price
    drops the row. Stock is clamped at 0 on the monitor path.
    S7: exactly three fields, the name is everything after the second ``|``; stock is not clamped.
    """
    clamp_zero = with_price if clamp_zero is None else clamp_zero
    v = F.col("value")
    has_bar = F.coalesce(v.contains("|"), F.lit(False))
    if with_price:
        parts = F.split(v, "[|]", -1)
        n = F.size(parts)
        name = F.when(n >= 4, F.array_join(F.slice(parts, 3, n - 3), "|")).otherwise(parts[2])
        price_text = F.when(n >= 4, F.trim(F.element_at(parts, -1)))
        price = F.when(price_text.isNull() | (price_text == ""), F.lit(0.0)).otherwise(price_text.try_cast("double"))
        out = lines.filter(has_bar).select(
            parts.alias("_p"), n.alias("_n"),
            F.trim(parts[0]).try_cast("long").alias("product_id"),
            parse_stock(parts[1], clamp_zero).alias("stock"),
            F.trim(name).alias("name"),
            price.alias("price"),
            (price_text.isNull() | (price_text == "") | price_text.try_cast("double").isNotNull()).alias("_price_ok"))
        return (out.filter((F.col("_n") >= 3) & F.col("product_id").isNotNull() & F.col("stock").isNotNull()
                           & F.col("_price_ok"))
                .drop("_p", "_n", "_price_ok"))
    parts = F.split(v, "[|]", 3)
    out = lines.filter(has_bar).select(
        F.size(parts).alias("_n"),
        F.trim(parts[0]).alias("product_id_text"),
        parse_stock(parts[1], clamp_zero).alias("stock"),
        F.trim(parts[2]).alias("name"))
    return out.filter((F.col("_n") == 3) & F.col("stock").isNotNull()).drop("_n")


# ---- S8: review feed -------------------------------------------------------------------------

def parse_review_feed(lines: DataFrame) -> DataFrame:
    """``comment_id|||name|||text|||rating``; exactly four fields, a 64-bit id, ``int(float(rating))``."""
    parts = F.split(F.col("value"), "[|]{3}", 4)
    out = lines.filter(F.coalesce(F.col("value").contains("|||"), F.lit(False))).select(
        F.size(parts).alias("_n"),
        F.trim(parts[0]).try_cast("long").alias("comment_id"),
        F.trim(parts[1]).alias("product_name"),
        F.trim(parts[2]).alias("review_text"),
        F.trim(parts[3]).try_cast("double").try_cast("int").alias("rating"))
    return (out.filter((F.col("_n") == 4) & F.col("comment_id").isNotNull() & F.col("rating").isNotNull())
            .drop("_n"))


# ---- S9/S10: nested API payloads ---------------------------------------------------------------

def explode_review_payload(payloads: DataFrame, key: str, max_reviews: int | None = None,
                           col: str = "payload") -> DataFrame:
    """S9 (+W8): one row per review of a landed payload; the first ``max_reviews`` are taken
    before empty texts are dropped; a falsy rating becomes 0.0."""
    data = F.from_json(F.col(col), REVIEW_PAYLOAD_SCHEMA)["data"]["reviews"]
    reviews = F.slice(data, 1, max_reviews) if max_reviews else data
    exploded = payloads.select(key, F.posexplode_outer(reviews).alias("review_pos", "r"))
    rating_text = F.col("r.review_star_rating")
    rating = F.when(rating_text.isNull() | (rating_text == "") | (rating_text == "0"), F.lit(0.0)).otherwise(
        F.coalesce(rating_text.try_cast("double"), F.lit(0.0)))
    return (exploded.filter(F.col("r.review_comment").isNotNull() & (F.col("r.review_comment") != ""))
            .select(key, "review_pos", F.col("r.review_comment").alias("text"), rating.alias("rating")))


def first_search_hit(payloads: DataFrame, key: str, col: str = "payload") -> DataFrame:
    """The first product id of a search payload, else ''."""
    products = F.from_json(F.col(col), REVIEW_PAYLOAD_SCHEMA)["data"]["products"]
    return payloads.select(key, F.coalesce(F.get(products, 0)["asin"], F.lit("")).alias("asin"))


def load_model(path: str):
    """Load a fitted pipeline (scalers + assembler + forest)."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)

