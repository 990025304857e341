"""Streaming queries: each lands its input (derived from the tables) chunk by chunk in event-time order in the
shared checkpoint folder, lets the stream catch up after every chunk (each time a restart from its checkpoint and
its tables in storage), and returns the sink. Their oracles are the batch SQL of the same operators (stream = batch)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.functions.scalars import stock_status
from storepulse.operators import reviews as R
from storepulse.operators import sinks as K
from storepulse.operators import stock as S
from storepulse.operators.versioned import VersionedTable
from storepulse.plans.oracle import LOG_CTE, with_ctes
from storepulse.plans.registry import query
from storepulse.plans.reviews_q import REVIEW_FEED_SQL, SAVED_SQL, sentiment_sql
from storepulse.plans.stock_q import HISTORY_SQL, cooldown_sql
from storepulse.session import cut_lineage
from storepulse.sources.feeds import lexicon, order_log_lines, review_feed_lines, saved_reviews, stock_history
from storepulse.sources.files import parse_review_feed
from storepulse.streaming import streams as X

CHUNKS = 4
TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
RULE_INPUT = ["order_id", "customer_email", "ts", "amount", "quantity", "payment_method", "card_country", "shipping_country", "failed_attempts"]


def _run_enriched(spark: SparkSession, sf_dir: str, name: str, write, after: Callable[[], object] | None = None,
                  columns: list[str] | None = None) -> None:
    """Order-log file stream → dedup (X5) → enrichment from the state store (X1–X3) → ``write(batch, batch_id)``.
    ``columns`` of an order (default: all) go on after the dedup; Spark cannot prune them through the Python state."""
    lines = order_log_lines(spark, sf_dir).select("value")
    ts = F.try_to_timestamp(F.get_json_object("value", "$.timestamp"), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    path, checkpoint = X.scratch(spark, f"{name}-log"), X.scratch(spark, f"{name}-ckpt")

    def run() -> None:
        orders = X.order_stream(spark, path)
        X.run_stream(X.enriched_stream(orders.select(*(columns or orders.columns))), spark, name, write, checkpoint=checkpoint)
        if after:
            after()

    X.replay(X.time_chunks(lines, ts, CHUNKS), path, run)


def _batch_sink(path: str, shape):
    def write(df: DataFrame, batch_id: int) -> None:
        shape(df).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


@query("stream_enriched_orders", sql=f"""{with_ctes(LOG_CTE)}
SELECT order_id, orders_last_hour, prior_orders, is_new_customer FROM log_enriched""")
def stream_enriched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + X2 + X3 + X5 + X8: file stream → dedup → per-email velocity and customer history
    from the state store, over restarts → idempotent sink; equal to the batch enrichment."""
    sink = X.scratch(spark, "enriched-out")
    _run_enriched(spark, sf_dir, "enriched", _batch_sink(
        sink, lambda d: d.select("order_id", "orders_last_hour", "prior_orders", "is_new_customer")))
    return X.read_sink(spark, sink)


@query("stream_fraud_scores", sql=f"""{with_ctes(LOG_CTE)}
SELECT order_id, rule_score, final_score, status FROM log_decided""")
def stream_fraud_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and decision on the enriched stream; per micro-batch the ``fraud_scores`` rows
    (K3), the ``fraud-alerts`` topic values (K1) and the notification outbox (K14), each written
    idempotently under the batch id."""
    sink = X.scratch(spark, "fraud-out")
    topic = X.scratch(spark, "fraud-alerts")
    outbox = X.scratch(spark, "fraud-outbox")

    def write(enriched: DataFrame, batch_id: int) -> None:
        scored = X.fraud_stream(enriched).persist()
        try:
            K.fraud_sink_rows(scored).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
            alerts = scored.select("order_id", "customer_email", "amount", "rule_score", "ml_score",
                                   "final_score", "status", "reasons",
                                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
            K.to_topic(alerts, key="order_id").write.mode("overwrite").parquet(f"{topic}/batch={batch_id}")
            K.notification_outbox(scored).write.mode("overwrite").parquet(f"{outbox}/batch={batch_id}")
        finally:
            scored.unpersist()

    _run_enriched(spark, sf_dir, "fraud", write)
    return X.read_sink(spark, sink).select("order_id", "rule_score", "final_score", "status")


@query("stream_overview", sql=f"""{with_ctes(LOG_CTE)}
SELECT status, count(*) AS n_orders, CAST(sum(amount) AS DOUBLE) AS revenue FROM log_decided GROUP BY status""")
def stream_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored stream writes its sink, and a second stream keeps the counts per status over it."""
    sink, table, checkpoint = (X.scratch(spark, f"overview-{n}") for n in ("scored", "table", "ckpt"))
    shape = lambda d: X.fraud_stream(d).select("order_id", "status", "amount")
    _run_enriched(spark, sf_dir, "scored", _batch_sink(sink, shape),
                  lambda: X.run_overview(spark, sink, spark.read.parquet(f"{sink}/batch=*").schema, table, checkpoint), RULE_INPUT)
    return VersionedTable(spark, table, "status", "status string, n_orders long, revenue double", 4).read()


def _run_history(spark: SparkSession, sf_dir: str, name: str, shape, process) -> None:
    """Stock observations, landed chunk by chunk → ``shape(stream)`` → ``process(batch, batch_id)``."""
    history = stock_history(spark, sf_dir)
    path, checkpoint = X.scratch(spark, f"{name}-in"), X.scratch(spark, f"{name}-ckpt")
    stream = lambda: shape(spark.readStream.schema(history.schema).parquet(path))
    X.replay(X.time_chunks(history, "checked_at", CHUNKS), path, lambda: X.run_stream(stream(), spark, name, process, checkpoint=checkpoint), "parquet")


@query("stream_stock_alerts", sql=f"""WITH RECURSIVE {HISTORY_SQL},
src AS (
  SELECT event_id, product_id, product_name, stock_level, checked_at AS ts,
         CASE WHEN stock_level = 0 THEN 'out' ELSE 'low' END AS level,
         CASE WHEN stock_level = 0 THEN 'out' ELSE 'low' END || '_' || CAST(product_id AS VARCHAR) AS alert_key
  FROM history WHERE stock_level <= 5),
{cooldown_sql('src', 'alert_key', 'event_id')}
SELECT s.event_id, s.product_id, s.level, 'admin' AS recipient,
       CASE WHEN s.level = 'low' THEN '⚠️ Low Stock Alert — ' ELSE '🚫 OUT OF STOCK — ' END || substr(s.product_name, 1, 40)
         AS subject,
       s.stock_level
FROM src s JOIN cooled c ON s.event_id = c.id WHERE c.sent""")
def stream_stock_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6 (alerts): stock observations stream → low / out alerts → cooldown with the last send per key kept in
    storage → notices that are sent."""
    sink = X.scratch(spark, "stock-alerts-out")
    shape = lambda d: K.stock_outbox(d.where("sent").withColumn("stock", F.col("stock_level")), keep=["event_id"])
    process = X.cooldown_stream(spark, X.scratch(spark, "stock-alerts-state"), _batch_sink(sink, shape))
    _run_history(spark, sf_dir, "stock-alerts", lambda h: S.alert_candidates(h, "stock_level", "product_id"), process)
    return X.read_sink(spark, sink).select("event_id", "product_id", "level", "recipient", "subject", "stock_level")


@query("stream_stock_upsert", sql=f"""WITH {HISTORY_SQL}
SELECT product_id, product_name, stock_level,
       CASE WHEN stock_level = 0 THEN 'OUT_OF_STOCK' WHEN stock_level <= 5 THEN 'LOW_STOCK' ELSE 'IN_STOCK' END AS status,
       strftime(checked_at, '%Y-%m-%d %H:%M:%S.%f') AS checked_at
FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY checked_at DESC) AS rn FROM history) WHERE rn = 1""")
def stream_stock_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6 (table): each micro-batch upserts the ``stock_levels`` table (K7), rewriting the buckets of its products."""
    schema = "product_id long, product_name string, stock_level int, status string, checked_at timestamp"
    table = VersionedTable(spark, X.scratch(spark, "stock-levels"), "product_id", schema)
    shape = lambda h: h.withColumn("status", stock_status("stock_level"))
    _run_history(spark, sf_dir, "stock-upsert", shape, X.upsert_stream(table, lambda known, batch: K.upsert_stock(known, batch, "product_id", "checked_at")))
    return table.read().withColumn("checked_at", F.date_format("checked_at", TS_TEXT))


@query("stream_reviews", sql=f"""WITH {REVIEW_FEED_SQL}, {SAVED_SQL},
fresh AS (SELECT * FROM review_feed WHERE comment_id NOT IN (SELECT comment_id FROM saved)),
{sentiment_sql('fresh')}
SELECT substr(product_name, 1, 500) AS product_name, substr(review_text, 1, 5000) AS review_text,
       CAST(rating AS DOUBLE) AS rating, textblob_score, textblob_sentiment, vader_score, vader_sentiment,
       final_sentiment, comment_id AS wp_comment_id
FROM scored""")
def stream_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review feed files → per micro-batch: parse, drop saved ids (the stored table and earlier batches, found in
    storage by the buckets of the batch's ids), score, label, append ``product_reviews`` rows."""
    lines = review_feed_lines(spark, sf_dir)
    path, checkpoint, sink = (X.scratch(spark, f"reviews-{n}") for n in ("in", "ckpt", "out"))
    lex = lexicon(spark)
    saved = VersionedTable(spark, X.scratch(spark, "reviews-saved"), "comment_id", "comment_id long")
    saved.change(0, saved_reviews(spark, sf_dir).select("comment_id"), lambda known, new: new)

    def process(batch: DataFrame, batch_id: int) -> None:
        def merge(known: DataFrame, feed: DataFrame) -> DataFrame:
            fresh = K.review_sink_rows(R.process_reviews(feed, known.withColumnRenamed("comment_id", "wp_comment_id"), lex))
            fresh.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
            return known.unionByName(feed.select(F.col("comment_id").cast("long"))).distinct()

        saved.change(batch_id + 1, cut_lineage(parse_review_feed(batch.select("value"))), merge)

    ids = F.timestamp_seconds(F.split("value", "[|]{3}", 2)[0].try_cast("long"))  # the feed comes in the order of its ids
    X.replay(X.time_chunks(lines.select("value"), ids, CHUNKS), path,
             lambda: X.run_stream(spark.readStream.text(path), spark, "reviews", process, checkpoint=checkpoint))
    return X.read_sink(spark, sink)
