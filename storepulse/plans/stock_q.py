"""Stock queries: feed parsing, status, counts, upsert, latest snapshot, alert cooldown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.functions.scalars import short, stock_status
from storepulse.operators import dashboard as D
from storepulse.operators import sinks as K
from storepulse.operators import stock as S
from storepulse.operators.windows import latest_by_key
from storepulse.plans.registry import query
from storepulse.sources.feeds import stock_feed_lines, stock_history
from storepulse.sources.files import parse_stock_feed

TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
UPSERT_CUT = "2024-01-16 00:00:00"

STOCK_NOW_SQL = """stock_now AS (
  SELECT CASE WHEN p_partkey % 100 = 3 THEN p_partkey + 5000000000 ELSE p_partkey END AS product_id,
         CAST(p_size - floor(coalesce(l.n, 0) / 2) AS INTEGER) AS stock_raw,
         p_name || ' ' || p_brand AS name, p_retailprice AS price
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) l ON p_partkey = l.l_partkey
  WHERE p_size % 10 <> 7
)"""
# The counts take every product that has a stock; a null stock never reaches the feed.
STOCK_ALL_SQL = STOCK_NOW_SQL.replace("p_size % 10 <> 7", "p_size IS NOT NULL")


def _status_sql(c: str) -> str:
    return f"CASE WHEN {c} = 0 THEN 'OUT_OF_STOCK' WHEN {c} <= 5 THEN 'LOW_STOCK' ELSE 'IN_STOCK' END"


def monitor_stock(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """S6 + P6 (clamped) + P7: the monitor's view of the feed."""
    return S.classify(parse_stock_feed(stock_feed_lines(spark, sf_dir, with_price=True, every=every), with_price=True))


def live_stock(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """S7 + P6 (not clamped) + P7 + P25: the dashboard's live view."""
    s = parse_stock_feed(stock_feed_lines(spark, sf_dir, with_price=False, every=every), with_price=False)
    return S.classify(s).select(F.col("product_id_text").try_cast("long").alias("product_id"),
                                short("name", 60).alias("product"), "stock", "status")


@query("stock_feed_parse", sql=f"""WITH {STOCK_NOW_SQL}
SELECT product_id, greatest(0, stock_raw) AS stock, name, price, {_status_sql('greatest(0, stock_raw)')} AS status
FROM stock_now""")
def stock_feed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + P6 + P7: ``id|stock|name|price`` lines → typed rows with status."""
    return monitor_stock(spark, sf_dir)


@query("stock_live", sql=f"""WITH {STOCK_NOW_SQL}
SELECT product_id, substr(name, 1, 60) AS product, stock_raw AS stock, {_status_sql('stock_raw')} AS status
FROM stock_now""")
def stock_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id|stock|name`` lines, unclamped (a negative stock is LOW on this path)."""
    return live_stock(spark, sf_dir)


@query("stock_counts", sql=f"""WITH {STOCK_ALL_SQL}
SELECT count(*) AS total,
       count(*) FILTER (WHERE greatest(0, stock_raw) > 5) AS in_stock,
       count(*) FILTER (WHERE greatest(0, stock_raw) BETWEEN 1 AND 5) AS low_stock,
       count(*) FILTER (WHERE greatest(0, stock_raw) = 0) AS out_of_stock
FROM stock_now""")
def stock_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total / in / low / out on the monitor path, over every product with a stock."""
    return S.stock_counts(monitor_stock(spark, sf_dir, every=True))


@query("stock_status_distribution", sql=f"""WITH {STOCK_ALL_SQL}
SELECT {_status_sql('stock_raw')} AS status, count(*) AS n FROM stock_now GROUP BY 1""")
def stock_status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products per status on the dashboard path, over every product with a stock."""
    return S.stock_status_distribution(live_stock(spark, sf_dir, every=True))


@query("lowest_stock", sql=f"""WITH {STOCK_NOW_SQL}
SELECT product_id, substr(name, 1, 60) AS product, stock_raw AS stock, {_status_sql('stock_raw')} AS status
FROM stock_now ORDER BY stock_raw, product_id LIMIT 10""")
def lowest_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the 10 products with the lowest stock (a top-k report)."""
    return D.lowest_stock(live_stock(spark, sf_dir), 10, "stock", "product_id")


@query("low_stock_products", sql=f"""WITH {STOCK_NOW_SQL}
SELECT product_id, name, greatest(0, stock_raw) AS stock FROM stock_now
WHERE greatest(0, stock_raw) BETWEEN 1 AND 5""")
def low_stock_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: the products in LOW_STOCK."""
    return S.stock_by_status(monitor_stock(spark, sf_dir), "LOW_STOCK").select("product_id", "name", "stock")


HISTORY_SQL = """history AS (
  SELECT event_id, user_id AS product_id, 'Product ' || CAST(user_id AS VARCHAR) AS product_name,
         CAST(floor(value / 10) AS INTEGER) AS stock_level, ts AS checked_at
  FROM events
)"""


@query("latest_stock", sql=f"""WITH {HISTORY_SQL}
SELECT product_name, stock_level, {_status_sql('stock_level')} AS status,
       strftime(checked_at, '%Y-%m-%d %H:%M:%S.%f') AS checked_at
FROM (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY checked_at DESC) AS rn FROM history)
WHERE rn = 1""")
def latest_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``DISTINCT ON (product_name)`` newest stock row (a max aggregate, skew-safe)."""
    h = stock_history(spark, sf_dir).select("product_name", "stock_level", "checked_at")
    last = latest_by_key(h, "product_name", "checked_at")
    return last.select("product_name", "stock_level", stock_status("stock_level").alias("status"),
                       F.date_format("checked_at", TS_TEXT).alias("checked_at"))


@query("stock_upsert", sql=f"""WITH {HISTORY_SQL},
cur AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY checked_at DESC) AS rn
                 FROM history WHERE checked_at < TIMESTAMP '{UPSERT_CUT}') WHERE rn = 1),
bat AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY checked_at DESC) AS rn
                 FROM history WHERE checked_at >= TIMESTAMP '{UPSERT_CUT}') WHERE rn = 1)
SELECT coalesce(c.product_id, b.product_id) AS product_id,
       coalesce(c.product_name, 'Renamed ' || CAST(b.product_id AS VARCHAR)) AS product_name,
       CASE WHEN b.product_id IS NOT NULL THEN b.stock_level ELSE c.stock_level END AS stock_level,
       {_status_sql('CASE WHEN b.product_id IS NOT NULL THEN b.stock_level ELSE c.stock_level END')} AS status,
       strftime(CASE WHEN b.product_id IS NOT NULL THEN b.checked_at ELSE c.checked_at END,
                '%Y-%m-%d %H:%M:%S.%f') AS checked_at
FROM cur c FULL OUTER JOIN bat b ON c.product_id = b.product_id""")
def stock_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: the stored snapshot before the cut, upserted with every later observation (last wins;
    the stored product name is kept, the batch's new name only lands for new keys)."""
    h = stock_history(spark, sf_dir).withColumn("status", stock_status("stock_level"))
    cut = F.lit(UPSERT_CUT).cast("timestamp")
    current = S.latest_snapshot(h.filter(F.col("checked_at") < cut).drop("event_id"), "product_id", "checked_at")
    batch = (h.filter(F.col("checked_at") >= cut)
             .withColumn("product_name", F.concat(F.lit("Renamed "), F.col("product_id").cast("string")))
             .withColumn("seq", F.col("checked_at")))
    up = K.upsert_stock(current.select("product_id", "product_name", "stock_level", "status", "checked_at"),
                        batch, "product_id", "seq")
    return up.withColumn("checked_at", F.date_format("checked_at", TS_TEXT))


def cooldown_sql(source_cte: str, key: str, id_col: str, seconds: int = 3600) -> str:
    """Recursive walk per key in (time, id) order — the oracle for the cooldown fold."""
    width = seconds * 1_000_000
    return f"""ev AS (
  SELECT {key} AS k, {id_col} AS id, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY {key} ORDER BY ts, {id_col}) AS rn
  FROM {source_cte}),
walk AS (
  SELECT k, rn, id, us, us AS last_sent, true AS sent, CAST(NULL AS BIGINT) AS prev_last FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.k, e.rn, e.id, e.us,
         CASE WHEN e.us - w.last_sent > {width} THEN e.us ELSE w.last_sent END,
         e.us - w.last_sent > {width}, w.last_sent
  FROM walk w JOIN ev e ON e.k = w.k AND e.rn = w.rn + 1),
cooled AS (
  SELECT id, sent,
         CASE WHEN NOT sent THEN CAST(trunc(({width} - (us - prev_last)) / 60000000.0) AS INTEGER) END
           AS minutes_remaining
  FROM walk)"""


@query("alert_cooldown", sql=f"""WITH RECURSIVE src AS (SELECT event_id, user_id, ts FROM events),
{cooldown_sql('src', 'user_id', 'event_id')}
SELECT s.event_id, s.user_id, c.sent, c.minutes_remaining FROM src s JOIN cooled c ON s.event_id = c.id""")
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 + W7b on the event stream keyed by user: which alerts are sent under a one-hour cooldown."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return S.cooldown(ev, "user_id", "ts", "event_id", 3600).select(
        "event_id", "user_id", "sent", "minutes_remaining")


@query("stock_alert_outbox", sql=f"""WITH RECURSIVE {HISTORY_SQL},
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
def stock_alert_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 + K15: low / out-of-stock observations, one-hour cooldown per (level, product), and the
    notices that are actually sent."""
    h = stock_history(spark, sf_dir)
    alerts = S.alert_candidates(h, "stock_level", "product_id")
    cooled = S.cooldown(alerts, "alert_key", "checked_at", "event_id", 3600).filter("sent")
    out = K.stock_outbox(cooled.withColumn("stock", F.col("stock_level")), keep=["event_id"])
    return out.select("event_id", "product_id", "level", "recipient", "subject", "stock_level")
