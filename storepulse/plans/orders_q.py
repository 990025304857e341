"""Order-risk queries: the order feed, fraud rules, scoring and dashboard aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.functions.scalars import dashboard_decision, risk_band
from storepulse.operators import dashboard as D
from storepulse.operators import sinks as K
from storepulse.operators.fraud import score_orders
from storepulse.operators.orders import (customer_segments, dedup_orders, enrich_orders, is_new_asof,
                                         is_new_current, normalize_orders, order_quantity, orders_per_customer)
from storepulse.operators.rules import dashboard_rule_score, rule_flags
from storepulse.operators.windows import trailing_count, velocity_alerts
from storepulse.plans.oracle import (DASH_CTE, LOG_CTE, ORDER_FEED_CTE, SCORED_CTE, with_ctes)
from storepulse.plans.registry import query
from storepulse.session import checkpoint_dir
from storepulse.sources.feeds import order_base, order_feed, order_items, order_log_lines
from storepulse.sources.files import parse_order_log
from storepulse.sources.tables import read_table

TS_TEXT = "yyyy-MM-dd HH:mm:ss"


# ---- shared plans -------------------------------------------------------------------------------

def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_orders(order_feed(spark, sf_dir))


def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + W3: the order log parsed (malformed and blank lines dropped) and deduplicated by id."""
    return dedup_orders(parse_order_log(order_log_lines(spark, sf_dir), keep=["pos"]), "order_id", "pos")


def log_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 over the deduplicated log, with the event time parsed from the record's timestamp."""
    norm = normalize_orders(parsed_log(spark, sf_dir))
    return norm.withColumn("ts", F.try_to_timestamp(F.col("timestamp"), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def log_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + X4 in batch: velocity per email, as-of new customer, rules, final score, status."""
    return score_orders(enrich_orders(log_orders(spark, sf_dir)))


def dashboard_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R14 inputs: the log's raw fields, quantity from items (A13), new customer from J4."""
    raw = parsed_log(spark, sf_dir).select(
        "order_id", F.col("email").alias("customer_email"), F.col("total").alias("amount"), "payment_method",
        "country", order_quantity("items").cast("int").alias("quantity"))
    history = order_base(spark, sf_dir).select("customer_email")
    return is_new_current(raw, history)


def dashboard_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard_rule_score(dashboard_orders(spark, sf_dir)).withColumn("status", dashboard_decision("score"))


# ---- queries ----------------------------------------------------------------------------------

@query("fraud_overview", sql=f"""{with_ctes(SCORED_CTE)}
SELECT status, count(*) AS n_orders, CAST(sum(amount) AS DOUBLE) AS revenue,
       CAST(sum(rule_score) AS BIGINT) AS sum_rule_score
FROM decided GROUP BY status""")
def fraud_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: order feed → velocity + new customer → rules → final score (ml 0) → decision →
    orders and revenue per status."""
    s = scored_orders(spark, sf_dir)
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n_orders"),
                                   F.sum("amount").cast("double").alias("revenue"),
                                   F.sum("rule_score").cast("bigint").alias("sum_rule_score"))


@query("order_scores", sql=f"""{with_ctes(SCORED_CTE)}
SELECT order_id, rule_score, ml_score, final_score, status, reasons_text FROM decided""")
def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R13 + P8 + P9 per order, reasons in evaluation order."""
    s = scored_orders(spark, sf_dir)
    return s.select("order_id", "rule_score", "ml_score", "final_score", "status",
                    F.array_join("reasons", "; ").alias("reasons_text"))


@query("rule_flag_counts", sql=f"""{with_ctes(ORDER_FEED_CTE)}
SELECT code, count(*) FILTER (WHERE fired) AS n_fired, CAST(sum(points) AS BIGINT) AS total_points FROM (
  SELECT 'R1' AS code, amount > 1000 AND is_new_customer AS fired FROM order_feed
  UNION ALL SELECT 'R2', amount > 1500 FROM order_feed
  UNION ALL SELECT 'R3', amount > 1500 FROM order_feed
  UNION ALL SELECT 'R4', quantity > 3 FROM order_feed
  UNION ALL SELECT 'R5', orders_last_hour > 3 FROM order_feed
  UNION ALL SELECT 'R6', card_country IS DISTINCT FROM shipping_country FROM order_feed
  UNION ALL SELECT 'R7', failed_attempts > 2 FROM order_feed
  UNION ALL SELECT 'R8', payment_method = 'stripe' AND amount > 500 AND is_new_customer FROM order_feed
  UNION ALL SELECT 'R9', payment_method = 'stripe' AND is_new_customer FROM order_feed
  UNION ALL SELECT 'R10', amount % 100 = 0 AND amount > 500 FROM order_feed
  UNION ALL SELECT 'R11', quantity >= 3 AND amount > 500 FROM order_feed
  UNION ALL SELECT 'R12', card_country NOT IN ('US', 'CA', 'GB', 'AU') FROM order_feed
) f JOIN (VALUES ('R1', 40), ('R2', 30), ('R3', 45), ('R4', 30), ('R5', 50), ('R6', 35), ('R7', 40),
                 ('R8', 35), ('R9', 20), ('R10', 15), ('R11', 40), ('R12', 25)) p(pcode, pts) ON f.code = p.pcode,
LATERAL (SELECT CASE WHEN fired THEN pts ELSE 0 END AS points)
GROUP BY code""")
def rule_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1–R12 each alone (one pass over the feed): orders fired and points per rule."""
    flags = rule_flags(order_feed(spark, sf_dir))
    return flags.groupBy("code").agg(F.count_if("fired").alias("n_fired"),
                                     F.sum("points").cast("bigint").alias("total_points"))


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id"]).withColumn(
        "ts", F.col("ts").cast("timestamp"))


@query("velocity_counts", sql="""
SELECT velocity, count(*) AS n_events FROM (
  SELECT CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
                             RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS INTEGER) AS velocity
  FROM events) GROUP BY velocity""")
def velocity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 on the event stream keyed by user: distribution of the trailing-hour count."""
    v = trailing_count(_events(spark, sf_dir), "user_id", "ts", 3600, out="velocity")
    return v.groupBy("velocity").agg(F.count(F.lit(1)).alias("n_events"))


@query("velocity_alerts_6h", sql="""
SELECT event_id, user_id, velocity FROM (
  SELECT event_id, user_id,
         CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
                             RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS INTEGER) AS velocity
  FROM events) WHERE velocity > 3""")
def velocity_alerts_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + W1b with a 6-hour window: events whose trailing count exceeds 3."""
    v = trailing_count(_events(spark, sf_dir), "user_id", "ts", 6 * 3600, out="velocity")
    return velocity_alerts(v, "velocity", 3).select("event_id", "user_id", "velocity")


@query("prior_orders", sql=f"""{with_ctes(ORDER_FEED_CTE)}
SELECT order_id, prior_orders, prior_orders <= 1 AS is_new_customer FROM (
  SELECT order_id, row_number() OVER (PARTITION BY customer_email ORDER BY ts, order_key) - 1 AS prior_orders
  FROM order_base)""")
def prior_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 + J3: earlier orders of the email at arrival; new ⇔ at most one."""
    out = is_new_asof(order_base(spark, sf_dir), "customer_email", "ts", "order_key")
    return out.select("order_id", "prior_orders", "is_new_customer")


@query("orders_per_customer", sql=f"""{with_ctes(ORDER_FEED_CTE)}
SELECT customer_email, count(*) AS n_orders FROM order_base GROUP BY customer_email""")
def orders_per_customer_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: stored orders per email."""
    return orders_per_customer(order_base(spark, sf_dir))


@query("customer_segments", sql=f"""{with_ctes(ORDER_FEED_CTE)}
SELECT customer_email, n_orders,
       CASE WHEN n_orders <= 1 THEN 'New' WHEN n_orders = 2 THEN 'Returning' WHEN n_orders < 10 THEN 'Regular'
            ELSE 'VIP' END AS segment
FROM (SELECT customer_email, count(*) AS n_orders FROM order_base GROUP BY customer_email)""")
def customer_segments_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advertised customer segments by stored order count."""
    return customer_segments(order_base(spark, sf_dir))


@query("order_log_dedup", sql=f"""{with_ctes(ORDER_FEED_CTE)}
SELECT CAST(order_key AS VARCHAR) AS order_id, order_key * 4 AS pos, quantity AS n_items FROM order_base""")
def order_log_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + W3: parse the JSON-lines log (blank / malformed lines dropped), first row per order id."""
    return parsed_log(spark, sf_dir).select("order_id", "pos", F.size("items").alias("n_items"))


@query("normalized_orders", sql=f"""{with_ctes(LOG_CTE)}
SELECT order_id, customer_email, customer_name, amount, quantity, payment_method, card_country,
       shipping_country, failed_attempts, products_text FROM log_orders""")
def normalized_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + A13: raw log record → enriched order fields."""
    o = log_orders(spark, sf_dir)
    return o.select("order_id", "customer_email", "customer_name", "amount", "quantity", "payment_method",
                    "card_country", "shipping_country", "failed_attempts",
                    F.array_join("products", ", ").alias("products_text"))


@query("enriched_orders", sql=f"""{with_ctes(LOG_CTE)}
SELECT order_id, orders_last_hour, prior_orders, is_new_customer FROM log_enriched""")
def enriched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 batch: velocity per email (W1) and new customer at arrival (J3) on the order log."""
    e = enrich_orders(log_orders(spark, sf_dir))
    return e.select("order_id", "orders_last_hour", "prior_orders", "is_new_customer")


@query("dashboard_scores", sql=f"""{with_ctes(DASH_CTE)}
SELECT order_id, score, status, reasons_text FROM dash_decided""")
def dashboard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R14 + R12 + P10 + J4: the dashboard's re-score of every logged order."""
    s = dashboard_scored(spark, sf_dir)
    return s.select("order_id", "score", "status", F.array_join("reasons", "; ").alias("reasons_text"))


@query("new_customer_current", sql=f"""{with_ctes(DASH_CTE)}
SELECT order_id, stored_orders, is_new_customer FROM dash_orders""")
def new_customer_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored orders of the email now (one aggregate + left join, not a lookup per order)."""
    return dashboard_orders(spark, sf_dir).select("order_id", "stored_orders", "is_new_customer")


@query("overview_metrics", sql=f"""{with_ctes(DASH_CTE)}
SELECT CAST(sum(amount) AS DOUBLE) AS revenue, count(*) AS orders,
       count(*) FILTER (WHERE status LIKE '%APPROVED%') AS approved,
       count(*) FILTER (WHERE status LIKE '%REVIEW%') AS review,
       count(*) FILTER (WHERE status LIKE '%FRAUD%') AS blocked
FROM dash_decided""")
def overview_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: revenue, orders and the three dashboard outcomes."""
    return D.overview_metrics(dashboard_scored(spark, sf_dir))


@query("revenue_by_payment", sql=f"""{with_ctes(ORDER_FEED_CTE)}
SELECT coalesce(payment_method, 'unknown') AS payment_method, CAST(sum(amount) AS DOUBLE) AS revenue
FROM order_base GROUP BY 1""")
def revenue_by_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per payment method over the deduplicated log."""
    log = parsed_log(spark, sf_dir).select("payment_method", F.col("total").alias("amount"))
    return D.revenue_by_payment(log)


def _fraud_scores_table(spark, sf_dir):
    s = scored_orders(spark, sf_dir)
    return s.select("order_id", "customer_email", "amount", "rule_score", "ml_score", "final_score", "status",
                    F.col("ts").alias("created_at"))


LATEST20_SQL = f"""{with_ctes(SCORED_CTE)},
latest AS (SELECT * FROM decided ORDER BY ts DESC, order_id DESC LIMIT 20)"""


@query("latest_fraud_scores", sql=f"""{LATEST20_SQL}
SELECT order_id, customer_email, amount, rule_score, ml_score, final_score, status,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM latest""")
def latest_fraud_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest 20 fraud scores (a top-k report)."""
    latest = D.latest_fraud_scores(_fraud_scores_table(spark, sf_dir), 20)
    return latest.withColumn("created_at", F.date_format("created_at", TS_TEXT))


@query("fraud_status_counts", sql=f"""{LATEST20_SQL}
SELECT status, count(*) AS n FROM latest GROUP BY status""")
def fraud_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status breakdown of the latest 20 fraud scores."""
    return D.fraud_status_counts(D.latest_fraud_scores(_fraud_scores_table(spark, sf_dir), 20))


@query("score_histogram", sql=f"""{with_ctes(SCORED_CTE)}
SELECT status, bin, count(*) AS n, CAST(bin * 20 AS DOUBLE) AS bin_lo, CAST((bin + 1) * 20 AS DOUBLE) AS bin_hi
FROM (SELECT status, CAST(least(19, greatest(0, floor(final_score / 20.0::DOUBLE))) AS INTEGER) AS bin FROM decided)
GROUP BY status, bin""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final-score histogram by status, 20 equal bins over [0, 400)."""
    return D.score_histogram(_fraud_scores_table(spark, sf_dir))


@query("recent_orders_table", sql=f"""{with_ctes(DASH_CTE)},
items AS (
  SELECT l_orderkey AS order_key, substr(string_agg(substr(p_name, 1, 25), ', ' ORDER BY l_linenumber, p_name), 1, 40) AS items_text
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT 'WOO-' || d.order_id AS "order", d.customer_email AS email,
       '$' || format('{{:,.2f}}', d.amount) AS amount_text, d.payment_method AS payment,
       coalesce(i.items_text, '') AS items_text, CAST(d.score AS VARCHAR) || '/100' AS score_text, d.status
FROM dash_decided d LEFT JOIN items i ON d.order_key = i.order_key""")
def recent_orders_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's order table (items cut to 25 each, joined, cut to 40)."""
    scored = dashboard_scored(spark, sf_dir).withColumn("order_key", F.col("order_id"))
    names = D.first_items(order_items(spark, sf_dir).withColumn("order_key", F.col("order_key").cast("string")),
                          "order_key", "name", "line", 21)
    return D.recent_orders_table(scored, names, key="order_key")


@query("latest_order", sql=f"""{with_ctes(SCORED_CTE)}
SELECT order_id, amount, rule_score,
       CASE WHEN rule_score >= 55 THEN 'fraud' WHEN rule_score >= 31 THEN 'review' ELSE 'low' END AS risk_band,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text
FROM decided ORDER BY ts DESC, order_key DESC LIMIT 1""")
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 + P19: the most recent order and the gauge band of its score."""
    s = scored_orders(spark, sf_dir).select("order_id", "order_key", "amount", "rule_score", "ts")
    last = D.latest_order(s, "ts", "order_key")
    return last.select("order_id", "amount", "rule_score", risk_band("rule_score").alias("risk_band"),
                       F.date_format("ts", TS_TEXT).alias("ts_text"))


@query("orders_sink", sql=f"""{with_ctes(LOG_CTE)}
SELECT order_id, customer_email, customer_name, amount, quantity, payment_method, is_new_customer,
       card_country, shipping_country, substr(products_text, 1, 500) AS products,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') AS order_timestamp
FROM log_enriched""")
def orders_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: rows for the ``orders`` table from the enriched log."""
    return K.orders_sink_rows(enrich_orders(log_orders(spark, sf_dir)).drop("ts"))


@query("fraud_sink", sql=f"""{with_ctes(SCORED_CTE)}
SELECT order_id, customer_email, amount, rule_score, ml_score, final_score, status,
       substr(replace(reasons_text, '; ', ', '), 1, 1000) AS reasons FROM decided""")
def fraud_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: rows for the ``fraud_scores`` table (reasons joined with ', ', cut to 1000)."""
    return K.fraud_sink_rows(scored_orders(spark, sf_dir))


@query("order_actions", sql=f"""{with_ctes(LOG_CTE)},
store AS (SELECT order_key, ts FROM order_base WHERE order_key % 37 <> 0),
latest AS (SELECT order_key AS latest_key FROM store ORDER BY ts DESC, order_key DESC LIMIT 1)
SELECT d.order_id, coalesce(b.order_key, l.latest_key) AS target_order, b.order_key IS NULL AS fallback,
       'on-hold' AS new_status,
       CASE WHEN d.status = 'FRAUD_BLOCKED' THEN 'FRAUD DETECTED' ELSE 'REVIEW NEEDED' END
         || ' - Score: ' || CAST(d.final_score AS VARCHAR) || '/100. Pending admin review.' AS note
FROM log_decided d LEFT JOIN store b ON CAST(replace(d.order_id, 'WOO-', '') AS BIGINT) = b.order_key
CROSS JOIN latest l
WHERE d.status <> 'APPROVED'""")
def order_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K13 + J10: hold actions for flagged orders; ids that the store doesn't know (it lacks some orders of the log)
    fall back to the latest store order."""
    return K.order_actions(log_scored(spark, sf_dir), order_base(spark, sf_dir).filter(F.col("order_key") % 37 != 0))


@query("notification_outbox", sql=f"""{with_ctes(LOG_CTE)}
SELECT order_id, status, template, recipient, subject, substr(products_text, 1, 100) AS products_text FROM (
  SELECT order_id, status, products_text, 'fraud_alert' AS template, 'admin' AS recipient,
         '🚨 FRAUD ALERT — ' || order_id || ' — Score: ' || CAST(final_score AS VARCHAR) || '/100' AS subject
  FROM log_decided WHERE status IN ('FRAUD_BLOCKED', 'REVIEW_NEEDED')
  UNION ALL
  SELECT order_id, status, products_text, 'under_review', customer_email, '⏳ Order Under Review — ' || order_id
  FROM log_decided WHERE status IN ('FRAUD_BLOCKED', 'REVIEW_NEEDED')
  UNION ALL
  SELECT order_id, status, products_text, 'order_confirmation', customer_email, '✅ Order Confirmed — ' || order_id
  FROM log_decided WHERE status NOT IN ('FRAUD_BLOCKED', 'REVIEW_NEEDED')
  UNION ALL
  SELECT order_id, status, products_text, 'admin_new_order', 'admin',
         '🛍️ New Order Received — ' || order_id || ' — $' || format('{{:,.2f}}', amount)
  FROM log_decided WHERE status NOT IN ('FRAUD_BLOCKED', 'REVIEW_NEEDED')
) WHERE recipient <> ''""")
def notification_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notification rows each decision sends (alert / under review / confirmation / notice)."""
    return K.notification_outbox(log_scored(spark, sf_dir))


@query("cancellation_outbox", sql=f"""{with_ctes(LOG_CTE)}
SELECT order_id, template, recipient, subject, 'Suspicious activity detected' AS reason FROM (
  SELECT order_id, 'customer_cancelled' AS template, customer_email AS recipient,
         '❌ Order Cancelled — ' || order_id AS subject FROM log_decided WHERE status = 'FRAUD_BLOCKED'
  UNION ALL
  SELECT order_id, 'admin_cancelled', 'admin', '👨‍💼 Admin Cancelled Order — ' || order_id
  FROM log_decided WHERE status = 'FRAUD_BLOCKED') WHERE recipient <> ''""")
def cancellation_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancellation notices for blocked orders (customer if email set, and admin)."""
    return K.cancellation_outbox(log_scored(spark, sf_dir).filter(F.col("status") == "FRAUD_BLOCKED"))


ALERT_VALUE = ("order_id string, customer_email string, amount double, rule_score int, ml_score int, final_score int, "
               "status string, reasons array<string>, timestamp string")


@query("alert_topic", sql=f"""{with_ctes(LOG_CTE)}
SELECT order_id AS key, order_id, customer_email, amount, rule_score, ml_score, final_score, status, reasons_text,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp" FROM log_decided""")
def alert_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the ``fraud-alerts`` topic rows (key and JSON value) for every scored order, read back as a consumer does."""
    s = log_scored(spark, sf_dir).select(
        "order_id", "customer_email", "amount", "rule_score", "ml_score", "final_score", "status", "reasons",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    value = F.from_json("value", ALERT_VALUE)
    return K.to_topic(s, key="order_id").select("key", value.alias("v")).select("key", "v.*").withColumn(
        "reasons", F.array_join("reasons", "; ")).withColumnRenamed("reasons", "reasons_text")


@query("event_type_changes", sql="""
SELECT event_id, user_id, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
WHERE event_type IS NOT NULL AND (rn = 1 OR prev IS DISTINCT FROM event_type)""")
def event_type_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, the events whose type differs from the user's previous event."""
    from storepulse.operators.windows import changed_rows
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"]).withColumn(
        "ts", F.col("ts").cast("timestamp"))
    return changed_rows(ev, "event_type", "ts", "event_id", "user_id").select("event_id", "user_id", "event_type")


@query("duplicate_order_ids", sql=f"""{with_ctes(ORDER_FEED_CTE)}
SELECT CAST(order_key AS VARCHAR) AS order_id, CAST(2 AS BIGINT) AS n FROM order_base WHERE order_key % 50 = 0""")
def duplicate_order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order ids that occur more than once in the raw log (the uniqueness guard)."""
    return K.assert_unique(parse_order_log(order_log_lines(spark, sf_dir)), "order_id")


@query("stored_orders", sql=f"""{with_ctes(LOG_CTE)}
SELECT order_id, customer_email, customer_name, amount, quantity, payment_method, is_new_customer, card_country, shipping_country,
       substr(products_text, 1, 500) AS products, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ordered_at, CAST(NULL AS VARCHAR) AS created
FROM log_enriched""")
def stored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9 + K10 + K2 + S5: the tables are created where absent, the rows get the columns they lack, are inserted
    into ``orders`` and read back from the catalogue."""
    name = f"store_{uuid.uuid4().hex[:12]}"
    for _ in range(2):  # the second call finds everything in place
        K.ensure_tables(spark, f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}", database=name)
    schema = K.TABLE_SCHEMAS["orders"]
    rows = K.with_missing_columns(K.orders_sink_rows(enrich_orders(log_orders(spark, sf_dir))), schema)
    rows.select(*schema.names).write.insertInto(f"{name}.orders")
    stored = spark.table(f"{name}.orders")
    return stored.select(*schema.names[:-2], F.date_format("order_timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("ordered_at"), F.col("created_at").cast("string").alias("created"))
