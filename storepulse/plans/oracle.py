"""DuckDB SQL fragments mirroring ``storepulse.sources.feeds`` (the oracle side of the check).

Written independently of the Spark code: the same FIXTURES derivations in plain SQL. Doubles
are cast explicitly (DuckDB types 0.8 as DECIMAL) and casts to integer use ``trunc`` first
(DuckDB rounds on cast, Spark truncates).
"""

COUNTRY_SQL = ("CASE c_nationkey % 8 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'GB' WHEN 3 THEN 'AU' "
               "WHEN 4 THEN 'DE' WHEN 5 THEN 'FR' WHEN 6 THEN 'IN' ELSE 'BR' END")

ORDER_FEED_CTE = f"""
order_base AS (
  SELECT o.o_orderkey AS order_key,
         'ORD-' || CAST(o.o_orderkey AS VARCHAR) AS order_id,
         'c' || CAST(o.o_custkey AS VARCHAR) || '@example.com' AS customer_email,
         'Customer ' || CAST(o.o_custkey AS VARCHAR) AS customer_name,
         CAST(floor(o.o_totalprice / 250) AS DOUBLE) AS amount,
         CAST(coalesce(l.n_lines, 0) AS INTEGER) AS quantity,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'stripe' WHEN '2-HIGH' THEN 'stripe'
              WHEN '3-MEDIUM' THEN 'paypal' WHEN '4-NOT SPECIFIED' THEN 'cod' WHEN '5-LOW' THEN 'bacs' END
           AS payment_method,
         {COUNTRY_SQL} AS card_country,
         CASE WHEN o.o_orderkey % 11 = 0 THEN 'US' ELSE {COUNTRY_SQL} END AS shipping_country,
         CAST(CASE WHEN o.o_orderkey % 20 = 0 THEN 3 ELSE 0 END AS INTEGER) AS failed_attempts,
         o.o_orderdate + to_seconds(o.o_orderkey % 86400) AS ts
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) l
    ON o.o_orderkey = l.l_orderkey
),
order_feed AS (
  SELECT *,
         row_number() OVER (PARTITION BY customer_email ORDER BY ts, order_key) <= 2 AS is_new_customer,
         CAST(count(*) OVER (PARTITION BY card_country ORDER BY epoch_us(ts)
                             RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS INTEGER) AS orders_last_hour
  FROM order_base
)"""

# Python-style float text of a whole-number amount.
AMT_TEXT = "(CAST(CAST(amount AS BIGINT) AS VARCHAR) || '.0')"

RULE_SCORE_SQL = """(
  (CASE WHEN amount > 1000 AND is_new_customer THEN 40 ELSE 0 END)
+ (CASE WHEN amount > 1500 THEN 30 ELSE 0 END)
+ (CASE WHEN quantity > 3 THEN 30 ELSE 0 END)
+ (CASE WHEN orders_last_hour > 3 THEN 50 ELSE 0 END)
+ (CASE WHEN card_country IS DISTINCT FROM shipping_country THEN 35 ELSE 0 END)
+ (CASE WHEN failed_attempts > 2 THEN 40 ELSE 0 END)
+ (CASE WHEN payment_method = 'stripe' AND amount > 500 AND is_new_customer THEN 35 ELSE 0 END)
+ (CASE WHEN payment_method = 'stripe' AND is_new_customer THEN 20 ELSE 0 END)
+ (CASE WHEN amount % 100 = 0 AND amount > 500 THEN 15 ELSE 0 END)
+ (CASE WHEN amount > 1500 THEN 45 ELSE 0 END)
+ (CASE WHEN quantity >= 3 AND amount > 500 THEN 40 ELSE 0 END))"""

REASONS_SQL = f"""concat_ws('; ',
  CASE WHEN amount > 1000 AND is_new_customer THEN 'High amount $' || {AMT_TEXT} || ' + new customer' END,
  CASE WHEN amount > 1500 THEN 'Very high amount $' || {AMT_TEXT} END,
  CASE WHEN quantity > 3 THEN 'High quantity ' || CAST(quantity AS VARCHAR) END,
  CASE WHEN orders_last_hour > 3 THEN 'Too many orders: ' || CAST(orders_last_hour AS VARCHAR) || '/hour' END,
  CASE WHEN card_country IS DISTINCT FROM shipping_country
       THEN 'Country mismatch: ' || card_country || ' vs ' || shipping_country END,
  CASE WHEN failed_attempts > 2 THEN 'Failed attempts: ' || CAST(failed_attempts AS VARCHAR) END,
  CASE WHEN payment_method = 'stripe' AND amount > 500 AND is_new_customer THEN 'High card payment + new customer' END,
  CASE WHEN payment_method = 'stripe' AND is_new_customer THEN 'Card payment from new customer' END,
  CASE WHEN amount % 100 = 0 AND amount > 500 THEN 'Suspicious round amount $' || {AMT_TEXT} END,
  CASE WHEN amount > 1500 THEN 'Extremely high order value $' || {AMT_TEXT} END,
  CASE WHEN quantity >= 3 AND amount > 500
       THEN 'Bulk purchase ' || CAST(quantity AS VARCHAR) || ' items worth $' || {AMT_TEXT} END)"""

SCORED_CTE = f"""{ORDER_FEED_CTE},
rule_scored AS (
  SELECT *, CAST({RULE_SCORE_SQL} AS INTEGER) AS rule_score, {REASONS_SQL} AS reasons_text
  FROM order_feed
),
scored AS (
  SELECT *, 0 AS ml_score,
         CAST(greatest(rule_score, CAST(trunc(rule_score * 0.8::DOUBLE) AS INTEGER)) AS INTEGER) AS final_score
  FROM rule_scored
),
decided AS (
  SELECT *, CASE WHEN final_score >= 55 OR rule_score >= 55 THEN 'FRAUD_BLOCKED'
                 WHEN final_score >= 31 THEN 'REVIEW_NEEDED' ELSE 'APPROVED' END AS status
  FROM scored
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


def scored_from(source: str, prefix: str) -> str:
    """CTEs ``{prefix}_rule`` and ``{prefix}_decided`` scoring any CTE with the detector's columns."""
    return f"""{prefix}_rule AS (
  SELECT *, CAST({RULE_SCORE_SQL} AS INTEGER) AS rule_score, {REASONS_SQL} AS reasons_text
  FROM {source}
),
{prefix}_decided AS (
  SELECT *, 0 AS ml_score,
         CAST(greatest(rule_score, CAST(trunc(rule_score * 0.8::DOUBLE) AS INTEGER)) AS INTEGER) AS final_score,
         CASE WHEN greatest(rule_score, CAST(trunc(rule_score * 0.8::DOUBLE) AS INTEGER)) >= 55 OR rule_score >= 55
              THEN 'FRAUD_BLOCKED'
              WHEN greatest(rule_score, CAST(trunc(rule_score * 0.8::DOUBLE) AS INTEGER)) >= 31 THEN 'REVIEW_NEEDED'
              ELSE 'APPROVED' END AS status
  FROM {prefix}_rule
)"""


# The order log as the dashboard and the watcher read it: one record per order (duplicates and
# malformed lines dropped), items named by part in sorted order.
LOG_CTE = f"""{ORDER_FEED_CTE},
item_names AS (
  SELECT l_orderkey AS order_key, string_agg(p_name, ', ' ORDER BY p_name) AS products_text
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
),
log_orders AS (
  SELECT b.order_key, 'WOO-' || CAST(b.order_key AS VARCHAR) AS order_id, b.customer_email, b.customer_name,
         b.amount, b.quantity, b.payment_method, b.card_country, b.card_country AS shipping_country,
         0 AS failed_attempts, coalesce(i.products_text, '') AS products_text, b.ts
  FROM order_base b LEFT JOIN item_names i ON b.order_key = i.order_key
),
log_enriched0 AS (
  SELECT *,
         CAST(count(*) OVER (PARTITION BY customer_email ORDER BY epoch_us(ts)
                             RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS INTEGER) AS orders_last_hour,
         row_number() OVER (PARTITION BY customer_email ORDER BY ts, order_id) - 1 AS prior_orders
  FROM log_orders
),
log_enriched AS (SELECT *, prior_orders <= 1 AS is_new_customer FROM log_enriched0),
{scored_from('log_enriched', 'log')}"""

DASH_RULE_SQL = """(
  (CASE WHEN amount > 1000 AND is_new_customer THEN 40 ELSE 0 END)
+ (CASE WHEN amount > 1500 THEN 30 ELSE 0 END)
+ (CASE WHEN quantity > 3 THEN 30 ELSE 0 END)
+ (CASE WHEN payment_method = 'stripe' AND amount > 500 AND is_new_customer THEN 35 ELSE 0 END)
+ (CASE WHEN country IS NULL OR country NOT IN ('US', 'CA', 'GB', 'AU') THEN 25 ELSE 0 END)
+ (CASE WHEN amount % 100 = 0 AND amount > 500 THEN 15 ELSE 0 END)
+ (CASE WHEN payment_method = 'stripe' AND is_new_customer THEN 20 ELSE 0 END)
+ (CASE WHEN amount > 1500 THEN 45 ELSE 0 END)
+ (CASE WHEN quantity >= 3 AND amount > 500 THEN 40 ELSE 0 END))"""

DASH_REASONS_SQL = f"""concat_ws('; ',
  CASE WHEN amount > 1000 AND is_new_customer THEN 'High amount + new customer' END,
  CASE WHEN amount > 1500 THEN 'Very high amount' END,
  CASE WHEN quantity > 3 THEN 'High quantity ' || CAST(quantity AS VARCHAR) || ' items' END,
  CASE WHEN payment_method = 'stripe' AND amount > 500 AND is_new_customer THEN 'High card payment + new customer' END,
  CASE WHEN country IS NULL OR country NOT IN ('US', 'CA', 'GB', 'AU') THEN 'International order' END,
  CASE WHEN amount % 100 = 0 AND amount > 500 THEN 'Suspicious round amount' END,
  CASE WHEN payment_method = 'stripe' AND is_new_customer THEN 'Card payment from new customer' END,
  CASE WHEN amount > 1500 THEN 'Extremely high order value $' || {AMT_TEXT} END,
  CASE WHEN quantity >= 3 AND amount > 500
       THEN 'Bulk purchase ' || CAST(quantity AS VARCHAR) || ' items worth $' || {AMT_TEXT} END)"""

DASH_CTE = f"""{ORDER_FEED_CTE},
history AS (SELECT customer_email, count(*) AS n FROM order_base GROUP BY customer_email),
dash_orders AS (
  SELECT b.order_key, CAST(b.order_key AS VARCHAR) AS order_id, b.customer_email, b.amount, b.payment_method,
         b.card_country AS country, b.quantity, coalesce(h.n, 0) AS stored_orders,
         coalesce(h.n, 0) <= 1 AS is_new_customer
  FROM order_base b LEFT JOIN history h ON b.customer_email = h.customer_email
),
dash_scored AS (
  SELECT *, CAST({DASH_RULE_SQL} AS INTEGER) AS score, {DASH_REASONS_SQL} AS reasons_text FROM dash_orders
),
dash_decided AS (
  SELECT *, CASE WHEN score >= 55 THEN 'FRAUD' WHEN score >= 31 THEN 'REVIEW' ELSE 'APPROVED' END AS status
  FROM dash_scored
)"""
