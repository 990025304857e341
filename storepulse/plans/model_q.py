"""Model queries: training data profile, preparation, metrics, forest training and live scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.operators import model as ML
from storepulse.operators.fraud import score_orders
from storepulse.plans.oracle import ORDER_FEED_CTE, RULE_SCORE_SQL, with_ctes
from storepulse.plans.registry import query
from storepulse.session import cut_lineage
from storepulse.sources.feeds import order_feed, transactions

UNDERSAMPLE_RATIO = 10  # normal rows kept per fraud row, as in the original training job
SEED = 42

TX_SQL = ("tx AS (SELECT vec_id AS id, CAST(vec_id * 10 AS DOUBLE) AS \"Time\", "
          + ", ".join(f'CAST(embedding[{i}] AS DOUBLE) AS "V{i}"' for i in range(1, 29))
          + ", CAST((vec_id * 37) % 1000 AS DOUBLE) AS \"Amount\", "
            "CASE WHEN label = 0 THEN 1 ELSE 0 END AS \"Class\" FROM embeddings)")
UNDER_SQL = f"""{TX_SQL},
fraud AS (SELECT * FROM tx WHERE "Class" = 1),
normal AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || '-{SEED}'), id) AS rk
           FROM tx WHERE "Class" = 0),
under AS (SELECT * FROM fraud UNION ALL
          SELECT * EXCLUDE (rk) FROM normal WHERE rk <= {UNDERSAMPLE_RATIO} * (SELECT count(*) FROM fraud)),
split AS (
  SELECT *, rk <= ceil(n * 0.2) AS is_test FROM (
    SELECT *, row_number() OVER (PARTITION BY "Class" ORDER BY md5(CAST(id AS VARCHAR) || '-{SEED}'), id) AS rk,
           count(*) OVER (PARTITION BY "Class") AS n FROM under))"""

# A deterministic score for the metric operators' oracle check (the forest is checked rows-only).
SCORE_SQL = f"""{TX_SQL},
pred AS (SELECT id, "Class", round("V1" + "V2", 6) AS p_fraud,
                CAST(round("V1" + "V2", 6) > 0 AS INTEGER) AS prediction FROM tx),
cm AS (SELECT count(*) FILTER (WHERE "Class" = 0 AND prediction = 0) AS tn,
              count(*) FILTER (WHERE "Class" = 0 AND prediction = 1) AS fp,
              count(*) FILTER (WHERE "Class" = 1 AND prediction = 0) AS fn,
              count(*) FILTER (WHERE "Class" = 1 AND prediction = 1) AS tp FROM pred)"""


def _tx(spark, sf_dir):
    return transactions(spark, sf_dir)


def _pred(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    score = F.round(F.col("V1") + F.col("V2"), 6)
    return tx.select("id", "Class", score.alias("p_fraud"), (score > 0).cast("int").alias("prediction"))


@query("label_profile", sql=f"""WITH {TX_SQL}
SELECT count(*) AS rows, CAST(sum("Class") AS BIGINT) AS fraud, count(*) FILTER (WHERE "Class" = 0) AS normal,
       avg("Class") * 100 AS fraud_rate_pct FROM tx""")
def label_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, fraud, normal and fraud rate of the labelled transactions."""
    return ML.label_profile(_tx(spark, sf_dir))


@query("standardized_features", sql=f"""WITH {TX_SQL},
st AS (SELECT avg("Time") AS tm, stddev_pop("Time") AS ts, avg("Amount") AS am, stddev_pop("Amount") AS as_ FROM tx)
SELECT id, round(("Time" - tm) / ts, 9) AS time_scaled, round(("Amount" - am) / as_, 9) AS amount_scaled
FROM tx, st""")
def standardized_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: Time and Amount scaled by mean and population standard deviation of all rows."""
    tx = _tx(spark, sf_dir)
    z = ML.standardize(tx, ML.scaler_stats(tx))
    return z.select("id", F.round("Time", 9).alias("time_scaled"), F.round("Amount", 9).alias("amount_scaled"))


@query("undersample", sql=f"""WITH {UNDER_SQL} SELECT id, "Class" FROM under""")
def undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + U1: all fraud rows and exactly ratio × as many normal rows, by hash order."""
    return ML.undersample(_tx(spark, sf_dir), ratio=UNDERSAMPLE_RATIO, seed=SEED).select("id", "Class")


@query("stratified_split", sql=f"""WITH {UNDER_SQL} SELECT id, "Class", is_test FROM split""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80/20 split within each class by hash order."""
    under = ML.undersample(_tx(spark, sf_dir), ratio=UNDERSAMPLE_RATIO, seed=SEED)
    return ML.stratified_split(under, seed=SEED).select("id", "Class", "is_test")


@query("class_weights", sql=f"""WITH {UNDER_SQL},
train AS (SELECT * FROM split WHERE NOT is_test),
sizes AS (SELECT "Class" AS c, count(*) AS cn FROM train GROUP BY 1)
SELECT id, "Class", (SELECT count(*) FROM train) / (2.0 * cn) AS weight FROM train JOIN sizes ON "Class" = c""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced class weights n / (2 · n_class) on the training part."""
    under = ML.undersample(_tx(spark, sf_dir), ratio=UNDERSAMPLE_RATIO, seed=SEED)
    train = ML.stratified_split(under, seed=SEED).filter(~F.col("is_test"))
    return ML.class_weights(train).select("id", "Class", "weight")


@query("confusion_matrix", sql=f"""WITH {SCORE_SQL} SELECT * FROM cm""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tn / fp / fn / tp of a scorer's predictions."""
    return ML.confusion_matrix(_pred(spark, sf_dir))


@query("accuracy", sql=f"""WITH {SCORE_SQL} SELECT (tn + tp) / (tn + fp + fn + tp) * 100.0 AS accuracy_pct FROM cm""")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy in percent."""
    return ML.accuracy(ML.confusion_matrix(_pred(spark, sf_dir)))


@query("classification_report", sql=f"""WITH {SCORE_SQL},
c AS (SELECT CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tp AS DOUBLE) AS tp
      FROM cm),
s AS (SELECT *,
        CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0,
        CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1
      FROM c),
f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0,
                CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1,
                tn + fp AS s0, tp + fn AS s1 FROM s)
SELECT 'Normal' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
UNION ALL SELECT 'Fraud', p1, r1, f1, s1 FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
                 (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM f""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class precision / recall / F1 / support with macro and weighted averages."""
    return ML.classification_report(ML.confusion_matrix(_pred(spark, sf_dir)))


@query("roc_auc", sql=f"""WITH {SCORE_SQL},
per AS (SELECT p_fraud AS s, CAST(sum("Class") AS DOUBLE) AS p, CAST(sum(1 - "Class") AS DOUBLE) AS n FROM pred GROUP BY 1),
below AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM per)
SELECT sum(p * (nb + n / 2)) / (sum(p) * sum(n)) AS auc FROM below""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact ROC AUC by mid-ranks."""
    return ML.roc_auc(_pred(spark, sf_dir))


def fit_fraud_model(spark: SparkSession, sf_dir: str, ratio: int = 10):
    """M1–M3: scale on all rows, undersample 1:ratio, stratified split, balanced weights, forest."""
    tx = _tx(spark, sf_dir)
    stats = ML.scaler_stats(tx)
    prepared = ML.standardize(ML.undersample(tx, ratio=ratio, seed=SEED), stats)
    split = ML.stratified_split(prepared, seed=SEED)
    train = ML.class_weights(split.filter(~F.col("is_test")))
    model = ML.train_fraud_model(train)
    return model, stats, split.filter(F.col("is_test"))


@query("fraud_model_eval")
def fraud_model_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 + M4 + A18–A21: train the forest and evaluate it on the held-out part."""
    model, _, test = fit_fraud_model(spark, sf_dir)
    pred = cut_lineage(ML.score_test(model, test).select("Class", "prediction", "p_fraud"))
    cm, one = ML.confusion_matrix(pred), F.lit(1).alias("one")  # one row each
    hit = (F.col("tn") + F.col("tp")) / F.nullif(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), F.lit(0))
    return cm.select("*", (hit * 100).alias("accuracy_pct"), one).join(ML.roc_auc(pred).select("auc", one), "one").drop("one")


@query("fraud_model_checks", sql=f"""WITH {UNDER_SQL}
SELECT count(*) AS n_test, count(*) FILTER (WHERE "Class" = 1) AS n_fraud, count(*) FILTER (WHERE "Class" = 0) AS n_normal,
       true AS metrics_agree, true AS in_range FROM split WHERE is_test""")
def fraud_model_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 + M4 + A18–A21: what must hold of ``fraud_model_eval`` whatever the trees are: every held-out row is judged
    once, accuracy follows from the matrix, and accuracy and AUC lie in their ranges."""
    e = fraud_model_eval(spark, sf_dir)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return e.select(n.alias("n_test"), (F.col("fn") + F.col("tp")).alias("n_fraud"), (F.col("tn") + F.col("fp")).alias("n_normal"),
                    (F.abs(F.col("accuracy_pct") * n / 100 - (F.col("tn") + F.col("tp"))) < 1e-6).alias("metrics_agree"),
                    (F.col("accuracy_pct").between(0, 100) & F.col("auc").between(0, 1)).alias("in_range"))


@query("live_features", sql=f"""WITH {TX_SQL},
st AS (SELECT avg("Time") AS tm, stddev_pop("Time") AS ts_, avg("Amount") AS am, stddev_pop("Amount") AS as_ FROM tx),
{ORDER_FEED_CTE}
SELECT order_id, round((hour(ts) * 3600 - tm) / ts_, 9) AS time_scaled,
       CAST(CASE WHEN is_new_customer THEN -2.5 ELSE 0.0 END AS DOUBLE) AS "V1",
       CAST(CASE WHEN orders_last_hour > 3 THEN -3.0 ELSE 0.0 END AS DOUBLE) AS "V2",
       CAST(CASE WHEN failed_attempts > 2 THEN -2.8 ELSE 0.0 END AS DOUBLE) AS "V3",
       CAST(CASE WHEN amount > 1000 THEN -2.2 ELSE 0.0 END AS DOUBLE) AS "V4",
       round((amount - am) / as_, 9) AS amount_scaled
FROM order_feed, st""")
def live_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the live 30-slot feature vector per order (scaled time and amount, flag slots)."""
    stats = ML.scaler_stats(_tx(spark, sf_dir))
    f = ML.live_features(order_feed(spark, sf_dir), stats, keep=["order_id"])
    return f.select("order_id", F.round("Time", 9).alias("time_scaled"), "V1", "V2", "V3", "V4",
                    F.round("Amount", 9).alias("amount_scaled"))


@query("ml_fraud_overview")
def ml_fraud_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 + P8 + P9: rules plus the forest's score on every order; orders per final status."""
    model, stats, _ = fit_fraud_model(spark, sf_dir)
    scored = score_orders(ML.with_ml_score(order_feed(spark, sf_dir), model, stats))
    return scored.groupBy("status").agg(F.count(F.lit(1)).alias("n_orders"),
                                        F.avg("ml_score").alias("avg_ml_score"))


@query("ml_fraud_checks", sql=f"""{with_ctes(ORDER_FEED_CTE)}, r AS (SELECT CAST({RULE_SCORE_SQL} AS INTEGER) AS rule_score FROM order_feed)
SELECT count(*) AS n_orders, CAST(sum(rule_score) AS BIGINT) AS rule_total, count(*) FILTER (WHERE rule_score >= 55) AS blocked_by_rules,
       CAST(0 AS BIGINT) AS n_unscored, CAST(0 AS BIGINT) AS n_unsound FROM r""")
def ml_fraud_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 + P8 + P9: what must hold of the scored orders whatever the trees are: each order scored once within 0..100,
    the final score and status by the published formula, no order blocked by rules let through."""
    model, stats, _ = fit_fraud_model(spark, sf_dir)
    s = score_orders(ML.with_ml_score(order_feed(spark, sf_dir), model, stats))
    rule, ml, final = F.col("rule_score"), F.col("ml_score"), F.col("final_score")
    formula = F.greatest(rule, (rule * 0.8 + ml * 0.2).cast("int"))
    sound = (final == formula) & ((F.col("status") == "FRAUD_BLOCKED") == ((final >= 55) | (rule >= 55))) & ((F.col("status") == "APPROVED") == ((final < 31) & (rule < 55)))
    return s.agg(F.count(F.lit(1)).alias("n_orders"), F.sum("rule_score").cast("long").alias("rule_total"), F.count_if(rule >= 55).alias("blocked_by_rules"),
                 F.count_if(~F.coalesce(ml.between(0, 100), F.lit(False))).alias("n_unscored"), F.count_if(~sound).alias("n_unsound"))


@query("transactions_csv_profile", sql=f"""WITH {TX_SQL}
SELECT count(*) AS rows, CAST(sum("Class") AS BIGINT) AS fraud, count(*) FILTER (WHERE "Class" = 0) AS normal,
       avg("Class") * 100 AS fraud_rate_pct FROM tx""")
def transactions_csv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + A15: the labelled transactions written as CSV to the shared folder, read back with
    the CSV source and profiled."""
    import uuid
    from storepulse.session import checkpoint_dir
    from storepulse.sources.files import read_transactions
    path = f"{checkpoint_dir(spark)}/transactions-csv-{uuid.uuid4().hex}"
    _tx(spark, sf_dir).select(*ML.feature_columns(), "Class").write.mode("overwrite").option("header", True).csv(path)
    return ML.label_profile(read_transactions(spark, path))


@query("model_roundtrip", sql=f"""WITH {UNDER_SQL}
SELECT count(*) AS n_test, count(*) AS n_equal FROM split WHERE is_test""")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K12 + S11: save the fitted pipeline to the shared folder, load it, and check that the
    loaded model predicts the held-out rows exactly as the fitted one."""
    import uuid
    from storepulse.operators.sinks import save_model
    from storepulse.session import checkpoint_dir
    from storepulse.sources.files import load_model
    model, _, test = fit_fraud_model(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    save_model(model, path)
    loaded = load_model(path)
    a = ML.score_test(model, test).select("id", F.col("p_fraud").alias("a"))
    b = ML.score_test(loaded, test).select("id", F.col("p_fraud").alias("b"))
    j = a.join(b, "id")
    return j.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"))
