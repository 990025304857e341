"""Model preparation and metrics; the driver contract."""
import random

from pyspark.sql import functions as F

from storepulse.operators import model as ML

import __spark_entry__ as E


def test_undersample_and_split(spark):
    rows = [(i, 1 if i % 10 == 0 else 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, Class int")
    under = ML.undersample(df, ratio=3)
    counts = {r.Class: r["count"] for r in under.groupBy("Class").count().collect()}
    assert counts == {1: 30, 0: 90}
    split = ML.stratified_split(under)
    tests = {r.Class: r["count"] for r in split.filter("is_test").groupBy("Class").count().collect()}
    assert tests == {1: 6, 0: 18}
    w = {r.Class: r.weight for r in ML.class_weights(under).select("Class", "weight").distinct().collect()}
    assert abs(w[1] - 120 / 60) < 1e-12 and abs(w[0] - 120 / 180) < 1e-12


def test_auc_matches_pairwise(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 1), float(rnd.randint(0, 20))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, Class int, p_fraud double")
    auc = ML.roc_auc(df).first().auc
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(auc - exp) < 1e-12
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    ev = BinaryClassificationEvaluator(rawPredictionCol="p_fraud", labelCol="Class").evaluate(
        df.withColumn("Class", F.col("Class").cast("double")))
    assert abs(ev - exp) < 1e-9


def test_confusion_and_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)], "Class int, prediction int")
    cm = ML.confusion_matrix(df)
    assert tuple(cm.first()) == (1, 1, 1, 2)
    rep = {r["class"]: r for r in ML.classification_report(cm).collect()}
    assert abs(rep["Fraud"].precision - 2 / 3) < 1e-12 and rep["weighted avg"].support == 5


def test_entry_contract(spark):
    out = E.entry(spark)
    assert out.count() >= 1 and set(out.columns) == {"status", "n_orders", "revenue", "sum_rule_score"}
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 80
