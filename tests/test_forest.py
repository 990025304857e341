"""The forest path (M2–M6, K12, S11), the topic (K1) and the hold actions (K13, J10) on small made-up rows."""
import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from storepulse.operators import model as ML
from storepulse.operators.fraud import score_orders
from storepulse.operators.sinks import order_actions, save_model, to_topic
from storepulse.sources.files import load_model

T0 = datetime(2024, 1, 1, 12)


def _transactions(spark, n=400):
    rnd, rows = random.Random(5), []
    for i in range(n):
        y = int(i % 8 == 0)
        rows.append((i, float(rnd.randrange(86400)), *[rnd.gauss(-3.0 * y if k < 4 else 0.0, 1.0) for k in range(28)], float(rnd.randrange(1000)), y))
    cols = ", ".join(["id long", "Time double", *[f"V{k} double" for k in range(1, 29)], "Amount double", "Class int"])
    return spark.createDataFrame(rows, cols)


@pytest.fixture(scope="module")
def fitted(spark):
    tx = _transactions(spark)
    stats = ML.scaler_stats(tx)
    split = ML.stratified_split(ML.undersample(ML.standardize(tx, stats), ratio=5), test_fraction=0.25)
    return ML.train_fraud_model(ML.class_weights(split.where("NOT is_test")), num_trees=20, max_depth=5), stats, split.where("is_test")


def test_forest_tells_the_classes_apart(fitted):
    model, _, test = fitted
    pred = ML.score_test(model, test)
    assert all(0 <= r.p_fraud <= 1 and r.prediction == int(r.p_fraud > 0.5) for r in pred.collect())
    assert ML.roc_auc(pred).first().auc > 0.99 and ML.accuracy(ML.confusion_matrix(pred)).first()[0] > 95


def test_saved_model_predicts_the_same(fitted, tmp_path):
    model, _, test = fitted
    save_model(model, str(tmp_path / "m"))
    save_model(model, str(tmp_path / "m"))  # replaces
    again = ML.score_test(load_model(str(tmp_path / "m")), test)
    assert {r.id: r.p_fraud for r in again.collect()} == {r.id: r.p_fraud for r in ML.score_test(model, test).collect()}


ORDERS = ("order_id string, customer_email string, amount double, quantity int, orders_last_hour int, is_new_customer boolean, failed_attempts int, "
          "payment_method string, card_country string, shipping_country string, ts timestamp")


def _orders(spark):
    rows = [(f"WOO-{i}", f"c{i}@x", 100.0 * i, 1, i % 6, i % 2 == 0, i % 5, "stripe", "US", "US", T0 + timedelta(minutes=i)) for i in range(30)]
    return spark.createDataFrame([*rows, (rows[7][0], "other@x", 5000.0, 9, 5, True, 4, "cod", "US", "FR", T0), (None,) * 11], ORDERS)


def test_live_scores_in_one_pass(spark, fitted):
    """The column form equals the joined form where ids are unique, and rows that share an id keep their own score."""
    model, stats, _ = fitted
    orders = _orders(spark)
    both = ML.with_ml_score(orders, model, stats).collect()
    assert len(both) == orders.count()
    joined = {r.order_id: r.ml_score for r in ML.ml_score(orders.where("order_id <> 'WOO-7'"), model, stats).collect()}
    assert {r.order_id: r.ml_score for r in both if r.order_id not in (None, "WOO-7")} == joined
    again = {r.customer_email: r.ml_score for r in ML.with_ml_score(orders.where("order_id = 'WOO-7'"), model, stats).collect()}
    assert {r.customer_email: r.ml_score for r in both if r.order_id == "WOO-7"} == again
    scored = score_orders(ML.with_ml_score(orders.where("order_id IS NOT NULL"), model, stats)).collect()
    assert all(r.final_score == max(r.rule_score, int(r.rule_score * 0.8 + r.ml_score * 0.2)) for r in scored)
    assert {r.ml_score for r in score_orders(orders.where("order_id = 'WOO-3'")).collect()} == {0}


def _hash(i, seed=42):
    return hashlib.md5(f"{i}-{seed}".encode()).hexdigest()


@pytest.mark.parametrize("n,ratio", [(400, 3), (400, 100), (30, 1), (0, 3)])
def test_undersample_is_exact(spark, n, ratio):
    tx = _transactions(spark, 400).limit(0) if not n else _transactions(spark, n)
    rows = [(r.id, r.Class) for r in tx.collect()]
    fraud = [i for i, y in rows if y]
    normal = sorted((i for i, y in rows if not y), key=lambda i: (_hash(i), i))[:ratio * len(fraud)]
    assert sorted(r.id for r in ML.undersample(tx, ratio=ratio).collect()) == sorted(fraud + normal)


def test_split_takes_shares_of_each_class_and_repeated_ids(spark):
    rows = [(i // 3 if i < 90 else i, float(i), int(i % 4 == 0)) for i in range(200)]  # ids that three rows share
    df = spark.createDataFrame(rows, "id long, v double, Class int")
    got = ML.stratified_split(df, test_fraction=0.3).collect()
    for y in (0, 1):
        own = [r for r in got if r.Class == y]
        assert sum(r.is_test for r in own) == -(-len(own) * 3 // 10)
        edge = max(_hash(r.id) for r in own if r.is_test)
        assert all(r.is_test for r in own if _hash(r.id) < edge)


def test_topic_values_read_back(spark):
    df = spark.createDataFrame([("a", 1.5, ["x", "y"], None), (None, None, [], "t")], "order_id string, amount double, reasons array<string>, note string")
    rows = to_topic(df, key="order_id").collect()
    assert [r.key for r in rows] == ["a", None]
    assert json.loads(rows[0].value) == {"order_id": "a", "amount": 1.5, "reasons": ["x", "y"]} and json.loads(rows[1].value) == {"reasons": [], "note": "t"}


def test_hold_actions_fall_back_to_the_latest_order(spark):
    scored = spark.createDataFrame([("WOO-1", "FRAUD_BLOCKED", 70), ("WOO-99", "REVIEW_NEEDED", 40), ("WOO-x", "FRAUD_BLOCKED", 60), ("WOO-2", "APPROVED", 0)], "order_id string, status string, final_score int")
    store = spark.createDataFrame([(1, T0), (2, T0 + timedelta(hours=2)), (3, T0 + timedelta(hours=2))], "order_key long, ts timestamp")
    got = {r.order_id: (r.target_order, r.fallback, r.note) for r in order_actions(scored, store).collect()}
    assert got == {"WOO-1": (1, False, "FRAUD DETECTED - Score: 70/100. Pending admin review."), "WOO-99": (3, True, "REVIEW NEEDED - Score: 40/100. Pending admin review."),
                   "WOO-x": (3, True, "FRAUD DETECTED - Score: 60/100. Pending admin review.")}
    assert {r.target_order for r in order_actions(scored, store.limit(0)).collect()} == {None}
