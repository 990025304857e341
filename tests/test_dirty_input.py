"""Rows with odd or missing values stay in the result and fail no job."""
import json

from pyspark.sql import functions as F

from storepulse.functions.scalars import feed_rating
from storepulse.operators.windows import changed_rows, prior_count, rank_within_key
from storepulse.sources.files import parse_order_log, parse_review_feed


def test_null_keys_and_times_stay(spark):
    rows = [("a", "2024-01-01 10:00:00", 1, "x"), ("a", None, 2, "y"), (None, "2024-01-01 09:00:00", 3, "x"), (None, "2024-01-02 09:00:00", 4, "x"), (None, None, 5, "z")]
    df = spark.createDataFrame(rows, "k string, ts string, id long, v string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: r.prior_orders for r in prior_count(df, "k", "ts", "id").collect()}
    assert got == {2: 0, 1: 1, 5: 0, 3: 1, 4: 2}
    assert sorted(r.id for r in changed_rows(df, "v", "ts", "id", "k").collect()) == [1, 2, 3, 5]
    ranks = {r.id: r["rank"] for r in rank_within_key(df, "k", [F.col("id")], num_partitions=3).collect()}
    assert ranks == {1: 1, 2: 2, 3: 1, 4: 2, 5: 3}


def test_numbers_given_as_text(spark):
    orders = [{"order_id": "1", "total": "129.99", "items": [{"name": "a", "quantity": "2"}]}, {"order_id": "2", "total": 5, "items": [{"name": "b", "quantity": 3}]},
              {"order_id": "3", "total": "much", "items": [{"name": "c", "quantity": "1e12"}]}]
    lines = spark.createDataFrame([(json.dumps(o),) for o in orders] + [("{broken",), ("",)], "value string")
    got = {r.order_id: (r.total, r["items"][0].quantity) for r in parse_order_log(lines).collect()}
    assert got == {"1": (129.99, 2), "2": (5.0, 3), "3": (None, None)}


def test_odd_ratings(spark):
    lines = spark.createDataFrame([(f"{i}|||p|||t|||{r}",) for i, r in enumerate(["4.6", "nan", "1e12", "x", ""])], "value string")
    assert {r.comment_id: r.rating for r in parse_review_feed(lines).collect()} == {0: 4}
    df = spark.createDataFrame([("nan",), ("1e12",), ("",), ("3.9",)], "r string").select(feed_rating("r").alias("x"))
    assert [r.x for r in df.collect()] == [None, None, 5, 3]
