"""Window operators against brute force, including boundaries and a hot key."""
import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from storepulse.operators.cooldown import cooldown
from storepulse.operators.windows import (first_by_key, latest_by_key, prior_count, rank_within_key,
                                          running_total, trailing_count)

T0 = datetime(2024, 1, 1)


def _events(n, keys, seed, span_s=6 * 3600):
    rnd = random.Random(seed)
    return [(i, rnd.choice(keys), T0 + timedelta(microseconds=rnd.randrange(span_s * 10**6))) for i in range(n)]


def test_trailing_count_boundaries(spark):
    h = timedelta(hours=1)
    rows = [(1, "a", T0), (2, "a", T0 + h), (3, "a", T0 + h + timedelta(microseconds=1)),
            (4, "a", T0 + h + timedelta(microseconds=1)), (5, "b", T0)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    got = {r.id: r.v for r in trailing_count(df, "k", "ts", 3600, out="v").collect()}
    # exactly one hour old is out; equal times count each other
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 1}


def test_trailing_count_brute_force(spark):
    rows = _events(400, ["hot"] * 8 + ["x", "y"], 1)
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    got = {r.id: r.v for r in trailing_count(df, "k", "ts", 1800, out="v").collect()}
    for i, k, t in rows:
        exp = sum(1 for _, k2, t2 in rows if k2 == k and t2 <= t and (t - t2).total_seconds() < 1800)
        assert got[i] == exp


def test_trailing_count_context(spark):
    rows = [(1, "a", T0 + timedelta(minutes=30)), (2, "a", T0 + timedelta(minutes=80))]
    ctx = spark.createDataFrame([("a", T0), ("a", T0 + timedelta(minutes=20))], "k string, ts timestamp")
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    got = {r.id: r.v for r in trailing_count(df, "k", "ts", 3600, out="v", context=ctx).collect()}
    assert got == {1: 3, 2: 2}


def test_prior_count_multi_day(spark):
    rows = _events(300, ["hot"] * 5 + ["a", "b"], 2, span_s=5 * 86400)
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    got = {r.id: r.p for r in prior_count(df, "k", "ts", "id", out="p").collect()}
    for i, k, t in rows:
        assert got[i] == sum(1 for j, k2, t2 in rows if k2 == k and (t2, j) < (t, i))


def test_rank_within_key_hot_key(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if rnd.random() < 0.7 else rnd.choice("abc"), rnd.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, v int")
    got = {r.id: r.rank for r in rank_within_key(df, "k", [F.col("v"), F.col("id")], num_partitions=6).collect()}
    for i, k, v in rows:
        assert got[i] == 1 + sum(1 for j, k2, v2 in rows if k2 == k and (v2, j) < (v, i))


def test_running_total(spark):
    rows = [(i, float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double")
    got = {r.id: r.running for r in running_total(df, [F.col("id")], "x", num_partitions=5).collect()}
    acc = 0.0
    for i, x in rows:
        acc += x
        assert got[i] == acc


def test_first_and_latest(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 5, "n"), (None, 3, "m")], "k string, o int, v string")
    first = {r.k: r.v for r in first_by_key(df, "k", "o").collect()}
    last = {r.k: r.v for r in latest_by_key(df, "k", "o").collect()}
    assert first == {"k": "a", None: "m"} and last == {"k": "b", None: "n"}


def _fold(rows, width_s=3600):
    last, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        prev = last.get(k)
        if prev is None or (t - prev).total_seconds() > width_s:
            out[i] = (True, None)
            last[k] = t
        else:
            out[i] = (False, int((width_s - (t - prev).total_seconds()) / 60))
    return out


def test_cooldown_boundaries(spark):
    h = timedelta(hours=1)
    rows = [(1, "a", T0), (2, "a", T0 + h), (3, "a", T0 + h + timedelta(microseconds=1)),
            (4, "a", T0 + h + timedelta(minutes=30)), (5, "a", T0 + 3 * h)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    got = {r.id: (r.sent, r.minutes_remaining) for r in cooldown(df, "k", "ts", "id").collect()}
    assert got == {1: (True, None), 2: (False, 0), 3: (True, None), 4: (False, 30), 5: (True, None)}


def test_cooldown_brute_force(spark):
    rows = _events(600, ["hot"] * 10 + ["a", "b", "c"], 4, span_s=48 * 3600)
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    got = {r.id: (r.sent, r.minutes_remaining) for r in cooldown(df, "k", "ts", "id").collect()}
    assert got == _fold(rows)


def test_cooldown_over_many_slices(spark):
    """A hot key over many slices (two levels of composed maps), keys that end inside one, and a null key."""
    for seed, span, n in ((8, 30 * 3600, 20), (9, 3 * 3600, 11), (10, 400 * 3600, 7)):
        rows = _events(500, ["hot"] * 10 + ["a", "b", None], seed, span_s=span)
        df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
        got = {r.id: (r.sent, r.minutes_remaining) for r in cooldown(df, "k", "ts", "id", n_slices=n).collect()}
        assert got == _fold(rows)


def test_cooldown_one_key_and_ties(spark):
    rows = [(i, "k", T0 + timedelta(minutes=20 * (i // 4))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp").select("*", F.lit(1).alias("x"))
    for n in (1, 5, 17):
        out = cooldown(df, "k", "ts", "id", n_slices=n)
        assert out.columns == ["id", "k", "ts", "x", "sent", "minutes_remaining"]
        assert {r.id: (r.sent, r.minutes_remaining) for r in out.collect()} == _fold(rows)


def test_cooldown_carried_sends_and_missing_times(spark):
    rows = _events(300, ["hot"] * 8 + ["a", "b"], 12, span_s=20 * 3600)
    rows.sort(key=lambda r: (r[2], r[0]))
    want, early, late = _fold(rows), rows[:140], rows[140:]
    schema = "id long, k string, ts timestamp"
    first = cooldown(spark.createDataFrame(early, schema), "k", "ts", "id", n_slices=3)
    carried = first.where("sent").groupBy("k").agg(F.max(F.unix_micros("ts")).alias("last_sent"))
    second = cooldown(spark.createDataFrame(late + [(9999, "hot", None)], schema), "k", "ts", "id", carried=carried, n_slices=6)
    got = {r.id: (r.sent, r.minutes_remaining) for r in first.unionByName(second).collect()}
    assert got.pop(9999) == (False, None) and got == want
    assert cooldown(spark.createDataFrame([], schema), "k", "ts", "id").count() == 0


def test_step_maps_compose():
    from storepulse.operators.cooldown import apply_map, compose, step_map, walk
    rnd = random.Random(3)
    for _ in range(200):
        width = rnd.randrange(1, 30)
        times = sorted(rnd.randrange(200) for _ in range(rnd.randrange(2, 40)))
        cut = rnd.randrange(1, len(times))
        parts = [times[:cut], times[cut:]]
        maps = [step_map(np.array(p), width) for p in parts]
        for last in [None, *range(times[0] - 40, times[0] + 1)]:
            for p, m in zip(parts[:1], maps[:1], strict=True):
                assert apply_map(*m, last) == walk(p, [False] * len(p), last, width)[2]
            assert apply_map(*compose(*maps), last) == walk(times, [False] * len(times), last, width)[2]


def test_changed_rows_multi_day(spark):
    from storepulse.operators.windows import changed_rows
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["hot"] * 6 + ["a", "b"]), T0 + timedelta(seconds=rnd.randrange(4 * 86400)),
             rnd.choice(["x", "y"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp, v string")
    got = sorted(r.id for r in changed_rows(df, "v", "ts", "id", "k").collect())
    exp, last = [], {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or last[k] != v:
            exp.append(i)
        last[k] = v
    assert got == sorted(exp)


def test_with_position(spark):
    from storepulse.operators.windows import with_position
    rows = [(i, f"n{(i * 7) % 50:02d}") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, name string")
    got = {r.id: r.position for r in with_position(df, [F.col("name"), F.col("id")]).collect()}
    exp = {i: p for p, (_, i) in enumerate(sorted((n, i) for i, n in rows))}
    assert got == exp


def test_enrich_null_key_options(spark):
    from storepulse.operators.orders import enrich_orders
    rows = [("o1", None, T0), ("o2", None, T0 + timedelta(minutes=5)), ("o3", "a", T0)]
    df = spark.createDataFrame(rows, "order_id string, customer_email string, ts timestamp")
    shared = {r.order_id: (r.orders_last_hour, r.prior_orders) for r in enrich_orders(df).collect()}
    skipped = {r.order_id: (r.orders_last_hour, r.prior_orders) for r in enrich_orders(df, null_key=None).collect()}
    assert shared == {"o1": (1, 0), "o2": (2, 1), "o3": (1, 0)}
    assert skipped == {"o1": (None, None), "o2": (None, None), "o3": (1, 0)}
