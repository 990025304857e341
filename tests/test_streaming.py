"""Stream = batch on small inputs landed in several chunks, each a restart; tables found in storage; late rows."""
from collections import Counter
from datetime import datetime, timedelta
import json
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from storepulse.operators.cooldown import cooldown
from storepulse.operators.orders import enrich_orders, normalize_orders
from storepulse.operators.rules import DETECTOR_DEFAULTS
from storepulse.operators.versioned import VersionedTable
from storepulse.plans.stream_q import RULE_INPUT, stream_overview
from storepulse.sources.files import parse_order_log
from storepulse.streaming import streams as X
from tests.conftest import SF_SMALL

T0 = datetime(2024, 1, 1)


def test_cooldown_stream_equals_batch(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice([1, 2, 3]), f"P{i % 3}", rnd.choice([0, 3]), T0 + timedelta(seconds=rnd.randrange(20 * 3600)))
            for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, product_id long, product_name string, stock_level int, "
                                     "checked_at timestamp")
    alerts = df.withColumn("level", F.when(F.col("stock_level") == 0, "out").otherwise("low")) \
        .withColumn("alert_key", F.when(F.col("product_id") < 3, F.concat("level", F.lit("_"), F.col("product_id").cast("string"))))
    batch = {r.event_id: (r.sent, r.minutes_remaining)
             for r in cooldown(alerts, "alert_key", "checked_at", "event_id").collect()}
    path, ckpt, state, sink = (X.scratch(spark, f"t-cool-{n}") for n in ("in", "ckpt", "state", "out"))

    def run():  # a new handler each time: what it knows comes from storage
        stream = spark.readStream.schema(alerts.schema).parquet(path)
        X.run_stream(stream, spark, "t-cool", X.cooldown_stream(spark, state, X.idempotent_sink(sink)), checkpoint=ckpt)

    X.replay(X.time_chunks(alerts, "checked_at", 3), path, run, "parquet")
    assert {r.event_id: (r.sent, r.minutes_remaining) for r in X.read_sink(spark, sink).collect()} == batch


def _order_lines(n, seed, people):
    rnd = random.Random(seed)
    return [json.dumps({"order_id": str(i), "email": people[rnd.randrange(len(people))], "total": 10.0 * i, "items": [{"name": f"p{i}"}],
                        "timestamp": (T0 + timedelta(seconds=i * 97 + rnd.randrange(60))).strftime("%Y-%m-%dT%H:%M:%S")}) for i in range(n)]


def _enriched(spark, src, ckpt, sink, **more):
    write = lambda batch, bid: batch.write.mode("overwrite").parquet(f"{sink}/batch={bid}")
    return X.run_stream(X.enriched_stream(X.order_stream(spark, src, max_files=more.pop("max_files", None))), spark, "t-orders", write, checkpoint=ckpt, **more)


def _batch_enriched(spark, lines):
    raw = normalize_orders(parse_order_log(spark.createDataFrame([(v,) for v in lines], "value string")))
    batch = enrich_orders(raw.withColumn("ts", F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ss")))
    return {r.order_id: (r.customer_email, list(r.products), r.amount, r.ts, r.orders_last_hour, r.prior_orders, r.is_new_customer) for r in batch.collect()}


def _streamed(spark, sink):
    rows = X.read_sink(spark, sink).collect()
    got = {r.order_id: (r.customer_email, list(r.products), r.amount, r.ts, r.orders_last_hour, r.prior_orders, r.is_new_customer) for r in rows}
    assert len(got) == len(rows)
    return got


def test_enriched_stream_over_restarts_equals_batch(spark):
    """Every chunk is a restart from the checkpoint; one email has most orders, and some orders none."""
    lines = _order_lines(240, 11, ["hot@x"] * 8 + [f"c{k}@x" for k in range(6)] + [None])
    src, ckpt, sink = (X.scratch(spark, f"t-restart-{n}") for n in ("src", "ckpt", "out"))
    chunks = [spark.createDataFrame([(v,) for v in lines[k:k + 80]], "value string").repartition(3) for k in (0, 80, 160)]
    X.replay(chunks, src, lambda: _enriched(spark, src, ckpt, sink))
    assert _streamed(spark, sink) == _batch_enriched(spark, lines)


def test_processing_time_trigger_and_late_rows(spark):
    """The same feed by ``processingTime`` with a bound on the files of a batch, stopped and resumed; an order that
    arrives twice counts once, one behind the watermark is dropped and accounted for, a late one that the watermark
    admits still sees the orders of its hour."""
    src, ckpt, sink = (X.scratch(spark, f"t-live-{n}") for n in ("src", "ckpt", "out"))
    order = lambda i, minutes: json.dumps({"order_id": str(i), "email": "a@x", "total": 1.0, "items": [], "timestamp": (T0 + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S")})
    for part in ([order(1, 0), order(2, 30)], [order(3, 200), order(2, 30)]):
        X.land(spark.createDataFrame([(v,) for v in part], "value string").coalesce(1), src)
        _enriched(spark, src, ckpt, sink, trigger={"processingTime": "200 milliseconds"}, max_files=1)
    X.land(spark.createDataFrame([(v,) for v in [order(4, 10), order(5, 150), order(6, 170), order(7, 201)]], "value string").coalesce(1), src)
    q = _enriched(spark, src, ckpt, sink, trigger={"processingTime": "200 milliseconds"}, max_files=1)
    got = {r.order_id: (r.orders_last_hour, r.prior_orders) for r in X.read_sink(spark, sink).collect()}
    assert got == {"WOO-1": (1, 0), "WOO-2": (2, 1), "WOO-3": (1, 2), "WOO-5": (1, 3), "WOO-6": (2, 4), "WOO-7": (4, 5)}
    assert X.late_rows(q) == 1


def test_state_expires(spark):
    """The remembered times of an email go once the watermark has passed them; its number of orders stays."""
    src, ckpt, sink = (X.scratch(spark, f"t-expire-{n}") for n in ("src", "ckpt", "out"))
    order = lambda i, who, hours: json.dumps({"order_id": str(i), "email": who, "total": 1.0, "items": [], "timestamp": (T0 + timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%S")})
    for part in ([order(1, "a", 0)], [order(2, "b", 30)], [order(3, "b", 31)], [order(4, "a", 32)]):
        X.land(spark.createDataFrame([(v,) for v in part], "value string").coalesce(1), src)
        _enriched(spark, src, ckpt, sink)
    got = {r.order_id: (r.orders_last_hour, r.prior_orders) for r in X.read_sink(spark, sink).collect()}
    assert got == {"WOO-1": (1, 0), "WOO-2": (1, 0), "WOO-3": (1, 1), "WOO-4": (1, 1)}


class _Bucket:
    """State and timers of one bucket, in memory."""
    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.calls = value, self.calls + 1

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_order_history_of_a_bucket_of_emails():
    """One call serves all emails of a bucket; late orders see their hour, and the timer forgets all that has passed."""
    rnd, hour, bucket, history = random.Random(3), X.HOUR_US, _Bucket(), X.OrderHistory("email", "ts", "order_id")
    history.init(bucket)
    arrived, n, mark = [], 0, 0
    for batch in range(4):
        rows = []
        for _ in range(60):
            n += 1
            rows.append((f"o{n:03d}", f"c{rnd.randrange(12)}", (batch * 3 + rnd.randrange(-1, 4)) * 1200 * 1_000_000 + 10 * hour))
        rows = [r for r in rows if r[2] >= mark * 1000]
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
        pdf = pd.DataFrame([(*r, 0) for r in rows], columns=["order_id", "email", "ts_us", "email_bucket"])
        out = pd.concat(history.handleInputRows((0,), iter([pdf.iloc[:20], pdf.iloc[20:]]), now))
        assert bucket.calls == batch + 1 and list(out.columns) == ["order_id", "email", "orders_last_hour", "prior_orders"]
        seen = arrived + rows
        want = {o: (sum(e2 == e and t - hour < t2 <= t for _, e2, t2 in seen),
                    sum(e2 == e for _, e2, _ in arrived) + sum(e2 == e and (t2, o2) < (t, o) for o2, e2, t2 in rows)) for o, e, t in rows}
        assert {r.order_id: (r.orders_last_hour, r.prior_orders) for r in out.itertuples()} == want
        arrived, mark = seen, max(t for _, _, t in seen) // 1000 - 1800_000
    done = SimpleNamespace(getCurrentWatermarkInMs=lambda: max(bucket.timers))
    assert list(history.handleExpiredTimer((0,), done, None)) == []
    emails, counts, who, us = bucket.value
    assert dict(zip(emails, counts, strict=True)) == Counter(e for _, e, _ in arrived) and list(who) == list(us) == []


def test_overview_in_both_modes(spark):
    sink = X.scratch(spark, "t-scored")
    tables = {m: (X.scratch(spark, f"t-over-{m}"), X.scratch(spark, f"t-over-{m}-ckpt")) for m in ("complete", "update")}
    for bid, rows in enumerate([[("1", "APPROVED", 2.0), ("2", "FRAUD_BLOCKED", 5.0)], [("3", "APPROVED", 4.0)]]):
        df = spark.createDataFrame(rows, "order_id string, status string, amount double")
        df.write.parquet(f"{sink}/batch={bid}")
        for mode, (table, ckpt) in tables.items():
            out = X.run_overview(spark, sink, df.schema, table, ckpt, mode)
    for table, _ in tables.values():
        rows = VersionedTable(spark, table, "status", "status string, n_orders long, revenue double", 4).read().collect()
        assert sorted(map(tuple, rows)) == [("APPROVED", 2, 6.0), ("FRAUD_BLOCKED", 1, 5.0)]
    assert out.count() == 2


def test_versioned_table(spark):
    root = X.scratch(spark, "t-table")
    table = VersionedTable(spark, root, "id", "id long, v string", n_buckets=8)
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string")
    upsert = lambda known, new: known.join(new, "id", "left_anti").unionByName(new)
    assert table.read().count() == 0 and table.versions() == []
    assert len(table.change(0, rows(*[(k, "old") for k in range(100)]), upsert)) == 8
    touched = table.change(1, rows((7, "new")), upsert)  # a one-row batch rewrites one bucket
    places = table.places()
    assert len(touched) == 1 and [b for b, v in places.items() if v == 1] == touched and sorted(places) == list(range(8))
    again = VersionedTable(spark, root, "id", "id long, v string", n_buckets=8)  # as after a restart
    want = sorted([(k, "old") for k in range(100) if k != 7] + [(7, "new")])
    assert sorted(map(tuple, again.read().collect())) == want
    again.change(1, rows((8, "newer")), upsert)  # a replay starts from the version before its own
    assert sorted(map(tuple, again.read().collect())) == sorted([(k, "old") for k in range(100) if k != 8] + [(8, "newer")])
    assert again.change(2, rows(), upsert) == [] and again.read().count() == 100 and again.versions() == [0, 1, 2]
    again.change(3, rows(*[(k, "x") for k in range(100)], (None, "null key")), lambda known, new: new.where("v <> 'x'"))
    assert [tuple(r) for r in again.read().collect()] == [(None, "null key")]


def test_other_columns_of_an_order_pass_python_as_one_text(spark):
    """The packed columns come back exactly: doubles, times to the microsecond, nulls, quotes, arrays with nulls."""
    spec = "order_id string, customer_email string, ts timestamp, amount double, quantity int, failed_attempts int, products array<string>, seen timestamp"
    when = datetime(2024, 1, 1, 1, 2, 3, 456789)
    rows = [("1", "a@x", when, 0.1 + 0.2, None, 3, ['say "hi"', None, "ü\n"], when), ("2", None, None, 1e300, 4, None, [], None), ("3", "b@x", when, None, None, None, None, None)]
    df = spark.createDataFrame(rows, spec)
    rest = df.drop("order_id", "customer_email", "ts").schema
    out = X.unpacked(df.select("order_id", X.packed(df, rest.names).alias("order")), "order", rest, ["order_id"])
    assert out.schema.fields[1:] == rest.fields
    assert sorted(map(tuple, out.collect())) == sorted((r[0], *r[3:]) for r in map(tuple, df.collect()))


def test_state_queries_do_not_count_rows_and_settings_come_back(spark):
    before = {k: spark.conf.get(k, None) for k in (X.STATE_STORE, X.ROW_COUNTS)}
    with X.rocksdb(spark):
        assert (spark.conf.get(X.STATE_STORE), spark.conf.get(X.ROW_COUNTS)) == (X.ROCKSDB, "false")
    assert {k: spark.conf.get(k, None) for k in before} == before


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_log_lines_are_parsed_once_and_rules_are_tried_once(spark):
    lines = spark.createDataFrame([(v,) for v in [*_order_lines(3, 1, ["a@x"]), "{\"order_id\": ", "", "x"]], "value string")
    raw = parse_order_log(lines)
    assert _plan(raw).count("from_json(") == 1 and raw.count() == 3
    orders = spark.createDataFrame([("1", 2000.0, True, "stripe", 5, 4)], "order_id string, amount double, is_new_customer boolean, payment_method string, quantity int, orders_last_hour int")
    scored = X.fraud_stream(orders)
    assert _plan(scored).count("Too many orders") == 1
    row = scored.first()
    assert row.rule_codes == ["R1", "R2", "R4", "R5", "R8", "R9", "R10", "R3", "R11"] and row.rule_score == 40 + 30 + 30 + 50 + 35 + 20 + 15 + 45 + 40
    assert len(row.reasons) == 9 and "_hits" not in scored.columns


def test_overview_stream_carries_only_what_the_rules_read(spark, monkeypatch):
    class Stop(Exception):
        pass

    found = []

    def replay(chunks, path, run, fmt="text"):
        X.land(spark.createDataFrame([("{}",)], "value string"), path)
        run()

    def run_stream(stream, *args, **kw):
        found.append(set(stream.columns))
        raise Stop

    monkeypatch.setattr(X, "time_chunks", lambda *args: [])
    monkeypatch.setattr(X, "replay", replay)
    monkeypatch.setattr(X, "run_stream", run_stream)
    with pytest.raises(Stop):
        stream_overview(spark, SF_SMALL)
    assert found == [{*RULE_INPUT, "orders_last_hour", "prior_orders", "is_new_customer"}]
    assert set(DETECTOR_DEFAULTS) <= found[0]
