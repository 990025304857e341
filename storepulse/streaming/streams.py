"""Structured Streaming (§2.12 X1–X9).

* X5 dedup: ``withWatermark`` + ``dropDuplicatesWithinWatermark(['order_id'])``.
* X1–X3 enrichment: ``transformWithStateInPandas`` per hash bucket of emails. Spark's state store holds each email's
  number of orders and the times that the watermark can still reach; an event-time timer expires them. A batch
  costs what the buckets of its emails cost, and a restart goes on from the checkpoint.
* X4 scoring is stateless (the batch rule engine on the stream). X9 counts the scored rows per status in a second
  query over the scored sink, a stateful ``groupBy`` in complete or update mode.
* X6 cooldown, X6 upsert and X7 run in ``foreachBatch`` on the batch operators, which split hot keys; their tables
  are ``VersionedTable``s found in storage, so only the buckets of a batch's keys are read and rewritten.
* Sinks write to ``<sink>/batch=<id>`` with overwrite, so a batch replayed after a failure replaces its own output.
* X8: ``trigger`` is an argument: ``processingTime`` for a live feed, ``availableNow`` to catch up and stop.
"""

from __future__ import annotations

import contextlib
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from storepulse.operators.cooldown import cooldown
from storepulse.operators.fraud import score_orders
from storepulse.operators.orders import normalize_orders
from storepulse.operators.versioned import VersionedTable
from storepulse.session import checkpoint_dir, cut_lineage
from storepulse.sources.files import parse_order_log

HOUR_US = 3600 * 1_000_000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROW_COUNTS = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# The stateful processor runs in Python workers; ship it by value so executors need not
# have this package installed (same effect as --py-files for it).
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def time_chunks(df: DataFrame, ts: Column | str, n_chunks: int = 4) -> list[DataFrame]:
    """``df``, written once, in ``n_chunks`` spans of event time; rows without a time belong to the first."""
    t = F.col(ts) if isinstance(ts, str) else ts
    with_t = cut_lineage(df.withColumn("_t", F.unix_micros(t.cast("timestamp"))))
    lo, hi = with_t.agg(F.min("_t"), F.max("_t")).first()
    lo, hi = (lo or 0), (hi or 0)
    step = max(1, (hi - lo) // n_chunks + 1)
    part = F.coalesce(F.floor((F.col("_t") - lo) / step), F.lit(0))
    return [with_t.filter(part == i).drop("_t") for i in range(n_chunks)]


def land(df: DataFrame, path: str, fmt: str = "text") -> None:
    """Append ``df`` to a landing folder; every task writes a file of its own."""
    df.write.mode("append").format(fmt).save(path)


def replay(chunks: list[DataFrame], path: str, run: Callable[[], object], fmt: str = "text") -> None:
    """Land one chunk after another and let the stream catch up after each: every chunk is a restart from the checkpoint."""
    for chunk in chunks:
        land(chunk, path, fmt)
        run()


def idempotent_sink(path: str):
    """foreachBatch writer: each micro-batch overwrites its own ``batch=<id>`` folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def read_sink(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """What the batches (before one) have written."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which ``transformWithState`` asks for. Its rows are not
    counted, as the count takes a read before every write."""
    old = {k: spark.conf.get(k, None) for k in (STATE_STORE, ROW_COUNTS)}
    for k, v in ((STATE_STORE, ROCKSDB), (ROW_COUNTS, "false")):
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the stateful operators of a query dropped behind the watermark, as far as its progress is kept."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def run_stream(stream: DataFrame, spark: SparkSession, name: str, foreach, output_mode: str = "append",
               trigger: dict | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Run a streaming plan through ``foreachBatch`` until what has landed is processed, and stop. Any trigger will do:
    ``availableNow`` (the default) ends by itself; a ``processingTime`` query is stopped once it is idle. Pass the
    same ``checkpoint`` to resume where the query left off."""
    writer = (stream.writeStream.outputMode(output_mode)
              .option("checkpointLocation", checkpoint or scratch(spark, f"{name}-ckpt"))
              .foreachBatch(foreach)
              .trigger(**(trigger or {"availableNow": True})))
    with rocksdb(spark):
        q = writer.start()
        if trigger and "processingTime" in trigger:
            try:
                q.processAllAvailable()
            finally:
                q.stop()
        else:
            q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


# ---- X5 + P1 -----------------------------------------------------------------------------------

def order_stream(spark: SparkSession, path: str, watermark: str = "2 hours", max_files: int | None = None) -> DataFrame:
    """S1 + X5 + P1 on a stream of order-log files: parse, event time, dedup by order id. ``max_files`` bounds a
    micro-batch of a live feed."""
    reader = spark.readStream if max_files is None else spark.readStream.option("maxFilesPerTrigger", max_files)
    raw = parse_order_log(reader.text(path))
    norm = normalize_orders(raw).withColumn("ts", F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return norm.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["order_id"])


# ---- X1–X3 ---------------------------------------------------------------------------------------

def _up_to(who: np.ndarray, times: np.ndarray, at_who: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each (``at_who``, ``at``) the number of (``who``, ``times``) not after it, in that order of both."""
    asks = np.repeat([0, 1], [len(who), len(at)])
    order = np.lexsort((asks, np.concatenate([times, at]), np.concatenate([who, at_who])))
    counts = np.empty(len(order), dtype=np.int64)
    counts[order] = np.cumsum(asks[order] == 0)
    return counts[len(who):]


class OrderHistory(StatefulProcessor):
    """Velocity and earlier orders per email, for a bucket of emails at a time. The orders of one email and micro-batch
    are handled together, in event-time order; equal times count each other, as in the batch operator. Late orders that
    the watermark admits see all remembered times of their hour, and come after the orders that arrived before them in
    ``prior_orders``. The state of a bucket: its emails and their numbers of orders, and remembered times with the
    place of their email."""

    def __init__(self, key: str, ts: str, tiebreak: str, width_us: int = HOUR_US):
        self.key, self.ts, self.tiebreak, self.width_us = key, ts, tiebreak, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getValueState("history", "emails array<string>, n array<long>, who array<int>, us array<long>")

    def _known(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        emails, n, who, us = self.history.get() or ([], [], [], [])
        return list(emails), np.array(n, dtype=np.int64), np.array(who, dtype=np.int64), np.array(us, dtype=np.int64)

    def _remember(self, emails: list[str], n: np.ndarray, who: np.ndarray, us: np.ndarray, watermark_ms: int) -> int | None:
        """Keep the times that an order not behind the watermark can still see; returns the last of them."""
        seen = us > watermark_ms * 1000 - self.width_us
        self.history.update((emails, n.tolist(), who[seen].tolist(), us[seen].tolist()))
        return int(us[seen].max()) if seen.any() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        emails, n, old_who, old_us = self._known()
        codes, uniques = pd.factorize(np.concatenate([np.array(emails, dtype=object), pdf[self.key].to_numpy(dtype=object)]))
        pdf = pdf.assign(_who=codes[len(emails):]).sort_values(["_who", "ts_us", self.tiebreak], kind="stable", ignore_index=True)
        who, times = pdf["_who"].to_numpy(np.int64), pdf["ts_us"].to_numpy(np.int64)
        n = np.concatenate([n, np.zeros(len(uniques) - len(emails), dtype=np.int64)])
        prior = n[who] + np.arange(len(who)) - np.searchsorted(who, who)
        all_who, all_us = np.concatenate([old_who, who]), np.concatenate([old_us, times])
        hour = _up_to(all_who, all_us, who, times) - _up_to(all_who, all_us, who, times - self.width_us)
        last = self._remember(uniques.tolist(), n + np.bincount(who, minlength=len(n)), all_who, all_us, timerValues.getCurrentWatermarkInMs())
        if last is not None:
            self.handle.registerTimer((last + self.width_us) // 1000 + 1)
        yield pdf.drop(columns=["ts_us", "email_bucket", "_who"]).assign(orders_last_hour=hour, prior_orders=prior)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._remember(*self._known(), timerValues.getCurrentWatermarkInMs())  # a newer order has a timer of its own
        yield from ()

    def close(self) -> None:
        pass


def packed(df: DataFrame, columns: list[str]) -> Column:
    """Columns as one JSON text, times as microseconds: a Python worker handles one value of a row in place of many."""
    return F.to_json(F.struct(*[(F.unix_micros(c) if isinstance(df.schema[c].dataType, T.TimestampType) else F.col(c)).alias(c) for c in columns]))


def unpacked(df: DataFrame, text: str, schema: T.StructType, keep: list[str]) -> DataFrame:
    """``keep`` of ``df`` and the columns of ``schema`` out of ``packed`` text."""
    times = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)]
    inside = T.StructType([T.StructField(f.name, T.LongType() if f.name in times else f.dataType) for f in schema.fields])
    rows = df.withColumn("_o", F.from_json(text, inside))
    return rows.select(*keep, *[(F.timestamp_micros(F.col("_o")[f.name]) if f.name in times else F.col("_o")[f.name]).alias(f.name) for f in schema.fields])


def enriched_stream(orders: DataFrame, key: str = "customer_email", ts: str = "ts", tiebreak: str = "order_id",
                    n_buckets: int = 1024) -> DataFrame:
    """A watermarked stream of orders with ``orders_last_hour`` (W1), ``prior_orders`` and ``is_new_customer``.
    Emails share hash buckets, so a call into Python and a read of the state serve many of them; ``n_buckets`` stays the
    same as long as a checkpoint lives, and up to some thousand emails a bucket are a good number. Python sees the email,
    the id and the time; the other columns of an order go past it as one text."""
    email = F.coalesce(F.col(key), F.lit("unknown"))
    found = T.StructType([T.StructField("orders_last_hour", T.IntegerType()), T.StructField("prior_orders", T.LongType())])
    orders = orders.withColumn(key, email)
    rest = T.StructType([f for f in orders.schema.fields if f.name not in (key, tiebreak, ts)])
    rows = orders.select(key, tiebreak, ts, packed(orders, rest.names).alias("order"), F.unix_micros(F.col(ts)).alias("ts_us"),
                         F.pmod(F.xxhash64(F.col(key)), F.lit(n_buckets)).cast("int").alias("email_bucket"))
    out = T.StructType([*(rows.schema[c] for c in (key, tiebreak, ts, "order")), *found.fields])
    done = rows.groupBy("email_bucket").transformWithStateInPandas(OrderHistory(key, ts, tiebreak), out, "Append", "EventTime")
    done = unpacked(done, "order", rest, [key, tiebreak, ts, *found.names])
    return done.select(*orders.columns, *found.names, (F.col("prior_orders") <= 1).alias("is_new_customer"))


def fraud_stream(enriched: DataFrame) -> DataFrame:
    """The rule engine and decision on enriched orders (stateless)."""
    return score_orders(enriched)


# ---- X6, X7: tables in foreachBatch ------------------------------------------------------------------

def cooldown_stream(spark: SparkSession, root: str, sink, key: str = "alert_key", ts: str = "checked_at", id_col: str = "event_id",
                    seconds: int = 3600):
    """W7 on a stream, for ``foreachBatch``: ``sink(cooled, batch_id)`` gets the alerts of a micro-batch with ``sent``
    and ``minutes_remaining``. The last send per key is a versioned table; a batch reads the buckets of its own
    keys, and the alerts of a hot key are split into slices as in the batch operator. Suppressed alerts change nothing."""
    state = VersionedTable(spark, root, "state_key", "state_key string, last_sent long")

    def process(batch: DataFrame, batch_id: int) -> None:
        alerts = cut_lineage(batch.withColumn("state_key", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))))
        keys = alerts.select("state_key").distinct()

        def merge(known: DataFrame, touched: DataFrame) -> DataFrame:
            cooled = cut_lineage(cooldown(touched, "state_key", ts, id_col, seconds, carried=known.join(keys, "state_key", "left_semi")))
            sink(cooled.drop("state_key"), batch_id)
            sends = cooled.where("sent").select("state_key", F.unix_micros(F.col(ts).cast("timestamp")).alias("last_sent"))
            return known.unionByName(sends).groupBy("state_key").agg(F.max("last_sent").alias("last_sent"))

        if not state.change(batch_id, alerts, merge):
            sink(alerts.drop("state_key").withColumns({"sent": F.lit(False), "minutes_remaining": F.lit(None).cast("int")}), batch_id)

    return process


def upsert_stream(table: VersionedTable, merge: Callable[[DataFrame, DataFrame], DataFrame]):
    """K7/K8 on a stream, for ``foreachBatch``: every micro-batch rewrites the buckets of its keys."""
    def process(batch: DataFrame, batch_id: int) -> None:
        table.change(batch_id, cut_lineage(batch), merge)
    return process


# ---- X9: live overview --------------------------------------------------------------------------------

def overview_stream(scored: DataFrame) -> DataFrame:
    """Orders and revenue per status; on a stream a stateful aggregate for complete or update mode."""
    return scored.groupBy("status").agg(F.count(F.lit(1)).alias("n_orders"),
                                        F.sum("amount").cast("double").alias("revenue"))


def run_overview(spark: SparkSession, sink: str, schema: T.StructType, table: str, checkpoint: str, output_mode: str = "complete",
                 trigger: dict | None = None) -> DataFrame:
    """Catch up with a scored sink and return the overview. In complete mode each micro-batch writes the whole
    result as a new version; in update mode the changed statuses replace their rows in a versioned table."""
    scored = spark.readStream.schema(schema).option("basePath", sink).parquet(f"{sink}/batch=*")
    live = VersionedTable(spark, table, "status", "status string, n_orders long, revenue double", n_buckets=4)

    def write(rows: DataFrame, batch_id: int) -> None:
        fresh = cut_lineage(rows)
        live.change(batch_id, fresh, lambda known, new: new if output_mode == "complete" else known.join(new, "status", "left_anti").unionByName(new))

    run_stream(overview_stream(scored), spark, "overview", write, output_mode, trigger, checkpoint)
    return live.read()
