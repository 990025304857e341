"""Alert cooldown (W7, W7b): an alert is sent when more than the cooldown has passed since the last *sent* alert of
its key; suppressed alerts do not move the clock. Whether one is sent depends on all sends before it, so it is no
window function.

One path serves keys of any size. The alerts are dealt into sorted slices by (key, time, id). A slice that holds
one key only is summarised as a step map from the last send before it to the last send after it; any other slice
ends in a send that does not depend on what came before. Eight maps are composed into one, level by level, until
one is left, and the sends before each slice then come down the same levels (a prefix scan). With its incoming
send known, every slice is walked once. A task holds one slice or eight maps, whatever share of the alerts a key has.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storepulse.operators.slices import sorted_slices
from storepulse.session import cut_lineage

MICROS = 1_000_000
FAN = 8  # maps composed at once
END = np.iinfo(np.int64).max

# The functions below run in Python workers; ship them by value so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAP = "_slice int, first_key string, last_key string, single boolean, bounds array<long>, outs array<long>, last long"
BEFORE = "_slice int, in_key string, in_last long"


def key_runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal keys."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=int)
    return list(zip(starts.tolist(), np.append(starts[1:], len(keys)).tolist(), strict=True))


def walk(times: list[int], carried: list[bool], last: int | None, width: int) -> tuple[list[bool], list[int | None], int | None]:
    """Which alerts of one key, in order, are sent; the send before each; and the last send. A carried row is a send
    of an earlier run and no alert."""
    sent, before = [], []
    for t, old in zip(times, carried, strict=True):
        before.append(last)
        go = old or last is None or t - last > width
        sent.append(go)
        if go:
            last = t
    return sent, before, last


def step_map(times: np.ndarray, width: int) -> tuple[list[int], list[int]]:
    """The last send after a run of alerts, as a function of the last send before it: ``outs[j]`` for the first
    ``bounds[j]`` above it; above all bounds nothing is sent and the send before stays."""
    following = np.searchsorted(times, times + width, side="right").tolist()
    outs, t = [0] * len(times), times.tolist()
    for i in range(len(t) - 1, -1, -1):
        outs[i] = outs[following[i]] if following[i] < len(t) else t[i]
    bounds = times - width
    n = min(len(t), int(np.searchsorted(bounds, t[0], side="right")) + 1)  # a send before the run is not later than its first alert
    ends = np.append(np.flatnonzero(np.diff(outs[:n])), n - 1)
    return bounds[ends].tolist(), np.array(outs)[ends].tolist()


def apply_map(bounds: list[int], outs: list[int], last: int | None) -> int | None:
    if last is None:
        return outs[0]
    j = int(np.searchsorted(bounds, last, side="right"))
    return outs[j] if j < len(bounds) else last


def compose(first: tuple[list[int], list[int]], second: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    """The second map after the first."""
    bounds, outs = list(first[0]), [apply_map(*second, o) for o in first[1]]
    for b, o in zip(*second, strict=True):
        if not bounds or b > bounds[-1]:
            bounds.append(b)
            outs.append(o)
    ends = [k for k in range(len(outs)) if k + 1 == len(outs) or outs[k] != outs[k + 1]]
    return [bounds[k] for k in ends], [outs[k] for k in ends]


def _summary(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_k", "_new", "_us", "_id"], kind="stable")
        keys, times, new = pdf["_k"].to_numpy(), pdf["_us"].to_numpy(np.int64), pdf["_new"].to_numpy(bool)
        a, b = key_runs(keys)[-1]
        single, bounds, outs, last = a == 0, None, None, None
        if single and new[0]:
            bounds, outs = step_map(times, width)
        elif single:  # begins with a carried send, so it is the key's first slice
            bounds, outs = [END], [walk(times.tolist(), (~new).tolist(), None, width)[2]]
        else:
            last = walk(times[a:b].tolist(), (~new[a:b]).tolist(), None, width)[2]
        return pd.DataFrame({"_slice": [int(pdf["_slice"].iloc[0])], "first_key": [keys[0]], "last_key": [keys[-1]], "single": [single], "bounds": [bounds], "outs": [outs], "last": pd.array([last], dtype="Int64")})
    return run


def _maps(pdf: pd.DataFrame) -> list[dict]:
    rows = pdf.sort_values("_slice").to_dict("records")
    for r in rows:
        r["last"] = None if pd.isna(r["last"]) else int(r["last"])
        if r["single"]:
            r["bounds"], r["outs"] = [int(x) for x in r["bounds"]], [int(x) for x in r["outs"]]
    return rows


def _step(state: tuple[str | None, int | None], row: dict) -> tuple[str, int | None]:
    """The (key, last send) after a slice."""
    if not row["single"]:
        return row["last_key"], row["last"]
    return row["last_key"], apply_map(row["bounds"], row["outs"], state[1] if state[0] == row["first_key"] else None)


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = _maps(pdf)
    joint, state = None, (None, None)  # the joint map while all slices are of the first one's key, else the state
    for k, r in enumerate(rows):
        if k == 0 and r["single"]:
            joint = r["bounds"], r["outs"]
        elif joint is not None and r["single"] and r["first_key"] == rows[0]["first_key"]:
            joint = compose(joint, (r["bounds"], r["outs"]))
        else:
            joint, state = None, _step(state, r)
            continue
        state = r["last_key"], None  # known once the map is applied; a later slice of the key composes instead
    single = joint is not None
    return pd.DataFrame({"_slice": [rows[0]["_slice"] // FAN], "first_key": [rows[0]["first_key"]], "last_key": [rows[-1]["last_key"]], "single": [single],
                         "bounds": [joint[0] if single else None], "outs": [joint[1] if single else None], "last": pd.array([None if single else state[1]], dtype="Int64")})


def _handed_down(pdf: pd.DataFrame) -> pd.DataFrame:
    first = pdf.iloc[0]
    state = (None if pd.isna(first["in_key"]) else first["in_key"], None if pd.isna(first["in_last"]) else int(first["in_last"]))
    out = []
    for r in _maps(pdf.drop(columns=["in_key", "in_last"])):
        out.append((r["_slice"], *state))
        state = _step(state, r)
    return pd.DataFrame({"_slice": [o[0] for o in out], "in_key": [o[1] for o in out], "in_last": pd.array([o[2] for o in out], dtype="Int64")})


def incoming_sends(slices: DataFrame, width: int) -> DataFrame:
    """(slice, key, last send) just before each slice; the key is null before the first."""
    spark = slices.sparkSession
    levels = [cut_lineage(slices.groupBy("_slice").applyInPandas(_summary(width), MAP))]
    group = F.floor(F.col("_slice") / FAN).cast("int")
    while levels[-1].agg(F.max("_slice")).first()[0] not in (None, 0):
        levels.append(cut_lineage(levels[-1].groupBy(group.alias("_group")).applyInPandas(_composed, MAP)))
    before = spark.createDataFrame([(0, None, None)], BEFORE)
    for maps in reversed(levels[:-1]):
        known = before.select(F.col("_slice").alias("_group"), "in_key", "in_last")
        before = cut_lineage(maps.withColumn("_group", group).join(known, "_group").groupBy("_group")
                             .applyInPandas(lambda pdf: _handed_down(pdf.drop(columns="_group")), BEFORE))
    return before


def _walked(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_k", "_new", "_us", "_id"], kind="stable")
        keys, times, new = pdf["_k"].to_numpy(), pdf["_us"].tolist(), pdf["_new"].to_numpy(bool)
        in_key, in_last = pdf["in_key"].iloc[0], pdf["in_last"].iloc[0]
        sent: list[bool] = []
        before: list[int | None] = []
        for a, b in key_runs(keys):
            last = int(in_last) if keys[a] == in_key and not pd.isna(in_last) else None
            s, p, _ = walk(times[a:b], (~new[a:b]).tolist(), last, width)
            sent += s
            before += p
        return pd.DataFrame({"_slice": pdf["_slice"].to_numpy(), "_id": pdf["_id"].to_numpy(), "sent": sent, "_before": pd.array(before, dtype="Int64")})[new]
    return run


def cooldown(alerts: DataFrame, key: str, ts: str, id_col: str, seconds: int = 3600, carried: DataFrame | None = None,
             n_slices: int | None = None) -> DataFrame:
    """W7 + W7b: ``sent`` per alert and, for suppressed ones, ``minutes_remaining``
    = trunc((cooldown − (now − last_sent)) / 60). ``id_col`` must be unique; order is (time, id).

    A null key is a key of its own. An alert without a time is not sent and has no minutes. ``carried`` holds the
    last send of some keys from earlier alerts (``key``, ``last_sent`` in microseconds)."""
    width = seconds * MICROS
    named = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))
    rows = alerts.withColumns({"_k": named, "_new": F.lit(True), "_us": F.unix_micros(F.col(ts).cast("timestamp")), "_id": F.col(id_col)})
    if carried is not None:
        rows = rows.unionByName(carried.select(named.alias("_k"), F.lit(False).alias("_new"), F.col("last_sent").alias("_us"),
                                             F.lit(0).cast(alerts.schema[id_col].dataType).alias("_id")), allowMissingColumns=True)
    slices = sorted_slices(rows, [F.col("_k"), F.col("_new"), F.col("_us"), F.col("_id")], n_slices)
    timed = slices.where("_us IS NOT NULL").select("_slice", "_k", "_new", "_us", "_id")
    before = incoming_sends(timed, width)
    id_type = slices.schema["_id"].dataType
    out = T.StructType([T.StructField("_slice", T.IntegerType()), T.StructField("_id", id_type), T.StructField("sent", T.BooleanType()), T.StructField("_before", T.LongType())])
    walked = timed.join(before, "_slice").groupBy("_slice").applyInPandas(_walked(width), out).drop("_slice")
    result = slices.where("_new").join(walked, "_id", "left")
    left = (F.lit(width) - (F.col("_us") - F.col("_before"))) / F.lit(60 * MICROS)
    return result.select(*alerts.columns, F.coalesce("sent", F.lit(False)).alias("sent"), F.when(~F.col("sent"), left.cast("int")).alias("minutes_remaining"))
