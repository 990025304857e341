"""Window functions and per-key sequences (§2.7).

Scale notes. A window ``partitionBy(key)`` sends every row of a key to one task, so a key that
holds a third of the data becomes a third of the job in one task. The operators here avoid that:

* ``trailing_count`` (W1) partitions by (key, time bucket). Each row is also copied, with only its
  key and time, into the following bucket, so a bucket sees every row that can fall in the
  trailing frame of its own rows. One shuffle, no join, and a hot key spreads over its buckets.
* ``prior_count`` (W2), ``changed_rows`` (W9), ranks (A14), positions (P3) and running totals (A21) work on
  sorted slices (``operators.slices``): bounded ranges of the whole order, with one small row per slice for
  what crosses them. The plan above is computed once, and rows without a key or a time are ranged like others.
* ``first_by_key`` / ``latest_by_key`` (W3/W4) are ``min_by``/``max_by`` aggregates, which combine
  partially before the shuffle, so a hot key ships one row per map task.
* top-k per key uses ``row_number() <= k``; Spark inserts a partial ``WindowGroupLimit`` before
  the exchange, so at most k rows per key leave each map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.operators.slices import previous_value, ranked_rows, running_sum

MICROS = 1_000_000


def _us(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int = 3600,
                   out: str = "orders_last_hour", context: DataFrame | None = None) -> DataFrame:
    """Rows of the same key with ``now − t < seconds``, this row included.

    Exactly ``seconds`` old is out of the frame. Rows with the same key and the same timestamp are
    peers of a RANGE frame and count each other (the reference handles them one after another).
    ``context`` (key, ts) rows are counted but not returned — e.g. remembered rows of earlier
    micro-batches.
    """
    width = seconds * MICROS
    cols = df.columns
    base = df.withColumn("_us", _us(ts))
    if context is not None:
        ctx = context.select(*[F.col(c) if c == key else F.lit(None).cast(t).alias(c) for c, t in df.dtypes],
                             _us(F.col(ts)).alias("_us"))
        base = base.withColumn("_ctx", F.lit(False)).unionByName(ctx.withColumn("_ctx", F.lit(True)))
    base = base.withColumn("_b", F.floor(F.col("_us") / F.lit(width)))
    # Every row of bucket b can reach back at most into bucket b-1, so bucket b+1 receives a
    # context copy of each row of b. The copy is made by exploding two markers in the same pass
    # (no union, so the upstream plan runs once) and carries only the key and time.
    marks = F.array(F.struct(F.col("_b").alias("b"), F.lit(True).alias("real")),
                    F.struct((F.col("_b") + 1).alias("b"), F.lit(False).alias("real")))
    real = F.col("_m.real") & ~F.col("_ctx") if context is not None else F.col("_m.real")
    both = base.withColumn("_m", F.explode(marks)).select(
        *[F.col(c) if c == key else F.when(F.col("_m.real"), F.col(c)).alias(c) for c in cols],
        "_us", F.col("_m.b").alias("_b"), real.alias("_real"))
    w = Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(-(width - 1), 0)
    return (both.withColumn(out, F.count(F.lit(1)).over(w).cast("int"))
            .filter("_real").select(*cols, out))


def velocity_alerts(df: DataFrame, col: str = "orders_last_hour", above: int = 3) -> DataFrame:
    """Rows whose trailing count exceeds ``above``."""
    return df.filter(F.col(col) > above)


def prior_count(df: DataFrame, key: str, ts: str, tiebreak: str, out: str = "prior_orders") -> DataFrame:
    """Number of earlier rows of the key, ordered by (ts, tiebreak); rows without a time come first, and
    a null key is one key."""
    return ranked_rows(df, key, [F.col(ts), F.col(tiebreak)], out, start=0)


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key by ``order`` (null key is one key) — ``min_by`` aggregate."""
    others = [c for c in df.columns if c != key]
    packed = df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r"))
    return packed.select(key, "_r.*")


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """``DISTINCT ON (key) ORDER BY key, order DESC`` — newest row per key.

    Ties on ``order`` resolve to the largest remaining columns, so the answer is deterministic."""
    others = [c for c in df.columns if c != key]
    packed = df.groupBy(key).agg(F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in others])).alias("_r"))
    return packed.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def top_k_per_key(df: DataFrame, key, order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Rank 1..k within each key by ``order``."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def changed_rows(df: DataFrame, value: str, ts: str, tiebreak: str, key: str) -> DataFrame:
    """Rows whose ``value`` is set and differs from the previous row of the key in (ts,
    tiebreak) order; the first row of a key is kept."""
    j = previous_value(df, key, [F.col(ts), F.col(tiebreak)], value, "_before")
    return j.filter(F.col(value).isNotNull() & (~F.col("_before.some") | ~F.col(value).eqNullSafe(F.col("_before.v")))).drop("_before")


def with_position(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """Dense 0-based position in ``order`` without a single-partition window (a distributed
    rank over one constant key)."""
    return ranked_rows(df.withColumn("_all", F.lit(0)), "_all", order, out, start=0).drop("_all")


def rank_within_key(df: DataFrame, key: str, order: list[Column], out: str = "rank",
                    num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row within its key in ``order`` — exact, however hot a key is."""
    return ranked_rows(df, key, order, out, n=num_partitions)


def running_total(df: DataFrame, order: list[Column], value: str, out: str = "running",
                  num_partitions: int | None = None, inclusive: bool = True) -> DataFrame:
    """Global running sum of ``value`` in ``order`` without a single-partition window.
    ``inclusive=False`` excludes the current row."""
    return running_sum(df, order, value, out, inclusive, num_partitions)
