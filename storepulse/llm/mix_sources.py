"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. *Targets.* Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``share`` times
   all words; a target stops at ``most`` times its source's size and the excess is shared anew.
2. *Cells and shards.* A source's rows are dealt by a seeded hash into cells of about ``cell_words`` words, so a
   hot source becomes many cells. With the columns of ``numbered`` the hash covers id, source, text and the row's
   number among equal rows, so neither null nor repeated ids meet in a cell. Each shard holds at most one cell
   of a source.
3. *Quotas.* Every shard hands its blocks to its cells by highest quotients ``target / (2 k + 1)``.
4. *Selection.* A cell's documents stand in seeded order, cut into blocks of ``block_words`` words (the last
   may be shorter). A quota takes all blocks once as often as it can, then the first ones of a seeded
   permutation. A document's ``taken`` words are the blocks' overlap with it.

The driver sees one row per source; cells and documents stay in Spark.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storepulse.llm.worker import give_back
from storepulse.session import cut_lineage

WEIGHTS = (5, 2, 1)  # fixed values: weights of the sources in their order, repeating
WORD = r"[^\x20\x09-\x0D]+"
MAX_SOURCES = 1_000_000  # sources whose totals fit the driver; more is an error, not a cut


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: list[tuple[str | None, int]], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets of sources given in their order: weighted filling of ``share`` of all words up to the caps."""
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    caps = [most * n for _, n in sizes]
    left, open_ = share * sum(n for _, n in sizes), set(range(len(sizes)))
    targets = [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= caps[i]]
        for i in full or open_:
            targets[i] = caps[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(caps[i] for i in full)
        open_ -= set(full)
    return targets


def highest_quotients(votes: np.ndarray, caps: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Laguë seats with caps: the highest of ``votes / (2 k + 1)``, ties to the earlier row.

    All quotients above a threshold are granted at once, found by halving, and the last ones singly."""
    at = lambda unit: np.minimum(caps, np.floor(votes / unit + 0.5)).astype(np.int64)
    seats = int(min(seats, caps.sum()))
    if seats <= 0 or not (votes > 0).any():
        return np.zeros(len(votes), dtype=np.int64)
    low, high = votes.max() / (4.0 * seats + 4), 4 * votes.sum()
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid).sum() > seats else (low, mid)
    got = at(high)
    heap = [(-v / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, got, caps, strict=True)) if g < c and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def mixed_hash(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: one seeded order of block numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def choose_blocks(n: int, quota: int, key: int) -> np.ndarray:
    """How often each of ``n`` blocks is taken."""
    whole, rest = divmod(quota, n)
    times = np.full(n, whole, dtype=np.int64)
    order = np.argsort(mixed_hash(np.arange(n, dtype=np.uint64) + np.uint64(key & (2**64 - 1))), kind="stable")
    times[order[:rest]] += 1
    return times


def _runs(times: np.ndarray, start: int, end: int, block: int) -> list[dict]:
    """Word ranges of a document at [start, end) of its cell, per copy, relative to the document."""
    out = []
    first, last = start // block, (end - 1) // block
    own = times[first:last + 1]
    for copy in range(1, int(own.max()) + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], own >= copy, [False]]).astype(np.int8)))
        out += [{"copy": copy, "from_word": int(max(start, (first + a) * block) - start), "to_word": int(min(end, (first + b) * block) - start)}
                for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return out


def row_key(id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> Column:
    """Hash of a row's id, source and text."""
    return F.xxhash64(F.col(id_col).isNull(), id_col, F.col(source_col).isNull(), source_col, F.col(text_col).isNull(), text_col)


def numbered(rows: DataFrame, key_col: str = "_key", nth_col: str = "_nth") -> DataFrame:
    """``rows``, written once, with the row's number among those of its key, from 0 on.

    Numbers run within a key's rows of a written partition, after those of the partitions before, so a key that
    many rows share meets in no task. The rows with a number above 0 are written before the join, so Spark knows how
    few they are and leaves the texts where they lie."""
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    thin = rows.select(key_col, "_row", F.shiftright("_row", 33).alias("_part"))
    whole = W.partitionBy(key_col)
    parts = (thin.groupBy(key_col, "_part").agg(F.count("*").alias("_n"))
             .withColumns({"_all": F.sum("_n").over(whole), "_before": F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")}))
    nth = F.col("_before") + F.row_number().over(W.partitionBy(key_col, "_part").orderBy("_row")) - 1
    later = thin.join(parts.where("_all > 1"), [key_col, "_part"]).select("_row", nth.alias(nth_col)).where(F.col(nth_col) > 0)
    later = cut_lineage(later)
    return rows.join(later, "_row", "left").withColumn(nth_col, F.coalesce(nth_col, F.lit(0))).drop("_row")


RANGES_ARROW = pa.list_(pa.struct([("copy", pa.int32()), ("from_word", pa.int64()), ("to_word", pa.int64())]))
RANGES = "array<struct<copy:int,from_word:long,to_word:long>>"


def mix_sources(docs: DataFrame, sizes: DataFrame, seed: int = 17, share: float = 1.5, most: float = 2.0,
                block_words: int = 64, cell_words: int = 500_000, id_col: str = "doc_id", source_col: str = "source",
                size_col: str = "size", deal_cols: tuple[str, ...] = (), finish: tuple[Callable[[pa.Table], pa.Table], T.StructType] | None = None) -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``taken`` and ``ranges`` (taken word ranges per copy).

    ``docs`` has ``id_col``, ``source_col`` and ``size_col``; ``sizes`` is the same rows with these three
    columns and ``deal_cols`` only, already written, as it is read twice. ``deal_cols`` (key and number of
    ``numbered``) deal rows that share an id into different cells and order them. Rows of size 0 take 0. A null source is a source of
    its own; null ids and repeated rows are rows like any other. Empty table: empty result. Columns of the
    names added here are replaced. ``finish`` turns a cell's rows into others in the same task; rows of size 0
    are then left out."""
    spark = docs.sparkSession
    spec = T.StructType([*(f for f in docs.schema if f.name not in ("source_size", "target", "taken", "ranges")),
                         T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
                         T.StructField("taken", T.LongType()), T.StructField("ranges", T._parse_datatype_string(RANGES))])
    rows = sizes.groupBy(source_col).agg(F.sum(size_col).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("more sources than the driver can weigh")
    sources = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    targets = source_targets(sources, share, most)
    cells = [max(1, n // cell_words) for _, n in sources]
    shards = max(cells, default=1)
    numbers = np.arange(len(sources))
    plan = pa.table([pa.array(numbers, pa.int64()), pa.array([s for s, _ in sources], pa.string()), pa.array([n for _, n in sources], pa.int64()), pa.array(targets, pa.float64()),
                     pa.array(cells, pa.int64()), pa.array(numbers % shards, pa.int64())], names=["_no", "_source", "source_size", "target", "_cells", "_first"])
    # an Arrow table becomes a local relation; a list of rows would go through Python workers of another kind, which stay on
    plan = spark.createDataFrame(plan, "_no long, _source string, source_size long, target double, _cells long, _first long")

    def dealt(df: DataFrame) -> DataFrame:
        df = df.drop(*[c for c in ("source_size", "target", "taken", "ranges") if c in df.columns])
        key = F.xxhash64(F.lit(seed), id_col, source_col, size_col, *deal_cols)
        return (df.join(F.broadcast(plan), F.col(source_col).eqNullSafe(F.col("_source")))
                .withColumn("_cell", F.pmod(key, F.col("_cells"))).withColumn("_order", key))

    def quotas(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_no", "ascending"), ("_cell", "ascending")])
        words = rows.column("_words").to_numpy()
        votes = rows.column("target").to_numpy() * words / rows.column("source_size").to_numpy() / block_words
        granted = highest_quotients(votes, int(most) * -(-words // block_words), round(float(votes.sum())))
        return pa.table({"_no": rows.column("_no"), "_cell": rows.column("_cell"), "_quota": pa.array(granted)})

    totals = (dealt(sizes.where(F.col(size_col) > 0)).groupBy("_no", "_cell", "target", "source_size", ((F.col("_first") + F.col("_cell")) % shards).alias("_shard"))
              .agg(F.sum(size_col).alias("_words")))
    granted = totals.groupBy("_shard").applyInArrow(quotas, "_no long, _cell long, _quota long")

    def select(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("_order", *deal_cols, id_col, size_col)])
        no, cell = (int(k.as_py()) for k in key)
        ends = rows.column(size_col).to_numpy().cumsum()
        starts = np.concatenate([[0], ends[:-1]])
        times = choose_blocks(int(-(-ends[-1] // block_words)), rows.column("_quota")[0].as_py(), seed * 1_000_003 + no * 8_191 + cell)
        before = np.concatenate([[0], np.cumsum(times * block_words)])
        padded = np.append(times, 0)
        upto = lambda x: before[x // block_words] + padded[x // block_words] * (x % block_words)
        made = {"taken": pa.array(upto(ends) - upto(starts)),
                "ranges": pa.array([_runs(times, int(x), int(y), block_words) for x, y in zip(starts, ends, strict=True)], RANGES_ARROW)}
        out = pa.table({c: made[c] if c in made else rows.column(c) for c in spec.names})
        out = finish[0](out) if finish else out
        del rows, ends, starts, times, before, padded, made
        give_back()
        return out

    taken = dealt(docs.where(F.col(size_col) > 0)).join(granted, ["_no", "_cell"]).groupBy("_no", "_cell").applyInArrow(select, finish[1] if finish else spec)
    if finish:
        return taken
    none = dealt(docs.where(F.col(size_col) == 0)).withColumns({"taken": F.lit(0).cast("long"), "ranges": F.array().cast(RANGES)}).select(*spec.names)
    return taken.unionByName(none)


def mixed_texts(docs: DataFrame, sizes: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars", size_col: str = "size", **options) -> DataFrame:
    """The mix itself: one row per document and copy whose text is the taken words. A wholly taken document stays
    verbatim, else its taken runs keep their own spacing and are joined by line ends. Documents that the mix leaves
    out go. The columns are those of ``docs`` but ``size_col``, ``deal_cols`` and those that ``mix_sources`` adds."""
    keep = [c for c in docs.columns if c not in (size_col, *options.get("deal_cols", ()), "source_size", "target", "taken", "ranges")]
    schema = T.StructType([docs.schema[c] for c in keep])
    word = re.compile(WORD)

    def cut(rows: pa.Table) -> pa.Table:
        at, texts = [], []
        for i, (text, size, ranges) in enumerate(zip(rows.column(text_col).to_pylist(), rows.column(size_col).to_pylist(), rows.column("ranges").to_pylist(), strict=True)):
            spans, by_copy = None, {}
            for r in ranges:
                by_copy.setdefault(r["copy"], []).append((r["from_word"], r["to_word"]))
            for _, runs in sorted(by_copy.items()):
                at.append(i)
                if runs == [(0, size)]:
                    texts.append(text)
                else:
                    spans = spans or [m.span() for m in word.finditer(text)]
                    texts.append("\n".join(text[spans[x][0]:spans[y - 1][1]] for x, y in runs))
        chosen = rows.select(keep).take(pa.array(at, pa.int64()))
        return chosen.set_column(keep.index(text_col), text_col, pa.array(texts, pa.string()))

    out = mix_sources(docs, sizes, size_col=size_col, finish=(cut, schema), **options)
    return out.withColumn(n_chars_col, F.length(text_col).cast(schema[n_chars_col].dataType)) if n_chars_col in keep else out
