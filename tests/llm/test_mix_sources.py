import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storepulse.llm.mix_sources import choose_blocks, highest_quotients, mix_sources, mixed_texts, numbered, row_key, source_targets, word_count
from storepulse.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_targets():
    assert source_targets([("a", 100), ("b", 100), ("c", 100)]) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    sizes = [("a", 10), ("b", 500), ("c", 70), ("d", 0), ("e", 31), (None, 999)]
    got = source_targets(sizes)
    assert sum(got) == pytest.approx(1.5 * 1610) and all(t <= 2 * n for t, (_, n) in zip(got, sizes, strict=True))
    unit = {t / w for t, w, (_, n) in zip(got, (5, 2, 1, 5, 2, 1), sizes, strict=True) if t < 2 * n}
    assert max(unit) - min(unit) < 1e-6 and all(2 * n <= max(unit) * w + 1e-6 for t, w, (_, n) in zip(got, (5, 2, 1, 5, 2, 1), sizes, strict=True) if t == 2 * n)
    assert source_targets([]) == [] and source_targets([("a", 0)]) == [0.0]


def test_highest_quotients_equal_one_by_one():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        votes, caps, seats = rng.random(n) * 30, rng.integers(0, 25, n), int(rng.integers(0, 60))
        plain = np.zeros(n, dtype=int)
        for _ in range(min(seats, caps.sum())):
            q = np.where(plain < caps, votes / (2 * plain + 1), -1)
            plain[q.argmax()] += 1
        assert (highest_quotients(votes, caps, seats) == plain).all()


def test_blocks_are_seeded():
    a = choose_blocks(100, 150, 5)
    assert a.sum() == 150 and set(a) == {1, 2} and (a == choose_blocks(100, 150, 5)).all() and (a != choose_blocks(100, 150, 6)).any()


def test_query(spark):
    docs = {r.doc_id: (len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_mix_sources"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op6_mix_sources"](spark, SF).collect()))
    totals = {}
    for n, s in docs.values():
        totals[s] = totals.get(s, 0) + n
    order = sorted(totals, key=lambda s: (s is None, s))
    targets = dict(zip(order, source_targets([(s, totals[s]) for s in order]), strict=True))
    taken = {}
    assert len(rows) == len(docs)
    for r in rows:
        n, s = docs[r.doc_id]
        assert (r.size, r.source_size) == (n, totals[s]) and r.target == pytest.approx(targets[s]) and 0 <= r.taken <= 2 * n
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= 200 for s in order)


def sized(df):
    return df.withColumn("size", word_count(F.col("text")))


def test_many_cells_and_ranges(spark):
    docs = sized(spark.read.parquet(f"{SF}/documents.parquet"))
    sizes = docs.select("doc_id", "source", "size")
    mixed = mix_sources(docs, sizes, cell_words=3000, block_words=16).cache()
    sums = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 0.03 * r.g for r in sums)
    ranged = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, x: a + x["to_word"] - x["from_word"])
    assert mixed.where(ranged != F.col("taken")).count() == 0
    out = mixed_texts(docs, sizes, cell_words=3000, block_words=16)
    assert out.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
    words = {r.doc_id: r.w for r in out.groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("w")).collect()}
    assert words == {r.doc_id: r.taken for r in mixed.where("taken > 0").select("doc_id", "taken").collect()}
    assert out.where("n_chars <> length(text)").count() == 0
    mixed.unpersist()


def test_edges(edge_docs, empty_docs):
    docs = sized(edge_docs)
    rows = mix_sources(docs, docs.select("doc_id", "source", "size"), block_words=4).collect()
    assert len(rows) == 15 and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert {r.taken for r in rows if r.size == 0} == {0}
    none = sized(empty_docs)
    sizes = none.select("doc_id", "source", "size")
    assert mix_sources(none, sizes).count() == 0 and mixed_texts(none, sizes).count() == 0


def test_rows_that_share_an_id(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    rows = [(None, "a", text(k)) for k in range(400)] + [(7, "a", text(k)) for k in range(400)] + [(None, "a", "same " * 20)] * 400 + [(k + 10, None, text(k)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    deal = {"deal_cols": ("_key", "_nth"), "cell_words": 400, "block_words": 4}

    def made(parts):
        ready = numbered(sized(docs.repartition(parts)).withColumn("_key", row_key()))
        return ready, ready.select("doc_id", "source", "size", "_key", "_nth")

    ready, sizes = made(5)
    assert ready.count() == 1500 and ready.select("_key", "_nth").distinct().count() == 1500 and ready.where("text LIKE 'same%'").agg(F.max("_nth")).first()[0] == 399
    count = (lambda rows: pa.table({"n": [rows.num_rows]}), T.StructType([T.StructField("n", T.LongType())]))
    cells = [r.n for r in mix_sources(ready, sizes, finish=count, **deal).collect()]
    assert sum(cells) == 1500 and max(cells) < 60
    plain = sizes.drop("_key", "_nth")
    assert max(r.n for r in mix_sources(plain, plain, finish=count, cell_words=400, block_words=4).collect()) >= 400  # what the columns are for
    first, again = (sorted(map(str, mixed_texts(*made(n), **deal).collect())) for n in (5, 2))
    assert first == again


def test_numbering_rows_leaves_texts_where_they_lie(spark):
    """The few rows that repeat others are known before the join, so the texts are not dealt out for it."""
    docs = spark.createDataFrame([(i % 590, f"s{i % 3}", f"text {i % 590} " * 60) for i in range(600)], "doc_id long, source string, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        out = numbered(docs.withColumn("source", F.lit("s")).withColumn("_key", row_key()))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert sorted(r[0] for r in out.select("_nth").collect()) == [0] * 590 + [1] * 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_targets_reach_the_tasks_without_python_workers(spark):
    """The table of sources is a local relation: rows from a list would start Python workers of another kind, which stay on."""
    docs = spark.createDataFrame([(1, "a", 3), (2, None, 4), (3, "a", 0)], "doc_id long, source string, size long")
    out = mix_sources(docs, docs, block_words=1)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") >= 2
    assert {(r.doc_id, r.source_size, r.target) for r in out.collect()} == {(1, 3, 6.0), (2, 4, 4.5), (3, 3, 6.0)}
