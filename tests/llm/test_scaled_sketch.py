import hashlib

import pytest
from pyspark.sql import functions as F

from storepulse.llm.queries import QUERIES
from storepulse.llm.scaled_sketch import containment, fingerprints, merge_sketches, resemblance, with_next, with_sketch
from tests.conftest import SF_SMALL


def grams(text):
    w = text.split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def edit(text, after):
    q = len(text) // 4
    return text[:len(text) - q] + after[:q]


def test_query_edits_and_likeness(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in QUERIES["op4_scaled_sketch"](spark, SF_SMALL).collect()}
    off, by_text = [], {}
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        r, e = got[i], edit(text, after)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        a, b = grams(text), grams(e)
        if min(len(a), len(b)) > 400:
            off.append(abs(r.near_edited - len(a & b) / min(len(a), len(b))))
    assert len(off) > 10 and sum(off) / len(off) < 0.05


def test_full_fraction_is_exact(spark):
    texts = [("a b c d e f g h", "b c d e f g h i j"), ("a b", "a b"), ("", ""), ("", "x"), ("x y z", "x y z w v u")]
    df = with_sketch(with_sketch(spark.createDataFrame(texts, "x string, y string"), "x", "sx", 1.0), "y", "sy", 1.0)
    for r in df.select("x", "y", containment(F.col("sx"), F.col("sy")).alias("c"), resemblance(F.col("sx"), F.col("sy")).alias("j")).collect():
        a, b = grams(r.x), grams(r.y)
        assert r.c == pytest.approx(1.0 if not a and not b else len(a & b) / min(len(a), len(b)) if a and b else 0.0)
        assert r.j == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_merging_equals_the_joint_sketch(spark):
    left, right = (" ".join(f"{p}{k}" for k in range(300)) for p in "ab")
    df = spark.createDataFrame([(left, right, "one two", "a0 a1 a2 a3 a4 b0")], "l string, r string, s string, m string")
    for c in "lrsm":
        df = with_sketch(df, c, f"k{c}")
    r = df.select("kl", "kr", "ks", merge_sketches(F.col("kl"), F.col("kr")).alias("lr"), merge_sketches(F.col("kl"), F.col("ks")).alias("ls")).first()
    assert set(r.lr) == set(r.kl) | set(r.kr) and len(r.ks) == 1
    assert set(r.ls) - set(r.ks) == set(r.kl) - set(r.ks)


@pytest.mark.parametrize("ids", [[3, 1, 2], [5], [None, 4, 4, 9], [None, None], list(range(100, 160)), [7, 7, 7], []])
def test_next_row(spark, ids):
    df = spark.createDataFrame([(i, f"t{k:02d}") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = sorted(((i, f"t{k:02d}") for k, i in enumerate(ids)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted((t, rows[(k + 1) % len(rows)][1]) for k, (_, t) in enumerate(rows))
    assert sorted((r.text, r.next_text) for r in with_next(df, "doc_id", ["text"], ["text"]).collect()) == want


def test_edges(edge_docs, empty_docs):
    rows = fingerprints(edge_docs).collect()
    assert len(rows) == 15
    assert {len(r.sketch) for r in rows if r.n_chars == 0} == {0}
    assert len({tuple(r.sketch) for r in rows if r.doc_id in (5, 6)}) == 1
    assert fingerprints(empty_docs).count() == 0
