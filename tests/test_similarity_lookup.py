"""Cosine top-k and substring lookup against brute force on small catalogues."""
import math
import random
import re

import pytest
from storepulse.operators import similarity as M
from storepulse.operators.lookup import substring_lookup

WORDS = ["red", "blue", "ring", "gear", "bolt", "old", "new", "brand", "kit", "pro", "x1", "alpha"]


def _catalog(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(0, 4))]
        rows.append((i, " ".join(words) if words else "a", rnd.choice(["A", "B", "C"])))
    return rows


def _brute(rows, k):
    docs = {p: f"{n} {c}".lower() for p, n, c in rows}
    toks = {p: [t for t in re.findall(r"\b\w\w+\b", d) if t not in M.STOP_WORDS] for p, d in docs.items()}
    counts = {}
    for ts in toks.values():
        for t in ts:
            counts[t] = counts.get(t, 0) + 1
    vocab = {t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:100]}
    n = len(docs)
    df = {t: sum(1 for ts in toks.values() if t in ts) for t in vocab}
    vec = {}
    for p, ts in toks.items():
        w = {}
        for t in ts:
            if t in vocab:
                w[t] = w.get(t, 0) + 1
        w = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in w.items()}
        norm = math.sqrt(sum(v * v for v in w.values())) or 1.0
        vec[p] = {t: v / norm for t, v in w.items()}
    out = {}
    for p in docs:
        sims = [(round(sum(v * vec[q].get(t, 0.0) for t, v in vec[p].items()), 9), q) for q in docs if q != p]
        sims.sort(key=lambda x: (-x[0], x[1]))
        out[p] = [q for _, q in sims[:k]]
    return out


def _top(docs, k):
    got = {}
    for r in M.similar_products(docs, k).collect():
        got.setdefault(r.source, []).append((r.rank, r.target))
    return {p: [t for _, t in sorted(v)] for p, v in got.items()}


@pytest.mark.parametrize("seed,tile_rows", [(1, 1024), (2, 7), (3, 1), (4, 25)])
def test_similar_products_exact(spark, monkeypatch, seed, tile_rows):
    monkeypatch.setattr(M, "TILE_ROWS", tile_rows)
    rows = _catalog(60, seed)
    docs = spark.createDataFrame(rows, "position long, name string, category string").withColumn(
        "content", M.product_content())
    assert _top(docs, 5) == _brute(rows, 5)


def test_long_texts_with_many_frequent_terms(spark, monkeypatch):
    """Texts of 15 and more frequent terms: exact, and far fewer candidate rows than pairs."""
    monkeypatch.setattr(M, "TILE_ROWS", 32)
    rnd = random.Random(11)
    vocab = [f"term{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(vocab[30 * (i % 2):30 * (i % 2) + 30]) for _ in range(rnd.randint(20, 40))), "A") for i in range(240)]
    docs = spark.createDataFrame(rows, "position long, name string, category string").withColumn("content", M.product_content())
    made, plain = [], M._signature_sims

    def counted(*args):
        made.append(plain(*args))
        return made[-1]

    monkeypatch.setattr(M, "_signature_sims", counted)
    assert _top(docs, 5) == _brute(rows, 5)
    assert made[0].count() <= 240 * 6 * 8 < 240 * 240 / 3


def test_similarity_symmetric_and_bounded(spark):
    rows = _catalog(80, 21)
    docs = spark.createDataFrame(rows, "position long, name string, category string").withColumn(
        "content", M.product_content())
    sims = {(r.source, r.target): r.similarity for r in M.similar_products(docs, 10).collect()}
    assert all(-1e-12 <= v <= 1 + 1e-9 for v in sims.values())
    for (a, b), v in sims.items():
        if (b, a) in sims:
            assert abs(v - sims[(b, a)]) < 1e-9


def test_twins_and_tiny_catalogue(spark):
    rows = [(0, "same thing", "A"), (1, "same thing", "A"), (2, "zz", "B")]
    docs = spark.createDataFrame(rows, "position long, name string, category string").withColumn(
        "content", M.product_content())
    got = {(r.source, r.rank): (r.target, round(r.similarity, 6)) for r in M.similar_products(docs, 5).collect()}
    assert got[(0, 1)] == (1, 1.0) and got[(1, 1)] == (0, 1.0)
    assert got[(2, 1)][1] == 0.0 and len([k for k in got if k[0] == 2]) == 2  # fewer than k+1 products


def test_substring_lookup(spark):
    names = [(i, n) for i, n in enumerate(["Red Ring", "blue GEAR", "red gear pro", "X", "ab-cd", "Ring"])]
    products = spark.createDataFrame(names, "pos long, name string")
    queries = ["ring", "GEAR", "red g", "x", "b-", "", "zzz", "ab", "d"]
    q = spark.createDataFrame([(s,) for s in queries], "query string")
    got = {r.query: r.pos for r in substring_lookup(q, "query", products, "name", "pos").collect()}
    exp = {}
    for s in queries:
        hits = [i for i, n in names if s.lower() in n.lower()]
        if hits:
            exp[s] = min(hits)
    assert got == exp


def test_substring_lookup_brute_force(spark):
    """Long and short queries, repeated and null names, grams that occur in every name, repeated patterns."""
    rnd = random.Random(21)
    text = lambda n: "".join(rnd.choice("aAb c") for _ in range(n))
    names = [(i, text(rnd.randrange(0, 30))) for i in range(300)] + [(400 + i, "Aaaaaaaaaa") for i in range(5)] + [(-1, None)]
    queries = [text(rnd.randrange(0, 9)) for _ in range(150)] + [n[3:15] for _, n in names[:60] if n] + ["aaaaaaaaaa", "aaaaaaaaaaa", None]
    got = substring_lookup(spark.createDataFrame([(s,) for s in queries], "query string"), "query", spark.createDataFrame(names, "pos long, name string"), "name", "pos").collect()
    want = {}
    for s in queries:
        hits = [i for i, n in names if s is not None and n is not None and s.lower() in n.lower()]
        if hits:
            want[s] = min(hits)
    assert {r.query: r.pos for r in got} == want and len(got) == len(want)
    assert all(dict(names)[r.pos] == r.name for r in got)
    nothing = spark.createDataFrame([], "pos long, name string")
    assert substring_lookup(spark.createDataFrame([("",), ("abc",)], "query string"), "query", nothing, "name", "pos").count() == 0


def test_tile_peaks_in_parts(spark, monkeypatch):
    """The largest weights of the tiles reach the tasks in parts; the lists stay those of brute force."""
    monkeypatch.setattr(M, "TILE_ROWS", 7)
    monkeypatch.setattr(M, "PEAK_TILES", 3)
    rows = _catalog(90, 5)
    docs = spark.createDataFrame(rows, "position long, name string, category string").withColumn("content", M.product_content())
    assert _top(docs, 4) == _brute(rows, 4)
