import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from storepulse.llm.block_search import Collection, Ranker, count_terms, search_documents
from storepulse.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    """Score of every pair, by the contract's formula."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    holding = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in sorted({x for x in items if x[1] is not None}, key=str):
        scored = []
        for i, c in counted:
            m = 100 - 25 + (25 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def test_terms():
    for text in ("", "Ab1-é漢\x7fÀb _x\x00y", "ÄÖ" * 10, "a b A", None, "\n\t9"):
        assert count_terms(text) == Counter(t.encode() for t in terms(text))
    long = "Word wörd, " * 300_000  # more than a chunk
    assert count_terms(long) == Counter({b"word": 300_000, "wörd".encode(): 300_000})


def test_equals_brute_force(spark):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["The", "the", "é"]
    docs = [(k if k % 50 else None, " ".join(rnd.choice(words[:4 + k % 60]) for _ in range(rnd.randrange(1, 30)))) for k in range(900)]
    docs += docs[:40] + [(5000 + k, "w1 w2 w3") for k in range(60)] + [(9000, None), (9001, ""), (9002, "...")]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 12)))) for k in range(40)] + [(3, "w1 w1 w2"), (3, "w1 w1 w2"), (None, "w5"), (77, None), (78, "unheard of")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for query_bytes in (1 << 20, 200):  # one block of queries, and several
        got = search_documents(frame, asked, query_bytes=query_bytes).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_blocks_are_skipped_and_nothing_is_lost():
    rnd = random.Random(9)
    size, topics = 80, [rnd.sample(range(80), 10) for _ in range(30)]
    docs = [Counter(rnd.choice(topics[k % 30]) for _ in range(rnd.randrange(5, 40))) for k in range(3000)]
    n = np.array([c.total() for c in docs])
    holding = Counter(t for c in docs for t in c)
    weights = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * holding[t] + 1))) for t in range(size)])
    collection = Collection(len(docs), int(n.sum()), weights)
    queries = [dict(Counter(rnd.choice(topics[k]) for _ in range(5))) for k in range(30)]
    ranker = Ranker(collection, queries, 20)
    for a in range(0, 3000, 1000):
        part = docs[a:a + 1000]
        ranker.add(list(range(a, a + 1000)), n[a:a + 1000], np.array([len(c) for c in part]), np.array([t for c in part for t in c]), np.array([x for c in part for x in c.values()]))
    for q, best in zip(queries, ranker.best, strict=True):
        scores = []
        for i, c in enumerate(docs):
            m = 75 + (25 * c.total() * len(docs)) // int(n.sum())
            scores.append((-sum(x * int(weights[t]) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, x in q.items() if c[t]), False, i))
        assert best == sorted(s for s in scores if s[0] < 0)[:20]
    assert ranker.skipped > ranker.opened  # within the lists that are visited at all


def test_edges(spark, edge_docs, empty_docs):
    items = spark.createDataFrame([(1, "one two"), (2, "漢字"), (3, "the of")], "item_id long, text string")
    docs = edge_docs.withColumnRenamed("score", "rank")
    got = search_documents(docs, items).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in edge_docs.collect()], [(1, "one two"), (2, "漢字"), (3, "the of")])
    assert search_documents(empty_docs, items).count() == 0
    assert search_documents(docs, items.limit(0)).count() == 0
    assert search_documents(docs.withColumn("text", F.lit(None).cast("string")), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_SMALL}/{name}.parquet'")
    want = con.sql(ORACLE["op11_block_search"])
    got = QUERIES["op11_block_search"](spark, SF_SMALL).select(*want.columns).collect()
    assert got and sorted(map(tuple, got)) == sorted(want.fetchall())
