import random
import re

import pytest

from storepulse.llm import ngram_join as M
from storepulse.llm.ngram_join import near_documents
from storepulse.llm.queries import QUERIES
from storepulse.session import cut_lineage
from tests.conftest import SF_SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs):
    """Brute force over all pairs: n_shingles and component_id by id."""
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_documents(df).collect()}


def family(rnd, n, size, edits):
    base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def documents():
    rnd = random.Random(5)
    texts = family(rnd, 40, 60, 6) + family(rnd, 25, 14, 2) + family(rnd, 25, 9, 1) + family(rnd, 12, 8, 1) + family(rnd, 10, 200, 20)
    passage = " ".join(f"p{k}" for k in range(50))
    texts += [f"{' '.join(f'u{rnd.randrange(10**6)}' for _ in range(30))} {passage} {' '.join(f'v{rnd.randrange(10**6)}' for _ in range(12))}" for _ in range(30)]
    texts += [" ".join(f"s{k}" for k in range(n)) for n in range(1, 16)] + [texts[0]] * 9 + [texts[50].upper()] * 3 + ["", None, " \n"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_equals_brute_force(spark, documents):
    assert run(spark, documents) == plain(documents)


def test_split_lists_no_frequent_table_and_no_light_sets(spark, documents, monkeypatch):
    monkeypatch.setattr(M, "LIST_SPLIT", 4)
    monkeypatch.setattr(M, "FULL_SCAN", 0)
    assert run(spark, documents) == plain(documents)
    monkeypatch.setattr(M, "FREQUENT", 1)
    monkeypatch.setattr(M, "light_boundary", lambda h: 0)
    assert run(spark, documents) == plain(documents)
    monkeypatch.setattr(M, "light_boundary", lambda h: 9)
    monkeypatch.setattr(M, "CROSS_BLOCK", 3)
    monkeypatch.setattr(M, "PAIR_SLICE", 7)
    assert run(spark, documents) == plain(documents)


def test_near_copies_under_the_threshold(spark):
    """Groups of copies with three of 100 words changed: most pairs miss the threshold. The pairs that leave the tasks of
    the full scan stay in proportion to the group, and no link is lost."""
    made = {}
    for size in (100, 200, 400):
        rnd = random.Random(size)
        base = [f"w{k}" for k in range(100)]
        docs = []
        for i in range(size):
            words = list(base)
            for k in rnd.sample(range(100), 3):
                words[k] = f"x{rnd.randrange(10**9)}"
            docs.append((i, " ".join(words)))
        counted = []
        cross = M._cross_pairs

        def spy(named, counts, cross=cross, counted=counted):
            out = cut_lineage(cross(named, counts))
            counted.append(out.count())
            return out

        M._cross_pairs = spy
        try:
            assert run(spark, docs) == plain(docs)
        finally:
            M._cross_pairs = cross
        made[size] = sum(counted)
    assert made[400] <= 8 * 400 and made[400] <= 16 * max(made[100], 25), made


def test_list_lengths_move_no_counts(spark, capsys):
    """The bucket counts, the widest column, are not part of the shuffle by shingle that tells a list's length."""
    named = cut_lineage(spark.createDataFrame([(1, 0, 7, True, 5, 5, True, 7)], "shingle long, part long, key long, indexed boolean, n long, open long, whole boolean, root long"))
    counts = cut_lineage(spark.createDataFrame([(7, bytearray(128))], "key long, counts binary"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        M._cross_pairs(named, counts).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    nodes = [x for x in capsys.readouterr().out.split("\n\n") if "Exchange\n" in x and "hashpartitioning(shingle" in x]
    assert nodes and not any("counts#" in x for x in nodes)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_ngram_join"](spark, SF_SMALL).collect()} == plain(docs)


def test_prefixes_and_counts_hold():
    for n in range(1, 80):
        for m in range(1, 80):
            c = M.least_common(n, m)
            links = [k for k in range(min(n, m) + 1) if 100 * k >= 75 * (n + m - k)]
            assert (links[0] == c) if links else c > min(n, m)
            assert bool(links) == (m in M.sizes_near(n))
            if links and m <= n:  # the first common shingle stands in both prefixes
                assert c > n - M.probe_length(n) and c > m - M.index_length(m)


def test_boundary_follows_cost():
    assert M.light_boundary({}) == 0
    assert M.light_boundary({4: 1000}) >= 4
    assert M.light_boundary({12: 1000}) < 12


def test_edges(edge_docs, empty_docs):
    rows = near_documents(edge_docs).collect()
    assert len(rows) == 15
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert got[1] == got[2] [:0] + [(0, 1)] and got[2] == [(0, 2)] and got[3] == [(0, 3)]
    assert got[5] == [(8, 5)] and got[6] == [(8, 5), (8, 5)]
    assert got[7] == [(1, 7)] and got[8] == [(1, 7)]
    assert sorted(got[None], key=str) == [(0, None), (8, 5)]
    assert near_documents(empty_docs).count() == 0
