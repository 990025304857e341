import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from storepulse.llm import line_crf as L
from storepulse.llm.queries import QUERIES
from tests.conftest import SF_SMALL

WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def base_counts(text):
    """The base figures by the contract, with lists and sets."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    inside = {k + d for k, w in enumerate(windows) if w in twice for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def noise(rnd, size):
    return "".join(rnd.choice("ab é漢#|\n\t \n") for _ in range(size))


def test_base_counts():
    rnd, reader = random.Random(1), L.LineReader()
    texts = [None, "", " \n ", "a", "a b a b a b", "a b c\na b c", "x\nx\n x\nx \n", "É\x0bé\x00#", "a a a a"] + [noise(rnd, rnd.randrange(80)) for _ in range(300)]
    for text in [*texts, "one two three\n" * 200_000]:
        got = reader.read(text)
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == base_counts(text), text
        assert len(got.real) == len(got.chars) and got.chars.sum() == got.word_chars and np.isfinite(got.real).all()


def test_line_features():
    got = L.LineReader().read("Hello big World.\n\nTHE!! ÉE!!\na a a b\n| 12 |\na a a b").real
    at = L.NAMES.index
    assert got[:, at("words")].tolist() == [3, 2, 4, 3, 4] and got[:, at("again")].tolist() == [0, 0, 0, 0, 1]
    assert got[:, at("upper")].tolist() == [2 / 13, 1, 0, 0, 0] and got[:, at("shouts")].tolist() == [0, 1, 0, 0, 0]
    assert got[:, at("same_as_last")].tolist() == [0, 0, .5, 0, .5] and got[:, at("bars")].tolist() == [0, 0, 0, 2 / 3, 0]
    assert got[:, at("distinct")].tolist() == [1, 1, .5, 2 / 3, .5]
    assert got[:, at("ends")].tolist() == [1, 1, 0, 0, 0] and got[:, at("capital")].tolist() == [1, 1, 0, 0, 0]
    assert got[:, at("repeats")].tolist() == [0, 0, 1, 0, 1]


def some_chain(rnd, features=3):
    return L.Chain(rnd.normal(size=(2, features)), rnd.normal(size=(2, 2)), rnd.normal(size=2))


def path_score(chain, e, y):
    return chain.first[y[0]] + sum(e[k, y[k]] for k in range(len(y))) + sum(chain.moves[a, b] for a, b in itertools.pairwise(y))


def test_viterbi_equals_enumeration():
    rnd = np.random.default_rng(2)
    for n in range(1, 9):
        chain = some_chain(rnd)
        e = chain.emissions(rnd.normal(size=(n, 3)))
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: path_score(chain, e, y))
        assert chain.viterbi(e).tolist() == list(best)
    assert L.everything_content().viterbi(np.zeros((0, 2))).tolist() == []


def test_likelihood_and_gradient():
    rnd = np.random.default_rng(3)
    chain, x = some_chain(rnd), rnd.normal(size=(4, 5, 3)).astype(np.float32)
    length, y, weight = np.array([5, 1, 3, 4]), rnd.integers(0, 2, (4, 5)), np.array([1.0, 2.0, 0.5, 1.0])
    value, slopes = L.log_likelihood(chain, x, y, length, weight)
    want = 0.0
    for k in range(4):
        e = chain.emissions(x[k, :length[k]])
        total = np.logaddexp.reduce([path_score(chain, e, p) for p in itertools.product((0, 1), repeat=int(length[k]))])
        want += weight[k] * (path_score(chain, e, y[k, :length[k]]) - total)
    assert value == pytest.approx(want, rel=1e-4)
    for part, slope in zip(("weights", "moves", "first"), slopes, strict=True):
        for at in np.ndindex(slope.shape):
            moved = {p: getattr(chain, p).copy() for p in ("weights", "moves", "first")}
            moved[part][at] += 1e-3
            up = L.log_likelihood(L.Chain(**moved), x, y, length, weight)[0]
            moved[part][at] -= 2e-3
            assert (up - L.log_likelihood(L.Chain(**moved), x, y, length, weight)[0]) / 2e-3 == pytest.approx(slope[at], abs=2e-2)


def test_held_out_documents(spark):
    """Learned without the ids of one fold, the verdict agrees with that fold's labels."""
    sf = SF_SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    chain = L.learn_lines(docs, labels.where(~other))
    rows = L.judge_lines(docs, chain).join(labels.where(other), "doc_id").where("not base_failed").collect()
    assert len(rows) > 30 and np.mean([r.kept == (r.quality == 1) for r in rows]) >= 0.95
    assert all(r.kept for r in rows if r.quality == 1)


def test_mixed_text_keeps_by_share(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = L.learn_lines(docs, labels)
    good = docs.join(labels.where("quality = 1"), "doc_id").where("length(text) > 1500").orderBy("doc_id").first().text.replace("\n", " ")
    lines = [good[k:k + 200] for k in range(0, 1400, 200)]
    junk = [" ".join(f"{x}{'#$%'[k % 3] * 3}" for k, x in enumerate(line.split())) for line in lines]
    rows = spark.createDataFrame([(1, "\n".join(lines + junk[:2])), (2, "\n".join(junk + lines[:1]))], "doc_id long, text string")
    got = {r.doc_id: r for r in L.judge_lines(rows, chain).collect()}
    assert got[1].kept and not got[2].kept and 0 < got[1].content_lines < got[1].n_lines and got[2].content_lines < got[2].n_lines


def test_query_counts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op13_line_crf"](spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_edges(spark, edge_docs, empty_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    marks = spark.createDataFrame([(4, 1), (5, 0), (6, 0), (6, 1), (None, 0), (7, None), (13, 0)], "doc_id long, quality int")
    docs = edge_docs.withColumn("n_words", F.lit("clash"))
    for labels in (none, marks):
        chain = L.learn_lines(docs, labels)
        got = L.judge_lines(docs, chain)
        rows = got.collect()
        assert len(rows) == docs.count() and got.columns == [c for c in docs.columns if c != "n_words"] + L.STATS.names + ["base_failed", "kept"]
        blank = [r for r in rows if r.doc_id in (1, 2, 3)]
        assert all(r.n_words == r.n_lines == 0 and r.base_failed and not r.kept for r in blank)
        assert len({(r.kept, r.content_chars) for r in rows if r.doc_id == 6}) == 1
    assert L.judge_lines(empty_docs, L.learn_lines(empty_docs, none)).count() == 0
    assert all(r.kept or r.base_failed for r in L.judge_lines(docs, L.learn_lines(docs, none)).collect())
