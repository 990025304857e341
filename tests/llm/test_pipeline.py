import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from storepulse.llm.secret_scan import spans_of
from storepulse.session import cut_lineage
from tests.conftest import SF_SMALL
from tests.llm.test_ngram_join import plain


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    kept = cut_lineage(P.language_id(spark, docs, SF_SMALL))
    assert kept.columns == columns
    letters = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert set(by_id(kept)) == letters

    single = cut_lineage(P.near_duplicates(spark, kept, SF_SMALL))
    groups = plain([(r.doc_id, r.text) for r in kept.collect()])
    assert single.columns == columns and set(by_id(single)) == {i for i, (_, c) in groups.items() if i == c}
    assert single.exceptAll(kept).count() == 0

    clean = cut_lineage(P.secrets(spark, single, SF_SMALL))
    before, after = by_id(single), by_id(clean)
    assert clean.columns == columns and before.keys() == after.keys()
    for i, r in before.items():
        spans = spans_of(r.text, 240)
        assert (after[i].text == r.text) == (not spans) and after[i].n_chars == len(after[i].text)
        assert all(r.text[s:e] not in after[i].text for _, s, e in spans)

    mixed = cut_lineage(P.mixture(spark, clean, SF_SMALL))
    assert mixed.columns == columns and set(by_id(mixed)) <= set(after) and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert all(w in texts[r.doc_id] for r in mixed.collect() for w in r.text.split("\n")[:1])

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, len(library.encode(r.text)), hashlib.sha256(",".join(map(str, library.encode(r.text))).encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in P.pieces(spark, mixed, SF_SMALL).collect()) == want
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in P.run(spark, SF_SMALL).collect()) == want


def test_edges(spark, edge_docs, empty_docs):
    for docs in (edge_docs, empty_docs):
        n = docs.count()
        for _, stage in P.STAGES:
            docs = cut_lineage(stage(spark, docs, ""))
        assert docs.count() <= 2 * n
    near = P.near_duplicates(spark, edge_docs, "")
    ids = sorted(str(r.doc_id) for r in near.collect())
    assert ids == sorted(map(str, [1, 2, 3, 4, 5, 7, 10, 11, 12, 13, None]))  # the copy without an id goes, the row without a text stays


def test_near_duplicates_decide_row_by_row(spark):
    """Copies without an id, two texts under one id, and a null id with a text of its own."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(None, a), (7, b), (7, a), (3, a), (None, c), (None, b), (9, b + " more"), (7, b)]
    got = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert got.columns == ["doc_id", "text"] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(3, a), (7, b), (None, c)]))


def test_every_text_with_a_letter_has_a_language(spark):
    words = [[f"{chr(97 + 2 * k)}{chr(98 + 2 * k)}"[i % 2] * (2 + i % 3) + chr(97 + 2 * k) * (i % 4) for i in range(24)] for k in range(12)]
    rows = [(i * 12 + k, " ".join(words[k][i % 12:]), f"l{k:02}") for i in range(20) for k in range(12)]
    mixed = " ".join(w for group in zip(*words, strict=True) for w in group)
    docs = spark.createDataFrame([*rows, (900, mixed, None), (901, "漢字", None), (902, "123", None), (903, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in P.language_id(spark, docs, "").collect()}
    assert set(got) == {*range(240), 900, 901} and got[900] and got[901]


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_stages_bound_the_batches_of_whole_texts(spark, empty_docs, stage):
    """A task of 12 MB of texts hands them to Python in batches of some 4 MB, and hands over all of them."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "64m")
    try:
        stage(spark, empty_docs, "")
        texts = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("abcd"), 1000).alias("text"))
        got = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"]) for b in batches), "n long, size long").collect()
        assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 5 << 20
    finally:
        spark.conf.set(limit, old)
