import zlib

import numpy as np
from pyspark.sql import functions as F

from storepulse.llm import string_kernel as S
from storepulse.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_string_kernel"](spark, SF).collect()
    assert len(rows) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_only_text_and_learning_labels_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    turned = docs.withColumns({"lang": F.when(S.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")), "source": F.lit("s")})
    a, b = S.learn_languages(docs), S.learn_languages(turned)
    assert a.languages == b.languages and (a.weights == b.weights).all()


def test_collapsed_weights_equal_the_kernel_machine():
    """Scores by the collapsed matrix equal kernel values against the landmarks times the fitted coefficients."""
    rnd = np.random.default_rng(2)
    words = {"aa": ["kala", "mola", "pila"], "bb": ["strum", "krest", "flunk"]}
    texts, langs = zip(*[(" ".join(rnd.choice(words[x], 6)), x) for x in ["aa", "bb"] * 20], strict=True)
    model = S.fit(list(texts), list(langs))
    letters = S.letter_table()
    z, x = S.unit_rows(list(texts), letters), S.unit_rows(["kala pila", "krest strum"], letters)
    kernel = x @ z.T
    assert np.allclose(kernel, [[len(set(S.presence(a, letters)) & set(S.presence(b, letters))) / np.sqrt(len(set(S.presence(a, letters))) * len(set(S.presence(b, letters))))
                                 for b in texts] for a in ("kala pila", "krest strum")], atol=1e-5)
    got = x @ model.weights
    y = np.where(np.array(langs)[:, None] == np.array(["aa", "bb"]), 1.0, -1.0)
    full = kernel @ np.linalg.pinv(z @ z.T + S.RIDGE * 20 * np.eye(40)) @ y  # all texts are landmarks: plain kernel ridge
    assert np.abs(got - full).max() < 0.05 and [model.languages[k] for k in got.argmax(axis=1)] == ["aa", "bb"]


def test_edges(edge_docs, empty_docs):
    model = S.learn_languages(edge_docs)
    rows = S.predict_language(edge_docs, model).collect()
    assert len(rows) == 15
    for r in rows:
        blank = not r.text or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und" and r.lang_score == 0) if blank else (r.lang_pred in model.languages and 0 <= r.lang_score <= 1)
    none = S.learn_languages(empty_docs)
    assert none.languages == [] and S.predict_language(empty_docs, none).count() == 0
    assert {r.lang_pred for r in S.predict_language(edge_docs, none).collect()} == {"und"}
