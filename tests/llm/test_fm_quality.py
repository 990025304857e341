import numpy as np
from pyspark.sql import functions as F

from storepulse.llm import fm_quality as Q
from storepulse.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    x, v = rng.random((5, 9)), rng.random((9, 3)) - 0.5
    m = Q.FactorisationMachine(0.1, rng.random(9) - 0.5, v)
    plain = [0.1 + r @ m.linear + sum(v[i] @ v[j] * r[i] * r[j] for i in range(9) for j in range(i)) for r in x]
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-np.array(plain))))


def test_held_out_quality(spark):
    out = QUERIES["op3_fm_quality"](spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("quality", "score", "predicted").collect()
    assert out.count() == 1000
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.learn_quality(docs, labels), Q.learn_quality(docs, turned)
    assert a.bias == b.bias and (a.factors == b.factors).all()
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("zz")})
    c = Q.learn_quality(other, labels)
    assert (a.linear == c.linear).all()


def test_edges(spark, edge_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1), (5, 0), (None, 1), (7, None), (11, 0)], "doc_id long, quality int")
    machine = Q.learn_quality(edge_docs, labels)
    rows = Q.score_quality(edge_docs, machine).collect()
    assert len(rows) == 15 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert Q.score_quality(empty_docs, machine).count() == 0
    none = Q.learn_quality(empty_docs, labels.limit(0))
    assert {r.score for r in Q.score_quality(edge_docs, none).collect()} == {0.5}
