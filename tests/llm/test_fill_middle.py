import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from storepulse.llm.fill_middle import UnitList, fill_in_middle, restored_text, transform
from storepulse.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL


def plain_way(text, doc_id):
    """The contract by a regular expression and list slices."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_skip_list_reaches_every_rank():
    rnd = random.Random(5)
    for size in (0, 1, 7, 8, 9, 64, 700, 5000):
        text = "".join(rnd.choice("abZ <é漢😀\n") for _ in range(size))
        units, places = UnitList(text), [0]
        for u in re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S):
            places.append(places[-1] + len(u))
        assert units.n == len(places) - 1
        assert [units.chars_before(r) for r in range(units.n + 1)] == places
        for lane in range(1, len(units.chars)):
            assert units.units[lane].sum() == units.n and units.chars[lane].sum() == len(text)


def test_cuts_as_the_plain_way_does():
    rnd = random.Random(6)
    texts = ["", "a", " ", "<", "<P", "P>", "<<S>", "<M>", "S>x<", "漢字 é \x00 😀"] + ["".join(rnd.choice("ab <>PSM\n😀") for _ in range(rnd.randrange(40))) for _ in range(400)]
    for doc_id, text in enumerate(texts):
        assert transform(text, doc_id, 1) == plain_way(text, doc_id)
    long = "word, " * 700_000  # more than a chunk of code points and of units
    assert transform(long, 3, 1) == plain_way(long, 3)


def test_round_trip_and_edges(spark, edge_docs, empty_docs):
    rnd = random.Random(7)
    rows = [(i, "".join(rnd.choice("ab <>PSM\n😀") for _ in range(rnd.randrange(30)))) for i in range(300)]
    out = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    back = out.select("doc_id", "form", "text", restored_text(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.back == r.text for r in back) and {r.form for r in back} == {"plain", "psm", "spm"}
    got = fill_in_middle(edge_docs.withColumn("form", F.lit(1)))
    assert got.columns == [c for c in edge_docs.columns if c != "n"] + ["n", "form", "prefix_chars", "middle_chars", "output"]
    rows = got.withColumn("back", restored_text(F.col("output"), F.col("form"))).collect()
    assert len(rows) == edge_docs.count() and all(r.back == (r.text or "") for r in rows)
    assert [(r.n, r.form, r.prefix_chars, r.output) for r in rows if r.doc_id == 1] == [(0, "plain", None, "")]
    assert len({(r.form, r.output) for r in rows if r.doc_id == 6}) == 1
    assert fill_in_middle(empty_docs).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    want = con.sql(ORACLE["op12_fill_middle"])
    got = QUERIES["op12_fill_middle"](spark, SF_SMALL).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
