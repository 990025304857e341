import base64
import glob
import gzip
import hashlib
import os

from storepulse.llm.queries import QUERIES
from storepulse.llm.warc import members, file_system, read_warc, warc_record, write_warc
from tests.conftest import SF_SMALL


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain(pages):
    """Rows of the contract by (page_id, html)."""
    top = {}
    for i, h in pages:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, h in pages:
        data, m = (h or "").encode(), top.get(h or "")
        own = m is None or m == i
        out.append((i, len(data), b32(data), "response" if own else "revisit", None if own else m))
    return sorted(out, key=str)


def columns(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()]
    assert columns(QUERIES["op5_warc"](spark, SF_SMALL)) == plain(pages)


PAGES = [(1, "http://a/", "same"), (2, None, "same"), (9, "http://c/\r\nX: y", "same"), (3, "u", None), (4, "u", ""), (5, "ü", "héllo\r\n\r\n" * 400),
         (None, "u", "same"), (None, "v", "alone"), (None, None, "alone"), (6, "u", "twice"), (6, "u", "twice"), (2**60, "u", "big id")]


def test_round_trip_and_edges(spark, tmp_path):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, kind string").repartition(3)
    manifest = write_warc(df, str(tmp_path / "w"), roll_bytes=600)
    back = read_warc(spark, str(tmp_path / "w"))
    assert columns(back) == plain([(i, h) for i, _, h in PAGES])
    got = {r.page_id: r for r in back.where("page_id IS NOT NULL").collect()}
    assert got[5].payload.decode() == "héllo\r\n\r\n" * 400 and got[5].url == "ü" and got[2].url is None
    assert got[9].url == "http://c/%0D%0AX: y" and got[1].payload is None
    files = sorted(glob.glob(str(tmp_path / "w" / "*.warc.gz")))
    assert len(files) > 1 and not os.path.exists(tmp_path / "w" / "_tmp")
    assert {(r.name, r.bytes, r.sha256) for r in manifest.collect()} == {(os.path.basename(f), os.path.getsize(f), hashlib.sha256(open(f, "rb").read()).hexdigest()) for f in files}
    text = gzip.open(files[0]).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")


def test_same_files_from_any_partitioning(spark, tmp_path):
    df = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    names = []
    for n, part in enumerate((df, df.repartition(7, "url"))):
        m = write_warc(part, str(tmp_path / f"w{n}"), roll_bytes=8_000, shard_bytes=40_000)
        names.append(sorted((r.name, r.records, r.sha256) for r in m.collect()))
    assert names[0] == names[1] and len(names[0]) > 4 and len({x[0][:11] for x in names[0]}) > 1


def test_files_outside_the_manifest_are_not_read(spark, tmp_path):
    out = str(tmp_path / "w")
    write_warc(spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string"), out)
    with open(f"{out}/part-000009-00000.warc.gz", "wb") as f:
        f.write(warc_record(7, "u", b"stray", None, "2024-01-01T00:00:00Z"))
    assert [r.page_id for r in read_warc(spark, out).collect()] == [1]
    fs, path = file_system(f"file:{out}/part-000009-00000.warc.gz")
    assert len(list(members(fs, path))) == 1


def test_min_revisit_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    write_warc(df, str(tmp_path / "w"), min_revisit_bytes=3)
    assert [(r[0], r[3]) for r in columns(read_warc(spark, str(tmp_path / "w")))] == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert write_warc(df, str(tmp_path / "w")).count() == 0
    assert read_warc(spark, str(tmp_path / "w")).count() == 0
