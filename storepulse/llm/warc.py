"""Deterministic sharded WARC writer, and reader.

Records are sorted by id into shards of about equal payload bytes, cut at exact byte counts per id bin, so
the same rows give the same files whatever the partitioning. Inside a shard files roll by compressed size.
Each record is its own gzip member with headers and digests regenerated from the payload. Tasks write under
temporary names of their own attempt; the names of finished attempts only are recorded, a second job moves
those files to their final names, and the manifest table is written last. Readers go by the manifest, so
files of lost or repeated attempts are never seen.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.session import cut_lineage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_BINS = 4096
FILES = "shard int, seq int, temp string, name string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder's URI, usable in any task."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def header_text(value: str | None) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, nth: int = 0) -> bytes:
    """One gzip member: a response with its payload, or a revisit of another page's equal payload."""
    def record_id(of: int | None, kind: str, n: int) -> str:
        return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{kind}:{of}:{digest}:{n}'.encode()).digest()[:16], version=5)}>"

    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, 'revisit' if revisit else 'response', nth)}",
            f"WARC-Date: {date}", f"WARC-Target-URI: {header_text(url)}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is None:
        head.append("X-No-Target: 1")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, 'response', 0)}", f"X-Refers-To-Page-Id: {refers_to}"]
    data = "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes) -> dict:
    """Columns of a record; the payload of a response is checked against its digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    payload = block.partition(b"\r\n\r\n")[2]
    response = fields["WARC-Type"] == "response"
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}" or (response and fields["WARC-Payload-Digest"] != f"sha1:{digest(payload)}"):
        raise ValueError(f"digest mismatch in {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-Id"), "url": None if "X-No-Target" in fields else fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
            "payload_bytes": len(payload) if response else number("X-Payload-Length"), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if response else None}


class ShardWriter:
    """Files of one task: rolls by compressed size and whenever the shard changes."""

    def __init__(self, out_dir: str, roll_bytes: int):
        self.fs, self.root = file_system(out_dir)
        self.roll, self.shard, self.seq, self.file, self.done = roll_bytes, -1, 0, None, []

    def add(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.seq = shard, 0
        if self.file is None:
            self.name = f"_tmp/{uuid.uuid4().hex}.warc.gz"
            self.fs.create_dir(f"{self.root}/_tmp", recursive=True)
            self.file, self.records, self.bytes, self.hash = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None), 0, 0, hashlib.sha256()
        self.file.write(record)
        self.records, self.bytes = self.records + 1, self.bytes + len(record)
        self.hash.update(record)
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append({"shard": self.shard, "seq": self.seq, "temp": self.name, "name": f"part-{self.shard:06d}-{self.seq:05d}.warc.gz",
                              "records": self.records, "bytes": self.bytes, "sha256": self.hash.hexdigest()})
            self.file, self.seq = None, self.seq + 1


FILES_ARROW = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temp", pa.string()), ("name", pa.string()),
                         ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
RECORDS_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                           ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def shard_column(thin: DataFrame, shard_bytes: int):
    """Shard of a ``page_id``: ids fall into fixed bins (nulls before all), bins fill shards in order.

    The driver sees one byte count per bin, at most ``ID_BINS`` + 1."""
    low, high = thin.agg(F.min("page_id"), F.max("page_id")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // ID_BINS))
    bin_of = F.coalesce(F.least(((F.col("page_id") - F.lit(low or 0)) / F.lit(width)).cast("long"), F.lit(ID_BINS - 1)), F.lit(-1)).cast("int")
    sums = dict(thin.groupBy(bin_of.alias("b")).agg(F.sum(F.col("n") + 512)).collect())
    shard_of, at = [0] * (ID_BINS + 1), 0
    for b in range(-1, ID_BINS):
        shard_of[b + 1] = at // shard_bytes
        at += sums.get(b, 0)
    return F.get(F.array(*[F.lit(int(x)) for x in shard_of]), bin_of + 1), shard_of[-1] + 1


def write_warc(pages: DataFrame, out_dir: str, roll_bytes: int = 16 << 20, shard_bytes: int = 32 << 20, min_revisit_bytes: int = 0,
               date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC shards under ``out_dir`` and return the committed manifest.

    Null html is an empty payload; null ids sort first and are never the response that others refer to unless
    no equal payload has an id. Of equal payloads of at least ``min_revisit_bytes`` the largest id is the
    response (repeated rows of that id are all responses). An empty table gives an empty manifest."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    thin = cut_lineage(rows.select("page_id", "sha1", F.length("payload").cast("long").alias("n")))
    shard, shards = shard_column(thin, shard_bytes)
    first = thin.where(F.col("n") >= min_revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1 AND refers_to IS NOT NULL").drop("_n")
    notes = thin.join(first, "sha1").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha1", "refers_to").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    both = (rows.select("page_id", "sha1", F.lit(1).alias("kind"), "url", "payload", none("long").alias("refers_to"))
            .unionByName(notes.select("page_id", "sha1", F.lit(0).alias("kind"), none("string").alias("url"), none("binary").alias("payload"), "refers_to")))
    both = both.select(shard.alias("shard"), "*").repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "sha1", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, note, last, nth = ShardWriter(out_dir, roll_bytes), (None, None), None, 0
        for b in batches:
            for r in b.to_pylist():
                key = (r["page_id"], r["sha1"])
                if r["kind"] == 0:  # the page's note stands before the page
                    note = (key, r["refers_to"])
                    continue
                nth, last = (nth + 1 if key == last else 0), key
                out.add(r["shard"], warc_record(r["page_id"], r["url"], r["payload"], note[1] if note[0] == key else None, date, nth))
        out.close()
        yield pa.RecordBatch.from_pylist(out.done, FILES_ARROW)

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(out_dir)
        for b in batches:
            for r in b.to_pylist():
                if fs.get_file_info(f"{root}/{r['temp']}").type == pafs.FileType.File:
                    fs.move(f"{root}/{r['temp']}", f"{root}/{r['name']}")
                elif fs.get_file_info(f"{root}/{r['name']}").size != r["bytes"]:  # moved by an attempt that was lost after
                    raise OSError(f"{r['name']} is missing or incomplete")
            yield b

    spark = pages.sparkSession
    written = cut_lineage(both.mapInArrow(write, FILES))
    written.repartition(max(1, min(shards, 1000)), "shard").mapInArrow(commit, FILES).drop("temp").write.parquet(f"{out_dir}/manifest")
    fs, root = file_system(out_dir)
    if fs.get_file_info(f"{root}/_tmp").type == pafs.FileType.Directory:
        fs.delete_dir(f"{root}/_tmp")  # of lost attempts
    return spark.read.parquet(f"{out_dir}/manifest")


def read_warc(spark: SparkSession, out_dir: str, with_payload: bool = True) -> DataFrame:
    """Records of the files in the manifest, each digest checked; files are streamed member by member."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(out_dir)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                for data in members(fs, f"{root}/{name}"):
                    row = parse_record(data)
                    rows.append(row if with_payload else row | {"payload": None})
                    size += len(data) if with_payload else 256
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, RECORDS_ARROW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORDS_ARROW)

    files = spark.read.parquet(f"{out_dir}/manifest").select("name")
    n = max(1, files.count())
    return files.repartition(min(n, 100_000)).mapInArrow(read, RECORDS)


def members(fs: pafs.FileSystem, path: str) -> Iterator[bytes]:
    """Uncompressed gzip members of a file, one at a time."""
    with fs.open_input_stream(path, compression=None) as f:
        z, parts, data = zlib.decompressobj(31), [], f.read(1 << 20)
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
            data = data or f.read(1 << 20)
        if parts:
            raise OSError(f"{path} ends inside a record")
