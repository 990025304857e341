"""Ranked lexical search by per-term geometric blocking.

Documents become integer vectors over the terms that the queries ask for. A task cuts the vectors it reads into
segments of bounded size. In a segment every term's posting list is clustered by document similarity (random
projections against pivots of the list) into blocks, and a block's summary is the coordinatewise maximum of its
vectors. A query visits the lists of its terms from the largest possible contribution down, and stops where the
rest cannot reach its k-th best score; inside a list it opens a block only if the summary's product with the query
can reach that score. Both bounds are exact integers and ties are opened, so no result is lost.

No posting is shuffled and no list meets in one task: counts are partial sums, and each task returns k rows a query
at most, which are merged in two steps. The queries are dealt into blocks of bounded text; each block's terms,
weights and vectors travel with the task functions, and each block reads the documents once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from storepulse.llm.worker import give_back
from storepulse.llm.words import mix
from storepulse.session import cut_lineage

TOP = 20
QUERY_BYTES = 256 << 10  # query text answered in one pass over the index, about
SEGMENT_CELLS, SUMMARY_CELLS = 8 << 20, 24 << 20  # of the vectors and the summaries of a segment
BLOCK_DOCS = 32
DIRECTIONS = 24
CHUNK = 1 << 20  # bytes of a text split at once
SLICE_ROWS = 256
MERGE_TASKS = 256  # tasks whose rows meet in the first merge
INDEX = "_id long, n long, terms array<int>, counts array<int>"

#: Bytes of a term stay, A-Z lower-cased; all others part terms. Every byte of a non-ASCII character is above 0x7F.
TERM_BYTES = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))


def count_terms(text: str | None) -> Counter:
    """Occurrences of every term of a whole text."""
    data = (text or "").encode().translate(TERM_BYTES)
    if len(data) <= CHUNK:
        return Counter(data.split())
    counts, at = Counter(), 0
    while at < len(data):
        end = data.find(b" ", min(len(data), at + CHUNK))
        end = len(data) if end < 0 else end
        counts.update(data[at:end].split())
        at = end
    return counts


def index_documents(docs: DataFrame, vocabulary: dict[bytes, int], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per document with a term: id, number of terms, and the numbers and counts of those in the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                ids, n, terms, counts, sizes = [], [], [], [], [0]
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found = count_terms(text)
                    if found:
                        known = [(k, c) for t, c in found.items() if (k := vocabulary.get(t)) is not None]
                        ids.append(i)
                        n.append(found.total())
                        terms += [k for k, _ in known]
                        counts += [c for _, c in known]
                        sizes.append(len(terms))
                offsets = pa.array(sizes, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                                                  pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))], ["_id", "n", "terms", "counts"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col)).mapInArrow(run, INDEX)


@dataclass(frozen=True)
class Collection:
    """What all documents together say: their number, their terms, and the weight of each vocabulary term."""
    n_docs: int
    n_terms: int
    weights: np.ndarray

    @classmethod
    def of(cls, index: DataFrame, size: int) -> "Collection":
        n_docs, n_terms = index.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = {r[0]: r[1] for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # a row per vocabulary term
        return cls(n_docs, n_terms, np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding.get(k, 0) + 1))) for k in range(size)], dtype=np.int64))


class Segment:
    """Vectors of some documents, and their posting lists in blocks, made when a query asks for them."""

    def __init__(self, collection: Collection, directions: np.ndarray, ids: list, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        rows = np.repeat(np.arange(len(n)), sizes)
        length = 100 - 25 + (25 * n * collection.n_docs) // collection.n_terms
        counts = counts.astype(np.int64)
        impact = (1_000_000_000 * counts) // (1000 * counts + 12 * length[rows])  # at most 10^6, exact in single precision
        self.ids = ids
        self.vectors = np.zeros((len(n), len(collection.weights)), dtype=np.float32)
        self.vectors[rows, terms] = impact
        self.directions, self.near = directions, None
        order = np.argsort(terms, kind="stable")
        self.posted, self.bounds = rows[order], np.searchsorted(terms[order], np.arange(len(collection.weights) + 1))
        self.highest = self.vectors.max(axis=0).astype(np.float64)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of a term's list by block, the starts of the blocks, and their summaries."""
        if term not in self.lists:
            rows = self.posted[self.bounds[term]:self.bounds[term + 1]]
            if len(rows) > BLOCK_DOCS:
                if self.near is None:
                    self.near = self.vectors @ self.directions
                    self.near /= np.maximum(np.linalg.norm(self.near, axis=1, keepdims=True), 1e-9)
                near = self.near[rows]
                pivots = near[np.linspace(0, len(rows) - 1, -(-len(rows) // BLOCK_DOCS)).astype(int)]
                cluster = np.argmax(near @ pivots.T, axis=1)
                order = np.argsort(cluster, kind="stable")
                rows, cluster = rows[order], cluster[order]
                place = np.arange(len(rows))
                first = np.flatnonzero(np.diff(cluster, prepend=-1))
                inside = place - first[np.cumsum(np.diff(cluster, prepend=-1) != 0) - 1]
                starts = np.flatnonzero(inside % (2 * BLOCK_DOCS) == 0)
            else:
                starts = np.zeros(1, dtype=np.int64)
            step = max(1, (1 << 21) // self.vectors.shape[1])  # rows gathered at once
            edges, parts, at = np.append(starts, len(rows)), [], 0
            while at < len(starts):
                end = max(at + 1, int(np.searchsorted(edges, edges[at] + step, side="right")) - 1)
                end = min(end, len(starts))
                parts.append(np.maximum.reduceat(self.vectors[rows[edges[at]:edges[end]]], edges[at:end] - edges[at], axis=0))
                at = end
            self.lists[term] = rows, edges, np.concatenate(parts)
        return self.lists[term]


class Ranker:
    """The best documents of every query over the segments of a task."""

    def __init__(self, collection: Collection, queries: list[dict[int, int]], top: int):
        self.collection, self.top = collection, top
        self.queries = [(np.array(sorted(q), dtype=np.int64), np.array([q[t] * collection.weights[t] for t in sorted(q)], dtype=np.float64)) for q in queries]
        size = len(collection.weights)
        signs = (mix(np.arange(1, size * DIRECTIONS + 1, dtype=np.uint64)) & np.uint64(1)).reshape(size, DIRECTIONS)
        self.directions = (signs.astype(np.float32) * 2 - 1) * collection.weights[:, None].astype(np.float32)
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in queries]  # (-score, id is null, id), best first
        self.opened = self.skipped = 0

    def least(self, q: int) -> int:
        """Score that a document must reach."""
        best = self.best[q]
        return -best[-1][0] if len(best) == self.top else 1

    def add(self, ids: list, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        segment = Segment(self.collection, self.directions, ids, n, sizes, terms, counts)
        for q, (of, weight) in enumerate(self.queries):
            most = weight * segment.highest[of]
            order = np.argsort(-most, kind="stable")
            rest = np.cumsum(most[order][::-1])[::-1]  # what the lists from here on can give
            seen = np.zeros(len(ids), dtype=bool)
            for k, place in enumerate(order.tolist()):
                if most[place] <= 0 or rest[k] < self.least(q):
                    break
                self._visit(segment, q, of, weight, int(of[place]), seen)

    def _visit(self, segment: Segment, q: int, of: np.ndarray, weight: np.ndarray, term: int, seen: np.ndarray) -> None:
        rows, edges, summaries = segment.blocks(term)
        bound = summaries[:, of].astype(np.float64) @ weight
        order, at, step = np.argsort(-bound, kind="stable"), 0, 1
        while at < len(order):
            chosen = order[at:at + step]
            chosen = chosen[bound[chosen] >= self.least(q)]
            if not len(chosen):
                break
            self.opened += len(chosen)
            docs = np.concatenate([rows[edges[b]:edges[b + 1]] for b in chosen.tolist()])
            docs = docs[~seen[docs]]
            seen[docs] = True
            score = segment.vectors[docs[:, None], of].astype(np.float64) @ weight
            good = score >= self.least(q)
            if good.any():
                found = [(-int(s), segment.ids[d] is None, segment.ids[d] or 0) for s, d in zip(score[good].tolist(), docs[good].tolist(), strict=True)]
                self.best[q] = sorted(self.best[q] + found)[:self.top]
            at += len(chosen)
            step *= 2
        self.skipped += len(order) - at


def search_block(index: DataFrame, collection: Collection, queries: list[dict[int, int]], names: list, name_type: T.DataType, top: int) -> DataFrame:
    """Best documents by query of this block: query number and name, document id, score, and the task they come from."""
    size = len(collection.weights)
    most_docs = max(16, min(4096, SEGMENT_CELLS // max(1, size)))
    most_postings = max(size, SUMMARY_CELLS // max(1, size) * BLOCK_DOCS)
    arrow_name = to_arrow_type(name_type)

    def segments(batches: Iterator[pa.RecordBatch]):
        """Rows in runs of at most ``most_docs`` documents and, but for a single one, ``most_postings`` postings."""
        for b in batches:
            ids, n, terms, counts = (b.column(k) for k in range(4))
            sizes = np.diff(terms.offsets.to_numpy())
            total = np.concatenate([[0], np.cumsum(sizes)])
            base, at = int(terms.offsets[0].as_py()), 0
            flat_terms, flat_counts = terms.values.to_numpy(), counts.values.to_numpy()
            while at < len(sizes):
                end = max(at + 1, min(at + most_docs, len(sizes), int(np.searchsorted(total, total[at] + most_postings, side="right")) - 1))
                span = slice(base + total[at], base + total[end])
                yield ids[at:end].to_pylist(), n[at:end].to_numpy(), sizes[at:end], flat_terms[span], flat_counts[span]
                at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(collection, queries, top)
        for part in segments(batches):
            ranker.add(*part)
        rows = [(q, names[q], None if none else i, -s) for q, best in enumerate(ranker.best) for s, none, i in best]
        if rows:
            task = TaskContext.get().partitionId() // MERGE_TASKS
            yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), arrow_name, pa.int64(), pa.int64()), strict=True)),
                                              pa.array([task] * len(rows), pa.int32())], ["query_no", "name", "doc", "score", "task"])
        give_back()

    schema = T.StructType([T.StructField("query_no", T.IntegerType()), T.StructField("name", name_type), T.StructField("doc", T.LongType()),
                           T.StructField("score", T.LongType()), T.StructField("task", T.IntegerType())])
    found = index.where(F.size("terms") > 0).mapInArrow(run, schema)
    for keys in (["query_no", "task"], ["query_no"]):
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return found


def search_documents(docs: DataFrame, items: DataFrame, top: int = TOP, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id",
                     item_text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """For each item the ``top`` documents of highest score above 0: item id, ``rank`` from 1, document id, ``score``.

    Equal scores go by ascending id, documents without one last; each row of ``docs`` is a document, also where rows
    repeat. Items equal in id and text count once; one id with two texts is two items. Null and empty texts have no
    terms, so such items give no row and such documents are never found. Empty tables give an empty one."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    name_type, found = items.schema[item_col].dataType, []
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // query_bytes))
    for block in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).orderBy("item", "text").collect()  # about query_bytes
        counted = [count_terms(r.text) for r in rows]
        vocabulary = {t: k for k, t in enumerate(sorted({t for c in counted for t in c}))}
        if not vocabulary:
            continue
        index = cut_lineage(index_documents(docs, vocabulary, text_col, id_col))
        collection = Collection.of(index, len(vocabulary))
        if collection.n_docs:
            queries = [{vocabulary[t]: n for t, n in c.items()} for c in counted]
            found.append(search_block(index, collection, queries, [r.item for r in rows], name_type, top))
    out = T.StructType([T.StructField(item_col, name_type), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()), T.StructField("score", T.LongType())])
    if not found:
        return spark.createDataFrame([], out)
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    return merged.select(F.col("name").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
