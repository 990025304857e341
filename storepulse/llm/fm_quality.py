"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text becomes one row: hashed word counts (log-damped, unit length), structure statistics as values and
as bins, and its length as metadata. The machine scores it as

    w0 + w.x + 1/2 sum_f ((V_f.x)^2 - V_f^2.x^2)

so all pairwise interactions cost time linear in the row (the sum-of-squares identity). It is fitted on a
bounded sample of labelled rows; whole texts are scored in batches by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storepulse.llm.words import WordHasher

WORD_BUCKETS = 4096
BINS = 12
STATS = 12
WIDTH = WORD_BUCKETS + STATS * (BINS + 1) + 1
FACTORS = 8
BATCH = 64
SAMPLE_PER_CLASS = 2000  # bound of the labelled sample
EPOCHS = 24
THRESHOLD = 0.3


def statistics(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, raw: np.ndarray, chars: int) -> np.ndarray:
    """Structure statistics between 0 and 1 of a text with words; ``raw`` has its bytes before lower-casing."""
    n = len(words)
    kinds = np.unique(words, return_counts=True)[1]
    letters = (data >= 97) & (data <= 122) | (data >= 128)
    upper = (raw >= 65) & (raw <= 90)
    digits = (data >= 48) & (data <= 57)
    signs = (data > 32) & (data < 127) & ~letters & ~digits
    seen = np.concatenate([[0], np.cumsum(letters)])
    lines = np.split(words, np.searchsorted(starts, np.flatnonzero(data == 10)))
    lines = [x.tobytes() for x in lines if len(x)]
    return np.array([
        min(1, np.log1p(chars) / 14), min(1, np.log1p(n) / 12), len(kinds) / n, kinds.max() / n,
        signs.sum() / len(data), upper.sum() / max(1, letters.sum()), digits.sum() / len(data), min(1, (ends - starts).mean() / 24),
        (words[1:] == words[:-1]).mean() if n > 1 else 0, 1 - len(set(lines)) / max(1, len(lines)),
        (seen[ends] == seen[starts]).mean(), min(1, np.log1p(n / max(1, len(lines))) / 8)])


def feature_row(text: str | None, hasher: WordHasher, out: np.ndarray) -> None:
    """Fill a zeroed row of ``WIDTH``. Texts without words set the last feature only."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    data = hasher.lower[raw]
    words = hasher.hashes(data)
    if not len(words):
        out[-1] = 1
        return
    starts, ends = hasher.split(data)
    counts = np.log1p(np.bincount((words >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS, minlength=WORD_BUCKETS))
    out[:WORD_BUCKETS] = counts / np.sqrt((counts * counts).sum())
    stats = statistics(data, starts, ends, words, raw, len(text))
    out[WORD_BUCKETS:WORD_BUCKETS + STATS] = stats
    at = np.minimum(BINS - 1, (np.sqrt(stats) * BINS).astype(np.int64))  # finer near zero
    out[WORD_BUCKETS + STATS + np.arange(STATS) * BINS + at] = 1


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    linear: np.ndarray  # WIDTH
    factors: np.ndarray  # WIDTH x FACTORS

    def score(self, x: np.ndarray) -> np.ndarray:
        pairs = (x @ self.factors) ** 2 - (x * x) @ (self.factors ** 2)
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.linear + pairs.sum(axis=1) / 2, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 3) -> FactorisationMachine:
    """Logistic loss with L2, by Adam over seeded mini-batches. Without rows of both classes: a constant machine."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return FactorisationMachine(float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros(WIDTH, np.float32), np.zeros((WIDTH, FACTORS), np.float32))
    rng = np.random.default_rng(seed)
    p = [np.zeros(1, np.float32), np.zeros(WIDTH, np.float32), (rng.standard_normal((WIDTH, FACTORS)) * 0.02).astype(np.float32)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at:at + BATCH]
            b = x[rows]
            s = b @ p[2]
            pairs = (s * s - (b * b) @ (p[2] ** 2)).sum(axis=1) / 2
            g = (1 / (1 + np.exp(-np.clip(p[0] + b @ p[1] + pairs, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            g = g.astype(np.float32)
            grads = [g.sum(keepdims=True), b.T @ g + 1e-4 * p[1], b.T @ (g[:, None] * s) - p[2] * ((b * b).T @ g)[:, None] + 1e-4 * p[2]]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return FactorisationMachine(float(p[0][0]), p[1], p[2])


def held_out(id_col: str, folds: int = 5, fold: int = 0) -> Column:
    """Is the row's crc32(id as text) mod ``folds`` equal to ``fold``? Null ids: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> FactorisationMachine:
    """Fit on labelled rows outside the held-out fold: at most ``SAMPLE_PER_CLASS`` of each class by a hash of the
    id, weighted to the classes' true shares. Labels other than 0 and 1 and null ids are left out."""
    own = labels.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).distinct()
    shares = dict(own.groupBy("_y").count().collect())
    first = [own.where(F.col("_y") == y).orderBy(F.xxhash64(F.lit(3), "_id"), "_id").limit(SAMPLE_PER_CLASS) for y in (0, 1)]
    chosen = first[0].unionByName(first[1])
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            found = []
            for t in b.column(2).to_pylist():
                x = np.zeros(WIDTH, dtype=np.float32)
                feature_row(t, hasher, x)
                at = np.flatnonzero(x).astype(np.int32)
                found.append((at.tobytes(), x[at].tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["id", "y", "at", "x"])

    least = F.min(F.struct("at", "x")).alias("f")  # rows that share an id count once, whichever text is the least
    got = sorted(texts.mapInArrow(rows, "id long, y int, at binary, x binary").groupBy("id", "y").agg(least).select("id", "y", "f.at", "f.x").collect())
    x = np.zeros((len(got), WIDTH), dtype=np.float32)
    for i, r in enumerate(got):
        x[i][np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["x"], np.float32)
    y = np.array([r["y"] for r in got], dtype=np.float32)
    total = max(1, sum(shares.values()))
    weight = np.array([shares[int(c)] / total * len(y) / max(1, (y == c).sum()) for c in y.tolist()], dtype=np.float32)
    return fit(x, y, weight)


def score_quality(docs: DataFrame, machine: FactorisationMachine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1) for every whole text; a column of that name is replaced.

    Only the text is an input. Null, empty and blank texts share one score; repeated rows score alike."""
    kept = [c for c in docs.columns if c != score_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                x = np.zeros((b.num_rows, WIDTH), dtype=np.float32)
                for row, t in zip(x, b.column(b.schema.get_field_index(text_col)).to_pylist(), strict=True):
                    feature_row(t, hasher, row)
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(machine.score(x).astype(np.float64))], [*kept, score_col])

    return docs.mapInArrow(score, T.StructType([*(docs.schema[c] for c in kept), T.StructField(score_col, T.DoubleType())]))
