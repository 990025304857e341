"""Language identification by a blended-spectrum string kernel.

The kernel of two texts is the cosine of their n-gram presence sets, blended over n = 1..``MAX_N``: letters
are lower-cased, everything else is one boundary sign, and grams are numbered by a ``BUCKETS``-wide hash.
Landmark texts span a Nyström feature space in which one-versus-rest kernel ridge regression is fitted on
a bounded sample of labelled rows. The fitted machine is linear in the presence sets, so landmarks,
Nyström map and ridge weights collapse into one gram-by-language matrix, and a batch of whole texts is
scored by one matrix product of its presence rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storepulse.llm.worker import give_back
from storepulse.session import cut_lineage

MAX_N = 3
BUCKETS = 1 << 15
BATCH = 32  # texts in a matrix product
SAMPLE_ROWS = 2400  # bound of the labelled sample, shared equally by the languages
SAMPLE_PER_LANG = 400
LANDMARKS = 256
RIDGE = 1e-3
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def presence(text: str, letters: np.ndarray) -> np.ndarray:
    """Gram numbers of a whole text (with repeats); empty when it has no letter."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    known = letters[cps]
    if not known.any():
        return np.empty(0, dtype=np.int64)
    c = np.ones(len(cps) + 2, dtype=np.uint32)  # 1 is the boundary sign, also at both ends
    np.copyto(c[1:-1], cps + np.uint32(2), where=known)
    out, code = [], np.zeros(len(c), np.uint32)
    for n in range(1, MAX_N + 1):
        code = code[:len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1:]
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out.append(mixed >> np.uint32(32 - 15))
    return np.concatenate(out)


def presence_rows(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Presence matrix of some texts, and the number of grams that each has (0: no letter)."""
    rows = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for i, t in enumerate(texts):
        if t and len(grams := presence(t, letters)):
            rows[i][grams] = 1
    return rows, rows.sum(axis=1)


def unit_rows(texts: list[str], letters: np.ndarray) -> np.ndarray:
    rows, sizes = presence_rows(texts, letters)
    return rows / np.sqrt(np.maximum(1, sizes))[:, None]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages


def packed_rows(texts: list[str | None], letters: np.ndarray) -> np.ndarray:
    """Presence rows as bits: 4 KB a text of any length."""
    return np.packbits(presence_rows(texts, letters)[0].astype(bool), axis=1)


def fit(texts: list[str], langs: list[str]) -> LanguageModel:
    """``fit_rows`` of some texts."""
    return fit_rows(packed_rows(texts, letter_table()), langs)


def fit_rows(packed: np.ndarray, langs: list[str]) -> LanguageModel:
    """Fit on the presence rows of a bounded sample: landmarks in turn from each language, Nyström features, ridge weights."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), dtype=np.float32))

    def unit(rows: np.ndarray) -> np.ndarray:
        rows = np.unpackbits(rows, axis=1).astype(np.float32)
        return rows / np.sqrt(np.maximum(1, rows.sum(axis=1)))[:, None]

    turn = {name: [i for i, x in enumerate(langs) if x == name] for name in names}
    marks = [i for k in range(max(map(len, turn.values()))) for name in names for i in turn[name][k:k + 1]][:LANDMARKS]
    z = unit(packed[marks])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström map
    gram, right = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(names)))
    for at in range(0, len(packed), BATCH):
        phi = (unit(packed[at:at + BATCH]) @ z.T) @ root
        y = np.where(np.array(langs[at:at + BATCH])[:, None] == np.array(names)[None, :], 1.0, -1.0)
        share = np.array([len(turn[x]) for x in langs[at:at + BATCH]])[:, None]  # every language weighs the same
        gram += phi.T @ (phi / share)
        right += phi.T @ (y / share)
    beta = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), right)
    return LanguageModel(names, (z.T @ (root @ beta)).astype(np.float32))


def held_out(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    """Is the row's crc32(id as text) mod ``folds`` equal to ``fold``? Null ids: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on labelled rows outside the held-out fold that have an id, a letter and a non-null language: at most
    ``SAMPLE_PER_LANG`` ids a language and ``SAMPLE_ROWS`` in all, by a hash of the id. The tasks read the chosen
    texts whole, whatever their length, and return their presence rows; of texts that share an id and a language
    the one with the least row counts."""
    own = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    own = own.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    ids = cut_lineage(own.select("_id", "_lang").distinct())
    langs = ids.select("_lang").distinct().count()
    each = max(1, min(SAMPLE_PER_LANG, SAMPLE_ROWS // max(1, langs)))
    order = W.partitionBy("_lang").orderBy(F.xxhash64(F.lit(10), "_id"), "_id")
    chosen = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).drop("_n")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                packed = packed_rows(b.column(2).to_pylist(), letters)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array([r.tobytes() for r in packed], pa.binary())], ["id", "lang", "row"])
        give_back()

    sample = own.join(F.broadcast(chosen), ["_id", "_lang"]).select("_id", "_lang", "_text").mapInArrow(rows, "id string, lang string, row binary")
    got = sorted(sample.groupBy("id", "lang").agg(F.min("row").alias("row")).collect())  # at most SAMPLE_ROWS, or one a language
    packed = np.frombuffer(b"".join(bytes(r["row"]) for r in got), dtype=np.uint8).reshape(-1, BUCKETS // 8)
    return fit_rows(packed, [r["lang"] for r in got])


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1); columns of these names are replaced.

    Null texts, texts without a letter, and every text if no language was learned: ``und`` with score 0. Whole
    texts are scored; repeated rows get equal results; ties go to the first language in order."""
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                rows, sizes = presence_rows(b.column(b.schema.get_field_index(text_col)).to_pylist(), letters)
                some = (sizes > 0) & bool(model.languages)
                got = rows @ model.weights / np.sqrt(np.maximum(1, sizes))[:, None] if model.languages else np.zeros((b.num_rows, 1))
                best = got.argmax(axis=1)
                lang = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), some.tolist(), strict=True)]
                sure = np.where(some, np.clip((1 + got[np.arange(len(best)), best]) / 2, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(lang, pa.string()), pa.array(sure.astype(np.float64))],
                                                 [*kept, lang_out, score_out])
        give_back()

    return docs.mapInArrow(score, T.StructType([*(docs.schema[c] for c in kept), T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))
