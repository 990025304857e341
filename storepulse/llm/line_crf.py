"""Quality rules by line sequence labelling.

Every line that holds a word gets a vector of structure features. A linear-chain conditional random field
over the lines of a text says for each whether it is content or boilerplate; its best label sequence is found
by Viterbi decoding, and a document is kept if enough of its word characters stand in content lines and the
plain base rules don't fail.

Only documents are labelled, not lines. Lines of documents marked good are content; lines of documents marked
bad start as boilerplate, fitted without transitions, and take the field's own best labels in later rounds, with at
least one boilerplate line left in each window (hard EM). The field is fitted on the driver from a bounded sample of windows, the
features of which the tasks compute; scoring reads every text once, in the task that holds it.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storepulse.llm.worker import give_back
from storepulse.llm.words import WordHasher, mix
from storepulse.session import cut_lineage

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PER_CENT = 50, 50  # base rules
CONTENT_SHARE = 0.5  # of the word characters; less is not kept
WINDOW = 16  # lines of a training window at most
SAMPLE_WINDOWS = 1500  # per label
SAMPLE_IDS = 2000  # labelled ids, per label
CONTENT, BOILERPLATE = 0, 1
ROUNDS, STEPS, RATE, PENALTY = 3, 80, 0.2, 5e-4
SLICE_ROWS = 64

# Features are real values; each also gives one indicator per cut it exceeds.
CUTS = {
    "words": (2, 5, 12), "word_length": (2.5, 4.0, 7.0, 10.0), "symbols": (0.02, 0.2, 0.6), "shouts": (0.05, 0.3, 0.8), "upper": (0.1, 0.4, 0.8),
    "same_as_last": (0.02, 0.1, 0.4), "distinct": (0.2, 0.5, 0.8, 0.95), "bars": (0.05, 0.3), "stops": (0.01, 0.05, 0.15), "repeats": (0.05, 0.3, 0.7), "again": (0.5,), "ends": (0.5,), "capital": (0.5,), "letters": (0.4, 0.7, 0.9),
}
NAMES = list(CUTS)
N_FEATURES = 1 + sum(map(len, CUTS.values()))
STATS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "content_lines", "content_chars")])


class Lines:
    """Base counts and line features of one text. ``start`` and ``end`` are the byte bounds of lines with a word."""

    def __init__(self, reader: "LineReader", text: str | None):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        solid = ~reader.space[data]
        words = reader.hasher.hashes(data)
        starts, ends = reader.hasher.split(data)
        self.n_words = n = len(words)
        points = (data & 0xC0) != 0x80
        count = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        solid_points = count(solid & points)
        self.word_chars = int(solid_points[-1])
        symbols = count(reader.symbol[data])
        self.n_symbols = int(symbols[-1])
        repeated = repeat_words(words)
        self.n_repeat_words = int(repeated.sum())

        bounds = np.concatenate([[-1], np.flatnonzero(data == 10), [len(data)]])
        first = np.searchsorted(starts, bounds[:-1] + 1)
        last = np.searchsorted(starts, bounds[1:])
        some = last > first
        self.start, self.end, a, b = bounds[:-1][some] + 1, bounds[1:][some], first[some], last[some]
        seen: set[bytes] = set()
        raw = data.tobytes()
        again = np.zeros(len(a))
        for k, (x, y) in enumerate(zip(self.start.tolist(), self.end.tolist(), strict=True)):
            line = raw[x:y]
            if line in seen:
                again[k] = 1.0
            else:
                seen.add(line)
        self.n_dup_lines = int(again.sum())
        self.chars = solid_points[self.end] - solid_points[self.start]

        of = lambda total: (total[self.end] - total[self.start]).astype(np.float64)
        n_words, chars = (b - a).astype(np.float64), self.chars.astype(np.float64)
        last_byte = data[ends - 1] if n else data[:0]
        by_word = lambda mask: (lambda c: (c[b] - c[a]).astype(np.float64))(count(mask))
        same = np.zeros(n, dtype=bool)
        same[1:] = words[1:] == words[:-1]
        upper, letters = reader.classes(text or "", data)
        line_of = np.repeat(np.arange(len(a)), b - a)
        inside = mix(words + line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if n else words
        values, where = np.unique(inside, return_index=True)
        distinct = np.bincount(line_of[where], minlength=len(a)).astype(np.float64) if n else np.empty(0)
        n_letters = np.maximum(of(letters), 1.0)
        self.real = np.column_stack([
            n_words, chars / np.maximum(n_words, 1), of(symbols) / np.maximum(n_words, 1), by_word(last_byte == 33) / np.maximum(n_words, 1), of(upper) / n_letters,
            by_word(same) / np.maximum(n_words, 1), distinct / np.maximum(n_words, 1), of(count(data == 124)) / np.maximum(n_words, 1), by_word(reader.stop[last_byte]) / np.maximum(n_words, 1),
            by_word(repeated) / np.maximum(n_words, 1), again, reader.stop[data[ends[b - 1] - 1]] if len(b) else np.empty(0), reader.starts_upper(upper, letters, starts[a] if len(a) else a), of(letters) / np.maximum(chars, 1),
        ]) if len(a) else np.empty((0, len(NAMES)))

    def features(self) -> np.ndarray:
        """Indicator vectors, the first place always 1."""
        out = np.ones((len(self.real), N_FEATURES), dtype=np.float32)
        at = 1
        for k, name in enumerate(NAMES):
            for cut in CUTS[name]:
                out[:, at] = self.real[:, k] > cut
                at += 1
        return out


def repeat_words(words: np.ndarray) -> np.ndarray:
    """Which words stand in a 3-word window that the text holds at least twice."""
    out = np.zeros(len(words), dtype=bool)
    if len(words) < 4:
        return out
    base = np.uint64(0x9E3779B97F4A7C15)
    window = mix((words[:-2] * base + words[1:-1]) * base + words[2:])
    order = np.argsort(window, kind="stable")
    equal = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(window), dtype=bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    for k in range(3):
        out[k:len(window) + k] |= twice
    return out


class LineReader:
    """Tables of one task."""

    def __init__(self):
        self.hasher = WordHasher()
        self.space = self.hasher.is_space
        self.symbol = np.zeros(256, dtype=bool)
        self.symbol[list(SYMBOLS.encode())] = True
        self.stop = np.zeros(256, dtype=bool)
        self.stop[list(b".!?:;")] = True
        ascii_kinds = np.zeros((2, 256), dtype=bool)  # upper, letter
        ascii_kinds[0, 65:91] = ascii_kinds[1, 65:91] = ascii_kinds[1, 97:123] = True
        self.kinds = ascii_kinds
        self.wide: dict[str, tuple[bool, bool]] = {}

    def classes(self, text: str, data: np.ndarray) -> list[np.ndarray]:
        """Running counts, by byte, of upper-case letters and letters; a character counts at its first byte."""
        masks = [k[data] for k in self.kinds]
        if len(data) != len(text):
            lead = np.flatnonzero(data >= 0xC0)
            points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
            values, place = np.unique(points[points >= 128], return_inverse=True)
            known = np.array([self._kind(chr(v)) for v in values], dtype=bool).reshape(-1, 2)
            for mask, kind in zip(masks, known.T, strict=True):
                mask[lead] = kind[place]
        return [np.concatenate([[0], np.cumsum(m, dtype=np.int64)]) for m in masks]

    def _kind(self, c: str) -> tuple[bool, bool]:
        if (got := self.wide.get(c)) is None:
            kind = unicodedata.category(c)
            got = self.wide[c] = (kind in ("Lu", "Lt"), kind[0] == "L")
        return got

    @staticmethod
    def starts_upper(upper: np.ndarray, letters: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a line's first character is an upper-case letter, or a letter of a script without case is not."""
        return (upper[at + 1] - upper[at]).astype(np.float64)

    def read(self, text: str | None) -> Lines:
        return Lines(self, text)


@dataclass(frozen=True)
class Chain:
    """A linear-chain field with two labels: feature weights by label, transition and start scores."""
    weights: np.ndarray  # 2 x features
    moves: np.ndarray  # from x to
    first: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return features.astype(np.float64) @ self.weights.T

    def viterbi(self, emissions: np.ndarray) -> np.ndarray:
        """Best label sequence; of equal scores the one with content goes first."""
        n = len(emissions)
        labels = np.zeros(n, dtype=np.int8)
        if not n:
            return labels
        (cc, cb), (bc, bb) = self.moves.tolist()
        scores = emissions.tolist()
        c, b = scores[0][0] + self.first[0], scores[0][1] + self.first[1]
        back_c, back_b = bytearray(n), bytearray(n)
        for k in range(1, n):
            e_c, e_b = scores[k]
            stay, come = c + cc, b + bc
            move, keep = c + cb, b + bb
            if come > stay:
                back_c[k], stay = 1, come
            if keep > move:
                back_b[k], move = 1, keep
            c, b = stay + e_c, move + e_b
        label = 1 if b > c else 0
        for k in range(n - 1, -1, -1):
            labels[k] = label
            label = (back_b if label else back_c)[k]
        return labels


def everything_content() -> Chain:
    """The field used without labels of both kinds."""
    weights = np.zeros((2, N_FEATURES))
    weights[CONTENT, 0] = 1.0
    return Chain(weights, np.zeros((2, 2)), np.zeros(2))


def log_likelihood(chain: Chain, x: np.ndarray, y: np.ndarray, length: np.ndarray, weight: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Weighted log-likelihood of padded label sequences and its gradient, by forward and backward sums.

    ``x`` is sequences x lines x features, ``y`` the labels, ``length`` the lines that count."""
    m, n, _ = x.shape
    live = np.arange(n)[None, :] < length[:, None]
    score = x @ chain.weights.T.astype(np.float32)
    score = score.astype(np.float64)
    forward, backward = np.empty((m, n, 2)), np.zeros((m, n, 2))
    forward[:, 0] = score[:, 0] + chain.first
    for k in range(1, n):
        step = np.logaddexp(forward[:, k - 1, :1] + chain.moves[0], forward[:, k - 1, 1:] + chain.moves[1]) + score[:, k]
        forward[:, k] = np.where(live[:, k, None], step, forward[:, k - 1])
    for k in range(n - 2, -1, -1):
        after = score[:, k + 1] + backward[:, k + 1]
        step = np.logaddexp(chain.moves[None, :, 0] + after[:, :1], chain.moves[None, :, 1] + after[:, 1:])
        backward[:, k] = np.where(live[:, k + 1, None], step, 0.0)
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    node = np.exp(forward + backward - total[:, None, None]) * live[..., None]
    truth = np.eye(2)[y] * live[..., None]
    both = live[:, 1:]
    edge = np.exp(forward[:, :-1, :, None] + chain.moves + (score + backward)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
    true_edge = truth[:, :-1, :, None] * truth[:, 1:, None, :]
    value = (truth * score).sum((1, 2)) + truth[:, 0] @ chain.first + (true_edge * chain.moves).sum((1, 2, 3)) - total
    rest = ((truth - node) * weight[:, None, None]).astype(np.float32)
    return float(value @ weight), (np.einsum("snl,snf->lf", rest, x, optimize=True).astype(np.float64), ((true_edge - edge) * weight[:, None, None, None]).sum((0, 1)), rest[:, 0].sum(0).astype(np.float64))


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # features, labels, lengths and weights of padded windows


def fit_chain(blocks: list[Block], chain: Chain, linked: bool = True) -> Chain:
    """Adam steps on the penalised likelihood of all blocks, from ``chain`` on; not ``linked``, transitions stay as they are."""
    values = [chain.weights.copy(), chain.moves.copy(), chain.first.copy()]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, STEPS + 1):
        parts = [log_likelihood(Chain(*values), *block)[1] for block in blocks]
        for k, (v, m, s, *slopes) in enumerate(zip(values, mean, square, *parts, strict=True)):
            slope = (sum(slopes) - PENALTY * v) * (linked or k != 1)
            m += 0.1 * (slope - m)
            s += 0.01 * (slope * slope - s)
            v += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return Chain(*values)


def fit_windows(windows: list[np.ndarray], bad: np.ndarray) -> Chain:
    """Hard EM over windows of line features; ``bad`` marks those of documents with the bad label. Both labels weigh alike."""
    length = np.array([len(w) for w in windows])
    weight = np.where(bad, 0.5 / max(1, bad.sum()), 0.5 / max(1, (~bad).sum()))
    order, blocks = np.argsort(length, kind="stable"), []
    for part in np.array_split(order, max(1, len(order) // 500)):  # windows of like length share a block
        x = np.zeros((len(part), length[part].max(), N_FEATURES), dtype=np.float32)
        for k, w in enumerate(part):
            x[k, :length[w]] = windows[w]
        blocks.append((x, np.repeat(bad[part].astype(np.int64)[:, None], x.shape[1], axis=1), length[part], weight[part]))
    chain = fit_chain(blocks, everything_content(), linked=False)  # line by line first, or every line of a bad text would stay bad
    for _ in range(ROUNDS - 1):
        for (x, y, lengths, _), part in zip(blocks, np.array_split(order, max(1, len(order) // 500)), strict=True):
            for k in np.flatnonzero(bad[part]):
                e = chain.emissions(x[k, :lengths[k]])
                y[k, :lengths[k]] = chain.viterbi(e)
                if not y[k, :lengths[k]].any():
                    y[k, int(np.argmax(e[:, BOILERPLATE] - e[:, CONTENT]))] = BOILERPLATE
        chain = fit_chain(blocks, chain)
    return chain


def _windows(labelled: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """A row per window of lines: label, a hash of its text, and the packed features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LineReader()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                rows: list[tuple[int, int, bytes]] = []
                for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    lines, raw = reader.read(text), (text or "").encode()
                    f = lines.features().astype(np.uint8)
                    for k in range(0, len(f), WINDOW):
                        part = raw[lines.start[k]:lines.end[min(k + WINDOW, len(f)) - 1]]
                        digest = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)
                        rows.append((label, digest, np.packbits(f[k:k + WINDOW], axis=1).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bad", "digest", "features"])
        give_back()

    return labelled.select(F.col(text_col), F.col(label_col).cast("int")).mapInArrow(run, "bad int, digest long, features binary")


def learn_lines(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> Chain:
    """Fit the field on at most ``SAMPLE_WINDOWS`` windows of ``WINDOW`` lines and differing text per label, taken by hash from the
    whole documents of at most ``SAMPLE_IDS`` ids per label, taken by hash from all that a row of ``labels`` marks 1 (good) or 0 (bad). Rows without an id, text or label, and ids marked both
    ways, teach nothing; without windows of both labels everything counts as content."""
    marks = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id"))
             .agg(F.min(label_col).alias("_low"), F.max(label_col).alias("_high")).where("_low = _high").select("_id", (1 - F.col("_low")).alias("_bad")))
    chosen = [marks.where(F.col("_bad") == bad).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_IDS) for bad in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most twice SAMPLE_IDS: texts stay where they are read
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL").join(ids, "_id")
    windows = cut_lineage(_windows(found, "_text", "_bad")).groupBy("bad", "digest").agg(F.first("features").alias("features"))
    rows = [r for bad in (0, 1) for r in windows.where(F.col("bad") == bad).orderBy("digest").limit(SAMPLE_WINDOWS).collect()]
    bad = np.array([r.bad == 1 for r in rows], dtype=bool)
    if not len(bad) or bad.all() or not bad.any():
        return everything_content()
    width = -(-N_FEATURES // 8)
    unpacked = [np.unpackbits(np.frombuffer(r.features, dtype=np.uint8).reshape(-1, width), axis=1)[:, :N_FEATURES].astype(np.float32) for r in rows]
    return fit_windows(unpacked, bad)


def label_lines(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``n_lines`` (lines with a word), ``content_lines`` and ``content_chars`` (word
    characters in content lines).

    Null, empty and blank texts have zeros; repeated rows get equal figures; other columns pass through, and those with
    one of the added names are replaced. An empty table gives an empty one."""
    kept = [c for c in docs.columns if c not in STATS.names]
    given = docs.select(*kept, F.col(text_col).alias("_crf_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LineReader()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                columns = dict(zip(b.schema.names, b.columns, strict=True))
                made = []
                for text in columns["_crf_text"].to_pylist():
                    lines = reader.read(text)
                    content = chain.viterbi(chain.emissions(lines.features())) == CONTENT
                    made.append((lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words, len(content), int(content.sum()), int(lines.chars[content].sum())))
                new = [pa.array(x, pa.int64()) for x in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([*(columns[c] for c in kept), *new], [*kept, *STATS.names])
        give_back()

    return given.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *STATS.fields]))


def judge_lines(docs: DataFrame, chain: Chain, text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """``label_lines`` with ``base_failed`` (too few words, or too many in repeated 3-word windows) and ``kept``: the base
    holds and at least ``share`` of the word characters stand in content lines."""
    out = label_lines(docs, chain, text_col)
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PER_CENT * F.col("n_words"))
    return out.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & (F.col("content_chars") >= share * F.col("word_chars")))
