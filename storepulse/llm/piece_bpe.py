"""Exact merge-type subword encoding by backtracking, and decoding.

A BPE result is the one token sequence in which every adjacent pair is *compatible*: merging the two
tokens' text from characters gives back just these two. So the encoder needs no merge queue over the
text: at each position it takes the longest piece found by an Aho-Corasick automaton, checks it
against the token before by re-merging the two (remembered per pair), tries shorter pieces on a
mismatch, and steps back when none fits, marking the position in a bitfield of failed positions.

No piece holds a word-start mark after other text, so words are encoded one by one and remembered in a
bounded table. Runs of spaces, whose merges tie in score, are re-merged directly. Every text is
processed whole in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

import gc
import heapq
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from storepulse.llm.worker import give_back, kept_tables

MARK = "▁"  # word start; stands for a space inside pieces
WORD_BYTES = 20 << 20  # of a word table's generation, about; a worker has two tables of two generations
KEPT = "piece_bpe"
PAIRS_KEPT = 400_000  # per worker, of 140 bytes about; a full table is emptied
TRANSITIONS_KEPT = 100_000  # of the automaton, through failure links
SLICE_ROWS = 500  # rows whose ids and texts a task holds at once
LONGEST_KEPT = 64


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: piece texts and scores by id, the ids that merging may produce, and the 256 byte ids."""
    texts: list[str]
    scores: list[float]
    mergeable: list[bool]
    byte_ids: list[int]


def load_pieces(path: str) -> Pieces:
    """Read a vocabulary file on the driver (tens of thousands of pieces, shipped with the task functions)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
        raise ValueError("only models with identity normalisation, a dummy prefix and byte fallback are supported")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    texts = [sp.id_to_piece(i) for i in range(n)]
    plain = [not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
    if any(p and re.search(f"[^{MARK}]{MARK}", t) for p, t in zip(plain, texts, strict=True)):
        raise ValueError("a piece spans two words")
    by_byte = {texts[i]: i for i in range(n) if sp.is_byte(i)}
    return Pieces(texts, [sp.get_score(i) for i in range(n)], plain, [by_byte[f"<0x{b:02X}>"] for b in range(256)])


class Words(dict):
    """Ids by word, made when missing, kept over the tasks of a worker. Two generations of bounded bytes: a full one
    becomes the old one, and words of the old one that come again move to the new."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old, self.bytes = make, most, {}, 0

    def __missing__(self, word: str) -> bytes:
        if (got := self.old.get(word)) is None:
            got = self.make(word)
        if len(word) <= LONGEST_KEPT:
            if self.bytes >= self.most:
                self.old = dict(self)
                self.clear()
                self.bytes = 0
            self[word] = got
            self.bytes += 200 + 2 * len(word) + len(got)  # two objects and their place in the table
        return got


class LongestStarts:
    """Aho-Corasick automaton of the pieces read backwards: after a text's end is read up to a character, its state
    tells the longest piece that starts there. Transitions through failure links are remembered, up to a bound."""

    def __init__(self, pieces: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.longest = [-1]
        for t, i in pieces.items():
            node = 0
            for c in reversed(t):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.longest.append(-1)
                node = self.next[node][c]
            self.longest[node] = i
        self.fail, self.room = [0] * len(self.next), TRANSITIONS_KEPT
        level = list(self.next[0].values())
        while level:
            below = []
            for node in level:
                if self.longest[node] < 0:
                    self.longest[node] = self.longest[self.fail[node]]
                for c, child in self.next[node].items():
                    self.fail[child] = self._after(self.fail[node], c)
                    below.append(child)
            level = below

    def _after(self, state: int, c: str) -> int:
        while (node := self.next[state].get(c)) is None and state:
            state = self.fail[state]
        return node or 0

    def of(self, text: str) -> list[int]:
        """Id of the longest piece that starts at each character, -1 for none."""
        step, longest, state, out = self.next, self.longest, 0, []
        for c in reversed(text):
            if (node := step[state].get(c)) is None:
                node = self._after(state, c)
                if self.room:
                    step[state][c] = node
                    self.room -= 1
            state = node
            out.append(longest[state])
        out.reverse()
        return out


class Encoder:
    """Text to ids."""

    def __init__(self, pieces: Pieces, word_bytes: int = WORD_BYTES):
        self.rank = {t: -s for t, s, m in zip(pieces.texts, pieces.scores, pieces.mergeable, strict=True) if m}
        self.ids = {t: i for i, (t, m) in enumerate(zip(pieces.texts, pieces.mergeable, strict=True)) if m}
        self.byte_ids, self.known = pieces.byte_ids, pieces.texts
        self.starts = LongestStarts(self.ids)
        # by number: pieces have their id, characters without a piece get further numbers when met
        self.texts, self.numbers = list(pieces.texts), dict(self.ids)
        self.sizes = [len(t) for t in self.texts]
        self.shorter = [-1] * len(self.texts)
        for t, i in self.ids.items():
            if len(t) > 1:
                self.shorter[i] = next((self.ids[t[:k]] for k in range(len(t) - 1, 1, -1) if t[:k] in self.ids), self._number(t[0]))
        self.fits: dict[int, bool] = {}
        self.joined = {t[k:k + 2] for t in self.ids for k in range(len(t) - 1)}
        self.by_word = Words(lambda w: self._word(MARK, w), word_bytes)
        self.inner = Words(lambda w: self._word("", w), word_bytes)
        self.newline = self._bytes_of(["\n"])
        self.newline_alone = not any("\n" in t and t != "\n" for t in self.ids)

    def remerge(self, text: str) -> list[str]:
        """Plain merging from characters: best score first, leftmost among equals."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap = [(self.rank[parts[i] + parts[i + 1]], i, 2) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, n = heapq.heappop(heap)
            if parts[i] is None or (j := right[i]) >= len(parts) or len(parts[i]) + len(parts[j]) != n:
                continue  # one of the two has merged meanwhile
            parts[i] += parts[j]
            parts[j] = None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0 and (b := right[a]) < len(parts) and (rank := self.rank.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (rank, a, len(parts[a]) + len(parts[b])))
        return [p for p in parts if p is not None]

    def _number(self, c: str) -> int:
        """Number of a character that no piece starts with."""
        if (i := self.numbers.get(c)) is None:
            i = self.numbers[c] = len(self.texts)
            self.texts.append(c)
            self.sizes.append(1)
            self.shorter.append(-1)
        return i

    def compatible(self, a: int, b: int) -> bool:
        """Do pieces ``a`` and ``b`` stay as they are when their joint text is merged anew? ``a`` is -1 at the start."""
        x, y = self.texts[a] if a >= 0 else "", self.texts[b]
        known = self.remerge(x + y) == ([x, y] if x else [y])
        if len(self.fits) >= PAIRS_KEPT:
            self.fits.clear()
        self.fits[a << 21 | b] = known
        return known

    def backtrack(self, text: str) -> list[int]:
        """Numbers of the tokens of one word, longest pieces first."""
        n = len(text)
        longest = self.starts.of(text)
        if -1 in longest:
            longest = [i if i >= 0 else self._number(c) for i, c in zip(longest, text, strict=True)]
        failed, stepped = bytearray(n // 8 + 1), False
        known, shorter, sizes = self.fits.get, self.shorter, self.sizes
        out: list[int] = []
        at, before, piece = 0, -1 << 21, longest[0]  # before: number of the token before, shifted
        while at < n:
            while piece >= 0:
                if (ok := known(before | piece)) is None:
                    ok = self.compatible(before >> 21, piece)
                if ok and not (stepped and failed[(end := at + sizes[piece]) >> 3] >> (end & 7) & 1):
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at += sizes[piece]
                before = piece << 21
                if at < n:
                    piece = longest[at]
            else:  # the encoding of text[:at] is unique, so nothing can start here again
                stepped = True
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= sizes[piece]
                piece = shorter[piece]
                before = (out[-1] if out else -1) << 21
        return out

    def _bytes_of(self, tokens: list[str]) -> bytes:
        return self._ids_of([self._number(t) if len(t) == 1 else self.ids[t] for t in tokens])

    def _ids_of(self, numbers: list[int]) -> bytes:
        """Ids of tokens by number; a character without a piece gives its bytes."""
        if max(numbers, default=0) < len(self.known):
            return array("i", numbers).tobytes()
        ids: list[int] = []
        for i in numbers:
            ids += [i] if i < len(self.known) else [self.byte_ids[b] for b in self.texts[i].encode()]
        return array("i", ids).tobytes()

    def _word(self, mark: str, word: str) -> bytes:
        """Ids of a word. No piece holds two characters that are neighbours in none, so the word is cut between such
        characters first: punctuation behind a word doesn't make another word of it."""
        if len(word) <= LONGEST_KEPT and word.isalpha():
            return self.segment(mark + word)
        pairs, joined = list(map(add, word, word[1:])), self.joined
        if not joined.issuperset(pairs):
            cuts = [k for k, pair in enumerate(pairs, 1) if pair not in joined]
            first = (self.by_word if mark else self.inner)[word[:cuts[0]]]
            return b"".join([first, *(self.inner[word[a:b]] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True))])
        return self.segment(mark + word)

    def segment(self, text: str) -> bytes:
        """Ids of a word with its marks."""
        return self._bytes_of(self.remerge(text)) if MARK * 2 in text else self._ids_of(self.backtrack(text))

    def _line(self, line: str, first: bool) -> list[bytes]:
        if "  " in line or line[-1:] == " " or (first and line[:1] == " ") or MARK in line:  # runs of marks belong to the word after them
            line = (MARK if first else "") + line.replace(" ", MARK)
            return [self.segment(seg) for seg in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line)]
        words = line.split(" ")
        start = [self.inner[w] for w in words[:1] if w and not first]
        return start + list(map(self.by_word.__getitem__, words if first else words[1:]))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for null and empty texts."""
        if not text:
            return np.empty(0, dtype=np.int32)
        out: list[bytes] = []
        for n, line in enumerate(text.split("\n") if self.newline_alone else [text]):
            if n:
                out.append(self.newline)
            if line or not n:
                out += self._line(line, not n)
        return np.frombuffer(b"".join(out), dtype=np.int32)


class Decoder:
    """Ids back to text."""

    def __init__(self, pieces: Pieces):
        self.table = np.array([t.replace(MARK, " ") for t in pieces.texts], dtype=object)
        for b, i in enumerate(pieces.byte_ids):
            self.table[i] = chr(b) if b < 128 else bytes([b])
        self.high = np.zeros(len(pieces.texts), dtype=bool)
        self.high[pieces.byte_ids[128:]] = True

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: marks become spaces, runs of byte pieces are read as UTF-8, the dummy prefix goes."""
        got = self.table[ids]
        if self.high[ids].any():
            parts, run = [], b""
            for x, i in zip(got, ids, strict=True):
                if self.high[i]:
                    run += x
                else:
                    parts += [run.decode("utf-8", "replace"), x]
                    run = b""
            text = "".join([*parts, run.decode("utf-8", "replace")])
        else:
            text = "".join(got)
        return text[1:] if text[:1] == " " else text


def worker_encoder(pieces: Pieces, word_bytes: int = WORD_BYTES) -> Encoder:
    """The encoder of this Python worker, kept over the tasks of a stage; another vocabulary replaces it."""
    tables, key = kept_tables(), hash((tuple(pieces.texts), tuple(pieces.scores), word_bytes))
    if tables.get(KEPT, (None,))[0] != key:
        tables[KEPT] = key, Encoder(pieces, word_bytes)
        gc.collect()
        gc.freeze()  # the automaton's many small tables stay out of every later collection
    return tables[KEPT][1]


def _with(df: DataFrame, made: dict[str, tuple[T.DataType, Callable]]) -> DataFrame:
    """``df`` with columns that ``value() -> (column of a batch) -> array`` make, in one pass and in order, so
    that one may read the one before; columns of these names are replaced."""
    kept = [c for c in df.columns if c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = {name: value() for name, (_, value) in made.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                columns = dict(zip(b.schema.names, b.columns, strict=True))
                for name, value in values.items():
                    columns[name] = value(columns.__getitem__)
                yield pa.RecordBatch.from_arrays([columns[c] for c in (*kept, *made)], [*kept, *made])
        del values
        give_back(keep=KEPT)

    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(n, k) for n, (k, _) in made.items())])
    return df.mapInArrow(run, schema)


def _encoded(pieces: Pieces, text_col: str, word_bytes: int = WORD_BYTES):
    def value():
        enc = worker_encoder(pieces, word_bytes)

        def ids(column) -> pa.Array:
            got = [enc.encode(t) for t in column(text_col).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got) if got else np.empty(0, dtype=np.int32)))
        return ids
    return T.ArrayType(T.IntegerType()), value


def _decoded(pieces: Pieces, ids_col: str):
    def value():
        dec = Decoder(pieces)

        def text(column) -> pa.Array:
            ids = column(ids_col)
            flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            return pa.array([dec.decode(flat[at[i]:at[i + 1]]) if ok else None for i, ok in enumerate(ids.is_valid().to_pylist())], pa.string())
        return text
    return T.StringType(), value


def encode_pieces(docs: DataFrame, pieces: Pieces, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: the ids of every whole text, without begin or end ids.

    Null and empty texts get an empty array; repeated rows are encoded each; other columns pass through, and
    one of the added name is replaced. An empty table gives an empty one."""
    return _with(docs, {ids_col: _encoded(pieces, text_col)})


def decode_pieces(df: DataFrame, pieces: Pieces, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``: the decoded text of ``ids_col``; a null array gives null."""
    return _with(df, {text_col: _decoded(pieces, ids_col)})


def round_trip(docs: DataFrame, pieces: Pieces, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", word_bytes: int = WORD_BYTES) -> DataFrame:
    """``encode_pieces`` and ``decode_pieces`` of its ids in one pass of the same worker, whose word tables hold about
    four times ``word_bytes``."""
    return _with(docs, {ids_col: _encoded(pieces, text_col, word_bytes), decoded_col: _decoded(pieces, ids_col)})
