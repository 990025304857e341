"""Fill-in-the-middle transformation: whole texts cut at two unit ranks and put together in another order.

A unit is a run of ASCII letters or any other single character. The units of a text stand in an indexable
skip list: the bottom lane has a link per unit, each lane above it a link to every eighth node or so, and a
link carries the number of units and of code points it spans. Descending from the top lane by the summed
unit widths reaches a cut rank exactly, and the summed code-point widths are the place to cut at.

Every text is cut in the task that reads it; nothing is shuffled. A task holds one slice of rows and one
list of four bytes a unit at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storepulse.llm.worker import give_back
from storepulse.llm.words import mix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
LANE_BITS = 3  # a node reaches the next lane with probability 1/8
CHUNK = 1 << 20  # code points or units handled at once
SLICE_ROWS = 64
MADE = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                     T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def unit_starts(text: str) -> Iterator[np.ndarray]:
    """Code-point places at which units start, in order and in chunks."""
    in_word = False
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at:at + CHUNK].encode("utf-32-le"), dtype=np.uint32)
        letter = ((points | 32) - np.uint32(97)) < 26
        start = np.empty(len(letter), dtype=bool)
        start[0] = not (in_word and letter[0])
        np.logical_not(letter[1:] & letter[:-1], out=start[1:])
        in_word = bool(letter[-1])
        yield np.flatnonzero(start) + at


class UnitList:
    """Skip list over units, indexed by unit rank. Lane 0 spans one unit a link; ``down`` of a lane's node is
    its place in the lane below."""

    def __init__(self, text: str):
        starts = [np.empty(0, dtype=np.uint32), *(s.astype(np.uint32) for s in unit_starts(text))]
        ends = np.append(np.concatenate(starts), np.uint32(len(text)))
        self.n = len(ends) - 1
        self.units: list[np.ndarray | None] = [None]
        self.chars = [np.diff(ends)]
        self.down: list[np.ndarray] = []
        nodes = np.arange(self.n if self.n > 1 << LANE_BITS else 0)
        heights = np.concatenate([np.empty(0, dtype=np.uint64), *(mix(nodes[at:at + CHUNK].astype(np.uint64)) for at in range(0, len(nodes), CHUNK))])
        while len(nodes) > 1 << LANE_BITS:
            up = (heights & np.uint64((1 << LANE_BITS) - 1)) == 0
            up[0] = True  # the head is as high as the list
            self.down.append(np.flatnonzero(up))
            nodes, heights = nodes[up], heights[up] >> np.uint64(LANE_BITS)
            edges = np.append(nodes, self.n)
            self.units.append(np.diff(edges))
            self.chars.append(np.diff(ends[edges]))

    def chars_before(self, rank: int) -> int:
        """Code points before the unit of this rank (0 to n)."""
        at, units, chars = 0, 0, 0
        for lane in range(len(self.chars) - 1, -1, -1):
            widths, spans = self.units[lane], self.chars[lane]
            while at < len(spans) and units + (step := 1 if widths is None else int(widths[at])) <= rank:
                units += step
                chars += int(spans[at])
                at += 1
            if units == rank:
                break
            if lane:
                at = int(self.down[lane - 1][at])
        return chars


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four 32-bit numbers of the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k:k + 4], "big") for k in range(0, 16, 4)]


def transform(text: str, doc_id: int | None, seed: int) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (none if plain), and the text put together anew."""
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= PLAIN_FROM or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return sum(map(len, unit_starts(text))), PLAIN, None, None, text
    units = UnitList(text)
    first, last = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.chars_before(first), units.chars_before(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form, parts = (SPM, (SUFFIX, suffix, PREFIX, prefix)) if h4 % 100 < SPM_BELOW else (PSM, (PREFIX, prefix, SUFFIX, suffix))
    return units.n, form, a, b - a, "".join([*parts, MIDDLE, middle])


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 1) -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    Null and empty texts, texts that hold a marker and a tenth of the others stay plain, with null lengths; a null
    text has the output "". A null id draws as the empty id does, repeated rows are cut alike, other columns pass
    through, and those with one of the added names are replaced. An empty table gives an empty one."""
    kept = [c for c in docs.columns if c not in MADE.names]
    given = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("_fim_text"), F.col(id_col).alias("_fim_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                columns = dict(zip(b.schema.names, b.columns, strict=True))
                made = [transform(t, i, seed) for t, i in zip(columns["_fim_text"].to_pylist(), columns["_fim_id"].to_pylist(), strict=True)]
                new = [pa.array(x, k) for x, k in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(columns[c] for c in kept), *new], [*kept, *MADE.names])
        give_back()

    return given.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *MADE.fields]))


def restored_text(output: Column, form: Column) -> Column:
    """The exact text of an output and its form. No marker can begin inside one part and end in a marker, so the
    first markers found are those that were put in."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))

    def split(rest: Column, marker: str) -> tuple[Column, Column]:
        head = F.substring_index(rest, marker, 1)
        return head, F.substr(rest, F.length(head) + len(marker) + 1)

    prefix, rest = split(body, SUFFIX)
    suffix, middle = split(rest, MIDDLE)
    late_suffix, late_rest = split(body, PREFIX)
    late_prefix, late_middle = split(late_rest, MIDDLE)
    return (F.when(form == PSM, F.concat(prefix, middle, suffix)).when(form == SPM, F.concat(late_prefix, late_middle, late_suffix))
            .otherwise(output))
