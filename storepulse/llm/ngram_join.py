"""N-gram Jaccard self-join, size-aware: light sets by fixed-size subsets, heavy sets by inverted lists.

A document's set holds its distinct five-word shingles as 64-bit hashes; equal sets are one node. Two sets of
n and m shingles link when they share at least ``c(n, m)``, the least count that reaches the threshold.

*Light* sets (up to a boundary size) enumerate all subsets of ``c(n, m)`` shingles for every partner size m.
Sets that meet in a subset link, with nothing left to verify.

*Heavy* sets go to inverted lists of their prefixes: in one global order of shingles, frequent ones last, two
sets that link share a shingle among the first ``n - ceil(t n) + 1``, on the smaller side even among the first
``n - ceil(2 t n / (1 + t)) + 1``. A list is scanned as a star: every member against one pivot, and in each round
lists whose members are still in different components against the member with the fewest shingles of its own. When the pairs left between
components cost no more than another round, they are all scanned, so no link between different texts is
lost, while a group of copies costs about as many pairs as members.

Candidates pass a rigorous filter first: counts of a set's shingles in hash buckets bound the overlap from above. What is left is verified on the whole sets.

The boundary is the size at which enumerating subsets starts to cost more than scanning lists.

Texts are read for sizes and counts, for lists, and for the sets of each scan's candidates only; they are
never shuffled. Tables between the steps are written to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storepulse.llm.graph import components
from storepulse.llm.worker import give_back
from storepulse.llm.words import WordHasher, mix, shingles
from storepulse.session import cut_lineage

T_NUM, T_DEN = 3, 4  # Jaccard threshold 3 / 4
SHINGLE = 5
MAX_LIGHT = 12  # sizes considered as boundary
VERIFY_COST = 12  # cost of a list entry with its share of scans, in subsets
FREQUENT = 1 << 18  # most frequent shingles known to every task, ordered last; a bound on the broadcast
LOCAL_LEAST = 3  # sets of one block that make a shingle worth counting
BLOCK_SHINGLES = 1 << 20  # shingles counted at once by a task
LIST_SPLIT = 20_000  # longer lists are scanned in parts that meet in their pivots
SLICE_ROWS = 500
BITS = 1 << 23  # size of the filter of wanted sets
BUCKETS = (128, 1024, 8192)  # hash buckets of the counts of sets up to eight times as many shingles; the last for all others
FULL_SCAN = 32  # pairs a list entry that make a full scan as cheap as a round of stars
GAIN = 0.7  # a round that leaves more than this share of the pairs is the last before the full scan
ENTRIES = 1 << 18  # list entries that a task packs at once
BUCKET_BYTES = 6 << 20  # packed entries of a shuffle partition
SHORT_LIST = 16  # lists up to this length lose entries that no other member can link with
CROSS_BLOCK = 4096  # members of a list that a full scan compares at once; longer lists are dealt into pairs of blocks
PAIR_SLICE = 1 << 15  # pairs whose counts are compared at once
PAIRS_SEEN = 200_000  # pairs that a task remembers
LIST_GROUPS = 4  # tasks that share the lists of one least member


def least_common(n: int, m: int) -> int:
    """Least number of common shingles at which sets of n and m reach the threshold."""
    return -(-T_NUM * (n + m) // (T_NUM + T_DEN))


def sizes_near(n: int) -> range:
    """Sizes that a set of n can link with."""
    return range(-(-T_NUM * n // T_DEN), T_DEN * n // T_NUM + 1)


def probe_length(n: int) -> int:
    return n - -(-T_NUM * n // T_DEN) + 1


def index_length(n: int) -> int:
    return n - -(-2 * T_NUM * n // (T_NUM + T_DEN)) + 1


def light_boundary(histogram: dict[int, int]) -> int:
    """Boundary of the least cost for these counts of sets by size (sizes to ``MAX_LIGHT``)."""
    def cost(b: int) -> int:
        light = sum(c * sum(comb(n, least_common(n, m)) for m in sizes_near(n) if m <= b) for n, c in histogram.items() if n <= b)
        return light + sum(c * VERIFY_COST * probe_length(n) for n, c in histogram.items() if n > b or T_DEN * n >= T_NUM * (b + 1))
    return min(range(MAX_LIGHT + 1), key=cost)


def set_key(found: np.ndarray) -> int:
    """64-bit key of a set, signed."""
    total = mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(found))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of (id, text) with the shingle sets of their texts."""
    hasher = WordHasher()
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE_ROWS):
            b = whole.slice(at, SLICE_ROWS)
            yield b, [shingles(hasher.hashes(hasher.bytes_of(t)), SHINGLE) for t in b.column(1).to_pylist()]
    give_back()


def _first_seen(sets: list[np.ndarray], seen: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Keys and sets that the task has not met yet (the memory of keys is bounded; a repeat does no harm)."""
    for s in sets:
        if len(s) and (key := set_key(s)) not in seen:
            if len(seen) >= 1_000_000:
                seen.clear()
            seen.add(key)
            yield key, s


def bucket_counts(found: np.ndarray) -> np.ndarray:
    """Shingles by hash bucket; 255 stands for that many or more."""
    n = next((b for b in BUCKETS if len(found) <= 8 * b), BUCKETS[-1])
    return np.minimum(np.bincount((found & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8)


def most_common(x: np.ndarray, y: np.ndarray) -> float:
    """Upper bound of the common shingles of two sets by their bucket counts."""
    if (x == 255).any() or (y == 255).any():
        return float("inf")
    n = min(len(x), len(y))  # a finer count folds into a coarser one
    return int(np.minimum(x.reshape(-1, n).sum(axis=0, dtype=np.int64), y.reshape(-1, n).sum(axis=0, dtype=np.int64)).sum())


SCAN = "id long, n long, key long, counts binary, small array<long>, often array<long>, times array<long>"
SCAN_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("counts", pa.binary()), ("small", pa.list_(pa.int64())),
                        ("often", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def sizes_and_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and key per row, and, where the task first meets a set, its bucket counts and a small set's shingles.
    Besides, rows with n = -1 that hold shingles met in several sets of a block."""
    def counted(block: list[np.ndarray]) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(block), return_counts=True)
        often = times >= LOCAL_LEAST
        return pa.RecordBatch.from_pylist([{"n": -1, "often": values[often].view(np.int64), "times": times[often]}], SCAN_ARROW)

    block, size, seen = [], 0, set()
    for b, sets in _sets(batches):
        rows = []
        for s in sets:
            key = set_key(s) if len(s) else None
            row = [len(s), key, None, None]
            if key is not None and key not in seen:
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(key)
                block.append(s)
                size += len(s)
                row[2] = bucket_counts(s).tobytes()
                row[3] = s.view(np.int64) if len(s) <= MAX_LIGHT else None
            rows.append(row)
        n, keys, counts, small = zip(*rows, strict=True)
        nothing = pa.nulls(len(sets), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(counts, pa.binary()),
                                          pa.array(small, pa.list_(pa.int64())), nothing, nothing], schema=SCAN_ARROW)
        if size >= BLOCK_SHINGLES:
            yield counted(block)
            block, size = [], 0
    if block:
        yield counted(block)


def frequent_shingles(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their counts, at most ``FREQUENT``. They only order the lists: any order is exact."""
    rows = (counts.select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy("x.often").agg(F.sum("x.times").alias("times"))
            .orderBy(F.desc("times"), "often").limit(FREQUENT).select("often", "times").toArrow())
    values = rows.column(0).to_numpy().view(np.uint64) if rows.num_rows else np.empty(0, np.uint64)
    times = rows.column(1).to_numpy() if rows.num_rows else np.empty(0, np.int64)
    order = np.argsort(values)
    return values[order], times[order]


def list_entries(boundary: int, often: np.ndarray, times: np.ndarray, buckets: int):
    """Entries of the inverted lists, packed by bucket of the list: shingles, whose last bit tells whether the entry
    is of the index, keys of the sets, the number of rare shingles (not among the frequent) in the set's
    prefix, sizes of the sets, and the shingle's place in the set's order. Twenty-six bytes an entry are all that is shuffled."""
    def packed(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        shingle, key, zero, n, place = (np.concatenate(c) for c in zip(*out, strict=True))
        bucket = (mix(shingle >> np.uint64(1)) + parts_of(shingle, key, often, times).astype(np.uint64)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        pieces = [np.split(c[order], cuts) for c in (shingle, key, zero, n, place)]
        names = bucket[order][np.concatenate([[0], cuts])].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(names), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in pieces)], ["bucket", "shingles", "keys", "zeros", "sizes", "places"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        out, size = [], 0
        for _, sets in _sets(batches):
            for key, s in _first_seen(sets, seen):
                n = len(s)
                if n <= boundary and T_DEN * n < T_NUM * (boundary + 1):
                    continue  # all its partners are light
                zero = probe_length(n)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rank = np.where(often[at] == s, times[at], 0)
                    s = s[np.argsort(rank, kind="stable")]  # equal ranks by hash
                    zero = min(zero, int((rank == 0).sum()))
                s = s[:probe_length(n)] & ~np.uint64(1)
                s[:index_length(n)] |= np.uint64(1)
                out.append((s, np.full(len(s), key), np.full(len(s), min(zero, 65_535), np.uint16), np.full(len(s), n, np.uint32), np.arange(len(s), dtype=np.uint32)))
                size += len(s)
            if size >= ENTRIES:
                yield packed(out)
                out, size = [], 0
        if out:
            yield packed(out)
    return rows


def parts_of(shingle: np.ndarray, key: np.ndarray, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Part of its list that an entry belongs to: from 1 for long lists, else 0."""
    long = times > LIST_SPLIT
    part = np.zeros(len(shingle), dtype=np.int64)
    if long.any():
        names, counts = often[long] & ~np.uint64(1), times[long]
        at = np.minimum(np.searchsorted(names, shingle & ~np.uint64(1)), len(names) - 1)
        hit = names[at] == shingle & ~np.uint64(1)
        part[hit] = 1 + key[hit] % -(-counts[at[hit]] // LIST_SPLIT)
    return part


def with_partner(lists: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Entries with another near enough in their list whose size and whose shingle's place allow a link.

    Before the shingle two sets share at most the lesser place, after it at most the lesser rest. An entry without
    such a partner is lost to no link: every set that holds the shingle in its prefix is ruled out."""
    found = np.zeros(len(n), dtype=bool)
    for d in range(1, min(SHORT_LIST, len(n))):
        same = np.flatnonzero(lists[d:] == lists[:-d])
        if not len(same):
            break
        a, b = same, same + d
        most = np.minimum(place[a], place[b]) + np.minimum(n[a] - place[a], n[b] - place[b])
        fits = (T_DEN * np.minimum(n[a], n[b]) >= T_NUM * np.maximum(n[a], n[b])) & ((T_NUM + T_DEN) * most >= T_NUM * (n[a] + n[b]))
        found[a[fits]] = found[b[fits]] = True
    return found


def shared_lists(often: np.ndarray, times: np.ndarray):
    """Lists of at least two sets, from all packed entries of a partition, with their least key as pivot."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [x for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True)]
        if not blocks:
            return
        shingle, key, zero, n, place = (np.frombuffer(b"".join(c), kind) for c, kind in zip(zip(*blocks, strict=True), (np.uint64, np.int64, np.uint16, np.uint32, np.uint32), strict=True))
        del blocks
        part, name = parts_of(shingle, key, often, times), shingle >> np.uint64(1)
        order = np.lexsort((key, part, name))
        shingle, key, zero, n, place, part, name = (c[order] for c in (shingle, key, zero, n, place, part, name))
        new_list = np.concatenate([[True], (name[1:] != name[:-1]) | (part[1:] != part[:-1])])
        once = new_list | np.concatenate([[True], key[1:] != key[:-1]])  # copies gave the same entry
        shingle, key, zero, n, place, part, name, new_list = (c[once] for c in (shingle, key, zero, n, place, part, name, new_list))
        start = np.flatnonzero(new_list)
        size = np.diff(np.append(start, len(name)))
        keep = np.repeat((size > SHORT_LIST) | (part[start] > 0), size) | with_partner(np.repeat(np.arange(len(size)), size), n.astype(np.int64), place.astype(np.int64))
        shingle, key, zero, part, name, new_list = (c[keep] for c in (shingle, key, zero, part, name, np.repeat(start, size)))
        keep = np.ones(len(name), bool)
        pivot = key[np.searchsorted(new_list, new_list)]  # the least key that is left
        known = np.sort(often >> np.uint64(1))
        rare = known[np.minimum(np.searchsorted(known, name), len(known) - 1)] != name if len(known) else np.ones(len(name), bool)
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (name.view(np.int64), part, key, (shingle & np.uint64(1)).astype(bool), rare, zero.astype(np.int32), pivot)],
                                         ["shingle", "part", "key", "indexed", "rare", "zero", "pivot"])
        del shingle, key, zero, n, place, part, name, order, new_list, once, keep, pivot, rare, known
        give_back()
    return rows


def light_links(small: DataFrame, boundary: int) -> DataFrame:
    """Links among light sets (key, small): members of a subset's group to its least key, if both sizes are there."""
    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, s = len(s), np.array(s, dtype=np.int64).view(np.uint64)
                for m in sizes_near(n) if n <= boundary else ():
                    if m <= boundary and (c := least_common(n, m)) <= min(n, m):
                        out += [(set_key(s[list(x)]), min(n, m), max(n, m), key, n) for x in combinations(range(n), c)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["subset", "low", "high", "key", "n"])

    rows = cut_lineage(small.dropDuplicates(["key"]).mapInArrow(subsets, "subset long, low long, high long, key long, n long"))
    group = ["subset", "low", "high"]
    roots = rows.groupBy(*group).agg(F.min("key").alias("root"), F.max("key").alias("_k"), F.min("n").alias("_a"), F.max("n").alias("_b"))
    roots = roots.where("root <> _k AND _a = low AND _b = high").drop("_k", "_a", "_b")
    return rows.join(roots, group).where("key <> root").select(F.col("key").alias("u"), F.col("root").alias("v")).distinct()


def probe_column(n):
    return n - F.ceil(F.lit(T_NUM) * n / T_DEN) + 1


def reachable(a: str, b: str):
    """Can sets a and b still have enough in common, by the rare shingles that no other prefix holds?

    ``open`` is a set's size without the rare shingles of its prefix that stand in no shared list. If the other set's
    prefix reaches into the frequent shingles (``whole``), it holds all its rare ones, so those are not among them."""
    need = F.lit(T_NUM) * (F.col(f"n_{a}") + F.col(f"n_{b}"))
    one = lambda x, y: ~F.col(f"whole_{y}") | ((T_NUM + T_DEN) * F.col(f"open_{x}") >= need)
    return one(a, b) & one(b, a)


def possible(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs (u, v) whose bucket counts allow the threshold; ``counts`` has the sizes and counts of every set in them."""
    thin = lambda x: counts.select(F.col("key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "open", "whole")])
    side = lambda x: counts.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"c_{x}"))
    fits = T_DEN * F.least("n_u", "n_v") >= T_NUM * F.greatest("n_u", "n_v")
    pairs = pairs.join(thin("u"), "u").join(thin("v"), "v").where(fits & reachable("u", "v")).select("u", "v")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
                n, m = (col[f"n_{x}"].to_numpy() for x in "uv")
                need = -(-T_NUM * (n + m) // (T_NUM + T_DEN))
                x, y = (col[f"c_{k}"].to_pylist() for k in "uv")
                fine = np.array([len(p) > BUCKETS[0] or len(q) > BUCKETS[0] for p, q in zip(x, y, strict=True)])
                most = np.zeros(len(n))
                if not fine.all():
                    p, q = (np.frombuffer(b"".join(c for c, f in zip(z, fine, strict=True) if not f), np.uint8).reshape(-1, BUCKETS[0]) for z in (x, y))
                    bound = np.minimum(p, q).sum(axis=1, dtype=np.int64).astype(np.float64)
                    bound[(p == 255).any(axis=1) | (q == 255).any(axis=1)] = np.inf
                    most[~fine] = bound
                for i in np.flatnonzero(fine & (np.minimum(n, m) >= need)):
                    most[i] = most_common(np.frombuffer(x[i], np.uint8), np.frombuffer(y[i], np.uint8))
                ok = pa.array((most >= need) & (np.minimum(n, m) >= need))
                yield pa.RecordBatch.from_arrays([col["u"].filter(ok), col["v"].filter(ok)], ["u", "v"])

    return cut_lineage(pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(keep, "u long, v long"))


def wanted_bits(keys: DataFrame) -> np.ndarray:
    """A filter of ``BITS`` bits over the keys, joined in Spark by words of 32 bits."""
    at = keys.select(F.pmod("key", F.lit(BITS)).alias("b"))
    words = at.groupBy(F.shiftright("b", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 AS int))")).alias("m"))
    bits = np.zeros(BITS // 32, dtype=np.int64)
    for w, m in words.collect():
        bits[w] = m
    return bits


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets, taken from the texts once, reach the threshold.

    Only sets that pass the filter of wanted keys leave their task. Both joins read one exchange of the sets."""
    bits = wanted_bits(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(batches):
            got = [(k, s.view(np.int64)) for k, s in _first_seen(sets, seen) if bits[(k % BITS) >> 5] >> (k % BITS & 31) & 1]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([s for _, s in got], pa.list_(pa.int64()))], ["key", "found"])

    sets = texts.mapInArrow(rows, "key long, found array<long>").dropDuplicates(["key"])
    first = pairs.withColumnRenamed("u", "key").join(sets, "key").select(F.col("key").alias("u"), F.col("v").alias("key"), F.col("found").alias("a"))
    both = first.join(sets, "key").select("u", F.col("key").alias("v"), "a", F.col("found").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return cut_lineage(both.where(100 * common >= 75 * (F.size("a") + F.size("b") - common)).select("u", "v"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _stars(lists: DataFrame, pivot: str) -> DataFrame:
    """Pairs of every entry with its list's pivot, and of the pivots of a long list's parts with the first of them."""
    parts = lists.where("part > 0").groupBy("shingle").agg(F.collect_set(pivot).alias("us"))
    parts = parts.select(F.explode("us").alias("u"), F.array_min("us").alias("v"))
    return _ordered(lists.select(F.col("key").alias("u"), F.col(pivot).alias("v")).unionByName(parts))


def _folded(counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts folded to the least number of buckets, and which of them have a full bucket, so bound nothing."""
    out, full = np.zeros((len(counts), BUCKETS[0]), dtype=np.int32), np.zeros(len(counts), dtype=bool)
    for size in {len(c) for c in counts}:
        at = np.array([k for k, c in enumerate(counts) if len(c) == size])
        own = np.frombuffer(b"".join(counts[k] for k in at), np.uint8).reshape(len(at), -1, BUCKETS[0])
        out[at], full[at] = own.sum(axis=1, dtype=np.int32), (own == 255).any(axis=(1, 2))
    return out, full


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a list's members whose sizes, private shingles and bucket counts allow a link, from rows sorted by group.

    All groups of a batch advance together: members one apart, two apart, and so on, as long as a group reaches. A pair
    that a task has returned before is left out (the memory of pairs is bounded; a repeat does no harm)."""
    seen: set[tuple[int, int]] = set()

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: rows.column(c).to_numpy() for c in ("shingle", "x", "y", "block", "key", "n", "root", "open")}
        whole, indexed = (rows.column(c).to_numpy().astype(bool) for c in ("whole", "indexed"))
        raw = rows.column("counts").to_pylist()
        counts, full = _folded(raw)
        new = np.concatenate([[True], (col["shingle"][1:] != col["shingle"][:-1]) | (col["x"][1:] != col["x"][:-1]) | (col["y"][1:] != col["y"][:-1])])
        starts = np.flatnonzero(new)
        ends = np.repeat(np.append(starts[1:], len(new)), np.diff(np.append(starts, len(new))))
        n, key, root, open_ = col["n"], col["key"], col["root"], col["open"]
        here, d = np.arange(len(new)), 0
        while True:
            d += 1
            here = here[here + d < ends[here]]
            if not len(here):
                return
            for at in range(0, len(here), PAIR_SLICE):
                i = here[at:at + PAIR_SLICE]
                j = i + d
                ok = (root[i] != root[j]) & ((col["x"][i] == col["y"][i]) | (col["block"][i] != col["block"][j]))
                ok &= T_DEN * np.minimum(n[i], n[j]) >= T_NUM * np.maximum(n[i], n[j])
                ok &= np.where((n[i] < n[j]) | ((n[i] == n[j]) & (key[i] < key[j])), indexed[i], indexed[j])
                need = T_NUM * (n[i] + n[j])
                ok &= (~whole[j] | ((T_NUM + T_DEN) * open_[i] >= need)) & (~whole[i] | ((T_NUM + T_DEN) * open_[j] >= need))
                i, j, need = i[ok], j[ok], need[ok]
                if not len(i):
                    continue
                most = np.minimum(counts[i], counts[j]).sum(axis=1, dtype=np.int64)
                ok = full[i] | full[j] | ((T_NUM + T_DEN) * most >= need)
                i, j = i[ok], j[ok]
                fine = np.fromiter((len(raw[p]) == len(raw[q]) == BUCKETS[0] or (T_NUM + T_DEN) * most_common(np.frombuffer(raw[p], np.uint8), np.frombuffer(raw[q], np.uint8)) >= T_NUM * (n[p] + n[q])
                                    for p, q in zip(i, j, strict=True)), dtype=bool, count=len(i))
                i, j = i[fine], j[fine]
                found = [p for p in zip(np.maximum(key[i], key[j]).tolist(), np.minimum(key[i], key[j]).tolist(), strict=True) if p not in seen]
                if found:
                    if len(seen) > PAIRS_SEEN:
                        seen.clear()
                    seen.update(found)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])

    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        name = np.rec.fromarrays([b.column(c).to_numpy() for c in ("shingle", "x", "y")])
        cut = int(np.flatnonzero(name != name[-1])[-1]) + 1 if (name != name[-1]).any() else 0  # where the last group begins
        if held and (cut or name[0] != last):
            yield from pairs(pa.Table.from_batches([*held, b.slice(0, cut)] if cut else held))
            held = []
        elif cut:
            yield from pairs(pa.Table.from_batches([b.slice(0, cut)]))
        held.append(b.slice(cut))
        last = name[-1]
    if held:
        yield from pairs(pa.Table.from_batches(held))
    give_back()


def _cross_pairs(named: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs of a list in different components that can still link, the smaller set by its index entry.

    The pairs of a list are made and judged in one task, which returns those that pass; a long list is dealt into
    blocks, and every two of its blocks meet in a task of their own. Lists with the same least member, such as those
    of a group of near copies, go to a few tasks, so that a pair leaves them a few times and not once a list. The bucket
    counts, by far the widest column, are joined last: one shuffle moves them, with a set's entries side by side."""
    lists = named.groupBy("shingle").agg(F.ceil(F.count("*") / F.lit(CROSS_BLOCK)).cast("int").alias("blocks"), F.min("key").alias("least"))
    own = named.join(lists, "shingle").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("x"), F.greatest("block", k).alias("y")))
    dealt = own.withColumn("_g", F.explode(others)).select("shingle", "_g.x", "_g.y", "block", "key", "n", "root", "open", "whole", "indexed", "least")
    dealt = dealt.join(counts.select("key", "counts"), "key")
    group = F.pmod("shingle", F.lit(LIST_GROUPS))
    ranged = dealt.repartition("least", group, "x", "y").sortWithinPartitions("least", "shingle", "x", "y").drop("least")
    return ranged.mapInArrow(_compared, "u long, v long").distinct()


def heavy_links(texts: DataFrame, scanned: DataFrame, boundary: int, often: np.ndarray, times: np.ndarray, light: DataFrame) -> DataFrame:
    """All links that components need: light ones, and those of the lists, by rounds of stars and a full scan."""
    entries = scanned.where("n > 0").agg(F.sum(F.col("n") / 4 + 1)).first()[0] or 0
    buckets = max(1, int(entries * 26) // BUCKET_BYTES)
    packed = texts.mapInArrow(list_entries(boundary, often, times, buckets), "bucket int, shingles binary, keys binary, zeros binary, sizes binary, places binary")
    lists = cut_lineage(packed.repartitionById(buckets, "bucket").mapInArrow(shared_lists(often, times), "shingle long, part long, key long, indexed boolean, rare boolean, zero int, pivot long"))
    whole = W.partitionBy("shingle", "part")
    listed = lists.groupBy("key").agg(F.max("zero").alias("zero"), F.count_if("rare").alias("_shared"))
    counts = cut_lineage(scanned.where("counts IS NOT NULL").select("key", "n", "counts").join(listed, "key").dropDuplicates(["key"])
                         .select("key", "n", "counts", (F.col("n") - F.col("zero") + F.col("_shared")).alias("open"), (F.col("zero") < probe_column(F.col("n"))).alias("whole")))
    lists = lists.drop("rare", "zero")
    tried = cut_lineage(_stars(lists, "pivot"))
    links = cut_lineage(verified(texts, possible(tried, counts)).unionByName(light))
    before = float("inf")
    lists = lists.join(counts.drop("counts"), "key")
    while True:
        roots = components(links).withColumnRenamed("node", "key")
        named = lists.drop("pivot").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        open_ = named.groupBy("shingle").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("_n")).where("_a <> _b AND _n > 2").select("shingle")
        named = cut_lineage(named.join(open_, "shingle", "left_semi").distinct())
        lists = named.drop("root")
        sizes = named.groupBy("shingle", "root").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("own"))
        total, cross = sizes.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()
        if not total:
            return links
        last = cross <= FULL_SCAN * total or cross > GAIN * before
        if last:
            pairs = _cross_pairs(named, counts)
        else:
            by = F.max(F.struct((F.col("open") / F.col("n")).alias("o"), F.xxhash64(F.lit(cross), "key").alias("h"), F.col("key").alias("k"), F.col("root").alias("r"))).over(whole)
            pairs = _stars(named.withColumn("_p", by).withColumn("pivot", F.col("_p.k")).where((F.col("part") > 0) | (F.col("_p.r") != F.col("root"))), "pivot")
        pairs = cut_lineage(pairs.join(tried, ["u", "v"], "left_anti"))
        links = cut_lineage(links.unionByName(verified(texts, pairs if last else possible(pairs, counts))))
        if last:
            return links
        tried, before = cut_lineage(tried.unionByName(pairs)), cross


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id`` (least id reachable by links, itself included) for every row.

    Null texts and texts without words have an empty set and link with nothing. Rows without an id take part, but
    name no component unless a row with an id is in it; repeated rows each get their row. Other columns are not
    read. Sets and shingles are told apart by 64-bit hashes."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scanned = cut_lineage(texts.mapInArrow(sizes_and_counts, SCAN))
    thin = scanned.where("n >= 0").select("id", "n", "key")
    often, times = frequent_shingles(scanned.where("n < 0"))
    boundary = light_boundary(dict(thin.where(F.col("n").between(1, 2 * MAX_LIGHT)).groupBy("n").count().collect()))
    light = light_links(scanned.where("small IS NOT NULL").select("key", "small"), boundary)
    links = heavy_links(texts, scanned, boundary, often, times, light)
    roots = components(links)
    named = thin.join(roots.withColumnRenamed("node", "key"), "key", "left").select("id", "n", F.coalesce("root", "key").alias("root"))
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"))
    return named.join(least, "root", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
