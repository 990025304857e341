"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale of their own, and the norm of what rounding lost is kept as
the vector's error. For two vectors the true cosine differs from the quantised product by at most
``e_a (1 + e_b) + e_b``, so a tile of products separates sure links, sure non-links and the few pairs that
are recomputed from the full vectors in double precision. The products are exact: their sums of int8
products stay below 2^24, where single precision holds every integer.

Equal vectors are one node, so copies cost nothing. Vectors are ordered by their nearest pivot and cut into
tiles; a pair of tiles whose cones are too far apart is skipped. A tile pair returns, per linked vector, its
number of links and one edge to the least vector of its local component: rows grow with vectors, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.llm.graph import components
from storepulse.session import cut_lineage

SLACK = 2e-6  # single-precision rounding of the bounds
ROWS = 1024  # rows of a product held at once
PAIRS = 1 << 16  # pairs recomputed at once
PIVOTS = 64


def usable(vector: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales, and the norms of their rounding errors."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    lost = u - q * scale[:, None]
    return q, scale, np.sqrt(np.einsum("ij,ij->i", lost, lost)) + 1e-12


class Tile:
    """A tile's arrays from its row."""

    def __init__(self, dim: int, n: int, keys: bytes, copies: bytes, vectors: bytes, kind: str):
        self.keys, self.copies = np.frombuffer(keys, np.int64), np.frombuffer(copies, np.int64)
        self.full = np.frombuffer(vectors, np.float32 if kind == "float" else np.float64).reshape(n, dim)
        self.q, self.scale, self.error = quantise(unit(self.full))
        self.q = self.q.astype(np.float32)


def linked_pairs(a: Tile, b: Tile, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs with cosine of at least ``least``."""
    found = []
    # per row, the smallest product that any vector of b could need
    need = (least - a.error * (1 + b.error.max()) - b.error.max() - SLACK) / a.scale
    need = np.where(need > 0, need / b.scale.max(), need / b.scale.min()).astype(np.float32) - np.float32(1)
    for at in range(0, len(a.keys), ROWS):
        product = a.q[at:at + ROWS] @ b.q.T
        i, j = np.divmod(np.flatnonzero(product >= need[at:at + ROWS, None]), len(b.keys))
        near = product[i, j].astype(np.float64) * a.scale[at + i] * b.scale[j]
        i = at + i
        bound = a.error[i] * (1 + b.error[j]) + b.error[j] + 1e-12
        open_ = np.abs(near - least) <= bound
        keep = near > least + bound
        ask = np.flatnonzero(open_)
        for k in range(0, len(ask), PAIRS):
            p = ask[k:k + PAIRS]
            x, y = a.full[i[p]].astype(np.float64), b.full[j[p]].astype(np.float64)
            x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
            dot = lambda s, t: np.einsum("ij,ij->i", s, t)
            keep[p] = dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) >= least
        found.append((i[keep], j[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def local_roots(i: np.ndarray, j: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Least key of each node's component among the links ``i``-``j`` (node numbers into ``keys``)."""
    label = keys.copy()
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (before == label).all():
            return label


def tile_links(a: Tile, b: Tile, same: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of linked vectors, their links within this tile pair, and the least key each is connected to."""
    i, j = linked_pairs(a, b, least)
    if same:
        apart = i != j
        i, j = i[apart], j[apart]
    n, m = len(a.keys), len(b.keys)
    links_a = np.bincount(i, weights=b.copies[j], minlength=n).astype(np.int64)
    if same:
        keys, links, nodes_j = a.keys, links_a, j
    else:
        keys = np.concatenate([a.keys, b.keys])
        links = np.concatenate([links_a, np.bincount(j, weights=a.copies[i], minlength=m).astype(np.int64)])
        nodes_j = j + n
    root = local_roots(i, nodes_j, keys)
    hit = links > 0
    return keys[hit], links[hit], root[hit]


TILE = "tile long, dim int, n int, keys binary, copies binary, vectors binary, centre binary, spread double"


def make_tiles(reps: DataFrame, kind: str, tile_rows: int) -> DataFrame:
    """One row per tile, numbered from 0 without large gaps, with its cone (centre and largest angle)."""
    total = reps.count()
    pivots: dict[int, np.ndarray] = {}
    for r in reps.orderBy("k").limit(PIVOTS).select("embedding").collect():  # any vectors will do
        pivots.setdefault(len(r[0]), []).append(r[0])
    pivots = {d: unit(np.array(v, dtype=np.float64)) for d, v in pivots.items()}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(2)
            out = [0] * b.num_rows
            flat, at = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            sizes = np.diff(at)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                if int(d) in pivots:
                    best = (unit(flat[at[rows][:, None] + np.arange(d)]) @ pivots[int(d)].T).argmax(axis=1)
                    for r, p in zip(rows.tolist(), best.tolist(), strict=True):
                        out[r] = p
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes.astype(np.int32)), pa.array(out, pa.int32())], ["k", "copies", "embedding", "dim", "pivot"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        dims = rows.column("dim").to_numpy()
        out = []
        for no, d in enumerate(np.unique(dims)):  # ranges hold one dimension, but for those on a border
            part = rows.filter(pa.array(dims == d)).combine_chunks()
            flat = part.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            u = unit(flat.reshape(-1, d))
            centre = u.mean(axis=0)
            centre = centre / (np.linalg.norm(centre) or 1.0)
            spread = float(np.arccos(np.clip(u @ centre, -1, 1)).max()) + 1e-6 if centre.any() else np.pi
            out.append({"tile": TaskContext.get().partitionId() + (no << 40), "dim": int(d), "n": part.num_rows, "keys": part.column("k").to_numpy().tobytes(),
                        "copies": part.column("copies").to_numpy().tobytes(), "vectors": flat.astype(np.float32 if kind == "float" else np.float64).tobytes(),
                        "centre": centre.tobytes(), "spread": spread})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("tile", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("copies", pa.binary()),
                                                         ("vectors", pa.binary()), ("centre", pa.binary()), ("spread", pa.float64())]))

    ranked = reps.select("k", "copies", "embedding").mapInArrow(nearest, f"k long, copies long, embedding array<{kind}>, dim int, pivot int")
    n = max(1, -(-total // tile_rows))  # neighbouring ranges are joined to this many, however many there are
    return cut_lineage(ranked.repartitionByRange(n, "dim", "pivot", "k").coalesce(n).sortWithinPartitions("dim", "pivot", "k").mapInArrow(tiles, TILE))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, tile_rows: int = 4096) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id``, ``kept`` for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    another length or rows without an id (their component is null). Repeated rows count as vectors of their own
    with the same id. Other columns are not read. Equal vectors are recognised by a 64-bit hash."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"))
    rows = rows.withColumn("ok", usable(F.col("embedding")) & F.col("id").isNotNull())
    thin = cut_lineage(rows.select("id", F.when(F.col("ok"), F.xxhash64("embedding")).alias("k")))
    reps = cut_lineage(rows.where("ok").groupBy(F.xxhash64("embedding").alias("k"), "embedding").agg(F.count("*").alias("copies")))
    tiles = make_tiles(reps, kind, tile_rows)
    numbers = sorted(r[0] for r in tiles.select("tile").collect())  # one number per tile
    at = {t: i for i, t in enumerate(numbers)}
    cones = tiles.select("tile", "dim", "centre", "spread").collect() if len(numbers) <= 4096 else []  # bounded: else no pair is skipped
    cone = {r.tile: (r.dim, np.frombuffer(r.centre), r.spread) for r in cones}

    def apart(s: int, t: int) -> bool:
        if s not in cone or t not in cone:
            return False
        (d, c, x), (e, f, y) = cone[s], cone[t]
        return d != e or np.arccos(np.clip(c @ f, -1, 1)) - x - y > np.arccos(least) + 1e-6

    m = len(numbers)
    partners = [(t, [numbers[(i + d) % m] for d in range(m // 2 + 1) if (d != m - d or i < m - d) and not apart(t, numbers[(i + d) % m])]) for t, i in at.items()]
    spark = vectors.sparkSession
    plan = spark.createDataFrame(partners, "tile long, others array<long>")
    one = tiles.drop("centre", "spread")
    first = one.join(plan, "tile").select(*[F.col(c).alias(f"a_{c}") for c in one.columns], F.explode("others").alias("tile"))
    pairs = first.join(one, "tile").where("dim = a_dim").repartition(max(1, min(m * (m // 2 + 1), 100_000)), "a_tile", "tile")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                r = {c: b.column(i)[n].as_py() for i, c in enumerate(b.schema.names)}
                own = Tile(r["a_dim"], r["a_n"], r["a_keys"], r["a_copies"], r["a_vectors"], kind)
                same = r["a_tile"] == r["tile"]
                keys, links, root = tile_links(own, own if same else Tile(r["dim"], r["n"], r["keys"], r["copies"], r["vectors"], kind), same, least)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(links), pa.array(root)], ["k", "links", "root"])

    found = cut_lineage(pairs.mapInArrow(products, "k long, links long, root long"))
    ids = thin.where("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    roots = components(found.select(F.col("k").alias("u"), F.col("root").alias("v")))
    nodes = (ids.join(found.groupBy("k").agg(F.sum("links").alias("links")), "k", "left")
             .join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k")))
    nodes = cut_lineage(nodes)
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(named, "root").select("k", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = thin.join(nodes, "k", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                               F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
