import math

import numpy as np

from storepulse.llm.queries import QUERIES
from storepulse.llm.tile_cosine import near_vectors, quantise, unit
from tests.conftest import SF_SMALL


def plain(rows, least=0.9):
    """Brute force: n_links and component by row."""
    ok = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, parent = {i: 0 for i in range(len(rows))}, {i: i for i in range(len(rows))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ok):
        for j in ok[n + 1:]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[find(i)] = find(j)
    low = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], links[i], low.get(find(i)), rows[i][0] is not None and low[find(i)] == rows[i][0]) for i in range(len(rows))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert got(QUERIES["op8_tile_cosine"](spark, SF_SMALL)) == plain(rows)


def test_clusters_in_many_tiles(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16))
    x = np.concatenate([centres[rng.integers(0, 6, 160)] + rng.standard_normal((160, 16)) * 0.35, centres[:3], centres[:3] * 4, rng.standard_normal((60, 16))])
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    rows += [(1000 + k, rows[0][1]) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert got(near_vectors(df, tile_rows=40)) == plain(rows) == got(near_vectors(df))


def test_error_bound_holds():
    u = unit(np.random.default_rng(5).standard_normal((200, 24)) ** 3)
    q, scale, error = quantise(u)
    near = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(near - u @ u.T) <= error[:, None] * (1 + error) + error).all()


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]),
            (10, [1.0, 0.0]), (None, [1.0, 0.0]), (11, [1e-30, 1e-31]), (12, [-1.0, 0.0]), (None, None), (2**60, [1e30, 1e30])]
    df = spark.createDataFrame([(*r, 3, 3) for r in rows], "vec_id long, embedding array<double>, k int, label int")
    assert got(near_vectors(df)) == plain(rows)
    assert near_vectors(df.limit(0)).count() == 0
    assert got(near_vectors(df.where("vec_id IN (3, 5)"))) == [(3, 0, 3, True), (5, 0, 5, True)]
