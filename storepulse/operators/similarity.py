"""Content-based recommendations: TF-IDF + cosine top-k (§2.11 M7–M12, §2.5 J6–J8, §2.3 P2–P4).

TF-IDF follows the public definition used by the reference's library: lower-cased words of at
least two word characters, stop words removed, vocabulary = the ``max_features`` terms with the
largest corpus count, raw tf × (ln((1+N)/(1+df)) + 1), L2-normalised per document.

Exact top-k cosine, one path for texts of any length:

1. Products with the same term-count map have the same vector; they collapse into one
   *signature*, which keeps only its k+1 lowest positions (the others can never be picked).
2. Signatures are sorted by their terms in order of weight and cut into tiles of ``TILE_ROWS``
   dense rows (at most ``max_features`` wide), so that like signatures are neighbours.
3. Each tile is multiplied with itself; a row's (k+1)-th best similarity there bounds its final
   list from below.
4. The largest weight per term of every other tile bounds what a row can find in it from above.
   A pair of tiles is multiplied only if some row's upper bound reaches its lower bound, and
   each product returns k+1 signatures a row: rows emitted grow with signatures and tiles
   visited, not with pairs.
5. Products with similarity 0 rank by position, so the 2k+1 lowest positions overall are added.

Similarities are ranked per signature by (similarity rounded to 9, position); each product then
drops itself and keeps the first k.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.scalars import match_band, short
from storepulse.operators.lookup import substring_lookup
from storepulse.operators.windows import top_k_per_key
from storepulse.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

TOKEN_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_]+"  # words of any script; the same class in Java and RE2
# Our own English stop-word table (shared with the SQL oracle).
STOP_WORDS = sorted(set("""
a about above after again against all am an and any are as at be because been before being below
between both but by can could did do does doing down during each few for from further had has have
having he her here hers herself him himself his how i if in into is it its itself just me more most
my myself no nor not now of off on once only or other our ours ourselves out over own same she
should so some such than that the their theirs them themselves then there these they this those
through to too under until up very was we were what when where which while who whom why will with
would you your yours yourself yourselves
""".split()))
RANK_DIGITS = 9
TILE_ROWS = 1024  # signatures of a tile
PEAK_TILES = 1 << 14  # tiles whose largest weights, a number per term, travel together
PRODUCT_ROWS = 256  # rows of a product held at once
SLACK = 3e-9  # rounding of the bounds, and ties of rounded similarities
TILE = ("tile int, n int, sig array<string>, pos array<long>, vec binary, most array<double>, least binary, "
        "g array<string>, h array<string>, sim array<double>")
TILE_ARROW = pa.schema([("tile", pa.int32()), ("n", pa.int32()), ("sig", pa.list_(pa.string())), ("pos", pa.list_(pa.int64())), ("vec", pa.binary()),
                        ("most", pa.list_(pa.float64())), ("least", pa.binary()), ("g", pa.list_(pa.string())), ("h", pa.list_(pa.string())), ("sim", pa.list_(pa.float64()))])


def named_products(df: DataFrame, name: str = "name") -> DataFrame:
    """Drop rows without a name."""
    return df.filter(F.col(name).isNotNull())


def product_content(name: str = "name", category: str = "category"):
    """Name + ' ' + category, nulls as ''."""
    return F.concat(F.coalesce(F.col(name), F.lit("")), F.lit(" "), F.coalesce(F.col(category), F.lit("")))


def tokens(docs: DataFrame, doc: str = "position", content: str = "content") -> DataFrame:
    """M7: (doc, term) for every word of ≥ 2 word characters, stop words removed."""
    spark = docs.sparkSession
    stop = F.broadcast(spark.createDataFrame([(w,) for w in STOP_WORDS], "term string"))
    words = docs.select(doc, F.explode(F.regexp_extract_all(F.lower(F.col(content)), F.lit(TOKEN_PATTERN), 0))
                        .alias("term"))
    return words.join(stop, "term", "left_anti")


def vocabulary(toks: DataFrame, n: int = 100) -> DataFrame:
    """M8: the ``n`` terms with the largest corpus count (ties: term ascending)."""
    counts = toks.groupBy("term").agg(F.count(F.lit(1)).alias("corpus_count"))
    return counts.orderBy(F.col("corpus_count").desc(), F.col("term")).limit(n)


def tfidf(docs: DataFrame, doc: str = "position", content: str = "content", max_features: int = 100) -> DataFrame:
    """M9: (doc, term, tf, weight) with L2-normalised weights; docs without vocabulary terms have no rows."""
    toks = tokens(docs, doc, content)
    vocab = F.broadcast(vocabulary(toks, max_features).select("term"))  # at most max_features rows
    tf = toks.join(vocab, "term", "inner").groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))
    n_docs = docs.count()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.broadcast(df.select(  # at most max_features rows
        "term", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf")))
    w = tf.join(idf, "term", "inner").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = Window.partitionBy(doc)  # a document has at most max_features terms
    return w.withColumn("weight", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(norm))) \
        .select(doc, "term", "tf", "weight", "raw")


def _dense(rows: list[tuple[list[int], list[float]]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, (at, w) in enumerate(rows):
        out[i, at] = w
    return out


def _best(a: np.ndarray, b: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and similarities of the ``n`` best columns of every row of ``a @ b.T`` by (rounded similarity,
    least position); ``order`` ranks the columns by position. Zero similarities are left out."""
    rows, cols, sims = [], [], []
    last = len(order) - 1
    for at in range(0, len(a), PRODUCT_ROWS):
        sim = a[at:at + PRODUCT_ROWS] @ b.T
        rank = np.rint(sim * 10**RANK_DIGITS) * len(order) + (last - order)  # distinct whole numbers below 2^53
        keep = np.argpartition(-rank, min(n, last + 1) - 1, axis=1)[:, :n]
        i = np.repeat(np.arange(len(sim)), keep.shape[1])
        j = keep.ravel()
        hit = sim[i, j] > 0
        rows.append(at + i[hit])
        cols.append(j[hit])
        sims.append(sim[i[hit], j[hit]])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(sims)


def _signature_sims(vectors: DataFrame, k: int, width: int) -> DataFrame:
    """(g, h, sim): per signature its k+1 best signatures of every tile that can hold one of its k+1 best.

    ``vectors`` has one row per signature: ``sig``, ``min_pos``, ``at`` (term numbers), ``w`` (weights), ``lead``
    (terms by falling weight, the sort key)."""
    total = vectors.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "g string, h string, sim double")
    n = -(-total // TILE_ROWS)

    def tiles(batches):
        for rows in _by_tile(batches):
            vec = _dense(list(zip(rows["at"], rows["w"], strict=True)), width)
            order = np.argsort(np.argsort(rows["min_pos"], kind="stable"))
            i, j, sim = _best(vec, vec, order, k + 1)
            least = np.zeros(len(vec))  # (k+1)-th best within the tile, 0 where there are fewer
            count = np.bincount(i, minlength=len(vec))
            low = np.full(len(vec), np.inf)
            np.minimum.at(low, i, sim)
            least[count > k] = low[count > k]
            sig = rows["sig"]
            yield pa.RecordBatch.from_pylist([{
                "tile": TaskContext.get().partitionId(), "n": len(vec), "sig": sig, "pos": order.astype(np.int64).tolist(), "vec": vec.tobytes(), "most": vec.max(axis=0).tolist(),
                "least": least.tobytes(), "g": [sig[x] for x in i.tolist()], "h": [sig[x] for x in j.tolist()], "sim": sim.tolist()}], TILE_ARROW)

    sorted_ = vectors.repartitionByRange(n, "lead", "sig").coalesce(n).sortWithinPartitions("lead", "sig")
    done = cut_lineage(sorted_.select("sig", "min_pos", "at", "w").mapInArrow(tiles, TILE))
    own = done.select(F.explode(F.arrays_zip("g", "h", "sim")).alias("x")).select("x.*")

    def visits(numbers: list[int], most: np.ndarray):
        def run(batches):
            for b in batches:
                for t, rows, vec, least in zip(*(b.column(c).to_pylist() for c in ("tile", "n", "vec", "least")), strict=True):
                    vec, least = np.frombuffer(vec).reshape(rows, width), np.frombuffer(least)
                    reach = (vec @ most.T + SLACK >= least[:, None]).any(axis=0)
                    others = [o for o, r in zip(numbers, reach.tolist(), strict=True) if r and o != t]
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(others), pa.int32()), pa.array(others, pa.int32())], ["tile", "other"])
        return run

    plan = None
    for first in range(0, n, PEAK_TILES):  # the largest weights of so many tiles at a time are known to every task
        peaks = done.where(F.col("tile").between(first, first + PEAK_TILES - 1)).select("tile", "most").orderBy("tile").collect()
        some = done.select("tile", "n", "vec", "least").mapInArrow(visits([r.tile for r in peaks], np.array([r.most for r in peaks]).reshape(-1, width)), "tile int, other int")
        plan = some if n <= PEAK_TILES else cut_lineage(some) if plan is None else plan.unionByName(cut_lineage(some))
    part = done.select("tile", "n", "sig", "pos", "vec")
    pairs = (plan.join(part, "tile").join(part.select(*[F.col(c).alias("other" if c == "tile" else f"o_{c}") for c in part.columns]), "other")
             .repartition(max(1, min(n * n, 10_000)), "tile", "other"))

    def products(batches):
        for b in batches:
            for x in range(b.num_rows):
                r = {c: b.column(y)[x].as_py() for y, c in enumerate(b.schema.names)}
                i, j, sim = _best(np.frombuffer(r["vec"]).reshape(r["n"], width), np.frombuffer(r["o_vec"]).reshape(r["o_n"], width), np.array(r["o_pos"]), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array([r["sig"][y] for y in i.tolist()], pa.string()), pa.array([r["o_sig"][y] for y in j.tolist()], pa.string()), pa.array(sim)],
                                                 ["g", "h", "sim"])

    return own.unionByName(pairs.drop("tile", "other").mapInArrow(products, "g string, h string, sim double"))


def _by_tile(batches):
    """All rows of a range partition (a tile), as lists by column."""
    batches = [b for b in batches if b.num_rows]
    if batches:
        yield pa.Table.from_batches(batches).to_pydict()


def similar_products(docs: DataFrame, k: int = 5, doc: str = "position", content: str = "content", max_features: int = 100) -> DataFrame:
    """M10 (+J6, W5): for every document its k most similar other documents.

    Returns (source, rank, target, similarity) with similarity in [0, 1]; see the module notes for
    how pairs are bounded."""
    # The weights and the doc → signature map are used by several branches below; written tables
    # compute them once and cut the lineage.
    w = cut_lineage(tfidf(docs, doc, content, max_features))
    sig_of = (w.groupBy(doc).agg(F.to_json(F.array_sort(F.collect_list(F.struct("term", "tf")))).alias("sig"))
              .withColumn("sig", F.sha2(F.col("sig"), 256)))
    all_docs = cut_lineage(docs.select(doc).join(sig_of, doc, "left").withColumn("sig", F.coalesce("sig", F.lit(""))))
    reps = top_k_per_key(all_docs, "sig", [F.col(doc)], k + 1, rank_col="_r").select(F.col("sig"), F.col(doc).alias("rep"))
    min_pos = all_docs.groupBy("sig").agg(F.min(doc).alias("min_pos"))
    numbers = {r[0]: i for i, r in enumerate(w.select("term").distinct().orderBy("term").collect())}  # at most max_features
    number = F.create_map(*[F.lit(x) for t, i in numbers.items() for x in (t, i)]) if numbers else F.create_map().cast("map<string,int>")
    post = w.join(min_pos, w[doc] == min_pos["min_pos"], "inner").withColumn("at", number[F.col("term")])
    vectors = post.groupBy("sig", "min_pos").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("neg"), "term", "at"))).alias("_t")).select(
        "sig", "min_pos", F.transform("_t", lambda x: x["at"]).alias("at"), F.transform("_t", lambda x: -x["neg"]).alias("w"),
        F.array_join(F.transform("_t", lambda x: x["term"]), " ").alias("lead"))
    sims = cut_lineage(_signature_sims(cut_lineage(vectors), k, max(1, len(numbers))))
    # Per signature, the top k+1 documents (self included) over the candidates and the
    # zero-similarity fill; every document of the signature shares that list.
    sig_cands = sims.join(reps.withColumnRenamed("sig", "h"), "h").select("g", F.col("rep").alias("target"), "sim")
    lowest = [r[0] for r in docs.select(doc).orderBy(doc).limit(2 * k + 1).collect()]  # 2k+1 values
    sigs = all_docs.select(F.col("sig").alias("g")).distinct()
    fill = sigs.select("g", F.explode(F.array(*[F.lit(v) for v in lowest])).alias("target")) \
        .withColumn("sim", F.lit(0.0))
    cand = sig_cands.unionByName(fill).groupBy("g", "target").agg(F.max("sim").alias("sim"))
    order = [F.round("sim", RANK_DIGITS).desc(), F.col("target")]
    per_sig = top_k_per_key(cand, "g", order, k + 1, rank_col="_r").drop("_r")
    # Each document drops itself and keeps the first k.
    src = all_docs.select(F.col(doc).alias("source"), F.col("sig").alias("g"))
    per_doc = src.join(per_sig, "g").filter(F.col("source") != F.col("target"))
    top = top_k_per_key(per_doc, "source", order, k, rank_col="rank")
    return top.select("source", "rank", "target", F.col("sim").alias("similarity"))


def recommend_all(products: DataFrame, k: int = 5, max_features: int = 100) -> DataFrame:
    """Recommendations for every product with display columns (name cut to 80, category,
    price text, similarity percent rounded to 1)."""
    docs = named_products(products).withColumn("content", product_content())
    sims = similar_products(docs, k, "position", "content", max_features)
    info = products.select(F.col("position").alias("target"), F.col("name").alias("_n"), "category", "price")
    src = products.select(F.col("position").alias("source"), F.col("name").alias("source_product"))
    return (sims.join(info, "target").join(src, "source")
            .select(F.col("source").alias("source_position"), "source_product", "rank",
                    F.col("target").alias("recommended_position"), short("_n", 80).alias("recommended_product"),
                    "category", "price", F.bround(F.col("similarity") * 100, 1).alias("similarity_score")))


def find_product(queries: DataFrame, products: DataFrame, n: int = 20) -> DataFrame:
    """For each query the first product (lowest position) whose name contains the query's
    first ``n`` characters, ignoring case; a query without a hit yields no row."""
    q = queries.select("query", short("query", n).alias("_q"))
    hits = substring_lookup(q, "_q", products, "name", "position")
    return q.join(hits.withColumnRenamed("query", "_q"), "_q", "inner").select("query", "position", "name")


def recommend_for_term(queries: DataFrame, recs: DataFrame, products: DataFrame, k: int = 3) -> DataFrame:
    """The first k recommendations of the product a search term resolves to."""
    found = find_product(queries, products)
    return (found.join(recs.withColumnRenamed("source_position", "position"), "position")
            .filter(F.col("rank") <= k)
            .select("query", F.col("position").alias("source_position"), "rank", "recommended_product",
                    "category", "similarity_score"))


def search_recommendations(recs: DataFrame, term: str, n: int = 5) -> DataFrame:
    """J8 + T3: stored recommendations whose source matches ``%term%`` ignoring case, by rank."""
    hit = recs.filter(F.col("source_product").ilike(f"%{term}%"))
    return hit.orderBy(F.col("rank"), F.col("source_position")).limit(n)


def with_match_band(recs: DataFrame) -> DataFrame:
    """P18 on the similarity percent."""
    return recs.withColumn("match", match_band("similarity_score"))
