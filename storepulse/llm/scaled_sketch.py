"""Document fingerprints as threshold-scaled sketches.

A sketch keeps every five-word shingle hash below a fixed fraction of the hash range, so its size follows
the document's and sketches of very unequal documents can be compared: the share of the smaller sketch
found in the larger one estimates containment, without bias from the larger one's length. Two sketches
merge by union. A text whose shingles all lie above the threshold keeps its smallest hash instead, which
gives way in a merge as soon as the other sketch has a hash below the threshold.

Only DataFrame functions are used. One shuffle moves the texts: it brings documents that follow each
other by id into the same range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHINGLE = 5
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def threshold(fraction: float) -> int:
    """Upper bound of retained hashes, in the signed 64-bit range."""
    return min(2**63 - 1, -2**63 + int(fraction * 2**64))


def with_sketch(df: DataFrame, text: str, out: str, fraction: float = 0.125) -> DataFrame:
    """``df`` with ``out``: the sorted sketch of column ``text``.

    Fewer words than a shingle: the whole sequence is one shingle. Null, empty or blank text: an empty sketch."""
    words, hashes, kept = f"_{out}_words", f"_{out}_hashes", f"_{out}_kept"
    word = lambda i, k: F.get(F.col(words), i + k)
    shingles = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[word(i, k) for k in range(SHINGLE)]))
    return (df.withColumn(words, F.split(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES)), SPACE))
            .withColumn(hashes, F.when(F.size(words) >= SHINGLE, shingles).when(F.get(F.col(words), F.lit(0)) == "", F.array().cast("array<bigint>"))
                        .otherwise(F.array(F.xxhash64(words))))
            .drop(words)
            .withColumn(kept, F.filter(hashes, lambda h: h < threshold(fraction)))
            .withColumn(out, F.when((F.size(kept) > 0) | (F.size(hashes) == 0), F.array_sort(F.array_distinct(kept))).otherwise(F.array(F.array_min(hashes))))
            .drop(hashes, kept))


def sketch_text(sketch: Column) -> Column:
    """Sixteen hexadecimal digits a hash, comma-joined."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other has; two empty sketches are alike, one empty is unlike."""
    least = F.least(F.size(a), F.size(b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(least == 0, F.lit(0.0))
            .otherwise(F.size(F.array_intersect(a, b)) / least).cast("double"))


def resemblance(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either).cast("double")


def merge_sketches(a: Column, b: Column, fraction: float = 0.125) -> Column:
    """Sketch of both texts together."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda h: h < threshold(fraction))
    return F.when(F.size(low) > 0, F.array_sort(low)).otherwise(F.slice(F.array_sort(both), 1, 1))


def with_next(df: DataFrame, id_col: str, columns: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``next_<c>``: each listed column's value on the following row by ``id_col`` (nulls first),
    then ``order``; the last row is followed by the first.

    Rows are dealt into id ranges of about equal size, so no task orders the whole table. The first row of
    each range is also sent to the range before it, where it only serves as the successor of the last row.
    The driver sees one id per range; their number follows spark.sql.shuffle.partitions."""
    spark = df.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(F.col(id_col).alias("i"))
    cuts = ids.agg(F.percentile_approx("i", [k / n for k in range(1, n)], 10 * n)).first()[0] or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>")
    bucket = lambda c: F.size(F.filter(cuts, lambda x: x <= c)).cast("int")
    firsts = sorted(ids.groupBy(bucket(F.col("i")).alias("b")).agg(F.min("i").alias("m"), F.count_if(F.col("i").isNull()).alias("nulls")).collect())
    if not firsts:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    starts: list[int | None] = [None] * n
    before = [0] * n
    for k, (b, m, _) in enumerate(firsts):
        starts[b], before[b] = m, firsts[k - 1]["b"]  # the last range stands before the first
    is_first = F.col(id_col) == F.get(F.array(*[F.lit(x) for x in starts]).cast("array<bigint>"), F.col("_b"))
    if firsts[0]["nulls"]:  # nulls stand first of all
        is_first = F.when(F.col("_b") == firsts[0]["b"], F.col(id_col).isNull()).otherwise(is_first)
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("g"))
    ghost = F.struct(F.get(F.array(*[F.lit(x) for x in before]), F.col("_b")).alias("b"), F.lit(1).alias("g"))
    sent = df.withColumn("_b", bucket(F.col(id_col))).withColumn("_at", F.explode(F.when(is_first, F.array(own, ghost)).otherwise(F.array(own)))).drop("_b")
    w = W.partitionBy("_at.b").orderBy("_at.g", F.col(id_col).asc_nulls_first(), *order)
    nexts = {f"next_{c}": F.lead(c).over(w) for c in columns}
    return sent.select("*", *[v.alias(k) for k, v in nexts.items()]).where(F.col("_at.g") == 0).drop("_at")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = 0.125) -> DataFrame:
    """Each text's sketch, that of its edited text, and their likeness.

    The edited text has its last quarter of code points replaced by the first as many (or all) of the next
    document's. Null text counts as empty; repeated rows follow each other; of equal ids the text decides.
    Only ``id_col`` and ``text_col`` are read."""
    own = with_sketch(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "sketch", fraction)
    both = with_next(own, id_col, ["text", "sketch"], ["text"])
    n = F.length("text").cast("long")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    out = both.select(id_col, n.alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    return with_sketch(out.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_sketch", fraction).drop("edited")
