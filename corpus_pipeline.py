"""Corpus pipeline: documents through five of the training-data operators.

Every stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that its predecessor kept. The stages up
to the last return the columns of ``documents``; between stages the rows are written as Parquet to the shared
checkpoint folder and read again, so a lost executor costs one stage at most. Every stage bounds the session's batches to
Python workers, as its rows are whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm.mix_sources import mixed_texts, numbered, row_key, word_count
from storepulse.llm.ngram_join import near_documents
from storepulse.llm.piece_bpe import load_pieces, round_trip
from storepulse.llm.registry import table
from storepulse.llm.secret_scan import redact_secrets
from storepulse.llm.string_kernel import UNKNOWN, learn_languages, predict_language
from storepulse.session import bounded_batches, cut_lineage


WORD_BYTES = 6 << 20  # smaller word tables than the codec's own: earlier stages have filled the executors


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language. Rejected: null texts and texts without a letter, nothing else; a text in a
    language that was not learned stays. A null ``lang`` takes the predicted one."""
    bounded_batches(spark)
    model = learn_languages(docs)
    out = predict_language(docs, model, lang_out="_lang", score_out="_score")
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out = out.where(F.col("_lang") != UNKNOWN)
    return out.withColumn("lang", F.coalesce("lang", "_lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, rows without an id after all others.

    Every row is decided by itself, under a number of its own: rows that repeat an id are documents like any others,
    and a copy without an id goes like any other copy. Of rows alike in id the one with the least text hash stays."""
    bounded_batches(spark)
    rows = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
    near = near_documents(rows, id_col="_row").select("_row", F.col("component_id").alias("_group"))
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64("text").alias("c"), F.col("_row").alias("d"))
    thin = cut_lineage(rows.select("_row", place.alias("_place")).join(near, "_row"))
    first = thin.groupBy("_group").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    gone = cut_lineage(thin.join(first, "_group").where("_row <> _first.d").select("_row"))  # few known rows move no texts in the join
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every reported secret replaced by a placeholder."""
    bounded_batches(spark)
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row per document and copy with the words that the mix takes. An extra
    column with the name of a mixing figure (target, taken, source_size, ranges) does not outlast this stage."""
    bounded_batches(spark)
    sized = numbered(docs.withColumns({"_words": word_count(F.col("text")), "_key": row_key()}))
    sizes = cut_lineage(sized.select("doc_id", "source", "_words", "_key", "_nth"))
    out = mixed_texts(sized, sizes, size_col="_words", deal_cols=("_key", "_nth"))
    return out.select(*[c for c in docs.columns if c in out.columns])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row's ids and of the text decoded from them."""
    import public_tokenizers

    bounded_batches(spark)
    coded = round_trip(docs, load_pieces(public_tokenizers.path("piece_bpe_32k.model")), word_bytes=WORD_BYTES)
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("pieces", pieces)]

ORACLE_SQL: str | None = None  # classification, merging and apportionment are beyond SQL; tests/llm checks the stages by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
