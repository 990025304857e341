"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.llm import fm_quality
from storepulse.llm.block_search import search_documents
from storepulse.llm.fill_middle import fill_in_middle, restored_text
from storepulse.llm.line_blocks import extract_text
from storepulse.llm.line_crf import judge_lines, learn_lines
from storepulse.llm.mix_sources import mix_sources, numbered, row_key, word_count
from storepulse.llm.ngram_join import near_documents
from storepulse.llm.piece_bpe import load_pieces, round_trip
from storepulse.llm.registry import ORACLE, QUERIES, query, table
from storepulse.llm.scaled_sketch import containment, fingerprints, resemblance, sketch_text
from storepulse.llm.secret_scan import BASE_KINDS, scan_secrets, spans_text
from storepulse.llm.string_kernel import held_out, learn_languages, predict_language
from storepulse.llm.tile_cosine import near_vectors
from storepulse.llm.warc import read_warc, write_warc
from storepulse.session import checkpoint_dir, cut_lineage

__all__ = ["ORACLE", "QUERIES"]


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, with the base kinds counted and digested."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS],
                        F.sha2(spans_text(spans, BASE_KINDS), 256).alias("base_sha256"), spans_text(spans).alias("spans"))


@query("op9_piece_codec")
def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as token counts and digests."""
    import public_tokenizers

    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_mix_sources")
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = table(spark, sf_dir, "documents")
    sizes = cut_lineage(numbered(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key().alias("_key"))))
    return mix_sources(sizes, sizes, deal_cols=("_key", "_nth")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_scaled_sketch")
def op4_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness."""
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", sketch_text(own).alias("fingerprint"), sketch_text(edited).alias("edited_fingerprint"),
        containment(own, edited).alias("near_edited"), containment(own, after).alias("near_next"),
        resemblance(own, edited).alias("jaccard_edited"), resemblance(own, after).alias("jaccard_next"))


@query("op5_warc")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC shards in the shared folder and read back."""
    out_dir = f"{checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), out_dir)
    return read_warc(spark, out_dir, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_tile_cosine")
def op8_tile_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every embedding."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_string_kernel")
def op10_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = predict_language(docs.select("doc_id", "text"), learn_languages(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op3_fm_quality")
def op3_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fm_quality.learn_quality(docs, table(spark, sf_dir, "labels"))
    out = fm_quality.score_quality(docs, machine)
    return out.select("doc_id", fm_quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= fm_quality.THRESHOLD).cast("int").alias("predicted"))


@query("op7_line_blocks")
def op7_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op2_ngram_join")
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return near_documents(table(spark, sf_dir, "documents"))


@query("op12_fill_middle", sql="""WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h
  FROM documents),
d AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS r1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS r2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90
              THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
c AS (
  SELECT *, array_to_string(u[1:least(r1, r2)], '') AS p, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
         array_to_string(u[greatest(r1, r2) + 1:], '') AS s
  FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c""")
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in its middle, with digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored_text(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op11_block_search", sql=r"""WITH words AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t
  FROM documents),
docs AS (SELECT doc_id, row_no, t, len(t) AS n FROM words WHERE len(t) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
tf AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(t) AS term FROM docs) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, doc_id, row_no, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN docs USING (row_no), total GROUP BY item_id, doc_id, row_no),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20""")
def op11_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op13_line_crf")
def op13_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document by its lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = learn_lines(docs, table(spark, sf_dir, "labels"))
    return judge_lines(docs, chain).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                                           "n_lines", "content_lines", "content_chars")
