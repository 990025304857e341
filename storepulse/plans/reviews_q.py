"""Review queries: feed parsing, new-review detection, lexicon sentiment, summaries, export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.functions.scalars import clean_search_prefix
from storepulse.operators import reviews as R
from storepulse.operators import sinks as K
from storepulse.operators.versioned import VersionedTable
from storepulse.plans.registry import query
from storepulse.session import checkpoint_dir, cut_lineage
from storepulse.sources.feeds import LEXICON, comments, lexicon, posts, review_feed_lines, saved_reviews
from storepulse.sources.files import explode_review_payload, first_search_hit, parse_review_feed
from storepulse.sources.tables import read_table

# ---- SQL fragments ----------------------------------------------------------------------------

LEX_VALUES = ", ".join(f"('{t}', {p!r}::DOUBLE)" for t, p in LEXICON)
REVIEW_FEED_SQL = """review_lines AS (
  SELECT CAST(CASE WHEN doc_id % 50 = 7 THEN doc_id + 3000000000 ELSE doc_id END AS VARCHAR) || '|||' || source || '|||'
         || replace(regexp_replace(text, '[\\r\\n]', ' ', 'g'), '|||', '') || '|||' || CAST(doc_id % 5 + 1 AS VARCHAR)
           AS value
  FROM documents),
review_parts AS (
  SELECT regexp_extract(value, '^(.*?)[|]{3}(.*?)[|]{3}(.*?)[|]{3}(.*)$', ['a', 'b', 'c', 'd']) AS p
  FROM review_lines WHERE value LIKE '%|||%'),
review_feed AS (
  SELECT * FROM (
    SELECT TRY_CAST(trim(p.a) AS BIGINT) AS comment_id, trim(p.b) AS product_name, trim(p.c) AS review_text,
           CAST(trunc(TRY_CAST(trim(p.d) AS DOUBLE)) AS INTEGER) AS rating
    FROM review_parts)
  WHERE comment_id IS NOT NULL AND rating IS NOT NULL)"""
SAVED_SQL = "saved AS (SELECT * FROM review_feed WHERE comment_id % 3 = 0)"


SENTIMENT_SQL = f"""lex(term, polarity) AS (VALUES {LEX_VALUES}),
toks AS (SELECT comment_id, unnest(regexp_extract_all(lower(review_text), '\\p{{L}}+')) AS token FROM {{src}}),
hits AS (SELECT comment_id, sum(polarity) AS s, count(*) AS n FROM toks JOIN lex ON token = term GROUP BY comment_id),
scored0 AS (
  SELECT r.*, CASE WHEN h.n > 0 THEN h.s / h.n ELSE 0.0::DOUBLE END AS first_s,
         coalesce(h.s, 0.0::DOUBLE) / sqrt(coalesce(h.s, 0.0::DOUBLE) * coalesce(h.s, 0.0::DOUBLE) + 15.0::DOUBLE)
           AS second_s
  FROM {{src}} r LEFT JOIN hits h ON r.comment_id = h.comment_id),
scored AS (
  SELECT *,
         CASE WHEN first_s > 0.1 THEN 'POSITIVE' WHEN first_s < -0.1 THEN 'NEGATIVE' ELSE 'NEUTRAL' END
           AS textblob_sentiment,
         CASE WHEN second_s >= 0.05 THEN 'POSITIVE' WHEN second_s <= -0.05 THEN 'NEGATIVE' ELSE 'NEUTRAL' END
           AS vader_sentiment,
         CASE WHEN second_s >= 0.05 THEN 'POSITIVE' WHEN second_s <= -0.05 THEN 'NEGATIVE' ELSE 'NEUTRAL' END
           AS final_sentiment,
         round_even(first_s, 4) AS textblob_score, round_even(second_s, 4) AS vader_score
  FROM scored0)"""


def sentiment_sql(src: str) -> str:
    return SENTIMENT_SQL.replace("{src}", src)


# ---- shared plans -----------------------------------------------------------------------------

def parsed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 over the review feed lines."""
    return parse_review_feed(review_feed_lines(spark, sf_dir))


def scored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ``product_reviews`` table: every feed review with its sentiment."""
    return R.sentiment_scores(parsed_feed(spark, sf_dir), lexicon(spark))


def _saved(spark, sf_dir):
    return saved_reviews(spark, sf_dir).select(F.col("comment_id").alias("wp_comment_id"), "product_name")


# ---- queries ----------------------------------------------------------------------------------

@query("review_feed_parse", sql=f"""WITH {REVIEW_FEED_SQL}
SELECT comment_id, product_name, review_text, rating FROM review_feed""")
def review_feed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id|||name|||text|||rating`` lines → typed review rows."""
    return parsed_feed(spark, sf_dir)


@query("new_reviews", sql=f"""WITH {REVIEW_FEED_SQL}, {SAVED_SQL}
SELECT comment_id, product_name FROM review_feed
WHERE comment_id NOT IN (SELECT comment_id FROM saved)""")
def new_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed reviews whose id is not saved yet (left anti-join)."""
    return R.new_reviews(parsed_feed(spark, sf_dir), _saved(spark, sf_dir)).select("comment_id", "product_name")


@query("new_review_count", sql=f"""WITH {REVIEW_FEED_SQL}, {SAVED_SQL}
SELECT count(*) AS new_reviews FROM review_feed WHERE comment_id NOT IN (SELECT comment_id FROM saved)""")
def new_review_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-tick counter of new reviews."""
    return R.new_reviews(parsed_feed(spark, sf_dir), _saved(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("new_reviews"))


@query("review_sentiment", sql=f"""WITH {REVIEW_FEED_SQL}, {sentiment_sql('review_feed')}
SELECT comment_id, textblob_score, textblob_sentiment, vader_score, vader_sentiment,
       final_sentiment FROM scored""")
def review_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13 + P11 + P12: both lexicon scores and the three labels per review (whole texts)."""
    return scored_reviews(spark, sf_dir).select("comment_id", "textblob_score", "textblob_sentiment",
                                                "vader_score", "vader_sentiment", "final_sentiment")


@query("sentiment_label_matrix", sql=f"""WITH {REVIEW_FEED_SQL}, {sentiment_sql('review_feed')}
SELECT textblob_sentiment, vader_sentiment, count(*) AS n FROM scored GROUP BY 1, 2""")
def sentiment_label_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First × second label counts (where the two scorers disagree, P12 takes the second)."""
    return scored_reviews(spark, sf_dir).groupBy("textblob_sentiment", "vader_sentiment").agg(
        F.count(F.lit(1)).alias("n"))


@query("process_reviews", sql=f"""WITH {REVIEW_FEED_SQL}, {SAVED_SQL},
fresh AS (SELECT * FROM review_feed WHERE comment_id NOT IN (SELECT comment_id FROM saved)),
{sentiment_sql('fresh')}
SELECT substr(product_name, 1, 500) AS product_name, substr(review_text, 1, 5000) AS review_text,
       CAST(rating AS DOUBLE) AS rating, textblob_score, textblob_sentiment, vader_score, vader_sentiment,
       final_sentiment, comment_id AS wp_comment_id
FROM scored""")
def process_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14 + K5: parse → new only → score → label → rows for ``product_reviews``."""
    out = R.process_reviews(parsed_feed(spark, sf_dir), _saved(spark, sf_dir), lexicon(spark))
    return K.review_sink_rows(out)


A1_SQL = f"""WITH {REVIEW_FEED_SQL}, {sentiment_sql('review_feed')},
a1 AS (SELECT product_name, final_sentiment, count(*) AS review_count, round(avg(vader_score), 3) AS avg_score
       FROM scored GROUP BY product_name, final_sentiment)"""


@query("sentiment_by_product", sql=f"""{A1_SQL} SELECT * FROM a1""")
def sentiment_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: reviews per product × sentiment with the mean second score."""
    return R.sentiment_by_product(scored_reviews(spark, sf_dir))


@query("review_summary", sql=f"""WITH {REVIEW_FEED_SQL}, {sentiment_sql('review_feed')}
SELECT count(DISTINCT product_name) AS products, count(*) AS total,
       CAST(sum(CASE WHEN final_sentiment = 'POSITIVE' THEN 1 ELSE 0 END) AS BIGINT) AS pos,
       CAST(sum(CASE WHEN final_sentiment = 'NEGATIVE' THEN 1 ELSE 0 END) AS BIGINT) AS neg,
       CAST(sum(CASE WHEN final_sentiment = 'NEUTRAL' THEN 1 ELSE 0 END) AS BIGINT) AS neu FROM scored""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: distinct products, rows and the three sentiment counts."""
    return R.review_summary(scored_reviews(spark, sf_dir))


@query("review_coverage", sql=f"""WITH {REVIEW_FEED_SQL}
SELECT count(DISTINCT product_name) AS products_with_reviews, count(*) AS total_reviews FROM review_feed""")
def review_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: products with reviews, total reviews."""
    return R.review_coverage(parsed_feed(spark, sf_dir))


@query("sentiment_totals", sql=f"""{A1_SQL}
SELECT CAST(sum(review_count) AS BIGINT) AS total_reviews,
       CAST(sum(CASE WHEN final_sentiment = 'POSITIVE' THEN review_count ELSE 0 END) AS BIGINT) AS positive,
       CAST(sum(CASE WHEN final_sentiment = 'NEGATIVE' THEN review_count ELSE 0 END) AS BIGINT) AS negative,
       CAST(sum(CASE WHEN final_sentiment = 'NEUTRAL' THEN review_count ELSE 0 END) AS BIGINT) AS neutral FROM a1""")
def sentiment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall sentiment totals from A1."""
    return R.sentiment_totals(R.sentiment_by_product(scored_reviews(spark, sf_dir)))


@query("sentiment_pivot", sql=f"""{A1_SQL}
SELECT product_name,
       CAST(coalesce(sum(review_count) FILTER (WHERE final_sentiment = 'POSITIVE'), 0) AS BIGINT) AS "POSITIVE",
       CAST(coalesce(sum(review_count) FILTER (WHERE final_sentiment = 'NEGATIVE'), 0) AS BIGINT) AS "NEGATIVE",
       CAST(coalesce(sum(review_count) FILTER (WHERE final_sentiment = 'NEUTRAL'), 0) AS BIGINT) AS "NEUTRAL",
       substr(product_name, 1, 25) AS product_short
FROM a1 GROUP BY product_name""")
def sentiment_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: product × sentiment pivot of counts, missing cells 0."""
    return R.sentiment_pivot(R.sentiment_by_product(scored_reviews(spark, sf_dir)))


@query("dominant_sentiment", sql=f"""{A1_SQL}
SELECT product_name, final_sentiment, review_count, avg_score, substr(product_name, 1, 50) AS product_short
FROM (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY review_count DESC, final_sentiment) AS r
      FROM a1) WHERE r = 1""")
def dominant_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's most frequent sentiment."""
    return R.dominant_sentiment(R.sentiment_by_product(scored_reviews(spark, sf_dir)))


@query("batch_tallies", sql=f"""WITH {REVIEW_FEED_SQL}, {SAVED_SQL},
fresh AS (SELECT * FROM review_feed WHERE comment_id NOT IN (SELECT comment_id FROM saved)),
{sentiment_sql('fresh')}
SELECT product_name, count(*) FILTER (WHERE final_sentiment = 'POSITIVE') AS positive,
       count(*) FILTER (WHERE final_sentiment = 'NEGATIVE') AS negative,
       count(*) FILTER (WHERE final_sentiment = 'NEUTRAL') AS neutral
FROM scored GROUP BY product_name""")
def batch_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-product positive / negative / neutral of the new-review batch."""
    return R.batch_tallies(R.process_reviews(parsed_feed(spark, sf_dir), _saved(spark, sf_dir), lexicon(spark)))


@query("run_summary", sql=f"""WITH {REVIEW_FEED_SQL},
products AS (SELECT DISTINCT source AS product_name FROM documents),
per AS (SELECT product_name, count(*) AS n FROM review_feed GROUP BY product_name)
SELECT count(*) FILTER (WHERE per.n IS NOT NULL) AS analyzed, count(*) FILTER (WHERE per.n IS NULL) AS skipped,
       CAST(coalesce(sum(per.n), 0) AS BIGINT) AS total_reviews
FROM products LEFT JOIN per ON products.product_name = per.product_name""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products analysed / skipped and total reviews of a scoring run."""
    products = read_table(spark, sf_dir, "documents", ["source"]).select(F.col("source").alias("product_name"))
    return R.run_summary(products, parsed_feed(spark, sf_dir))


@query("reviews_grouped", sql=f"""WITH {REVIEW_FEED_SQL}
SELECT product_name, comment_id, rating,
       row_number() OVER (PARTITION BY product_name ORDER BY rating DESC NULLS FIRST, comment_id) AS position
FROM review_feed""")
def reviews_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 + T6: reviews grouped per product in export order (rating descending)."""
    g = R.reviews_grouped(parsed_feed(spark, sf_dir).select("product_name", "comment_id", "rating"))
    return g.select("product_name", "comment_id", "rating", "position")


@query("export_rows", sql=f"""WITH {REVIEW_FEED_SQL}
SELECT comment_id, product_name,
       replace(replace(replace(replace(replace(replace(replace(replace(replace(substr(review_text, 1, 200),
         '''', ''), '"', ''), '\\', ''), chr(10), ' '), chr(13), ''), '`', ''), '$', ''), ';', ''), '&', 'and')
         AS clean_text,
       CAST(least(5, greatest(1, CAST(trunc(coalesce(nullif(CAST(rating AS DOUBLE), 0.0), 3.0)) AS INTEGER)))
            AS INTEGER) AS export_rating
FROM review_feed""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13 + P15 + T6: reviews as pushed back to the store (clean text, clamped rating), in export order."""
    ex = R.export_rows(R.reviews_for_export(parsed_feed(spark, sf_dir)))
    return ex.select("comment_id", "product_name", "clean_text", "export_rating")


@query("replace_reviews", sql=f"""WITH {REVIEW_FEED_SQL}, {SAVED_SQL},
batch AS (SELECT * FROM review_feed WHERE comment_id % 3 <> 0 AND right(product_name, 1) IN ('1', '4', '7', '8'))
SELECT comment_id, product_name FROM saved
WHERE product_name NOT IN (SELECT product_name FROM batch)
UNION ALL SELECT comment_id, product_name FROM batch""")
def replace_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: replace every stored review of a product that appears in the new batch; only the buckets of its products are rewritten."""
    feed = cut_lineage(parsed_feed(spark, sf_dir).select("comment_id", "product_name"))
    table = VersionedTable(spark, f"{checkpoint_dir(spark).rstrip('/')}/product-reviews/{uuid.uuid4().hex}", "product_name", feed.schema)
    replace = lambda known, new: K.replace_by_key(known, new, "product_name")
    table.change(0, feed.filter(F.col("comment_id") % 3 == 0), replace)
    table.change(1, feed.filter((F.col("comment_id") % 3 != 0) & F.right("product_name", F.lit(1)).isin("1", "4", "7", "8")), replace)
    return table.read()


STORE_SQL = """posts AS (
  SELECT p_partkey AS "ID", CASE WHEN p_size > 5 THEN 'product' ELSE 'page' END AS post_type,
         p_name || ' ' || p_brand AS name FROM part),
comments AS (
  SELECT doc_id AS "comment_ID", text AS comment_content, doc_id % 997 + 1 AS "comment_post_ID",
         'review' AS comment_type, CASE WHEN doc_id % 4 <> 0 THEN '1' ELSE '0' END AS comment_approved,
         CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN '' ELSE CAST(doc_id % 6 AS VARCHAR) END AS rating FROM documents)"""


@query("store_reviews", sql=f"""WITH {STORE_SQL}
SELECT "comment_ID" AS comment_id, replace(name, '|||', '') AS product_name,
       replace(comment_content, '|||', '') AS review_text,
       CASE WHEN rating IS NULL OR rating IN ('', '0') THEN 5 ELSE CAST(rating AS INTEGER) END AS rating
FROM comments c JOIN posts p ON c."comment_post_ID" = p."ID"
WHERE p.post_type = 'product' AND c.comment_type = 'review' AND c.comment_approved = '1'
ORDER BY "comment_ID" DESC LIMIT 50""")
def store_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + J2 + P23 + T7: newest 50 approved product reviews of the store with their product."""
    return R.store_reviews(comments(spark, sf_dir), posts(spark, sf_dir), 50)


def _catalog_reviews(spark, sf_dir):
    """All reviews, each of a catalogue product, or of one that the catalogue doesn't list."""
    feed = parsed_feed(spark, sf_dir).select("comment_id", "review_text", "rating")
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
    listed = F.when(F.col("p_partkey").isNotNull(), F.concat_ws(" ", "p_name", "p_brand"))
    return feed.join(part, feed.comment_id % 2999 + 1 == part.p_partkey, "left").select(
        "comment_id", F.coalesce(listed, F.concat(F.lit("Unlisted "), F.col("comment_id").cast("string"))).alias("product_name"), "review_text", "rating")


def _store(spark, sf_dir):
    p = posts(spark, sf_dir)
    return p.withColumn("status", F.when(F.col("post_type") == "product", "publish").otherwise("draft"))


MATCH_SQL = f"""WITH {STORE_SQL}, {REVIEW_FEED_SQL},
cat_reviews AS (SELECT r.comment_id, coalesce(p_name || ' ' || p_brand, 'Unlisted ' || CAST(r.comment_id AS VARCHAR)) AS product_name
                FROM review_feed r LEFT JOIN part ON r.comment_id % 2999 + 1 = p_partkey),
names AS (SELECT DISTINCT product_name,
                 replace(replace(replace(replace(replace(substr(product_name, 1, 35), '''', ''), '"', ''), '\\', ''),
                   '&', 'and'), ';', '') AS search FROM cat_reviews),
matched AS (
  SELECT n.product_name, n.search,
         (SELECT min(p."ID") FROM posts p WHERE p.post_type = 'product' AND contains(lower(p.name), lower(n.search)))
           AS store_id
  FROM names n)"""


@query("match_store_product", sql=f"""{MATCH_SQL} SELECT product_name, search, store_id FROM matched""")
def match_store_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 + P16: store product per reviewed product by its cleaned 35-character prefix."""
    return R.match_store_product(_catalog_reviews(spark, sf_dir), _store(spark, sf_dir))


@query("import_summary", sql=f"""{MATCH_SQL},
per AS (SELECT product_name, count(*) AS n FROM cat_reviews GROUP BY product_name)
SELECT count(*) FILTER (WHERE store_id IS NOT NULL) AS found, count(*) FILTER (WHERE store_id IS NULL) AS not_found,
       CAST(coalesce(sum(CASE WHEN store_id IS NOT NULL THEN per.n END), 0) AS BIGINT) AS reviews_kept
FROM matched JOIN per ON matched.product_name = per.product_name""")
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products found / not found in the store and reviews kept."""
    reviews = _catalog_reviews(spark, sf_dir)
    return R.import_summary(R.match_store_product(reviews, _store(spark, sf_dir)), reviews)


PAYLOAD_SQL = """payload_reviews AS (
  SELECT doc_id, list_slice(string_split(text, chr(10)), 1, 5) AS lines FROM documents),
exploded AS (
  SELECT doc_id, unnest(lines) AS line, unnest(generate_series(0, len(lines) - 1)) AS review_pos
  FROM payload_reviews)"""


def review_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed API payloads derived per document: its lines are the reviews (rating text
    ``(doc_id + line) % 6``, so '0' occurs), and even documents carry one search hit."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    lines = F.split(F.col("text"), "\n", -1)
    reviews = F.transform(lines, lambda x, i: F.struct(
        x.alias("review_comment"), ((F.col("doc_id") + i) % 6).cast("string").alias("review_star_rating")))
    products = F.when(F.col("doc_id") % 2 == 0,
                      F.array(F.struct(F.concat(F.lit("B"), F.col("doc_id").cast("string")).alias("asin")))) \
        .otherwise(F.array().cast("array<struct<asin:string>>"))
    payload = F.to_json(F.struct(F.struct(reviews.alias("reviews"), products.alias("products")).alias("data")))
    return docs.select("doc_id", payload.alias("payload"))


@query("review_payload_explode", sql=f"""WITH {PAYLOAD_SQL}
SELECT doc_id, CAST(review_pos AS INTEGER) AS review_pos, line AS text,
       CAST((doc_id + review_pos) % 6 AS DOUBLE) AS rating
FROM exploded WHERE line <> ''""")
def review_payload_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 + W8: first 5 reviews of each landed payload, empty texts dropped, falsy rating → 0.0."""
    return explode_review_payload(review_payloads(spark, sf_dir), "doc_id", max_reviews=5)


@query("first_search_hit", sql="""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'B' || CAST(doc_id AS VARCHAR) ELSE '' END AS asin FROM documents""")
def first_search_hit_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First product id of each search payload, '' when there is none."""
    return first_search_hit(review_payloads(spark, sf_dir), "doc_id")


@query("top_reviews_per_product", sql=f"""WITH {REVIEW_FEED_SQL}
SELECT product_name, comment_id, review_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY comment_id) AS review_rank FROM review_feed)
WHERE review_rank <= 5""")
def top_reviews_per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five reviews per product in feed order."""
    feed = parsed_feed(spark, sf_dir)
    top = R.top_reviews_per_product(feed, 5, "comment_id")
    return top.select("product_name", "comment_id", F.col("review_rank").cast("long").alias("review_rank"))


@query("search_prefixes", sql=f"""{MATCH_SQL} SELECT product_name, search FROM names""")
def search_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned 35-character search prefix per reviewed product."""
    names = _catalog_reviews(spark, sf_dir).select("product_name").distinct()
    return names.withColumn("search", clean_search_prefix("product_name"))


NEG_VALUES = ", ".join(f"'{w}'" for w in R.NEGATIONS)
BOOST_VALUES = ", ".join(f"'{w}'" for w in R.BOOSTERS)
CONTEXT_SENTIMENT_SQL = SENTIMENT_SQL.replace(
    "toks AS (SELECT comment_id, unnest(regexp_extract_all(lower(review_text), '\\p{L}+')) AS token FROM {src}),",
    """tl AS (SELECT comment_id, regexp_extract_all(lower(review_text), '\\p{L}+') AS ws FROM {src}),
toks0 AS (SELECT comment_id, ws, unnest(generate_series(1, len(ws))) AS i FROM tl),
toks AS (SELECT comment_id, ws[i] AS token, CASE WHEN i > 1 THEN ws[i - 1] END AS prev FROM toks0),""").replace(
    "hits AS (SELECT comment_id, sum(polarity) AS s, count(*) AS n FROM toks JOIN lex ON token = term GROUP BY comment_id),",
    f"""hits AS (SELECT comment_id,
  sum(CASE WHEN prev IN ({NEG_VALUES}) THEN polarity * ({R.NEGATION_SCALAR})::DOUBLE
           WHEN prev IN ({BOOST_VALUES}) THEN polarity + sign(polarity) * {R.BOOSTER_INCREMENT}::DOUBLE
           ELSE polarity END) AS s, count(*) AS n
  FROM toks JOIN lex ON token = term GROUP BY comment_id),""")


@query("review_sentiment_context", sql=f"""WITH {REVIEW_FEED_SQL}, {CONTEXT_SENTIMENT_SQL.replace('{src}', 'review_feed')}
SELECT comment_id, textblob_score, textblob_sentiment, vader_score, vader_sentiment,
       final_sentiment FROM scored""")
def review_sentiment_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13 with context rules: negation and booster words before a lexicon hit (whole texts)."""
    out = R.sentiment_scores(parsed_feed(spark, sf_dir), lexicon(spark), context_rules=True)
    return out.select("comment_id", "textblob_score", "textblob_sentiment", "vader_score", "vader_sentiment",
                      "final_sentiment")
