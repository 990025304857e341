"""Reviews: sentiment scoring, labels, new-review detection, summaries (§2.11 M13–M14, §2.3
P11–P16, §2.5 J1–J2, J5, J9, §2.6 A1–A3, A9–A10, A14, A16–A17, A22–A23, §2.7 W6, W8, §2.8 T6).

Sentiment (M13) is a fold over the token array of each review, in the row itself: no token row is made,
joined or shuffled, and reviews that share an id keep their own scores. The lexicon is an input table;
up to ``LEXICON_BOUND`` terms (counted first) it travels as one bucketed literal, above that the tokens
of each numbered row meet it in a shuffle join.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.scalars import (clean_review_text, clean_search_prefix, export_rating, feed_rating, final_sentiment,
                                          first_score_label, second_score_label, short)
from storepulse.operators.lookup import substring_lookup
from storepulse.operators.windows import rank_within_key, top_k_per_key
from storepulse.session import cut_lineage

TOKEN_PATTERN = r"\p{L}+"  # words of any script; the same class in Java and RE2
# Normalisation constant of the second (compound) score: s / sqrt(s^2 + alpha).
COMPOUND_ALPHA = 15.0
# Lexicon terms that travel with the plan; a larger lexicon stays a table.
LEXICON_BOUND = 50_000


# Fixed values for the optional context rules: a negation word flips and damps the next word's
# polarity; a booster word strengthens it (published compound-score constants).
NEGATIONS = ["not", "no", "never", "none", "nothing", "neither", "nor", "without"]
BOOSTERS = ["very", "really", "extremely", "so", "too", "most"]
NEGATION_SCALAR = -0.74
BOOSTER_INCREMENT = 0.293


def _tokens(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN_PATTERN), 0)


def _context(token: Column) -> Column:
    """What a word does to the hit right after it: 1 negates, 2 boosts, 0 nothing."""
    return F.when(token.isin(NEGATIONS), F.lit(1)).when(token.isin(BOOSTERS), F.lit(2)).otherwise(F.lit(0))


def _adjusted(polarity: Column, context: Column) -> Column:
    return (F.when(context == 1, polarity * F.lit(NEGATION_SCALAR))
            .when(context == 2, polarity + F.signum(polarity) * F.lit(BOOSTER_INCREMENT)).otherwise(polarity))


def _bucketed(rows: list) -> tuple[Column, int]:
    """The lexicon as a literal array of small maps, a term's map found by its hash: a lookup costs the same
    in a lexicon of any size."""
    n = 1 << max(0, len(rows) - 1).bit_length()
    maps: list[dict[str, float]] = [{} for _ in range(n)]
    for r in rows:
        maps[r.h % n][r.term] = r.polarity
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,double>>"), n


def _folded(reviews: DataFrame, text: str, lexicon: Column, n_buckets: int, context_rules: bool) -> DataFrame:
    """``reviews`` with ``_f``: summed polarity ``s`` and number ``n`` of the lexicon hits, folded over the tokens
    with the state (sum, hits, what the word before does)."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("c"))

    def step(state: Column, token: Column) -> Column:
        found = F.try_element_at(F.get(lexicon, F.pmod(F.xxhash64(token), F.lit(n_buckets)).cast("int")), token)

        def after(polarity: Column) -> Column:
            hit = _adjusted(polarity, state["c"]) if context_rules else polarity
            return F.struct((state["s"] + F.coalesce(hit, F.lit(0.0))).alias("s"), (state["n"] + polarity.isNotNull().cast("int")).alias("n"),
                            (_context(token) if context_rules else F.lit(0)).alias("c"))

        return F.transform(F.array(found), after)[0]  # binds the polarity, so it is looked up once

    return reviews.withColumn("_f", F.aggregate(F.coalesce(_tokens(text), F.array().cast("array<string>")), zero, step))


def _joined(reviews: DataFrame, text: str, terms: DataFrame, context_rules: bool) -> DataFrame:
    """``_folded`` for a lexicon above the bound: rows are numbered in a written table, so that their tokens can
    meet the lexicon in a shuffle join and come back to their own row."""
    numbered = cut_lineage(reviews.withColumn("_row", F.monotonically_increasing_id()))
    words = _tokens(text)
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))))
    tokens = numbered.select("_row", F.explode(F.arrays_zip(words.alias("term"), before.alias("before"))).alias("_t")).select("_row", "_t.*")
    polarity = _adjusted(F.col("polarity"), F.coalesce(_context(F.col("before")), F.lit(0))) if context_rules else F.col("polarity")
    sums = tokens.join(terms.hint("merge"), "term").groupBy("_row").agg(F.sum(polarity).alias("s"), F.count(F.lit(1)).alias("n"))
    out = numbered.join(sums, "_row", "left")
    return out.withColumn("_f", F.struct(F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("n", F.lit(0)).alias("n"))).drop("_row", "s", "n")


def sentiment_scores(reviews: DataFrame, lexicon: DataFrame, text: str = "review_text",
                     context_rules: bool = False, lexicon_bound: int = LEXICON_BOUND) -> DataFrame:
    """First score = mean polarity of the lexicon hits; second score = s / sqrt(s² + 15) with
    s the summed polarity; a review without hits, or without a text, scores 0 on both. Labels are taken
    before the stored scores are rounded to 4 (half-even). With ``context_rules`` a hit right after a
    negation word is multiplied by −0.74 and one right after a booster moves 0.293 away from 0.

    ``lexicon`` has ``term`` and ``polarity``; terms are compared in lower case, one that stands in it more
    than once counts with its mean polarity, and rows with a null are left out."""
    terms = (lexicon.where("term IS NOT NULL AND polarity IS NOT NULL").groupBy(F.lower("term").alias("term"))
             .agg(F.avg(F.col("polarity").cast("double")).alias("polarity")))
    rows = terms.withColumn("h", F.xxhash64("term")).limit(lexicon_bound + 1).collect()  # bounded: the lexicon, or the news that it is larger
    if len(rows) <= lexicon_bound:
        scored = _folded(reviews, text, *_bucketed(rows), context_rules)
    else:
        scored = _joined(reviews, text, terms, context_rules)
    s, n = F.col("_f.s"), F.col("_f.n")
    scored = scored.withColumns({"_first": F.when(n > 0, s / n).otherwise(F.lit(0.0)), "_second": s / F.sqrt(s * s + F.lit(COMPOUND_ALPHA))})
    return (scored.withColumn("textblob_sentiment", first_score_label("_first"))
            .withColumn("vader_sentiment", second_score_label("_second"))
            .withColumn("final_sentiment", final_sentiment("textblob_sentiment", "vader_sentiment"))
            .withColumn("textblob_score", F.bround("_first", 4))
            .withColumn("vader_score", F.bround("_second", 4))
            .drop("_f", "_first", "_second"))


def new_reviews(feed: DataFrame, saved: DataFrame, key: str = "comment_id",
                saved_key: str = "wp_comment_id") -> DataFrame:
    """J5 + P22: feed rows whose id is not already saved (left anti-join on non-null saved ids)."""
    ids = saved.select(F.col(saved_key).alias(key)).filter(F.col(key).isNotNull())
    return feed.join(ids, key, "left_anti")


def process_reviews(feed: DataFrame, saved: DataFrame, lexicon: DataFrame) -> DataFrame:
    """New reviews (J5) → sentiment (M13) → labels (P11–P12); the caller appends the sink rows (K5)."""
    return sentiment_scores(new_reviews(feed, saved), lexicon)


def store_reviews(comments: DataFrame, posts: DataFrame, n: int = 50) -> DataFrame:
    """J1 + J2 + P23 + T7: approved product reviews joined to their product post, newest ``n`` by
    comment id, product name and text with the ``|||`` separator removed, rating by P14."""
    c = comments.filter((F.col("comment_type") == "review") & (F.col("comment_approved") == "1"))
    p = posts.filter(F.col("post_type") == "product").select("ID", "name")
    j = c.join(p, c.comment_post_ID == p.ID, "inner")
    newest = j.orderBy(F.col("comment_ID").desc()).limit(n)
    return newest.select(F.col("comment_ID").alias("comment_id"),
                         F.replace(F.col("name"), F.lit("|||"), F.lit("")).alias("product_name"),
                         F.replace(F.col("comment_content"), F.lit("|||"), F.lit("")).alias("review_text"),
                         feed_rating("rating").alias("rating"))


def sentiment_by_product(reviews: DataFrame) -> DataFrame:
    """A1: reviews per (product, final sentiment): count and mean second score rounded to 3."""
    return (reviews.groupBy(F.col("product_name"), F.col("final_sentiment"))
            .agg(F.count(F.lit(1)).alias("review_count"), F.round(F.avg("vader_score"), 3).alias("avg_score"))
            .orderBy(F.col("product_name"), F.col("review_count").desc(), F.col("final_sentiment")))  # T9


def review_summary(reviews: DataFrame) -> DataFrame:
    """A2: distinct products, rows, positive / negative / neutral."""
    s = F.col("final_sentiment")
    return reviews.agg(F.countDistinct("product_name").alias("products"), F.count(F.lit(1)).alias("total"),
                       F.sum(F.when(s == "POSITIVE", 1).otherwise(0)).alias("pos"),
                       F.sum(F.when(s == "NEGATIVE", 1).otherwise(0)).alias("neg"),
                       F.sum(F.when(s == "NEUTRAL", 1).otherwise(0)).alias("neu"))


def review_coverage(reviews: DataFrame, approximate: bool = False) -> DataFrame:
    """A3: products with reviews and total reviews (``approx_count_distinct`` at scale if wanted)."""
    distinct = F.approx_count_distinct("product_name") if approximate else F.countDistinct("product_name")
    return reviews.agg(distinct.alias("products_with_reviews"), F.count(F.lit(1)).alias("total_reviews"))


def sentiment_totals(by_product: DataFrame) -> DataFrame:
    """Overall totals from A1."""
    s, c = F.col("final_sentiment"), F.col("review_count")
    return by_product.agg(F.sum(c).alias("total_reviews"),
                          F.sum(F.when(s == "POSITIVE", c).otherwise(0)).alias("positive"),
                          F.sum(F.when(s == "NEGATIVE", c).otherwise(0)).alias("negative"),
                          F.sum(F.when(s == "NEUTRAL", c).otherwise(0)).alias("neutral"))


def sentiment_pivot(by_product: DataFrame) -> DataFrame:
    """A10: product × sentiment counts, missing cells 0; the display name is cut to 25."""
    piv = (by_product.groupBy("product_name").pivot("final_sentiment", ["POSITIVE", "NEGATIVE", "NEUTRAL"])
           .agg(F.sum("review_count")).na.fill(0))
    return piv.withColumn("product_short", short("product_name", 25))


def dominant_sentiment(by_product: DataFrame) -> DataFrame:
    """Per product the sentiment with the most reviews (ties: alphabetically first); name cut to 50.

    A1 has at most three rows per product, so this per-product window is small."""
    w = Window.partitionBy("product_name").orderBy(F.col("review_count").desc(), F.col("final_sentiment"))
    top = by_product.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return top.withColumn("product_short", short("product_name", 50))


def batch_tallies(scored: DataFrame) -> DataFrame:
    """Per product positive / negative / neutral of a batch."""
    s = F.col("final_sentiment")
    return scored.groupBy("product_name").agg(F.count_if(s == "POSITIVE").alias("positive"),
                                              F.count_if(s == "NEGATIVE").alias("negative"),
                                              F.count_if(s == "NEUTRAL").alias("neutral"))


def run_summary(products: DataFrame, reviews: DataFrame, product: str = "product_name") -> DataFrame:
    """Products analysed (with reviews), skipped (none) and total reviews."""
    per = reviews.groupBy(product).agg(F.count(F.lit(1)).alias("_n"))
    j = products.select(product).distinct().join(per, product, "left")
    return j.agg(F.count_if(F.col("_n").isNotNull()).alias("analyzed"),
                 F.count_if(F.col("_n").isNull()).alias("skipped"),
                 F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("total_reviews"))


def top_reviews_per_product(reviews: DataFrame, n: int = 5, order: str = "review_pos") -> DataFrame:
    """The first ``n`` reviews per product in payload order."""
    return top_k_per_key(reviews, "product_name", [F.col(order)], n, rank_col="review_rank")


def reviews_for_export(reviews: DataFrame) -> DataFrame:
    """Ordered by product ascending, rating descending (nulls first, as PostgreSQL DESC does)."""
    return reviews.orderBy(F.col("product_name").asc_nulls_last(), F.col("rating").desc_nulls_first())


def reviews_grouped(reviews: DataFrame, tiebreak: str = "comment_id") -> DataFrame:
    """Reviews grouped per product in export order, as (product, position) rows rather than
    one collected list, so a product with a huge number of reviews never sits in one task."""
    return rank_within_key(reviews, "product_name",
                           [F.col("rating").desc_nulls_first(), F.col(tiebreak)], out="position")


def export_rows(reviews: DataFrame) -> DataFrame:
    """P13 + P15: the review as pushed to the store: cleaned text and clamped integer rating."""
    return reviews.withColumn("clean_text", clean_review_text("review_text")) \
        .withColumn("export_rating", export_rating("rating"))


def match_store_product(reviews: DataFrame, store: DataFrame, product: str = "product_name") -> DataFrame:
    """J9 + P16: store product for each reviewed product by its cleaned 35-character prefix
    (first published hit, lowest id); products without a hit are 'not found'."""
    names = reviews.select(product).distinct().withColumn("search", clean_search_prefix(product))
    published = store.filter(F.col("status") == "publish")
    hits = substring_lookup(names, "search", published, "name", "ID")
    return (names.join(hits, names.search == hits.query, "left")
            .select(product, "search", F.col("ID").alias("store_id")))


def import_summary(matched: DataFrame, reviews: DataFrame, product: str = "product_name") -> DataFrame:
    """Products found, not found and reviews kept (reviews of found products)."""
    per = reviews.groupBy(product).agg(F.count(F.lit(1)).alias("_n"))
    j = matched.join(per, product, "left")
    found = F.col("store_id").isNotNull()
    return j.agg(F.count_if(found).alias("found"), F.count_if(~found).alias("not_found"),
                 F.coalesce(F.sum(F.when(found, F.col("_n"))), F.lit(0)).cast("long").alias("reviews_kept"))
