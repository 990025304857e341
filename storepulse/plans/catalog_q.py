"""Catalogue queries: TF-IDF, exact cosine top-k recommendations, lookups, CSV round trip."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.operators import dashboard as D
from storepulse.operators import similarity as M
from storepulse.operators import sinks as K
from storepulse.plans.registry import query
from storepulse.session import checkpoint_dir
from storepulse.sources.feeds import catalogue
from storepulse.sources.files import read_catalog
from storepulse.sources.tables import read_table

# Search terms of the recommendation checks (the reference runs a fixed list of four).
SEARCH_TERMS = ["ring", "Blue Widget", "hot", "gear brand#1", "xyz", "ro"]
SEARCH_TERM = "widget"

STOP_VALUES = ", ".join(f"('{w}')" for w in M.STOP_WORDS)
TFIDF_SQL = f"""cat AS (
  SELECT p_partkey AS position, p_name || ' ' || p_brand AS name, p_type AS category,
         '$' || CAST(p_retailprice AS VARCHAR) AS price FROM part),
stop(term) AS (VALUES {STOP_VALUES}),
content AS (SELECT position, lower(coalesce(name, '') || ' ' || coalesce(category, '')) AS c FROM cat
            WHERE name IS NOT NULL),
toks AS (SELECT position, unnest(regexp_extract_all(c, '{M.TOKEN_PATTERN}')) AS term FROM content),
toks2 AS (SELECT * FROM toks WHERE term NOT IN (SELECT term FROM stop)),
vocab AS (SELECT term, count(*) AS corpus_count FROM toks2 GROUP BY term ORDER BY count(*) DESC, term LIMIT 100),
tf AS (SELECT position, term, count(*) AS tf FROM toks2 WHERE term IN (SELECT term FROM vocab) GROUP BY 1, 2),
ndocs AS (SELECT count(*) AS n FROM content),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT position, term, tf, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN dfs USING (term), ndocs),
wn AS (SELECT position, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY position)) AS weight FROM w)"""

SIM_SQL = f"""{TFIDF_SQL},
pos AS (SELECT position FROM content),
dots AS (SELECT a.position AS source, b.position AS target, sum(a.weight * b.weight) AS sim
         FROM wn a JOIN wn b ON a.term = b.term AND a.position <> b.position GROUP BY 1, 2),
allp AS (SELECT s.position AS source, t.position AS target, coalesce(d.sim, 0.0) AS sim
         FROM pos s JOIN pos t ON s.position <> t.position
         LEFT JOIN dots d ON d.source = s.position AND d.target = t.position),
top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(sim, 9) DESC, target) AS rank
                        FROM allp) WHERE rank <= 5),
recs AS (
  SELECT t.source AS source_position, s.name AS source_product, t.rank, t.target AS recommended_position,
         substr(c.name, 1, 80) AS recommended_product, c.category, c.price,
         round_even(t.sim * 100, 1) AS similarity_score
  FROM top5 t JOIN cat c ON t.target = c.position JOIN cat s ON t.source = s.position)"""


def _recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.recommend_all(catalogue(spark, sf_dir), k=5)


@query("tfidf_vocabulary", sql=f"""WITH {TFIDF_SQL} SELECT term, corpus_count FROM vocab""")
def tfidf_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 + M8: tokens without stop words; the 100 terms with the largest corpus count."""
    docs = M.named_products(catalogue(spark, sf_dir)).withColumn("content", M.product_content())
    return M.vocabulary(M.tokens(docs), 100)


@query("tfidf_weights", sql=f"""WITH {TFIDF_SQL}
SELECT position, term, tf, round(weight, 9) AS weight FROM wn""")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: smooth-idf TF-IDF weights, L2-normalised per product."""
    docs = M.named_products(catalogue(spark, sf_dir)).withColumn("content", M.product_content())
    return M.tfidf(docs).select("position", "term", "tf", F.round("weight", 9).alias("weight"))


@query("similar_products", sql=f"""WITH {SIM_SQL}
SELECT source, rank, target, round(sim, 9) AS similarity FROM top5""")
def similar_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 + J6 + W5: the 5 most similar other products of every product (exact cosine top-k)."""
    docs = M.named_products(catalogue(spark, sf_dir)).withColumn("content", M.product_content())
    out = M.similar_products(docs, k=5)
    return out.select("source", F.col("rank").cast("long").alias("rank"), "target",
                      F.round("similarity", 9).alias("similarity"))


@query("recommend_all", sql=f"""WITH {SIM_SQL} SELECT * FROM recs""")
def recommend_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations with display columns for every product."""
    return _recs(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))


@query("recommendations_sink", sql=f"""WITH {SIM_SQL}
SELECT substr(source_product, 1, 500) AS source_product, substr(recommended_product, 1, 500) AS recommended_product,
       substr(category, 1, 100) AS category, substr(price, 1, 50) AS price, similarity_score,
       CAST(rank AS INTEGER) AS rank FROM recs""")
def recommendations_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: rows for the ``recommendations`` table."""
    return K.recommendation_sink_rows(_recs(spark, sf_dir))


@query("top_recommendations", sql=f"""WITH {SIM_SQL}
SELECT source_position, rank, recommended_position, similarity_score FROM recs
ORDER BY similarity_score DESC, source_position, rank LIMIT 50""")
def top_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 pairs with the largest similarity (a top-k report)."""
    top = D.top_recommendations(_recs(spark, sf_dir), 50)
    return top.select("source_position", F.col("rank").cast("long").alias("rank"), "recommended_position",
                      "similarity_score")


@query("nlargest_recommendations", sql=f"""WITH {SIM_SQL}
SELECT source_position, rank, recommended_position, similarity_score,
       substr(source_product, 1, 25) AS source_short, substr(recommended_product, 1, 25) AS recommended_short
FROM recs ORDER BY similarity_score DESC, source_position, rank LIMIT 10""")
def nlargest_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the 10 largest of the top 50, with display names cut to 25."""
    top = D.nlargest_recommendations(_recs(spark, sf_dir), 10)
    return top.select("source_position", F.col("rank").cast("long").alias("rank"), "recommended_position",
                      "similarity_score", "source_short", "recommended_short")


@query("search_recommendations", sql=f"""WITH {SIM_SQL}
SELECT source_position, source_product, rank, recommended_product, similarity_score FROM recs
WHERE source_product ILIKE '%{SEARCH_TERM}%' ORDER BY rank, source_position LIMIT 5""")
def search_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8 + T3: stored recommendations of sources matching the search term, best ranks first."""
    hit = M.search_recommendations(_recs(spark, sf_dir), SEARCH_TERM, 5)
    return hit.select("source_position", "source_product", F.col("rank").cast("long").alias("rank"),
                      "recommended_product", "similarity_score")


TERMS_SQL = "terms(query) AS (VALUES " + ", ".join(f"('{t}')" for t in SEARCH_TERMS) + ")"


@query("find_product", sql=f"""WITH {TFIDF_SQL}, {TERMS_SQL},
found AS (SELECT query, (SELECT min(position) FROM cat WHERE contains(lower(name), lower(substr(query, 1, 20))))
            AS position FROM terms)
SELECT f.query, f.position, c.name FROM found f JOIN cat c ON f.position = c.position""")
def find_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First product whose name contains the term's first 20 characters, ignoring case."""
    terms = spark.createDataFrame([(t,) for t in SEARCH_TERMS], "query string")
    return M.find_product(terms, catalogue(spark, sf_dir))


@query("recommend_for_term", sql=f"""WITH {SIM_SQL}, {TERMS_SQL},
found AS (SELECT query, (SELECT min(position) FROM cat WHERE contains(lower(name), lower(substr(query, 1, 20))))
            AS position FROM terms)
SELECT f.query, r.source_position, r.rank, r.recommended_product, r.category, r.similarity_score
FROM found f JOIN recs r ON f.position = r.source_position WHERE r.rank <= 3""")
def recommend_for_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three recommendations for each search term's product."""
    terms = spark.createDataFrame([(t,) for t in SEARCH_TERMS], "query string")
    out = M.recommend_for_term(terms, _recs(spark, sf_dir), catalogue(spark, sf_dir), k=3)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("recommendation_bands", sql=f"""WITH {SIM_SQL}
SELECT CASE WHEN similarity_score > 50 THEN 'high' WHEN similarity_score > 20 THEN 'medium' ELSE 'low' END AS match,
       count(*) AS n FROM recs GROUP BY 1""")
def recommendation_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations per match band."""
    return M.with_match_band(_recs(spark, sf_dir)).groupBy("match").agg(F.count(F.lit(1)).alias("n"))


def _catalog_csv(spark: SparkSession, sf_dir: str) -> str:
    """Write the catalogue as a products CSV (quoted fields, a few bad or empty prices) into the
    shared checkpoint folder and return its path."""
    path = f"{checkpoint_dir(spark)}/catalog-csv-{uuid.uuid4().hex}"
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"])
    price = (F.when(F.col("p_partkey") % 97 == 0, F.lit("abc"))
             .when(F.col("p_partkey") % 89 == 0, F.lit(""))
             .otherwise(F.concat(F.lit("$"), F.format_number("p_retailprice", 2))))
    rows = part.select(F.lit("simple").alias("Type"), F.concat_ws(" ", "p_name", "p_brand").alias("Name"),
                       F.lit(1).alias("Published"), price.alias("Regular price"), F.col("p_type").alias("Categories"),
                       F.lit("").alias("Images"),
                       F.concat(F.col("p_name"), F.lit(", "), F.lower("p_type")).alias("Short description"))
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


@query("catalog_csv_sink", sql="""
SELECT substr(p_name || ' ' || p_brand, 1, 500) AS product_name, substr(p_type, 1, 100) AS category,
       CASE WHEN p_partkey % 89 = 0 THEN 0.0 ELSE p_retailprice END AS price
FROM part WHERE p_partkey % 97 <> 0""")
def catalog_csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + P5 + K4: products CSV → price parsed ($ and , stripped; empty → 0; bad row dropped)."""
    return K.catalog_sink_rows(read_catalog(spark, _catalog_csv(spark, sf_dir)))


@query("catalog_positions", sql="""
SELECT p_partkey AS product_id, p_name || ' ' || p_brand AS name,
       row_number() OVER (ORDER BY p_name || ' ' || p_brand, p_partkey) - 1 AS position FROM part""")
def catalog_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 + P3: named products with a dense position in name order (distributed rank)."""
    from storepulse.operators.windows import with_position
    cat = M.named_products(catalogue(spark, sf_dir)).select(F.col("position").alias("product_id"), "name")
    return with_position(cat, [F.col("name"), F.col("product_id")])
