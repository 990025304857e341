"""Substring (theta) lookups as equi-joins (§2.5 J7, J9; §2.10 F8).

"First product whose name contains the query, ignoring case, lowest position wins" is a non-equi join; as a nested
loop it costs |queries| × |products|. Here it is exact and runs as equi-joins over a positional gram index:

* Products of one name are one entry, its least position: only that can win.
* A query of up to two characters is itself a gram. Short grams are reduced to the least position of their names by
  a partial aggregate, so a gram that every name holds is one row per task. The empty gram serves the empty query.
* A longer query is covered by 3-grams at every third place and at its end. A name holds the query at a place if and
  only if it holds each of these grams at its distance from there, so the index alone decides: the postings
  (gram, name, place) of the rarest gram give the candidates, and the others are looked up by all three columns.

Only the grams that some query asks for are kept, in a written table; no name travels with a gram, and names are
fetched for the winners only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.session import cut_lineage

GRAM = 3


def _grams_at(text: Column, places: Column) -> Column:
    """array<struct<g, at>> of the 3-grams at 0-based ``places``."""
    return F.transform(places, lambda i: F.struct(F.substring(text, i + 1, GRAM).alias("g"), i.alias("at")))


def _short_grams(text: Column) -> Column:
    """The distinct substrings of up to two characters, the empty one among them."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    pairs = F.transform(places, lambda i: F.array(F.substring(text, i, 1), F.substring(text, i, 2)))
    return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(pairs)))


def substring_lookup(queries: DataFrame, query_col: str, products: DataFrame, name_col: str,
                     pos_col: str) -> DataFrame:
    """For each distinct query text: the product (lowest ``pos_col``) whose ``name_col`` contains
    it, ignoring case. Queries without a match, null queries and null names produce no row. Returns (query, pos, name)."""
    asked = (queries.select(F.col(query_col).alias("query")).filter(F.col("query").isNotNull()).distinct()
             .withColumn("_q", F.lower("query")))
    named = products.select(F.col(pos_col).alias("_pos"), F.col(name_col).alias("_name")).filter(F.col("_name").isNotNull())
    names = named.groupBy(F.lower("_name").alias("_n")).agg(F.min("_pos").alias("_pos"))

    short = asked.filter(F.length("_q") < GRAM).select("query", F.col("_q").alias("g"))
    firsts = names.select("_pos", F.explode(_short_grams(F.col("_n"))).alias("g")).groupBy("g").agg(F.min("_pos").alias("_pos"))
    short_hits = short.join(firsts, "g").select("query", "_pos")

    last = F.length("_q") - GRAM
    cover = F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(GRAM)), F.array(last)))
    covered = (asked.filter(F.length("_q") >= GRAM).withColumn("_c", _grams_at(F.col("_q"), cover))
               .select("query", F.size("_c").alias("n"), F.explode("_c").alias("_x")).select("query", "n", "_x.g", F.col("_x.at").alias("off")))
    covered = cut_lineage(covered)  # a few rows per query, read three times
    everywhere = F.sequence(F.lit(0), F.length("_n") - GRAM)
    postings = (names.filter(F.length("_n") >= GRAM).select("_pos", F.explode(_grams_at(F.col("_n"), everywhere)).alias("_x"))
                .select("_x.g", "_pos", "_x.at").join(covered.select("g").distinct(), "g", "left_semi"))
    postings = cut_lineage(postings)
    frequency = postings.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rarest = (covered.join(frequency, "g", "left").groupBy("query", "n")
              .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "g")).alias("r"))
              .filter("r.df > 0").select("query", "n", "r.g", "r.off"))  # a gram without postings: no match
    starts = rarest.join(postings, "g").select("query", "n", "_pos", (F.col("at") - F.col("off")).alias("start")).filter("start >= 0")
    wanted = starts.join(covered.drop("n"), "query").select("query", "n", "_pos", "start", "g", (F.col("start") + F.col("off")).alias("at"))
    long_hits = (wanted.join(postings, ["g", "_pos", "at"]).groupBy("query", "n", "_pos", "start").agg(F.count(F.lit(1)).alias("found"))
                 .filter("found = n").select("query", "_pos"))

    best = short_hits.unionByName(long_hits).groupBy("query").agg(F.min("_pos").alias("_pos"))
    return best.join(named, "_pos").select("query", F.col("_pos").alias(pos_col), F.col("_name").alias(name_col))
