"""Sink properties and review operators."""
from datetime import datetime

from storepulse.operators.reviews import new_reviews, sentiment_scores
from storepulse.operators.sinks import assert_unique, replace_by_key, upsert_stock, with_missing_columns, TABLE_SCHEMAS

S = "product_id long, product_name string, stock_level int, status string, checked_at timestamp"


def test_upsert_keeps_name_last_wins_idempotent(spark):
    cur = spark.createDataFrame([(1, "Old", 5, "LOW_STOCK", datetime(2024, 1, 1)),
                                 (2, "Keep", 9, "IN_STOCK", datetime(2024, 1, 1))], S)
    batch = spark.createDataFrame([(1, "New", 0, "OUT_OF_STOCK", datetime(2024, 1, 2), 1),
                                   (1, "New", 7, "IN_STOCK", datetime(2024, 1, 3), 2),
                                   (3, "Fresh", 4, "LOW_STOCK", datetime(2024, 1, 2), 1)], S + ", seq int")
    once = upsert_stock(cur, batch)
    twice = upsert_stock(once, batch)
    rows = {r.product_id: (r.product_name, r.stock_level) for r in once.collect()}
    assert rows == {1: ("Old", 7), 2: ("Keep", 9), 3: ("Fresh", 4)}
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert assert_unique(once, "product_id").count() == 0


def test_replace_by_key(spark):
    cur = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "product string, id int")
    batch = spark.createDataFrame([("p", 9)], "product string, id int")
    out = sorted(map(tuple, replace_by_key(cur, batch, "product").collect()))
    assert out == [("p", 9), ("q", 3)]


def test_missing_columns(spark):
    df = spark.createDataFrame([("x",)], "product_name string")
    out = with_missing_columns(df, TABLE_SCHEMAS["product_reviews"])
    assert "wp_comment_id" in out.columns and out.first().wp_comment_id is None


def test_sentiment_and_anti_join(spark):
    lex = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "term string, polarity double")
    reviews = spark.createDataFrame([(1, "good good bad"), (2, "nothing here"), (3, "Bad.")],
                                    "comment_id int, review_text string")
    got = {r.comment_id: r for r in sentiment_scores(reviews, lex).collect()}
    assert got[1].textblob_score == round(1 / 3, 4) and got[1].vader_score == round(1 / (1 + 15) ** 0.5, 4)
    assert got[2].final_sentiment == "NEUTRAL" and got[2].vader_score == 0.0
    assert got[3].final_sentiment == "NEGATIVE"
    saved = spark.createDataFrame([(1,), (None,)], "wp_comment_id int")
    assert sorted(r.comment_id for r in new_reviews(reviews, saved).collect()) == [2, 3]


def test_ensure_tables(spark, tmp_path):
    from storepulse.operators.sinks import ensure_tables
    made = ensure_tables(spark, str(tmp_path))
    assert set(made) == set(TABLE_SCHEMAS)
    assert spark.table("stock_levels").columns == [f.name for f in TABLE_SCHEMAS["stock_levels"].fields]
    for t in made:
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_order_stream_reader_on_text_source(spark, tmp_path):
    from storepulse.sources.files import read_order_stream
    src = tmp_path / "topic"
    src.mkdir()
    (src / "part-0.txt").write_text('{"order_id": "WOO-1", "amount": 12.5, "products": ["a"]}\nnot json\n')
    stream = read_order_stream(spark, fmt="text", path=str(src))
    q = stream.writeStream.format("memory").queryName("orders_topic_test").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("SELECT order_id, amount, products FROM orders_topic_test").collect()
    assert [(r.order_id, r.amount, r.products) for r in rows] == [("WOO-1", 12.5, ["a"])]


def test_sentiment_context_rules(spark):
    lex = spark.createDataFrame([("good", 1.0)], "term string, polarity double")
    reviews = spark.createDataFrame([(1, "not good"), (2, "very good"), (3, "good")], "comment_id int, review_text string")
    got = {r.comment_id: r.textblob_score for r in sentiment_scores(reviews, lex, context_rules=True).collect()}
    assert got == {1: -0.74, 2: 1.293, 3: 1.0}


def test_sentiment_is_row_local(spark):
    """No token row, join or exchange in the plan; rows that share an id, and rows without a text, keep their own scores."""
    lex = spark.createDataFrame([("good", 1.0), ("bad", -1.0), ("GOOD", 3.0), (None, 1.0), ("x", None), ("größe", 0.5)], "term string, polarity double")
    reviews = spark.createDataFrame([(1, "good"), (1, "bad bad"), (2, None), (None, "good Größe"), (None, "")], "comment_id int, review_text string")
    scored = sentiment_scores(reviews, lex)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Generate"))
    got = sorted(((r.comment_id or 0, r.review_text or "", r.textblob_score) for r in scored.collect()))
    assert got == [(0, "", 0.0), (0, "good Größe", 1.25), (1, "bad bad", -1.0), (1, "good", 2.0), (2, "", 0.0)]


def test_sentiment_beyond_the_lexicon_bound(spark):
    """A lexicon above the bound stays a table; both ways give the same scores, with and without context rules."""
    import random
    rnd = random.Random(6)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["not", "very", "never", "most"]
    lex = spark.createDataFrame([(w, rnd.choice([-1.5, -0.5, 0.5, 1.0])) for w in words[:40]], "term string, polarity double")
    rows = [(i % 50, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 25)))) for i in range(120)] + [(7, None)]
    reviews = spark.createDataFrame(rows, "comment_id int, review_text string")
    for rules in (False, True):
        both = [sorted((str(r.comment_id), r.review_text or "", r.textblob_score, r.vader_score, r.final_sentiment) for r in sentiment_scores(reviews, lex, context_rules=rules, lexicon_bound=bound).collect()) for bound in (1000, 3)]
        assert [x[:2] for x in both[0]] == [x[:2] for x in both[1]]
        assert all(abs(a[2] - b[2]) < 2e-4 and abs(a[3] - b[3]) < 2e-4 and a[4] == b[4] for a, b in zip(*both, strict=True))
    assert sentiment_scores(reviews.limit(0), lex).count() == 0 and {r.vader_score for r in sentiment_scores(reviews, lex.limit(0)).collect()} == {0.0}


def test_untracked_stock_and_wide_ids(spark):
    from storepulse.operators.stock import tracked_products
    from storepulse.sources.files import parse_review_feed, parse_stock_feed
    products = spark.createDataFrame([(1, 0), (2, None), (3, -4)], "id long, stock int")
    assert sorted(r.id for r in tracked_products(products).collect()) == [1, 3]
    lines = spark.createDataFrame([("5000000007|3|Name|2.5",), ("9223372036854775808|3|Name|2.5",), ("x|3|Name|2",)], "value string")
    assert [(r.product_id, r.stock) for r in parse_stock_feed(lines).collect()] == [(5000000007, 3)]
    feed = spark.createDataFrame([("3000000001|||P|||text|||4.9",), ("y|||P|||text|||4",)], "value string")
    assert [(r.comment_id, r.rating) for r in parse_review_feed(feed).collect()] == [(3000000001, 4)]


def test_stock_counts_take_every_product(spark, tmp_path):
    """Sizes that end in 7 count as well; only a product without a size has no stock."""
    from storepulse.plans.stock_q import live_stock, stock_counts, stock_feed_parse, stock_status_distribution
    parts = [(1, "a", "B", 7, 1.0), (2, "a", "B", 17, 1.0), (3, "a", "B", 8, 1.0), (4, "a", "B", 1, 1.0), (5, "a", "B", None, 1.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1,)] * 14 + [(3,)] * 6 + [(4,)] * 4, "l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert tuple(stock_counts(spark, str(tmp_path)).first()) == (4, 1, 1, 2)
    assert {r.status: r.n for r in stock_status_distribution(spark, str(tmp_path)).collect()} == {"IN_STOCK": 1, "LOW_STOCK": 2, "OUT_OF_STOCK": 1}
    assert stock_feed_parse(spark, str(tmp_path)).count() == live_stock(spark, str(tmp_path)).count() == 2
