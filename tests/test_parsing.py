"""Scalar parsing and feed parsers on hand-made lines (FIXTURES §4)."""
from storepulse.functions.scalars import (clean_review_text, export_rating, parse_price, parse_stock,
                                          second_score_label, first_score_label, stock_status)
from storepulse.sources.files import parse_order_log, parse_review_feed, parse_stock_feed


def test_stock_text(spark):
    df = spark.createDataFrame([(t,) for t in ["0", "5", "6", "-3", "--5", " 7 ", "x", "", None]], "t string")
    rows = df.select("t", parse_stock("t", True).alias("c"), parse_stock("t", False).alias("u")).collect()
    got = {r.t: (r.c, r.u) for r in rows}
    assert got["0"] == (0, 0) and got["5"] == (5, 5) and got["6"] == (6, 6)
    assert got["-3"] == (0, -3) and got[" 7 "] == (7, 7) and got["x"] == (0, 0) and got[""] == (0, 0)
    assert got["--5"] == (None, None)  # passes the text test, fails the conversion → row dropped


def test_stock_status(spark):
    df = spark.createDataFrame([(v,) for v in [-1, 0, 5, 6]], "v int")
    got = [r.s for r in df.select(stock_status("v").alias("s")).collect()]
    assert got == ["LOW_STOCK", "OUT_OF_STOCK", "LOW_STOCK", "IN_STOCK"]


def test_price_text(spark):
    df = spark.createDataFrame([(t,) for t in ["$1,299.99", "", "abc", " 5 ", None]], "t string")
    got = {r.t: r.p for r in df.select("t", parse_price("t").alias("p")).collect()}
    assert got["$1,299.99"] == 1299.99 and got[""] == 0.0 and got["abc"] is None and got[" 5 "] == 5.0
    assert got[None] == 0.0


def test_sentiment_cuts(spark):
    df = spark.createDataFrame([(v,) for v in [-0.1, 0.1, 0.1001, -0.1001, 0.05, -0.05, 0.0499, -0.0499]], "v double")
    rows = {r.v: (r.a, r.b) for r in df.select("v", first_score_label("v").alias("a"),
                                               second_score_label("v").alias("b")).collect()}
    assert rows[0.1][0] == "NEUTRAL" and rows[0.1001][0] == "POSITIVE" and rows[-0.1001][0] == "NEGATIVE"
    assert rows[0.05][1] == "POSITIVE" and rows[-0.05][1] == "NEGATIVE" and rows[0.0499][1] == "NEUTRAL"


def test_export_rating_and_clean(spark):
    df = spark.createDataFrame([(None, 'a "b"\n$c;&d'), (0.0, "x"), (7.9, "y"), (2.6, "z")], "r double, t string")
    rows = df.select(export_rating("r").alias("e"), clean_review_text("t").alias("c")).collect()
    assert [r.e for r in rows] == [3, 3, 5, 2]
    assert rows[0].c == "a b candd"


def test_stock_feed(spark):
    lines = ["1|5|Plain|9.99", "2|7|Name|with|bar|12.50", "3|4|Only three", "x|3|Bad id|1", "", "4|--5|Weird|1",
             "5|2|Bad price|abc", "6|0|Empty price|"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    got = {r.product_id: (r.stock, r.name, r.price) for r in parse_stock_feed(df).collect()}
    assert got[1] == (5, "Plain", 9.99)
    assert got[2] == (7, "Name|with|bar", 12.5)
    assert got[3] == (4, "Only three", 0.0)
    assert got[6] == (0, "Empty price", 0.0)
    assert set(got) == {1, 2, 3, 6}
    live = {r.name: r.stock for r in parse_stock_feed(df, with_price=False).collect()}
    assert live["Name|with|bar|12.50"] == 7  # dashboard split keeps the rest of the line as the name


def test_review_feed(spark):
    lines = ["1|||Prod|||Great item|||4", "2|||P|||text ending in bar||||5", "x|||P|||t|||3", "3|||P|||t",
             "4|||P|||t|||4.7"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    got = {r.comment_id: (r.product_name, r.review_text, r.rating) for r in parse_review_feed(df).collect()}
    assert got == {1: ("Prod", "Great item", 4), 4: ("P", "t", 4)}


def test_order_log(spark):
    lines = ['{"order_id": "1", "email": "a@x", "total": 10, "items": [{"name": "n", "quantity": 2}, {"name": "m"}]}',
             '{"order_id": ', "", "   ", "[1, 2]", "{}"]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    rows = parse_order_log(df).collect()
    assert len(rows) == 2
    assert rows[0].order_id == "1" and rows[0].items[1].quantity is None


def test_feed_rating(spark):
    from storepulse.functions.scalars import feed_rating
    df = spark.createDataFrame([(t,) for t in ["4", "4.7", "", None, "0", "x"]], "t string")
    assert [r.r for r in df.select(feed_rating("t").alias("r")).collect()] == [4, 4, 5, 5, 5, None]


def test_read_order_log_file(spark, tmp_path):
    from storepulse.sources.files import read_order_log
    p = tmp_path / "orders.json"
    p.write_text('{"order_id": "7", "total": 3.5, "items": []}\n\n{broken\n{"order_id": "8"}\n')
    rows = sorted((r.order_id, r.total) for r in read_order_log(spark, str(p)).collect())
    assert rows == [("7", 3.5), ("8", None)]


def test_review_payload(spark):
    import json
    from storepulse.sources.files import explode_review_payload, first_search_hit
    payload = json.dumps({"data": {"reviews": [
        {"review_comment": "a", "review_star_rating": "4"}, {"review_comment": "", "review_star_rating": "5"},
        {"review_comment": "c", "review_star_rating": None}, {"review_comment": "d", "review_star_rating": "0"},
        {"review_comment": "e", "review_star_rating": "x"}, {"review_comment": "f", "review_star_rating": "3"}],
        "products": [{"asin": "B1"}, {"asin": "B2"}]}})
    empty = json.dumps({"data": {"reviews": [], "products": []}})
    df = spark.createDataFrame([(1, payload), (2, empty)], "k int, payload string")
    rows = [(r.k, r.review_pos, r.text, r.rating) for r in explode_review_payload(df, "k", max_reviews=5).collect()]
    # the first five are taken before the empty text is dropped, so "f" (sixth) never appears
    assert sorted(rows) == [(1, 0, "a", 4.0), (1, 2, "c", 0.0), (1, 3, "d", 0.0), (1, 4, "e", 0.0)]
    hits = {r.k: r.asin for r in first_search_hit(df, "k").collect()}
    assert hits == {1: "B1", 2: ""}
