"""Search text, scores, filters, orders and pages."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.price import Rates
from shelfmark.operators.listings import index_listings, normalize_listings, public_columns
from shelfmark.plans import query_text as Q
from shelfmark.plans.search import Request, after, is_browse, matches, next_page, request_from_text, search, search_batch

ROWS = [
    # shop, title, price, offer_id
    ("B", "Lithium battery charger TP4056", "￥3.5", "100"),
    ("A", "TP4056 module", "US$2", "101"),
    ("A", "battery holder", "", "102"),
    ("A", "string of lights", "￥9", "103"),
    ("C", "ring TP-4056 red", "￥1", "tp4056x"),
    ("C", "", "￥1", ""),
]


@pytest.fixture(scope="module")
def index(spark):
    raw = spark.createDataFrame(
        [(s, "f", n, t, p, o, f"http://h/{n}" if t else "") for n, (s, t, p, o) in enumerate(ROWS, 1)],
        "shop string, source_file string, row_number long, title string, price string, offer_id string, source_url string",
    )
    return index_listings(normalize_listings(raw)).cache()


def titles(df):
    return [r["title"] for r in df.collect()]


def test_query_text():
    q = Q.compile_query('a OR "b c" || !x -y | d')
    assert q.groups == (("a",), ("b", "c"), ("d",)) and q.exclude == ("x", "y")
    # A negated phrase rules out its first word only and asks for the others.
    assert Q.compile_query('-"two words"').groups == (("words",),)
    assert Q.compile_query('-"two words"').exclude == ("two",)
    assert Q.compile_query("AB-123").title_word == "ab123" and Q.compile_query("a b").title_word == ""
    assert Q.compile_query("!!! ---").groups == () and Q.compile_query("").compact == ""


def test_inline_filters():
    text, f = Q.inline_filters('chip min:2 max:"9" has:photo shop:\'Big Shop\' id:AB-1 price:5..3')
    assert text == "chip" and f == Q.Filters(3.0, 5.0, True, "big shop", "ab1")
    assert Q.inline_filters("price:7 has:nothing")[1] == Q.Filters(min_price=7.0)


def test_clauses():
    q = Q.compile_clauses('the "Red  Chip" of ab || -new !"old one" x')
    first, second = q.clauses
    # A stop word alone is kept: it is all there is of that word.
    assert first.phrases == ("red chip",) and first.words == ("the", "of", "ab")
    assert second.not_words == ("new",) and second.not_phrases == ("old one",) and second.words == ("x",)
    assert Q.compile_clauses("TPS-5430 ddar").clauses[0].compact == "tps5430ddar"
    assert Q.compile_clauses("").clauses == (Q.Clause(),) and not Q.compile_clauses(" ").has_terms
    assert Q.expand_term("converter")[0] == "boost" and Q.expand_term("zzz") == ["zzz"]
    assert [Q.term_weight(t) for t in ("tps5430", "10", "chip", "ab", "word")] == [2.2, 1.55, 0.35, 0.45, 1.0]


def test_blank_rows_are_dropped_and_columns_filled(index):
    rows = {r["offer_id"]: r for r in index.collect()}
    assert len(rows) == 5
    assert rows["101"]["price_currency"] == "usd" and rows["101"]["price_value"] == 2.0
    assert rows["102"]["price_value"] is None and rows["102"]["price_currency"] == ""
    assert not [c for c in public_columns(index).columns if c.startswith("_")]


def test_scores(index):
    def scores(text):
        return {r["offer_id"]: r["score"] for r in matches(index, Request(text)).collect()}

    # A part number does not run across tokens, but the one-word bonus looks at the raw title.
    assert scores("TP4056") == {"100": 500 + 120 + 4000 + 2500, "101": 7120, "tp4056x": 800 + 120 + 4000 + 2500}
    # Substrings match, in excludes too.
    assert set(scores("ring")) == {"103", "tp4056x"}
    assert set(scores("ring !string")) == {"tp4056x"}
    # A word may run across tokens.
    assert scores("lithiumbattery") == {"100": 500 + 120 + 4000 + 2500}
    assert scores("battery charger") == {"100": 1240 + 2500}
    assert scores("battery nothing") == {}
    assert set(scores("holder OR lights")) == {"102", "103"}
    assert set(scores("").values()) == {1.0} and len(scores("")) == 5


def test_orders(index):
    assert titles(search(index, Request(sort="price-asc")))[-1] == "battery holder"
    assert titles(search(index, Request(sort="price-desc")))[-1] == "battery holder"
    assert titles(search(index, Request(sort="shop"))) == titles(search(index, Request()))
    assert titles(search(index, Request("tp4056")))[:1] == ["ring TP-4056 red"]


def test_filters(index):
    def ids(**kw):
        return {r["offer_id"] for r in matches(index, Request(**kw)).collect()}

    assert ids(min_price=3) == {"100", "103"} and ids(max_price=2) == {"101", "tp4056x"}
    assert ids(shop_exact=" B ") == {"100"} and ids(disabled_shops=("A", "")) == {"100", "tp4056x"}
    assert ids(offer_filter="10-1") == {"101"} and ids(shop_filter="c") == {"tp4056x"} and ids(has_image=True) == set()


def test_pages(index):
    whole = titles(search(index, Request(limit=5000)))
    assert Request(limit=0).page() == (0, 240) and Request(limit=-3, offset=-1).page() == (0, 1) and Request(limit=9999).page()[1] == 9999
    step, request, seen = 2, Request(limit=2), []
    while True:
        rows = search(index, request).orderBy("rank").collect()
        if not rows:
            break
        assert all(r["total"] == 5 for r in rows)
        seen += [r["title"] for r in rows]
        request = next_page(request, len(seen))
    assert seen == whole and step == 2
    for sort in ("match", "price-asc", "price-desc", "title", "shop"):
        ordered = search(index, Request(sort=sort)).orderBy("rank").collect()
        rest = titles(after(index, Request(sort=sort), ordered[1].asDict()))
        assert rest == [r["title"] for r in ordered[2:]], sort


def test_batch_equals_single(index):
    requests = {f"q{n}": Request(t, sort=s, limit=3, offset=o) for n, (t, s, o) in enumerate(
        [("tp4056", "match", 0), ("battery", "title", 0), ("", "price-asc", 1), ("zzz", "match", 0)] * 5)}
    batch = search_batch(index, requests).collect()
    for name, request in requests.items():
        want = [(r["rank"], r["title"], r["total"]) for r in search(index, request).orderBy("rank").collect()]
        assert sorted((r["rank"], r["title"], r["total"]) for r in batch if r["request_id"] == name) == want


def test_deep_pages_of_a_batch_equal_single_ones(index):
    many = index.crossJoin(index.sparkSession.range(500).withColumnRenamed("id", "n")).withColumn(
        "row_number", F.col("row_number") * 1000 + F.col("n")).drop("n")
    requests = {"deep": Request("tp4056", limit=7, offset=1300), "first": Request("tp4056", limit=5), "price": Request("", "price-asc", 2000, 9)}
    batch = search_batch(many, requests).collect()
    for name, request in requests.items():
        want = [(r["rank"], r["title"], r["row_number"], r["total"]) for r in search(many, request).orderBy("rank").collect()]
        assert sorted((r["rank"], r["title"], r["row_number"], r["total"]) for r in batch if r["request_id"] == name) == want and want


def test_requests():
    rates = Rates(1.4, 0.2)
    r = request_from_text("chip min:10 max:2 shop:Big", Request(), rates, "usd")
    assert (r.query, r.min_price, r.max_price, r.shop_filter) == ("chip", pytest.approx(14.0), pytest.approx(70.0), "big")
    assert request_from_text("min:5", Request(min_price=1.0), rates).min_price == 1.0
    assert is_browse(Request()) and not is_browse(Request("x")) and not is_browse(replace(Request(), has_image=True))


def test_price_filter_is_pushed_into_a_stored_index(index, tmp_path, spark):
    path = str(tmp_path / "ix")
    index.write.parquet(path)
    plan = matches(spark.read.parquet(path), Request("ring", min_price=1.0))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(price_value,1.0)" in plan and F is not None
