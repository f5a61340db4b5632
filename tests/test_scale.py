"""Steps whose cost must stay in proportion: what their plans read, move and compare."""

from pyspark.sql import functions as F

from shelfmark.functions.price import Rates
from shelfmark.operators import postings as IX, prices, vectors as V
from shelfmark.functions.text import _SPACES, clean_text, is_filled, normalize_search, strip_marks
from shelfmark.operators.images import near_hashes
from shelfmark.operators.listings import index_listings, normalize_listings
from shelfmark.operators.scoring import order_keys, sort_rich
from shelfmark.plans import fixtures
from shelfmark.plans.search import Request, is_match, matches, search, search_batch
from shelfmark.sources import sinks, tabular

RATES = Rates(1.37, 0.19, "fixture", "2024-01-02")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_csv_reads_the_columns_that_headers_have(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"a, ""b""\nc",n\n1,"x,\ny",2,9,9,9\n3\n', "utf-8")
    (tmp_path / "b.csv").write_text("id\n7\n", "utf-8")
    rows = tabular.read_listing_csv(spark, str(tmp_path))
    found = {(r["source_file"], r["row_number"]): r["fields"] for r in rows.collect()}
    assert found == {("a.csv", 1): {"id": "1", 'a, "b"\nc': "x,\ny", "n": "2"}, ("a.csv", 2): {"id": "3", 'a, "b"\nc': None, "n": None},
                     ("b.csv", 1): {"id": "7"}}
    assert "c3#" in plan(rows) and "c4#" not in plan(rows)


def test_csv_tables_become_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "CSV_ROWS", 4)
    sinks.write_listing_csv(spark.range(10).coalesce(1).select(F.col("id").cast("string").alias("title")), f"{tmp_path}/out")
    rows = tabular.read_listing_csv(spark, f"{tmp_path}/out")
    assert rows.select("source_file").distinct().count() == 3
    assert sorted(r[0] for r in rows.select(F.col("fields")["title"]).collect()) == sorted(map(str, range(10)))


def test_good_prices_are_not_joined_with_repairs(spark):
    df = spark.createDataFrame([("1", "￥5", 5.0), ("2", "￥0.00", 0.0), ("3", "", None), ("4", "￥7", 7.0)], "offer_id string, price string, price_value double")
    fixes = spark.createDataFrame([("2", "￥9", 9.0), ("4", "￥1", 1.0)], "key string, price string, value double")
    out = prices.apply_repairs(df, fixes, RATES)
    got = {r["offer_id"]: (r["repaired"], r["price"], r["price_value"]) for r in out.collect()}
    assert got == {"1": (False, "￥5", 5.0), "2": (True, "￥9.00", 9.0), "3": (False, "", None), "4": (False, "￥7", 7.0)}
    assert "Union" in plan(out)


def test_rich_order_compares_columns(spark):
    rows = spark.createDataFrame([("a", "s2", "T 10", 1.0), ("b", "s10", "t 9", 2.0)], "id string, shop string, title string, price_value double")
    for sort, first in (("title", "b"), ("shop", "a"), ("price-asc", "a")):
        found = sort_rich(rows, sort)
        assert [r["id"] for r in found.collect()][0] == first and found.columns == rows.columns
        order = next(line for line in plan(found).splitlines() if "Sort [" in line)
        assert "regexp" not in order


def test_listings_are_dealt_by_part_once(spark, tmp_path):
    spark.sql("SELECT 1L AS l_partkey, 1L AS l_suppkey UNION ALL SELECT 1L, 1L UNION ALL SELECT 1L, 2L UNION ALL SELECT 2L, null").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 1L AS p_partkey, 'n' AS p_name, 't' AS p_type, 'b' AS p_brand, 3 AS p_size, 9.5D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("SELECT id AS s_suppkey, concat('S', id) AS s_name FROM range(3)").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = fixtures.raw_listings(spark, str(tmp_path))
        assert sorted((r["shop"], r["sales"]) for r in df.collect()) == [("S1", "2"), ("S2", "1")]
        moved = [line for line in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines() if "Exchange hashpartitioning(l_partkey" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(moved) == 1 and "l_suppkey" not in moved[0].split(")")[0]


def test_turned_hashes_are_not_broadcast(spark):
    rows = spark.createDataFrame([(5,), (5,), (4,), (-1,), (None,)], "hash long")
    found = near_hashes(rows, 6)
    assert [tuple(r) for r in found.collect()] == [(4, 5, 1, 1, 2)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_listing_code_is_small_enough_to_be_compiled(spark, tmp_path):
    spark.sql("SELECT 'S' AS shop, 'f' AS source_file, 1L AS row_number, '' AS offer_id, ' T  1' AS title, '5' AS price, '1' AS sales,"
              " 'https://detail.1688.com/offer/123456.html' AS source_url, '' AS agent_url, 'i.jpg' AS image_file").write.parquet(f"{tmp_path}/raw")
    rows = normalize_listings(spark.read.parquet(f"{tmp_path}/raw"))
    df = index_listings(rows).select("offer_id", "shop", "title", "price_value", "source_file", "row_number", "_blob", "_compact")
    assert df.select("offer_id", "title", "price_value").collect() == [("123456", "T 1", 5.0)]
    code = df._jdf.queryExecution().debug().codegenToSeq()
    # The JVM leaves methods above 8,000 bytes to its interpreter.
    assert max(code.apply(n)._3().maxMethodCodeSize() for n in range(code.size())) < 8000


def test_filled_texts_and_plain_texts(spark):
    df = spark.createDataFrame([(t,) for t in ("", None, " ", "\t\u3000 ", "a", " é ", "\x00", "\u2028x", "Åx")], "t string")
    rows = df.select("t", (clean_text("t") != "").alias("a"), is_filled("t").alias("b"), strip_marks("t").alias("s")).collect()
    assert all(r["a"] == r["b"] for r in rows)
    assert [r["s"] for r in rows] == ["", None, " ", "\t  ", "a", " e ", "\x00", "\u2028x", "Ax"]


def test_counted_matches_are_the_scored_ones(spark):
    rows = spark.createDataFrame([(n, t, "o1", t, t.replace(" ", ""), t.replace(" ", ""), "o1", t) for n, t in enumerate(
        ("hot ring", "ring", "pn 7x a", "pn7x", "gear bolt"))], "id long, _title string, _offer string, _blob string, _compact string,"
        " _title_compact string, _offer_compact string, _raw_title string")
    for text in ("", "ring", "ring !hot", "pn7x OR gear bolt", "!ring", "boltz", "ri ng"):
        scored = sorted(r["id"] for r in matches(rows, Request(text)).collect())
        assert scored == sorted(r["id"] for r in rows.filter(is_match(text)).collect())


def test_classes_of_characters_hold_all_they_held(spark):
    chars = [chr(n) for n in range(1, 0x3100)] + ["\U0001f600", "￿", "﻿"]
    df = spark.createDataFrame([(f"a{c}{c}  b {c}",) for c in chars] + [(c,) for c in chars], "t string")
    spelled = F.replace(F.lower("t"), F.lit("&"), F.lit(" and "))
    plain = F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))
    collapsed = F.trim(F.regexp_replace("t", _SPACES, " "))
    assert df.filter((normalize_search("t") != plain) | (clean_text("t") != collapsed)).isEmpty()
    assert "[^a-z0-9]" not in plan(df.select(normalize_search("t")))


def index_rows(spark, path):
    """Listings with search columns: two rows hold rings, one of them twice."""
    spark.sql("SELECT shop, 'f' AS source_file, n AS row_number, cast(n AS string) AS offer_id, title, price FROM VALUES ('A', 1L, 'hot ring', '5'),"
              " ('A', 2L, 'Ring  red', '7'), ('A', 2L, 'Ring  red', '7'), ('B', 3L, 'gear\tbox', ''), (null, 4L, 'bolt ', '1')"
              " AS t(shop, n, title, price)").write.parquet(path)
    return index_listings(normalize_listings(spark.read.parquet(path)))


def test_a_search_reads_its_rows_once(spark, tmp_path):
    index = index_rows(spark, f"{tmp_path}/raw")
    for request in (Request("ring"), Request("ring", sort="price-desc", offset=1, limit=1), Request("ring OR bolt !hot", limit=2), Request("zzzz")):
        found = search(index, request)
        many = matches(index, request).count()
        start, size = request.page()
        rows = found.collect()
        assert [r["rank"] for r in rows] == list(range(start + 1, min(many, start + size) + 1))
        assert all(r["total"] == many for r in rows)
        assert "_many" in plan(found) and found.columns == [*index.columns, "score", "rank", "total"]
    # Where all rows match, counting them needs no texts.
    assert "_many" not in plan(search(index, Request("")))


def test_a_batch_reads_its_rows_once(spark, tmp_path):
    index = index_rows(spark, f"{tmp_path}/raw")
    found = search_batch(index, {"a": Request("ring", limit=1), "b": Request("", sort="price-asc", limit=2, offset=1), "c": Request("zzzz")})
    got = sorted((r["request_id"], r["rank"], r["total"], r["offer_id"]) for r in found.collect())
    assert got == [("a", 1, 3, "1"), ("b", 2, 5, "1"), ("b", 3, 5, "2")]
    assert plan(found).count("Relation [") == 1 and "Join" not in plan(found)


def test_texts_of_a_row_are_tested_together(spark, tmp_path):
    spark.sql("SELECT 'S' AS shop, 'f' AS source_file, n AS row_number, title, price, sales, 'u' AS source_url FROM VALUES"
              " (1L, ' a\tb  c ', '5', '1'), (2L, 'tidy', '  6 ', null), (3L, 'x\u3000y', '7', ' '), (4L, null, '8  9', '2')"
              " AS t(n, title, price, sales)").write.parquet(f"{tmp_path}/raw")
    rows = normalize_listings(spark.read.parquet(f"{tmp_path}/raw"))
    got = sorted((r["row_number"], r["title"], r["price_text"], r["sales"]) for r in rows.collect())
    assert got == [(1, "a b c", "5", "1"), (2, "tidy", "6", ""), (3, "x y", "7", ""), (4, "(untitled listing)", "8 9", "2")]
    assert plan(rows).count(r"RLIKE [\x00-\x1f]") + plan(rows).count(r"[\x00-\x1f])") <= 2


def test_postings_of_some_fields(spark):
    names = [f"_{f}_tokens" for f in ("title", "offer", "shop", "blob", "part")]
    index = spark.createDataFrame([("i", ["a"], ["b"], ["c"], ["a", "b"], None)], "id string, " + ", ".join(f"{n} array<string>" for n in names))
    every = IX.build_postings(index)
    some = IX.build_postings(index, "title", "part")
    assert sorted(some.collect()) == sorted(every.filter("field IN ('title', 'part')").collect()) and some.count() == 1
    assert "_blob_tokens" not in plan(some.select("token")).split("LogicalRDD")[0]


def test_known_vectors_take_one_join(spark):
    rows = spark.createDataFrame([("k1", "1", "p1", 1, 1), ("k2", "2", "p2", 1, 1), (None, "3", "p3", 1, 1), ("k1", "4", "p4", 1, 1)],
                                 "vector_key string, id string, path string, size long, mtime long")
    cache = spark.createDataFrame([("k1", [1.0]), ("k1", [1.0]), (None, [2.0])], "vector_key string, embedding array<float>")
    found = V.refresh_vectors(rows, cache, lambda paths: [[3.0]] * len(paths))
    assert sorted((r["id"], r["embedding"], r["reused"]) for r in found.collect()) == [
        ("1", [1.0], True), ("2", [1.0], False), ("3", [1.0], False), ("4", [1.0], True)]
    assert "LeftAnti" not in plan(found)


def test_lists_sorted_twice_make_their_keys_once(spark, tmp_path):
    rows = [("b", "Écran 10", "s2"), ("a", "ecran 9", "s10"), ("c", None, "s2"), ("c", None, "s2"), (None, "x", None)]
    df = spark.createDataFrame(rows, "id string, title string, shop string").withColumns(
        {"price_value": F.lit(1.0), "score": F.lit(2.0), "exact_terms": F.lit(0), "title_terms": F.lit(0)})
    order_keys(df).write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    for sort in ("match", "title", "shop", "price-asc"):
        found = sort_rich(kept, sort)
        assert [r[:3] for r in found.collect()] == [r[:3] for r in sort_rich(df, sort).collect()]
        assert "regexp_extract_all" not in plan(found) and sort_rich(df, sort).columns == df.columns
