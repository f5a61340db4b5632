"""Prices, crawl, queue, catalogue, images and vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions.price import Rates
from shelfmark.operators import catalog, crawl, images, prices, queue, vectors as V

RATES = Rates(1.37, 0.19, "bank", "2024-01-02")


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_normalize_prices(spark):
    rows = [("a", "US$1.90", "", "", ""), ("b", "￥5", "US$3", "", ""), ("c", "x", "", "", ""), ("d", "", "", "", ""), ("e", "￥9", "￥8", "", "7")]
    df = spark.createDataFrame(rows, "k string, price string, price_original string, price_currency string, price_original_value string")
    got = by(prices.normalize_prices(df, RATES), "k")
    assert got["a"]["price_value"] == pytest.approx(1.9 * 1.37 / 0.19) and got["a"]["price_original"] == "US$1.90"
    assert got["b"]["price_original_currency"] == "usd" and got["b"]["price_value"] == pytest.approx(21.631579)
    assert got["c"]["price"] == "x" and got["c"]["price_currency"] == "cny" and got["c"]["price_value"] is None
    assert got["d"]["price"] == "" and got["d"]["price_exchange_source"] == "bank"
    assert got["e"]["price"] == "￥7.00" and got["e"]["price_original"] == "￥8"
    again = by(prices.normalize_prices(prices.normalize_prices(df, RATES), RATES), "k")
    assert {k: v["price"] for k, v in again.items()} == {k: v["price"] for k, v in got.items()}
    table = spark.createDataFrame([(1.37, 0.19, "bank", "2024-01-02")], "usd_to_cad double, cny_to_cad double, source string, source_date string")
    assert by(prices.normalize_prices(df, table), "k") == got


def test_rescale_only_named_shops(spark):
    df = spark.createDataFrame([("A", "￥150.00", "150"), ("B", "￥150.00", "150")], "shop string, price string, price_value string")
    got = by(prices.rescale_prices(df, ["A"]), "shop")
    assert (got["A"]["price"], got["A"]["price_value"], got["B"]["price"]) == ("￥1.50", 1.5, "￥150.00")


def test_repairs(spark):
    rows = [(1, "k1", "￥0.00", ""), (2, "k1", "￥0.00", "0"), (3, "k2", "￥5", "5"), (4, "", "￥0.00", ""), (5, "k3", "￥4", "0.0")]
    df = spark.createDataFrame(rows, "n int, offer_id string, price string, price_value string").withColumn("source_url", F.lit("http://x"))
    targets = by(prices.repair_targets(df, ["n"]), "key")
    assert set(targets) == {"k1", "k3", "http://x"}
    fixes = spark.createDataFrame([("k1", "￥2.5", 2.5), ("k2", "￥9", 9.0)], "key string, price string, value double")
    assert set(by(prices.pending_repairs(prices.repair_targets(df, ["n"]), fixes), "key")) == {"k3", "http://x"}
    out = by(prices.apply_repairs(df, fixes, RATES), "n")
    assert out[1]["price"] == "￥2.50" and out[1]["repaired"] and out[3]["price"] == "￥5" and not out[5]["repaired"]
    pages = spark.createDataFrame([("k1", "Product link > ￥3.10"), ("k3", "nothing")], "key string, text string")
    good, bad = prices.prices_from_pages(prices.repair_targets(df, ["n"]), pages)
    assert by(good, "key")["k1"]["price"] == "￥3.1" and set(by(bad, "key")) == {"k3", "http://x"}


OBS = "shop string, stream string, page int, seq int, row_key string, image_url string"


def test_merge_is_order_free(spark):
    rows = [("s", "a", 1, 1, "k", "i1"), ("s", "a", 1, 2, "k", ""), ("s", "a", 2, 3, "j", ""), ("s", "a", 2, 4, "", "x")]
    df = spark.createDataFrame(rows, OBS)
    want = {"k": (2, "i1"), "j": (3, "")}
    for part in (df, df.repartition(3), df.orderBy(F.desc("seq"))):
        got = {k: (v["seq"], v["image_url"]) for k, v in by(crawl.merge_observations(part), "row_key").items()}
        assert got == want
    halves = crawl.partial_merge(df.filter("seq > 1 AND row_key <> ''"), ["shop", "row_key"]).unionByName(
        crawl.partial_merge(df.filter("seq <= 1"), ["shop", "row_key"]))
    assert {k: (v["seq"], v["image_url"]) for k, v in by(crawl.merge_partials(halves, ["shop", "row_key"]), "row_key").items()} == want


def test_progress(spark):
    keys = ["a", "b", "a", "b", "c", "a", "a", "a", "a", "d"]
    df = spark.createDataFrame([("s", "x", n, n, k, "") for n, k in enumerate(keys, 1)], OBS)
    pages = crawl.new_keys_per_page(df)
    assert [r["added"] for r in pages.orderBy("page").collect()] == [1, 1, 0, 0, 1, 0, 0, 0, 0, 1]
    assert [crawl.stop_page(pages, n).first()["stop_page"] for n in (1, 2, 3, 4)] == [3, 4, 8, 9]
    assert crawl.stop_page(pages, 5).isEmpty()
    repeats = crawl.repeated_pages(crawl.page_signatures(df))
    assert sorted((r["page"], r["first_page"]) for r in repeats.collect()) == [(3, 1), (4, 2), (6, 1), (7, 1), (8, 1), (9, 1)]
    assert sorted(r["page"] for r in crawl.checkpoints(df, 4).collect()) == [4, 8, 10]


def test_sequence_number_equals_window(spark):
    df = spark.sql("SELECT id % 3 AS g, timestamp_seconds(1700000000 + (id * 7919) % 9000) AS ts, id FROM range(500)")
    got = crawl.sequence_number(df, ["g"], ["ts", "id"], [F.date_trunc("hour", "ts"), F.date_trunc("second", "ts")], "seq")
    want = spark.sql("SELECT id, row_number() OVER (PARTITION BY id % 3 ORDER BY timestamp_seconds(1700000000 + (id * 7919) % 9000), id) AS seq FROM range(500)")
    assert sorted(map(tuple, got.select("id", "seq").collect())) == sorted(map(tuple, want.collect()))


def test_rate_limits(spark):
    rows = [(1, 0, 200), (2, 100, 429), (3, 219, 200), (4, 220, 200), (5, 239, 403), (6, 358, 200), (7, 359, 200)]
    df = spark.createDataFrame(rows, "n int, s long, code int").select("n", F.timestamp_seconds("s").alias("ts"), F.lit("x").alias("shop"), "code")
    got = crawl.rate_limit_active(df, F.col("code") >= 400)
    assert {r["n"]: r["active"] for r in got.collect()} == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True, 7: False}
    urls = [(429, "x", ""), (403, "https://agent.example.com/a", ""), (403, "https://agent.example.com/a.PNG", ""), (403, "https://o/a", ""), (200, "", "Please Verify")]
    u = spark.createDataFrame([(n, *r) for n, r in enumerate(urls)], "n int, c int, u string, t string")
    assert [r[1] for r in u.select("n", crawl.is_rate_limited("c", "u", "t")).orderBy("n").collect()] == [True, True, False, False, True]
    waits = spark.range(7).select(crawl.backoff(F.col("id") - 1)).collect()
    assert [r[0] for r in waits] == [60, 60, 120, 240, 480, 960, 1200]


def test_plan_crawl(spark):
    urls = spark.createDataFrame([(1, "http://s/shops/a"), (2, "http://s/shops/a?x=1"), (3, "ftp://s"), (4, "http://s/shops/b"), (5, "http://s/shops/c"), (6, "http://s/shops/c")], "pos int, url string")
    saved = spark.createDataFrame([("shops:b",)], "shop_key string")
    queued = spark.createDataFrame([("shops:c",)], "shop_key string")
    assert sorted(r["pos"] for r in crawl.plan_crawl(urls, saved, queued).collect()) == [1]
    assert sorted(r["pos"] for r in crawl.plan_crawl(urls, saved, queued, force=True).collect()) == [1, 4]
    manifests = spark.createDataFrame([("m1", "http://s/shops/b", "Beta"), ("m2", "", "Gamma")], "path string, source_url string, shop_name string")
    asked = spark.createDataFrame([("http://s/shops/b", "x"), ("http://q", "Gamma"), ("http://r", "shop")], "url string, shop_name string")
    assert {k: v["manifest_path"] for k, v in by(crawl.existing_store(asked, manifests), "url").items()} == {"http://s/shops/b": "m1", "http://q": "m2", "http://r": None}


def test_completeness(spark):
    rows = [("a", 10, 1, "", False, "completed"), ("b", 1800, 90, "Next page stopped changing", False, ""), ("c", 5, 1, "", True, ""), ("d", 5, 1, "", False, "checkpoint"), ("e", 0, 1, "", False, "")]
    df = spark.createDataFrame(rows, "k string, row_count int, pages_visited int, completion_reason string, stopped_early boolean, status string")
    got = crawl.usable(df).withColumn("ok", crawl.is_complete())
    assert {r["k"]: r["ok"] for r in got.collect()} == {"a": True, "b": False, "c": False}
    tabs = spark.createDataFrame([("s", 0, "All"), ("s", 1, "x"), ("s", 2, "All"), ("s", 3, "x"), ("s", 4, "y")], "shop string, pos int, label string")
    assert [r["label"] for r in crawl.categories(tabs).orderBy("place").collect()] == ["x", "y"]


def test_queue(spark):
    events = spark.createDataFrame([("a", "queued", 1), ("b", "queued", 2), ("a", "running", 3), ("c", "queued", 4), ("c", "error", 5)], "item_id string, status string, seq long").withColumn("ts", F.lit("t"))
    items = queue.queue_state(events)
    assert queue.queue_status(items).first().asDict() == {"busy": True, "active_item_id": "a", "queue_length": 1, "items": 3}
    assert by(queue.queue_state(events, restarted=True), "item_id")["a"]["status"] == "queued"
    full = items.withColumns({"url": F.lit("u"), "retry_count": F.lit(1)})
    again = queue.retry(full, ["a", "c"]).collect()
    assert [(r["retried_from_item_id"], r["retry_count"], r["status"]) for r in again] == [("c", 2, "queued")]


def test_catalog(spark):
    names = spark.createDataFrame([(1, 0, "agent shop"), (1, 1, "Lumen"), (1, 2, "Lumens/x"), (1, 3, "Lumens:y"), (2, 0, "shop"), (3, 0, "")], "g int, pos int, name string")
    assert {k: v["shop_name"] for k, v in by(catalog.best_name(names, ["g"], "name", "pos"), "g").items()} == {1: "Lumens_x", 2: "shop", 3: "Agent Shop"}
    own = spark.createDataFrame([("A", "favorite"), ("B", "disabled")], "shop string, kind string")
    new = spark.createDataFrame([("C", "favorite"), ("D", "disabled")], "shop string, kind string")
    assert sorted(map(tuple, catalog.merge_prefs(own, new).collect())) == [("A", "favorite"), ("C", "favorite"), ("D", "disabled")]


def test_images(spark):
    rows = [("1", "s/m.csv", "a.jpg", "images/./z.jpg", "u"), ("2", "s/m.csv", "b.jpg", "", "u"), ("3", "s/agent_shop_x.csv", "c.jpg", "", "u"), ("4", "s/m.csv", "", "", "u")]
    df = spark.createDataFrame(rows, "id string, source_file string, image_file string, zip_path string, image_src string")
    files = spark.createDataFrame([("s/images/z.jpg",), ("s/images/a.jpg",), ("images/b.jpg",), ("s/agent_shop_images_x/images/c.jpg",)], "path string")
    got = by(images.resolve_images(df, files), "id")
    assert [got[i]["image_path"] for i in "1234"] == ["s/images/z.jpg", "images/b.jpg", "s/agent_shop_images_x/images/c.jpg", ""]
    assert got["1"]["image_src"] == "" and got["4"]["image_src"] == "u"


def unit(n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 8))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("blocks", [False, True])
def test_knn(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(V, "BROADCAST_NUMBERS", 8)
        monkeypatch.setattr(V, "VECTOR_BLOCK", 40)
        monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    data, asked = unit(150, 1), unit(7, 2)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<float>")
    got = V.knn_batch(vectors, queries, 4).orderBy("query_id", "rank").collect()
    want = [(q, int(i)) for q, v in enumerate(asked) for i in np.argsort(-(data @ v))[:4]]
    assert [(r["query_id"], r["id"]) for r in got] == want
    subset = spark.createDataFrame([(1,), (2,), (999,), (2,)], "id long")
    assert {r["id"] for r in V.knn(vectors, asked[0].tolist(), 5, subset).collect()} == {1, 2}
    assert V.knn(vectors, asked[0].tolist(), 5, subset.limit(0)).count() == 5
    assert V.knn(vectors, asked[0].tolist(), 0).isEmpty()
    many = spark.range(2600).select("id", F.array(F.cos(F.col("id") % 7), F.sin(F.col("id") % 7)).alias("embedding")).repartition(5)
    got = V.knn(many, [1.0, 0.0], 2500).orderBy("rank").collect()
    assert len(got) == 2500 and [(r["score"], -r["id"]) for r in got] == sorted(((r["score"], -r["id"]) for r in got), reverse=True)


def test_refresh_vectors(spark):
    schema = "vector_key string, id string, path string, size long, mtime long"
    now = spark.createDataFrame([("k1", "1", "a", 1, 1), ("k2", "2", "b", 1, 1)], schema)
    cache = spark.createDataFrame([("k1", [1.0, 0.0])], "vector_key string, embedding array<float>")
    out = V.refresh_vectors(now, cache, lambda paths: [[0.0, 2.0] for _ in paths])
    got = by(out, "vector_key")
    assert got["k1"]["embedding"] == [1.0, 0.0] and got["k2"]["embedding"] == [0.0, 1.0]
    assert V.vector_stats(out).first().asDict() == {"total": 2, "reused": 1, "encoded": 1}
    assert V.vectors_stale(now, cache) and not V.vectors_stale(now.limit(1).filter("vector_key = 'k1'"), cache)


def test_near_hashes_equal_a_full_comparison(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-2**63, 2**63 - 1, 40)
    hashes = [int(h) for h in base] + [0, -1, 1, 3]
    for h in base:
        for bits in (1, 3, 6, 9):
            turned = int(h) & (2**64 - 1)
            for b in rng.choice(64, bits, replace=False):
                turned ^= 1 << int(b)
            hashes.append(turned - 2**64 if turned >= 2**63 else turned)
    df = spark.createDataFrame([(h,) for h in hashes + hashes[:5]] + [(None,)], "hash long")
    for distance in (0, 3, 6, 9):
        expected = {(a, b): bin((a ^ b) & (2**64 - 1)).count("1") for a in set(hashes) for b in set(hashes) if a < b}
        expected = {p: d for p, d in expected.items() if d <= distance}
        found = images.near_hashes(df, distance).collect()
        assert {(r.hash_a, r.hash_b): r.distance for r in found} == expected and len(found) == len(expected)
        assert all(r.images_a == 1 + (r.hash_a in hashes[:5]) for r in found)
