"""File formats, the index build, sinks and streams, on files written by the test."""

import base64
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.price import Rates
from shelfmark.operators.crawl import checkpoints, merge_observations
from shelfmark.operators.listings import index_listings, normalize_listings
from shelfmark.operators.queue import queue_state
from shelfmark.plans.index_build import build_index, load_sources, normalize_all
from shelfmark.sources import files, html, manifest, sinks, state, tabular
from shelfmark.streaming import ingest
from shelfmark.streaming.state import add_pages, due_pages, queue_state_stream, rate_limit_windows

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, rows, shared):
    def cell(ref, value):
        if value in shared:
            return f'<c r="{ref}" t="s"><v>{shared.index(value)}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>' if value else f'<c r="{ref}"/>'

    body = "".join(
        f"<row>{''.join(cell(f'{chr(65 + c)}{r}', v) for c, v in enumerate(row))}</row>" for r, row in enumerate(rows, 1))
    strings = "".join(f"<si><t>{s[:2]}</t><t>{s[2:]}</t></si>" for s in shared)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="a" sheetId="1" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId9" Target="worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("data")
    for d in ("Alpha/images", "Beta", "scraped data/Gamma", "src"):
        (r / d).mkdir(parents=True)
    rows = [{"title": "one", "price": "US$2", "price_value": 0, "image_file": "x/a.jpg", "offer_id": 11}, "text", 5,
            {"Title": "two", "Price Value": "0", "source_url": "http://h/offer/22.html"}, {}]
    (r / "Alpha/manifest.json").write_text(json.dumps({"shop_name": "Alpha", "source_url": " http://s/shops/a ", "rows": rows}))
    (r / "Alpha/ignored.csv").write_text("title\nno\n")
    (r / "Alpha/images/a.jpg").write_bytes(b"x")
    (r / "Beta/t.csv").write_text('﻿Title,Price,extra\n"line\nbreak ""q""",￥3,z\nshort\nlong,1,2,3,4\n', encoding="utf-8")
    (r / "Beta/u.csv").write_text("price,title,offer_id\n￥4,four,44\n", encoding="utf-8")
    workbook(r / "Beta/w.xlsx", [["Title", "", "Price"], ["five", "", "￥5"], ["", "", ""], ["six"]], ["Title", "five", "six"])
    (r / "Beta/bad.xlsx").write_bytes(b"not a zip")
    (r / "scraped data/Gamma/manifest.json").write_text('{"rows": [{"title": "cut')
    (r / "loose.csv").write_text("title\nfree\n")
    (r / "src/manifest.json").write_text('{"rows": [{"title": "system"}]}')
    return str(r)


def test_discovery(spark, root):
    found = files.apply_precedence(files.discover_sources(spark, root))
    got = {r["path"]: (r["kind"], r["shop"]) for r in found.collect()}
    assert got == {
        "Alpha/manifest.json": ("manifest", "Alpha"), "Beta/t.csv": ("table", "Beta"), "Beta/u.csv": ("table", "Beta"),
        "Beta/w.xlsx": ("table", "Beta"), "Beta/bad.xlsx": ("table", "Beta"), "loose.csv": ("table", "workspace"),
        "scraped data/Gamma/manifest.json": ("manifest", "Gamma")}


def test_load_and_build(spark, root):
    rows, errors, manifests = load_sources(spark, root)
    assert {r["source_file"] for r in errors.collect()} == {"scraped data/Gamma/manifest.json", "Beta/bad.xlsx"}
    got = {(r["source_file"], r["row_number"]): r["fields"] for r in rows.collect()}
    # Objects only are numbered; numeric zero is empty, the text "0" is not.
    assert got["Alpha/manifest.json", 1]["price_value"] == "" and got["Alpha/manifest.json", 1]["offer_id"] == "11"
    assert got["Alpha/manifest.json", 2]["Price Value"] == "0" and got["Alpha/manifest.json", 3] == {}
    assert got["Beta/t.csv", 1] == {"Title": 'line\nbreak "q"', "Price": "￥3", "extra": "z"}
    assert got["Beta/t.csv", 2]["Price"] is None and got["Beta/t.csv", 3]["extra"] == "2"
    assert got["Beta/u.csv", 1] == {"price": "￥4", "title": "four", "offer_id": "44"}
    assert got["Beta/w.xlsx", 1] == {"Title": "five", "column_2": "", "Price": "￥5"}
    assert got["Beta/w.xlsx", 2] == {"Title": "six", "column_2": "", "Price": ""}
    listings = {r["title"]: r for r in build_index(spark, root).collect()}
    assert set(listings) == {"one", "two", 'line break "q"', "short", "long", "four", "five", "six", "free"}
    assert listings["one"]["image_path"] == "Alpha/images/a.jpg" and listings["one"]["price_value"] == 2.0
    assert listings["two"]["offer_id"] == "22" and listings["two"]["price_value"] == 0.0
    priced = normalize_all(spark, root, Rates(1.4, 0.2), ["title", "offer_id"])
    assert {r["price_value"] for r in priced.filter("title = 'four'").collect()} == {4.0}
    assert manifest.manifest_info(manifests).first()["shop_key"] == "shops:a"


def test_api_rates_and_data_urls(spark):
    body = json.dumps({"data": {"records": [{"itemId": 5, "subject": " T ", "price": 1500, "imgUrl": "http://i/x.png", "detailUrl": "http://d/1"}, "x", {"url": "http://d/offer/7.html", "name": "N", "promotionPrice": "US$2"}]}})
    pages = spark.createDataFrame([(1, body)], "page int, body string")
    got = {r["title"]: r for r in manifest.rows_from_api(manifest.explode_api_pages(pages).drop("body")).collect()}
    assert (got["T"]["offer_id"], got["T"]["price"], got["T"]["image_file"]) == ("5", "￥15.00", "5.png")
    assert (got["N"]["offer_id"], got["N"]["price_currency"]) == ("7", "usd")
    obs = [{"d": "2024-01-03", "FXUSDCAD": {"v": "1.40"}}, {"d": "2024-01-02", "FXUSDCAD": {"v": "1.30"}, "FXCNYCAD": {"v": "0.20"}}, {"d": "2024-01-04", "FXCNYCAD": {"v": ""}}]
    doc = spark.createDataFrame([([json.dumps(o) for o in obs],)], "observations array<string>")
    rate = manifest.latest_rates(doc).first()
    assert (rate["usd_to_cad"], rate["cny_to_cad"], rate["source_date"]) == (1.3, 0.2, "2024-01-02")
    data = spark.createDataFrame([("data:image/png;base64," + base64.b64encode(b"hi").decode(),), ("data:text/plain,a%20b+",), ("http://x",), ("data:image/png;base64,@",)], "u string")
    decoded = files.decode_data_urls(data, "u")
    assert [r["image_bytes"] for r in decoded.collect()][:3] == [bytearray(b"hi"), bytearray(b"a b+"), None]
    assert files.decode_report(decoded).first().asDict() == {"saved": 2, "skipped": 2}


def test_cards(spark):
    link = "/products?productLink=https%253A%252F%252Fd%252Foffer%252F9.html"
    page = f"""<a class="x" href="/no">n</a><a class="goods-item big" href="{link}"><div class="img-wrap" style="background: url('bg.png')">
      <img data-src="i.webp"></div><p class=title>Red &amp; <b>blue</b></p><i class="price">￥ 3</i><span class="num">12 sold</span></a>
      <a class="goods-item" href="{link}x">Plain text<img srcset="s1.png 1x, s2.png 2x"></a><a class="goods-item" href="/other">o</a>"""
    rows = html.extract_cards(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).orderBy("pos").collect()
    assert len(rows) == 2
    first, second = rows
    assert (first["title"], first["price"], first["sales"], first["image_url"], first["offer_id"]) == ("Red & blue", "￥ 3", "12 sold", "i.webp", "9")
    assert first["source_url"] == "https://d/offer/9.html" and first["image_file"] == "9.jpg"
    assert (second["title"], second["image_url"]) == ("Plain text", "s1.png")


def listing_rows(spark, n=25):
    return spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") < 20, "Big").otherwise("Small").alias("shop"),
        F.concat(F.lit('t "'), F.col("id").cast("string")).alias("title"), F.lit("￥1").alias("price"), F.lit("").alias("error"))


def test_sinks(spark, tmp_path):
    rows = listing_rows(spark)
    sinks.write_listing_csv(rows.withColumn("extra", F.lit("e")), f"{tmp_path}/csv")
    back = tabular.read_listing_csv(spark, f"{tmp_path}/csv").collect()
    columns = sinks.listing_table(rows.withColumn("extra", F.lit("e"))).columns
    assert columns[:2] == ["offer_id", "title"] and columns[15:] == ["image_file", "id", "shop", "error", "extra", "zip_path", "saved"]
    assert len(back) == 25 and set(back[0]["fields"]) == set(columns)
    assert back[0]["fields"]["title"].startswith('t "') and back[0]["fields"]["extra"] == "e"
    meta = spark.createDataFrame([("Big", "http://s/shops/b", "completed"), ("Small", "", "checkpoint")], "shop string, source_url string, status string")
    sinks.write_manifests(rows, meta, Rates(1.4, 0.2, "bank", "d"), f"{tmp_path}/m", per_manifest=8)
    docs = manifest.read_manifest_files(spark, f"{tmp_path}/m", glob="*.txt", multi_line=False)
    info = manifest.manifest_info(docs).collect()
    assert sum(r["row_count"] for r in info) == 25 and len([r for r in info if r["shop_name"] == "Big"]) > 1
    assert {r["status"] for r in info} == {"completed", "checkpoint"} and docs.first()["price_exchange_source"] == "bank"
    assert {r["fields"]["title"] for r in manifest.manifest_rows(docs).collect()} == {r["title"] for r in rows.collect()}


def test_index_versions(spark, tmp_path):
    path = f"{tmp_path}/ix"
    assert sinks.load_index(spark, path) is None
    raw = listing_rows(spark).select("shop", F.lit("f").alias("source_file"), F.col("id").cast("long").alias("row_number"), "title", "price")
    index = index_listings(normalize_listings(raw))
    assert sinks.save_index(index, path) == 1 and sinks.load_index(spark, path).count() == 25
    assert sinks.drop_shop(spark, path, "Big") == 2 and sinks.load_index(spark, path).count() == 5
    assert sinks.load_index(spark, path, "usd") is None
    assert sinks.save_index(index.drop("_blob"), path) == 3 and sinks.load_index(spark, path) is None


def test_stored_index_is_narrow_and_whole(spark, tmp_path):
    raw = listing_rows(spark).select("shop", F.lit("f").alias("source_file"), F.col("id").cast("long").alias("row_number"), "title", "price")
    listings = normalize_listings(raw)
    index = index_listings(listings)
    for n, df in enumerate((index, listings)):
        path = f"{tmp_path}/ix{n}"
        sinks.save_index(df, path)
        # What follows from other columns is neither dealt nor stored, and there again when the index is loaded.
        assert not {"_compact", "_tokens", "_raw_title", "_title_tokens"} & set(spark.read.parquet(f"{path}/data/version=1").columns)
        loaded = sinks.load_index(spark, path)
        assert loaded.columns == index.columns
        assert sorted(map(str, loaded.collect())) == sorted(map(str, index.collect()))
        sinks.drop_shop(spark, path, "Big")
        left = sinks.load_index(spark, path)
        assert sorted(map(str, left.collect())) == sorted(map(str, index.filter("shop <> 'Big'").collect()))


def test_state(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"favorites": ["b", " a", "b"], "disabled": "x"}))
    q = tmp_path / "q.json"
    q.write_text(json.dumps({"items": [{"id": "1", "url": "u", "status": "running"}, {"id": "", "url": "u"}, {"id": "2", "url": "v"}]}))
    bad = tmp_path / "bad.json"
    bad.write_text("{oops")
    r = tmp_path / "r.json"
    r.write_text(json.dumps({"prices": {"k": {"price": "￥1", "value": 1}}, "failures": {"j": "no", "k2": "no"}}))
    assert [(x["item_id"], x["status"]) for x in state.read_queue(spark, str(q)).orderBy("enqueued").collect()] == [("1", "queued"), ("2", "queued")]
    assert state.read_prefs(spark, str(bad)).isEmpty() and state.read_prefs(spark, str(tmp_path / "none")).isEmpty()
    prefs = spark.createDataFrame([(" b", "favorite"), ("A", "favorite"), ("b", "favorite")], "shop string, kind string")
    sinks.save_prefs(prefs, f"{tmp_path}/prefs")
    assert [x["shop"] for x in sinks.prefs_rows(state.load_prefs(spark, f"{tmp_path}/prefs")).collect()] == ["A", "b"]
    prices, failures = state.read_repairs(spark, str(r))
    new = spark.createDataFrame([("j", "￥2", 2.0)], "key string, price string, value double")
    merged, failed = sinks.merge_repair_cache(prices, new, failures, failures.limit(0))
    assert {x["key"] for x in merged.collect()} == {"k", "j"} and {x["key"] for x in failed.collect()} == {"k2"}


def test_stream_listings(spark, tmp_path):
    src = tmp_path / "in/Shop"
    src.mkdir(parents=True)
    (src / "manifest.json").write_text(json.dumps({"rows": [{"title": "old"}, {"title": "gone"}]}))
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"
    ingest.stream_listings(spark, f"{tmp_path}/in", out, ck).awaitTermination(60)
    assert {r["title"] for r in ingest.streamed_index(spark, out).collect()} == {"old", "gone"}
    other = tmp_path / "in/Other"
    other.mkdir()
    (other / "manifest.json").write_text(json.dumps({"rows": [{"title": "new"}]}))
    ingest.stream_listings(spark, f"{tmp_path}/in", out, ck).awaitTermination(60)
    got = ingest.streamed_index(spark, out)
    assert {(r["shop"], r["title"]) for r in got.collect()} == {("Shop", "old"), ("Shop", "gone"), ("Other", "new")}
    assert ingest.compact(spark, out, ingest.latest_files) == 1
    assert ingest.streamed_index(spark, out).count() == 3
    assert ingest.compact(spark, out, ingest.latest_files) == 1  # nothing new: nothing is written
    assert ingest.streamed_index(spark, out).count() == 3


def test_batch_that_arrives_during_compaction_stays_in_the_log(spark, tmp_path):
    def append(batch, *ids):
        spark.createDataFrame([(i,) for i in ids], "id long").write.parquet(f"{tmp_path}/log/batch={batch}")

    def merge(rows):
        append(2, 30)  # arrives after the last batch was looked up
        return rows.distinct()

    append(0, 10, 10)
    append(1, 20)
    assert ingest.compact(spark, str(tmp_path), merge) == 1
    assert sorted(r["id"] for r in ingest.read_log(spark, str(tmp_path)).collect()) == [10, 20, 30]
    assert ingest.compact(spark, str(tmp_path), lambda rows: rows) == 2
    assert sorted(r["id"] for r in ingest.read_log(spark, str(tmp_path)).collect()) == [10, 20, 30]


def test_stream_merge_equals_batch(spark, tmp_path):
    schema = "shop string, row_key string, seq long, image_url string, ts timestamp"
    rows = [("s", f"k{n % 7}", n, "" if n % 3 else f"i{n}") for n in range(60)]
    df = spark.createDataFrame(rows, "shop string, row_key string, seq long, image_url string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 40))
    df.repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    ingest.stream_merge(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(90)
    want = {(r["row_key"], r["seq"], r["image_url"]) for r in merge_observations(df).collect()}
    assert {(r["row_key"], r["seq"], r["image_url"]) for r in ingest.merged(spark, f"{tmp_path}/out").collect()} == want
    result = lambda: {(r["row_key"], r["seq"], r["image_url"]) for r in ingest.merged(spark, f"{tmp_path}/out").collect()}
    assert ingest.compact_merge(spark, f"{tmp_path}/out") == ingest.compact_merge(spark, f"{tmp_path}/out")
    assert result() == want
    more = [("s", f"k{n % 9}", n, "" if n % 4 else f"j{n}") for n in range(60, 80)]
    later = spark.createDataFrame(more, "shop string, row_key string, seq long, image_url string").withColumn("ts", F.lit(None).cast("timestamp"))
    later.write.mode("append").parquet(f"{tmp_path}/in")
    ingest.stream_merge(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(90)
    want = {(r["row_key"], r["seq"], r["image_url"]) for r in merge_observations(df.unionByName(later)).collect()}
    assert result() == want
    ingest.compact_merge(spark, f"{tmp_path}/out")
    assert result() == want
    windows = rate_limit_windows(df.withColumnRenamed("shop", "shop"), F.col("image_url") != "")
    assert windows.filter("active").count() > 0


def test_queue_stream_equals_batch(spark, tmp_path):
    rows = [(f"i{n % 5}", ["queued", "running", "completed"][n % 3], n) for n in range(40)]
    df = spark.createDataFrame(rows, "item_id string, status string, seq long")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = queue_state_stream(stream).writeStream.outputMode("update").format("memory").queryName("queue_out").option(
        "checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    # Timeouts keep the query going after all data is read.
    query.awaitTermination(40)
    query.stop()
    last = spark.sql("SELECT item_id, max_by(status, seq) AS status, max(seq) AS seq, max(events) AS events FROM queue_out GROUP BY item_id")
    want = {(r["item_id"], r["status"], r["seq"]) for r in queue_state(df.withColumn("ts", F.lit(""))).collect()}
    assert {(r["item_id"], r["status"], r["seq"]) for r in last.collect()} == want and {r["events"] for r in last.collect()} == {8}


def test_finished_queue_items_leave_the_state():
    from shelfmark.streaming.state import _advance

    class State:
        def __init__(self, value=None, timed_out=False):
            self.value, self.hasTimedOut, self.timeout, self.removed = value, timed_out, None, False

        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def update(self, value):
            self.value = value

        def setTimeoutDuration(self, ms):
            self.timeout = ms

        def remove(self):
            self.removed = True

    import pandas as pd

    going, done = State(), State()
    list(_advance(("a",), iter([pd.DataFrame({"item_id": ["a"], "status": ["running"], "seq": [1]})]), going, 5))
    list(_advance(("a",), iter([pd.DataFrame({"item_id": ["a"], "status": ["completed"], "seq": [2]})]), done, 5))
    assert going.timeout is None and done.timeout == 5
    late = State(done.value, timed_out=True)
    assert list(_advance(("a",), iter([]), late, 5)) == [] and late.removed


def test_checkpoint_marks_equal_batch_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(shop, tab, page, n) for shop in "ab" for tab, pages in (("x", range(1, 12)), ("y", range(12, 17)), ("z", [20, 21, 23, 27, 28]))
            for page in pages for n in range(2)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "shop string, stream string, page long, n int")
    df.repartition(7).write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest.stream_checkpoints(arriving, f"{tmp_path}/out", f"{tmp_path}/ck", every=3).awaitTermination(120)
    want = {tuple(r) for r in checkpoints(df, 3).select("shop", "stream", "page").collect()}
    assert {tuple(r) for r in ingest.checkpoint_pages(spark, f"{tmp_path}/out").collect()} == want
    assert {p for s, t, p in want if (s, t) == ("a", "y")} == {14, 16} and {p for s, t, p in want if (s, t) == ("a", "x")} == {3, 6, 9, 11}


def test_runs_of_pages():
    rng = random.Random(5)
    for _ in range(200):
        pages = [rng.randint(1, 30) for _ in range(rng.randint(1, 25))]
        starts, ends = [], []
        for at in range(0, len(pages), 4):
            starts, ends = add_pages(starts, ends, pages[at:at + 4])
        assert [p for s, e in zip(starts, ends, strict=True) for p in range(s, e + 1)] == sorted(set(pages))
        every, first = rng.randint(1, 5), min(pages)
        assert due_pages(starts, ends, every) == sorted({p for p in pages if (p - first + 1) % every == 0} | {max(pages)})
