"""Registered queries that write the given tables in a source or sink format and read them back, and small column operators.

Each has its SQL beside it: a round trip must give what the tables say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import similarity as S, text as X, url as U
from ..operators import crawl, listings as L, prices, queue
from ..session import shared_dir
from ..sources import files, manifest, sinks, state, tabular
from ..streaming import ingest
from . import fixtures as fx
from .index_build import load_sources
from .oracle import LST, OBS, QUEUE, page, score
from .search import Request, is_browse, request_from_text, search

SHOWN = ["rank", "total", "offer_id", "shop", "title", "price_value", "score"]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as listing rows of one shop for each brand; every seventh title holds quotes and a line break."""
    part = fx.table(spark, sf, "part")
    odd = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit('a "quoted",\n'), "p_name")).otherwise(F.col("p_name"))
    return part.select(
        F.col("p_brand").alias("shop"), F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").cast("string").alias("offer_id"),
        odd.alias("title"), F.concat(F.lit("￥"), F.col("p_size").cast("string")).alias("price"))


_TITLE = "CASE WHEN p_partkey % 7 = 0 THEN concat('a \"quoted\", ', p_name) ELSE p_name END"


def csv_round_trip(spark, sf):
    """Write listings as CSV and read them with their header."""
    path = _folder(spark)
    sinks.write_listing_csv(_parts(spark, sf).drop("shop"), path)
    rows = tabular.read_listing_csv(spark, path)
    return rows.select(*[F.try_element_at("fields", F.lit(c)).alias(c) for c in ("offer_id", "title", "price")],
                       F.size(F.map_keys("fields")).alias("columns"))


CSV_SQL = f"SELECT CAST(p_partkey AS VARCHAR) AS offer_id, {_TITLE} AS title, concat('￥', CAST(p_size AS VARCHAR)) AS price, 20 AS columns FROM part"


def _meta(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "part").select(F.col("p_brand").alias("shop")).distinct().select(
        "shop", F.concat(F.lit("https://shop.example.com/"), "shop").alias("source_url"), F.lit("completed").alias("status"))


def manifest_round_trip(spark, sf):
    """Write one or more manifests per shop and read their rows and facts."""
    path = _folder(spark)
    sinks.write_manifests(_parts(spark, sf), _meta(spark, sf), fx.RATES, path, per_manifest=40)
    read = manifest.read_manifest_files(spark, path, glob="*.txt", multi_line=False)
    rows = manifest.manifest_rows(read.withColumn("shop", F.col("shop_name")))
    facts = manifest.manifest_info(read).groupBy("shop_name").agg(F.max("status").alias("status"))
    found = rows.groupBy("shop").agg(
        F.count("*").alias("listings"), F.min(F.col("fields")["title"]).alias("first_title"), F.min("row_number").alias("from_row"))
    return found.join(facts, found["shop"] == facts["shop_name"]).select("shop", "listings", "first_title", "from_row", "status")


MANIFEST_SQL = f"""SELECT p_brand AS shop, count(*) AS listings, min(replace({_TITLE}, '\", ', '\",' || chr(10))) AS first_title, 1 AS from_row,
  'completed' AS status FROM part GROUP BY p_brand"""


def _file(spark: SparkSession, source: str, target: str) -> None:
    """Give the one part file below ``source`` a name of its own, as other programs would have written it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(source)
    fs = place.getFileSystem(conf)
    part = next(f.getPath() for f in fs.listStatus(place) if f.getPath().getName().startswith("part-"))
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(target).getParent())
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(target))


def loaded_sources(spark, sf):
    """All parts, by the last digit of their brand, as the files a data root can hold.

    Tables in a shop's folder, in the collected-data folder and loose in both roots; a folder with a manifest, whose table
    must not count, and one with a manifest alone; a system folder, which does not count; and a damaged manifest.
    """
    root, aside = _folder(spark), _folder(spark)
    rows = _parts(spark, sf).withColumn("digit", F.substring("shop", -1, 1))
    for digits, folder in (("78", ""), ("90", "/scraped data"), ("1", "/One"), ("2", "/scraped data/Two"), ("3", "/Three/deep"), ("4", "/src"),
                           ("5", "/Five")):
        sinks.write_listing_csv(rows.filter(F.col("digit").isin(*digits)).drop("shop", "digit"), root + folder)
    for digit, shop in (("5", "Five"), ("6", "Six")):
        mine = rows.filter(F.col("digit") == digit).drop("digit").withColumn("shop", F.lit(shop))
        meta = mine.select("shop", F.lit("https://shop.example.com").alias("source_url")).distinct()
        texts = sinks.shop_manifests(mine, meta, fx.RATES, per_manifest=1 << 30).select("value")
        texts.coalesce(1).write.text(f"{aside}/{shop}")
        _file(spark, f"{aside}/{shop}", f"{root}/{shop}/manifest.json")
    spark.range(1).select(F.lit('{"rows": [{"title": ').alias("value")).coalesce(1).write.text(f"{aside}/Broken")
    _file(spark, f"{aside}/Broken", f"{root}/Broken/manifest.json")
    found, errors, _ = load_sources(spark, root)
    return found.groupBy("shop", "kind").agg(F.count("*").alias("listings")).unionByName(
        errors.select(F.col("source_file").alias("shop"), F.col("error").alias("kind"), F.lit(0).cast("long").alias("listings")))


LOADED_SQL = """SELECT CASE right(p_brand, 1) WHEN '1' THEN 'One' WHEN '2' THEN 'Two' WHEN '3' THEN 'Three' WHEN '5' THEN 'Five' WHEN '6' THEN 'Six'
    WHEN '9' THEN 'scraped data' WHEN '0' THEN 'scraped data' ELSE 'workspace' END AS shop,
  CASE WHEN right(p_brand, 1) IN ('5', '6') THEN 'manifest' ELSE 'table' END AS kind, count(*) AS listings
FROM part WHERE right(p_brand, 1) <> '4' GROUP BY 1, 2
UNION ALL SELECT 'Broken/manifest.json', 'not a JSON manifest', 0"""


def stored_index(spark, sf):
    """Save the index, drop a shop, load it again."""
    path = _folder(spark)
    sinks.save_index(fx.listings(spark, sf), path)
    sinks.drop_shop(spark, path, "Supplier#000000001")
    return sinks.load_index(spark, path).groupBy("shop").agg(F.count("*").alias("listings"))


INDEX_SQL = f"WITH {LST} SELECT shop, count(*) AS listings FROM lst WHERE shop <> 'Supplier#000000001' GROUP BY shop"


def stored_queue(spark, sf):
    """Save the queue's state, whole, and read it back as after a restart."""
    path = _folder(spark)
    sinks.save_queue(queue.queue_state(fx.queue_events(spark, sf)).withColumn("url", F.lit("")), path)
    return state.load_queue(spark, path).groupBy("status").agg(F.count("*").alias("items"))


QUEUE_SQL = f"""WITH {QUEUE} SELECT CASE WHEN status = 'running' THEN 'queued' ELSE status END AS status, count(*) AS items FROM qs GROUP BY 1"""


def stored_prefs(spark, sf):
    path = _folder(spark)
    prefs = fx.shop_prefs(spark, sf)
    sinks.save_prefs(prefs.select(F.concat(F.lit(" "), "shop").alias("shop"), "kind").unionByName(prefs), path)
    return sinks.prefs_rows(state.load_prefs(spark, path))


PREFS_SQL = """SELECT s_name AS shop, CASE WHEN s_suppkey % 5 = 0 THEN 'favorite' ELSE 'disabled' END AS kind
FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0"""


def compacted_merge(spark, sf):
    """Merge sightings in batches, compact, merge more, compact again: the same as merging all at once."""
    path = _folder(spark)
    obs = fx.crawl_observations(spark, sf).select("shop", "row_key", "seq", "image_url", "value", "page")
    keys = ["shop", "row_key"]
    for batch in range(4):
        part = obs.filter(F.pmod(F.col("seq"), F.lit(4)) == batch)
        crawl.partial_merge(part, keys).write.parquet(f"{path}/log/batch={batch}")
        if batch in (1, 2):
            ingest.compact_merge(spark, path)
            ingest.compact_merge(spark, path)
    return ingest.merged(spark, path)


MERGE_SQL = f"""WITH {OBS} SELECT shop, row_key, max(seq) AS seq,
  coalesce(arg_max(image_url, seq) FILTER (WHERE image_url <> ''), '') AS image_url, arg_max(value, seq) AS value, arg_max(page, seq) AS page
FROM obs GROUP BY shop, row_key"""


def category_labels(spark, sf):
    """Nations as tabs of their region's shop, named by their first letter."""
    tabs = fx.table(spark, sf, "nation").select(
        F.col("n_regionkey").cast("string").alias("shop"), F.substring("n_name", 1, 1).alias("label"), F.floor(F.col("n_nationkey") / 2).alias("pos"))
    return crawl.categories(tabs)


CATEGORY_SQL = """WITH t AS (SELECT CAST(n_regionkey AS VARCHAR) AS shop, left(n_name, 1) AS label, min(n_nationkey // 2) AS pos FROM nation GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY shop ORDER BY pos, label) AS place FROM t WHERE pos > 0"""


def search_typed(spark, sf):
    """Filters typed into the search text."""
    request = request_from_text("ring OR plate !hot min:905 has:image", rates=fx.RATES)
    return search(fx.index(spark, sf), request).select(*SHOWN)


def search_exact_shop(spark, sf):
    return search(fx.index(spark, sf), Request(query="ring", shop_exact="Supplier#000000002")).select(*SHOWN)


def browse_preview(spark, sf):
    """What is shown without terms or filters."""
    request = request_from_text("")
    found = search(fx.index(spark, sf), request).select(*SHOWN)
    return found if is_browse(request) else found.limit(0)


def listing_ids(spark, sf):
    part = fx.table(spark, sf, "part")
    return part.select("p_partkey", X.listing_id("p_name", "p_brand", F.when(F.col("p_size") > 25, F.col("p_type"))).alias("id"))


IDS_SQL = """SELECT p_partkey, left(sha1(concat(p_name, '|', p_brand, '|', CASE WHEN p_size > 25 THEN p_type ELSE '' END)), 16) AS id FROM part"""


def pasted_urls(spark, sf):
    pasted = F.concat(F.lit("12) "), "url", F.lit("\r\n \n\t3. https://shop.example.com/"), F.col("page_id").cast("string"), F.lit("  "))
    return fx.table(spark, sf, "pages").select("page_id", F.posexplode(X.clean_url_lines(pasted)).alias("pos", "line"))


PASTED_SQL = """SELECT page_id, 0 AS pos, url AS line FROM pages
UNION ALL SELECT page_id, 1, concat('https://shop.example.com/', CAST(page_id AS VARCHAR)) FROM pages"""


def string_lists(spark, sf):
    names = F.array(F.concat(F.lit("  "), "p_type"), F.lit(""), F.col("p_brand"), F.lower("p_brand"), F.col("p_type"), F.lit(None))
    part = fx.table(spark, sf, "part")
    return part.select("p_partkey", F.array_join(X.string_list(names), ";").alias("sorted"),
                       F.array_join(X.unique_tokens(F.split(F.concat_ws(" ", "p_name", "p_name", "p_type"), " ")), ";").alias("seen"))


LISTS_SQL = """WITH n AS (SELECT DISTINCT p_partkey, trim(x) AS x FROM (SELECT p_partkey, unnest([p_type, p_brand, lower(p_brand)]) AS x FROM part) u),
s AS (SELECT p_partkey, string_agg(x, ';' ORDER BY lower(x), x) AS sorted FROM n GROUP BY 1),
w AS (SELECT p_partkey, unnest(string_split(concat_ws(' ', p_name, p_name, p_type), ' ')) AS t,
  generate_subscripts(string_split(concat_ws(' ', p_name, p_name, p_type), ' '), 1) AS i FROM part),
f AS (SELECT p_partkey, t, min(i) AS i FROM w GROUP BY 1, 2), d AS (SELECT p_partkey, string_agg(t, ';' ORDER BY i) AS seen FROM f GROUP BY 1)
SELECT p_partkey, sorted, seen FROM s JOIN d USING (p_partkey)"""


def date_texts(spark, sf):
    """The later of two dates, and times for display."""
    orders = fx.table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date").cast("string")
    shown = X.display_time(F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).when(F.col("o_orderkey") % 3 == 1, F.lit("soon")).otherwise(
        F.concat(day, F.lit("T01:02:03"))))
    return orders.select("o_orderkey", X.later_date(F.when(F.col("o_orderkey") % 2 == 0, day), F.lit("1995-06-17")).alias("later"), shown.alias("shown"))


DATES_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN greatest(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '1995-06-17') ELSE '1995-06-17' END AS later,
  CASE o_orderkey % 3 WHEN 0 THEN 'unknown time' WHEN 1 THEN 'soon' ELSE concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), ' 01:02:03') END AS shown FROM orders"""


def term_supports(spark, sf):
    """Support that each word of the parts' names needs."""
    words = fx.table(spark, sf, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))), " ")).alias("term"))
    return words.distinct().select("term", S.min_support("term").alias("support"))


SUPPORT_SQL = """SELECT DISTINCT term, CASE WHEN len(term) <= 2 THEN CASE WHEN regexp_matches(term, '[0-9]') THEN 0.76 ELSE 1.0 END
  WHEN len(term) = 3 THEN CASE WHEN regexp_matches(term, '[0-9]') THEN 0.74 ELSE 1.0 END WHEN len(term) <= 5 THEN 0.78 ELSE 0.58 END::DOUBLE AS support
FROM (SELECT unnest(string_split(lower(concat_ws(' ', p_name, p_type, CAST(p_size AS VARCHAR))), ' ')) AS term FROM part) w"""


def login_pages(spark, sf):
    """Pages as login pages: every fifth has a login address, every seventh the words of a login form."""
    pages = fx.table(spark, sf, "pages")
    url = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/LOGIN"))).otherwise(F.lit("https://shop.example.com/a"))
    body = F.when(F.col("page_id") % 7 == 0, F.lit("Welcome to  Login. Sign in here")).otherwise(F.lit("Sign in"))
    return pages.select("page_id", U.needs_login(url, body, F.when(F.col("page_id") % 14 == 0, 3)).alias("login"))


LOGIN_SQL = "SELECT page_id, page_id % 5 = 0 OR (page_id % 7 = 0 AND page_id % 14 <> 0) AS login FROM pages"


def file_places(spark, sf):
    """Kind and shop of source paths made of the pages' ids."""
    n = F.col("page_id").cast("string")
    path = F.element_at(F.array(
        F.concat(F.lit("s"), n, F.lit("/manifest.json")), F.concat(F.lit("scraped data/s"), n, F.lit("/x/t.CSV")), F.concat(F.lit("t"), n, F.lit(".xlsx")),
        F.concat(F.lit("src/t"), n, F.lit(".csv")), F.concat(F.lit("s"), n, F.lit("/other.json"))), (F.col("page_id") % 5 + 1).cast("int"))
    found = files.placement(path)
    return fx.table(spark, sf, "pages").select("page_id", *[found[c].alias(c) for c in ("kind", "shop", "shop_dir")])


PLACES_SQL = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'manifest' WHEN 1 THEN 'table' WHEN 2 THEN 'table' END AS kind,
  CASE page_id % 5 WHEN 2 THEN 'workspace' WHEN 3 THEN 'src' ELSE concat('s', CAST(page_id AS VARCHAR)) END AS shop,
  CASE page_id % 5 WHEN 1 THEN concat('scraped data/s', CAST(page_id AS VARCHAR)) WHEN 2 THEN NULL WHEN 3 THEN 'src' ELSE concat('s', CAST(page_id AS VARCHAR)) END AS shop_dir
FROM pages"""


def normalize_totals(spark, sf):
    """Rows and files by kind of source."""
    rows = fx.raw_listings(spark, sf).withColumn("kind", F.when(F.col("row_number") % 3 == 0, "table").otherwise("manifest"))
    return prices.normalize_report(rows)


TOTALS_SQL = f"""WITH {LST} SELECT CASE WHEN part % 3 = 0 THEN 'table' ELSE 'manifest' END AS kind, count(*) AS rows, count(DISTINCT shop) AS files FROM lst GROUP BY 1"""


def index_places(spark, sf):
    """Place of each listing in the base order, by shop, as running counts."""
    ordered = L.index_order(fx.listings(spark, sf)).select("shop", "offer_id", F.monotonically_increasing_id().alias("at"))
    return ordered.groupBy("shop").agg(F.min_by("offer_id", "at").alias("first"), F.max_by("offer_id", "at").alias("last"))


PLACED_SQL = f"""WITH {LST} SELECT shop, arg_min(offer_id, k) AS first, arg_max(offer_id, k) AS last FROM (
  SELECT shop, offer_id, row_number() OVER (ORDER BY lower(shop), lower(title), part) AS k FROM lst) x GROUP BY shop"""

RING_OR_PLATE = page(score([["ring"], ["plate"]], ["hot"], "ringorplatehot"), "price_value >= 905 AND image_path <> ''")

QUERIES = {
    "csv_round_trip": csv_round_trip, "manifest_round_trip": manifest_round_trip, "loaded_sources": loaded_sources,
    "stored_index": stored_index, "stored_queue": stored_queue, "stored_prefs": stored_prefs, "compacted_merge": compacted_merge,
    "category_labels": category_labels, "search_typed": search_typed, "search_exact_shop": search_exact_shop,
    "browse_preview": browse_preview, "listing_ids": listing_ids, "pasted_urls": pasted_urls, "string_lists": string_lists,
    "date_texts": date_texts, "term_supports": term_supports, "login_pages": login_pages, "file_places": file_places,
    "normalize_totals": normalize_totals, "index_places": index_places,
}
ORACLE = {
    "csv_round_trip": CSV_SQL, "manifest_round_trip": MANIFEST_SQL, "loaded_sources": LOADED_SQL, "stored_index": INDEX_SQL,
    "stored_queue": QUEUE_SQL, "stored_prefs": PREFS_SQL, "compacted_merge": MERGE_SQL, "category_labels": CATEGORY_SQL,
    "search_typed": RING_OR_PLATE, "search_exact_shop": page(score([["ring"]], [], "ring", "ring"), "shop = 'Supplier#000000002'"),
    "browse_preview": page(score([], [], "")), "listing_ids": IDS_SQL, "pasted_urls": PASTED_SQL, "string_lists": LISTS_SQL,
    "date_texts": DATES_SQL, "term_supports": SUPPORT_SQL, "login_pages": LOGIN_SQL, "file_places": PLACES_SQL,
    "normalize_totals": TOTALS_SQL, "index_places": PLACED_SQL,
}
