"""The registered queries in DuckDB SQL, written from the tables up."""

from __future__ import annotations

from .query_text import SYNONYMS

LST = """
pl AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey),
lst AS (
  SELECT CAST(p.p_partkey AS VARCHAR) AS offer_id, p.p_partkey AS part, p.p_size,
    concat(p.p_name, ' ', p.p_type, ' ', p.p_brand, ' PN', CAST(p.p_partkey AS VARCHAR), 'X', CAST(p.p_size AS VARCHAR)) AS title,
    s.s_name AS shop,
    CASE WHEN p.p_partkey % 50 = 0 THEN '' WHEN p.p_partkey % 51 = 0 THEN '￥0.00'
      ELSE concat(CASE p.p_partkey % 4 WHEN 0 THEN 'CA$' WHEN 1 THEN 'US$' WHEN 2 THEN '￥' ELSE '' END,
                  CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) AS VARCHAR)) END AS price_text,
    CAST(pl.n AS VARCHAR) AS sales,
    concat('https://detail.example.com/offer/', CAST(p.p_partkey AS VARCHAR), '.html') AS source_url,
    concat('https://agent.example.com/products?productLink=https%253A%252F%252Fdetail.example.com%252Foffer%252F',
           CAST(p.p_partkey AS VARCHAR), '.html') AS agent_url,
    CASE WHEN p.p_partkey % 3 = 0 THEN '' ELSE concat('images/', CAST(p.p_partkey AS VARCHAR), '.jpg') END AS image_path
  FROM pl JOIN part p ON p.p_partkey = pl.l_partkey JOIN supplier s ON s.s_suppkey = pl.l_suppkey),
priced AS (
  SELECT *, TRY_CAST(nullif(regexp_extract(replace(price_text, ',', ''), '-?\\d+(\\.\\d+)?'), '') AS DOUBLE) AS price_value,
    CASE WHEN contains(price_text, 'CA$') THEN 'cad' WHEN contains(price_text, '￥') THEN 'cny'
         WHEN contains(price_text, 'US$') THEN 'usd' ELSE '' END AS marker
  FROM lst)"""


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


INDEX = LST + f""",
ix AS (SELECT *, {norm('title')} AS t, {norm('offer_id')} AS o, {norm('shop')} AS s,
       {norm("concat_ws(' ', title, shop, offer_id, price_text, sales, source_url)")} AS b FROM priced)"""

# Canonical prices of the fixture rates.
CANON = LST + """,
canon AS (SELECT *, CASE WHEN marker = 'cad' THEN price_value * 1.0 / 0.19 WHEN marker = 'usd' THEN price_value * 1.37 / 0.19
                         ELSE price_value END AS cny FROM priced)"""


def amount(v: str, digits: int = 4, keep: int = 2, comma: bool = False) -> str:
    """Fixed decimals with trailing zeros cut down to ``keep``."""
    fmt = f"format('{{:,.{digits}f}}', {v})" if comma else f"printf('%.{digits}f', {v})"
    return f"regexp_replace({fmt}, '(\\.\\d{{{keep}}}\\d*?)0+$', '\\1')"


def _hit(term: str, col: str, part: bool) -> str:
    return f"contains({col if part else f'''replace({col}, ' ', '')'''}, '{term}')"


def score(groups: list[list[str]], exclude: list[str], compact: str, word: str = "", parts: tuple[str, ...] = ()) -> str:
    """Live score as SQL; ``parts`` names the terms with letters and digits."""
    if not groups:
        return "1.0"
    bonus = "0"
    if word:
        bonus += f" + CASE WHEN contains(regexp_replace(lower(title), '[-_ ]', '', 'g'), '{word}') THEN 4000 ELSE 0 END"
    if compact:
        p = compact in parts
        bonus += f" + CASE WHEN {_hit(compact, 't', p)} OR {_hit(compact, 'o', p)} THEN 2500 ELSE 0 END"
    each = []
    for group in groups:
        points = " + ".join(
            f"CASE WHEN {_hit(term, col, term in parts)} THEN {n} ELSE 0 END"
            for term in group for col, n in (("o", 800), ("t", 500), ("b", 120))
        )
        needed = " AND ".join(
            "(" + " OR ".join(_hit(term, col, term in parts) for col in "otb") + ")" for term in group
        )
        each.append(f"CASE WHEN {needed} THEN {points} + {bonus} END")
    best = f"greatest({', '.join(each)})" if len(each) > 1 else each[0]
    if exclude:
        out = " OR ".join(f"contains(b, '{t}')" for t in exclude)
        return f"CASE WHEN NOT ({out}) THEN {best} END"
    return best


STORED = "lower(shop), lower(title), price_value IS NULL, coalesce(price_value, 0), lower(source_file), source_file, part"
ORDERS = {
    "match": "score DESC, lower(shop), lower(title)",
    "price-asc": "coalesce(price_value, 1e12), lower(title)",
    "price-desc": "coalesce(price_value, -1) DESC, lower(title)",
    "title": "lower(title)",
    "shop": "lower(shop), lower(title)",
}
SHOWN = "rank, total, offer_id, shop, title, price_value, score"


def found(scored: str, where: str = "true") -> str:
    return f"""SELECT * FROM (SELECT *, concat(shop, '/manifest.json') AS source_file,
        CAST({scored} AS DOUBLE) AS score FROM ix WHERE {where}) q WHERE score IS NOT NULL"""


def page(scored: str, where: str = "true", sort: str = "match", offset: int = 0, limit: int = 240, columns: str = SHOWN) -> str:
    return f"""WITH {INDEX}, f AS ({found(scored, where)}),
r AS (SELECT *, row_number() OVER (ORDER BY {ORDERS[sort]}, {STORED}) AS rank, count(*) OVER () AS total FROM f)
SELECT {columns} FROM r WHERE rank > {offset} AND rank <= {offset + limit}"""


def ranked(name: str, scored: str, where: str, sort: str, offset: int, limit: int) -> str:
    """One request of a batch."""
    return f"""SELECT '{name}' AS request_id, {SHOWN} FROM (
  SELECT *, row_number() OVER (ORDER BY {ORDERS[sort]}, {STORED}) AS rank, count(*) OVER () AS total
  FROM ({found(scored, where)}) f) r WHERE rank > {offset} AND rank <= {offset + limit}"""


OBS = """
e AS (SELECT event_id, ts, value, concat('shop-', CAST(user_id % 10 AS VARCHAR)) AS shop,
        row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS seq,
        concat('K', CAST((event_id * 7919 + user_id * 104729) % 120 AS VARCHAR)) AS row_key,
        CASE WHEN event_type = 'error' THEN '' ELSE concat('https://img.example.com/', CAST(event_id AS VARCHAR), '.jpg') END AS image_url,
        CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 2 = 0 THEN 429 ELSE 403 END AS http_status
      FROM events),
obs AS (SELECT *, CAST(floor((seq - 1) / 20.0) AS BIGINT) + 1 AS page FROM e)"""

FIRSTS = OBS + """,
seen AS (SELECT shop, page, count(*) AS seen FROM obs GROUP BY shop, page),
fresh AS (SELECT shop, page, count(*) AS added FROM (
  SELECT shop, page, row_number() OVER (PARTITION BY shop, row_key ORDER BY seq) AS nth FROM obs) x WHERE nth = 1 GROUP BY shop, page),
news AS (SELECT shop, page, seen, coalesce(added, 0) AS added FROM seen LEFT JOIN fresh USING (shop, page))"""

QUEUE = """
qe AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS item_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running'
   WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'error' END AS status FROM events),
qs AS (SELECT item_id, arg_max(status, seq) AS status, max(seq) AS seq, min(seq) AS enqueued FROM qe GROUP BY item_id)"""

PREFS = """
prefs AS (SELECT s_name AS shop, CASE WHEN s_suppkey % 5 = 0 THEN 'favorite' ELSE 'disabled' END AS kind
          FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0)"""

VEC = """
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
q1 AS (SELECT arg_min(e, id) AS qe FROM v)"""

KNN = VEC + """,
near AS (SELECT id, label, list_dot_product(e, qe) AS raw FROM v, q1),
top AS (SELECT id, raw, row_number() OVER (ORDER BY raw DESC, id) AS rank FROM near QUALIFY rank <= 200)"""

FUSE = KNN + """,
txt AS (SELECT id, label * 100.0 AS score, label % 2 AS exact_terms, 1 AS matched_terms, label % 3 AS title_terms, label = 4 AS smart_guess
        FROM v WHERE label <= 4),
ext AS (SELECT max(raw) AS hi, min(raw) AS lo, count(*) AS n FROM top),
sc AS (SELECT id, raw, rank, greatest(0, least(1, (raw - lo) / greatest(0.0001, hi - lo))) AS scaled, 1 - (rank - 1) / CAST(n AS DOUBLE) AS boost
       FROM top, ext)"""

SIG = VEC + """,
lum AS (SELECT id, label, list_transform(e, lambda x: greatest(0.0, least(255.0, x * 256 + 128))) AS l FROM v),
grid AS (SELECT id, label, l, l || l[1:8] AS g, list_transform(l, lambda x: least(15, CAST(floor(x / 256 * 16) AS INTEGER))) AS bins FROM lum),
sig AS (SELECT id, 1 + label / 10.0 AS ratio,
   list_transform(range(0, 64), lambda n: CASE WHEN g[(n // 8) * 9 + n % 8 + 1] > g[(n // 8) * 9 + n % 8 + 2] THEN 1 ELSE 0 END) AS bits,
   list_transform(range(0, 16), lambda k: len(list_filter(bins, lambda x: x = k)) / 64.0) AS hist FROM grid)"""

TERMS = ["widgit", "smal", "platte", "gismo", "ring", "pn12x"]
DICT = INDEX + """,
words AS (SELECT DISTINCT unnest(string_split(t, ' ') || string_split(o, ' ')) AS token FROM ix),
dict AS (SELECT token FROM words WHERE token <> ''),
terms AS (SELECT unnest(['widgit', 'smal', 'platte', 'gismo', 'ring', 'pn12x']) AS term),
pairs AS (SELECT term, token, least(len(term), len(token)) / CAST(greatest(len(term), len(token)) AS DOUBLE) AS ratio,
  levenshtein(term, token) AS lev, greatest(len(term), len(token)) AS longer,
  list_transform(range(1, greatest(len(term), 1)), lambda i: substr(term, CAST(i AS INTEGER), 2)) AS ga,
  list_transform(range(1, greatest(len(token), 1)), lambda i: substr(token, CAST(i AS INTEGER), 2)) AS gb,
  len(token) >= 3 OR (len(token) = 2 AND regexp_matches(token, '[0-9]')) AS back FROM terms, dict),
diced AS (SELECT *, CASE WHEN term = token THEN 1.0 WHEN len(term) < 2 OR len(token) < 2 THEN 0.0 ELSE
  2.0 * coalesce(list_sum(list_transform(list_distinct(ga), lambda g: least(len(list_filter(ga, lambda x: x = g)), len(list_filter(gb, lambda x: x = g))))), 0)
  / (len(term) + len(token) - 2) END AS dice FROM pairs),
sim AS (SELECT *, CASE WHEN term = token THEN 1.0
   WHEN starts_with(token, term) OR (back AND starts_with(term, token)) THEN 0.82 + ratio * 0.12
   WHEN len(term) < 3 OR len(token) < 3 THEN 0.0
   WHEN contains(token, term) OR (back AND contains(term, token)) THEN 0.68 + ratio * 0.18
   WHEN substr(term, 1, 1) = substr(token, 1, 1) AND lev <= 2 THEN 0.72 + (2 - lev) / 2.0 * 0.16
   WHEN dice >= 0.72 THEN 0.58 + (dice - 0.72) * 0.9 ELSE 0.0 END AS ts,
  CASE WHEN term = token THEN 1.0 WHEN len(term) < 3 AND NOT regexp_matches(term, '[0-9]') THEN 0.0
   WHEN starts_with(token, term) OR (back AND starts_with(term, token)) THEN 0.84 + ratio * 0.12
   WHEN contains(token, term) OR (back AND contains(term, token)) THEN 0.76 + ratio * 0.16
   WHEN lev <= least(3, greatest(2, longer // 4)) THEN 0.62 + (least(3, greatest(2, longer // 4)) - lev) / CAST(least(3, greatest(2, longer // 4)) AS DOUBLE) * 0.18
   WHEN dice >= 0.72 THEN 0.58 + (dice - 0.72) * 0.9 ELSE 0.0 END AS cs FROM diced)"""

RICH = LST + f""",
rx AS (SELECT *, {norm('title')} AS t, {norm('offer_id')} AS o, {norm('shop')} AS s,
       {norm("concat_ws(' ', title, shop, offer_id, price_text, sales)")} AS b FROM lst),
tok AS (SELECT offer_id, shop, field, unnest(list_distinct(list_filter(words, lambda w: w <> ''))) AS token FROM (
  SELECT offer_id, shop, unnest(['title', 'offer', 'shop', 'blob']) AS field,
         unnest([string_split(t, ' '), string_split(o, ' '), string_split(s, ' '), string_split(b, ' ')]) AS words FROM rx) x),
parts AS (SELECT DISTINCT offer_id, shop, token FROM tok WHERE field <> 'shop' AND len(token) BETWEEN 5 AND 40
          AND regexp_matches(token, '[a-z]') AND regexp_matches(token, '[0-9]'))"""

# Parts of a URL: scheme, host, path, query, fragment.
URI = r"""
u AS (SELECT *, regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$',
        ['scheme', 'host', 'path', 'query', 'frag']) AS p FROM pages),
qv AS (SELECT *, list_filter(list_transform(list_filter(string_split(p.query, '&'), lambda x: x <> ''),
        lambda x: concat(url_decode(replace(split_part(x, '=', 1), '+', ' ')), '=', url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' ')))),
        lambda x: NOT ends_with(x, '=')) AS kv FROM u),
keyed AS (SELECT page_id, url, p, kv,
  coalesce('shopid:' || list_filter(kv, lambda x: starts_with(x, 'shopid='))[1][8:],
           'shops:' || nullif(regexp_extract(p.path, '(?i)/shops/([^/?#]+)', 1), ''),
           'shops:' || nullif(regexp_extract(p.frag, '(?i)/shops/([^/?#&]+)', 1), ''),
           'sellerid:' || list_filter(kv, lambda x: starts_with(x, 'sellerId='))[1][10:],
           concat(lower(p.scheme), '|', lower(p.host), '|', p.path, '|', array_to_string(list_sort(kv), '&'), '|', p.frag)) AS shop_key FROM qv)"""

FIX = """
fixes AS (SELECT CAST(p_partkey AS VARCHAR) AS key, concat('￥', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)) AS fix,
          CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS fix_value FROM part WHERE p_size > 25)"""
# A fixture row is bad when its price is missing or zero.
BAD = "(price_text = '' OR price_text = '￥0.00')"

ORACLE = {
    "search_match": page(score([["ring", "small"]], [], "smallring")),
    "search_or_not": page(score([["ring"], ["plate"]], ["hot"], "ringorplatehot"), "price_value >= 905 AND image_path <> ''"),
    "search_filters": page(
        score([["gear"]], [], "gear", "gear"),
        "price_value >= 950 AND price_value <= 1400 AND image_path <> '' AND contains(s, 'supplier 00000000') AND contains(o, '1')",
    ),
    "search_price_asc": page(score([["bolt"]], [], "bolt", "bolt"), sort="price-asc"),
    "search_price_desc": page(score([["bolt"]], [], "bolt", "bolt"), sort="price-desc"),
    "search_by_shop": page(score([["plate"]], [], "plate", "plate"), sort="shop"),
    "search_by_title": page(score([["old"]], [], "old", "old"), sort="title", limit=5000),
    "search_page2": page(score([["gear"]], [], "gear", "gear"), offset=240),
    "search_part_number": page(score([["pn12x"]], [], "pn12x", "pn12x", ("pn12x",))),
    "search_browse": page(score([], [], "")),
    "search_page_after": page(score([["gear", "small"]], [], "smallgear"), offset=100, limit=100,
                              columns="offer_id, shop, title, price_value, score"),
    "search_active_shops": page(
        score([["anvil", "hot"]], [], "hotanvil"), limit=200,
        where="shop NOT IN (SELECT s_name FROM supplier WHERE s_suppkey % 7 = 0 AND s_suppkey % 5 <> 0)",
    ),
    "search_all_matches": f"""WITH {INDEX} SELECT offer_id, shop, score FROM ({found(
        score([["bolt", "red"], ["pn11x"]], ["promo"], "redboltpn11xpromo", "", ("pn11x", "redboltpn11xpromo")))}) f""",
    "search_batch": f"WITH {INDEX} " + " UNION ALL ".join([
        ranked("rings", score([["ring"]], [], "ring", "ring"), "true", "match", 0, 50),
        ranked("plates_or_gears", score([["plate"], ["gear"]], ["small"], "plateorgearsmall"), "true", "price-asc", 0, 40),
        ranked("part", score([["pn7x"]], [], "pn7x", "pn7x", ("pn7x",)), "true", "title", 10, 30),
        ranked("cheap", "1.0", "price_value <= 905", "price-desc", 0, 25),
        ranked("nothing", score([["zzzz"]], [], "zzzz", "zzzz"), "true", "match", 0, 240),
    ]),
    "shop_search": f"WITH {LST} SELECT DISTINCT shop FROM lst WHERE contains({norm('shop')}, '000001')",
    "norm_titles": f"""WITH {LST} SELECT offer_id, shop, title AS clean, {norm('title')} AS norm,
        replace({norm('title')}, ' ', '') AS compact FROM lst""",
    "title_tokens": f"""WITH {LST} SELECT token, count(*) AS listings FROM (
        SELECT unnest(list_distinct(string_split({norm('title')}, ' '))) AS token FROM lst) x WHERE token <> '' GROUP BY token""",
    "part_like_titles": f"""WITH {LST}, w AS (SELECT offer_id, shop, string_split({norm('title')}, ' ') AS w FROM lst)
        SELECT offer_id, shop, len(w) <= 3 AND len(array_to_string(w, '')) BETWEEN 5 AND 40 AS whole,
          array_to_string(list_filter(w, lambda x: len(x) BETWEEN 5 AND 40 AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]')), ' ') AS parts FROM w""",
    "doc_term_postings": f"""SELECT token, count(*) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (
        SELECT doc_id, unnest(list_distinct(string_split({norm('text')}, ' '))) AS token FROM documents) x WHERE token <> '' GROUP BY token""",
    "page_shop_key": f"WITH {URI} SELECT page_id, shop_key, lower(p.scheme) IN ('http', 'https') AND p.host <> '' AS valid FROM keyed",
    "page_url_kinds": rf"""WITH {URI}, named AS (SELECT page_id, url, p, kv,
          trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM qv)
        SELECT page_id, regexp_matches(lower(p.path), '/shops/|/shop/home') OR regexp_matches(lower(p.frag), '/shops/|/shop/home')
            OR len(list_filter(kv, lambda x: regexp_matches(lower(x), '^(shopid|sellerid)='))) > 0 AS store,
          regexp_matches(lower(url), '/products\?|productlink=|/product/|detail\.1688\.com/offer/|item\.taobao\.com/item\.htm') AS listing,
          coalesce(nullif(trim(regexp_replace(regexp_replace(title, '(?i)\s*[-|]\s*agent.*$', ''), '(?i)\s*[-|]\s*shop.*$', '')), ''),
            regexp_replace(list_filter(string_split(p.path, '/'), lambda x: x <> '')[-1], '[-_]+', ' ', 'g'), '') AS name FROM named""",
    "page_url_decode": f"""WITH {LST} SELECT offer_id, shop, source_url AS link,
          concat('https://agent.example.com/products?productLink=', source_url) AS decoded,
          concat('https://www.agent.example.com/products?productLink=https%253A%252F%252Fdetail.example.com%252Foffer%252F', offer_id, '.html') AS wrapped FROM lst""",
    "page_links": """SELECT page_id, CAST(pos AS BIGINT) AS pos, href FROM (SELECT page_id, generate_subscripts(h, 1) AS pos, unnest(h) AS href FROM (
          SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages) x) y""",
    "offer_ids": f"""WITH {LST} SELECT offer_id AS own, shop, offer_id AS "index", offer_id AS queue, offer_id AS saved_page,
          offer_id AS live_page, concat(offer_id, '.html') AS image FROM lst""",
    "event_props_json": """SELECT event_type, count(*) AS events, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total,
          max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type""",
    "shop_count_map": f"WITH {LST} SELECT shop, count(*) AS listings FROM lst GROUP BY shop",
    "parse_prices": f"WITH {LST} SELECT offer_id, shop, price_value AS value, price_value AS low, CAST(NULL AS DOUBLE) AS high FROM priced",
    "currency_markers": f"""WITH {LST} SELECT marker, CASE WHEN price_text = '' THEN '' WHEN marker = '' THEN 'cny' ELSE marker END AS currency,
          count(*) AS listings FROM priced GROUP BY 1, 2""",
    "canonical_prices": f"""WITH {CANON} SELECT offer_id, shop, coalesce('￥' || {amount('cny')}, '') AS price,
          CASE WHEN cny IS NULL THEN '' ELSE 'cny' END AS price_currency, round(round(cny, 6), 4) AS price_value, price_text AS price_original,
          CASE WHEN price_text = '' THEN '' WHEN marker = '' THEN 'cny' ELSE marker END AS price_original_currency,
          round(price_value, 4) AS price_original_value, '2024-01-02' AS price_exchange_date FROM canon""",
    "price_display": f"""WITH {CANON}, r AS (SELECT offer_id, shop, round(cny, 6) AS v FROM canon),
          a AS (SELECT *, v * 0.19 / 1.37 AS usd, v * 0.19 AS cad FROM r)
        SELECT offer_id, shop, CASE WHEN v IS NULL THEN 'No price' ELSE '$' || {amount('usd', comma=True)} END AS "primary",
          CASE WHEN v IS NULL THEN '' ELSE '$' || {amount('cad', comma=True)} || ' · ¥' || {amount('v', comma=True)} END AS secondary FROM a""",
    "rescaled_prices": f"""WITH {LST} SELECT offer_id, shop, CASE WHEN shop IN ('Supplier#000000003', 'Supplier#000000007') AND price_value IS NOT NULL
          THEN regexp_extract(price_text, '^(\\D*)', 1) || printf('%.2f', price_value / 100) ELSE price_text END AS price,
          round(CASE WHEN shop IN ('Supplier#000000003', 'Supplier#000000007') THEN price_value / 100 ELSE price_value END, 6) AS price_value FROM priced""",
    "bad_prices": f"WITH {LST} SELECT shop, count(*) AS bad, min(offer_id) AS first FROM lst WHERE {BAD} GROUP BY shop",
    "repaired_prices": f"""WITH {CANON}, {FIX}, m AS (SELECT {BAD} AND fix IS NOT NULL AS repaired, price_text, cny, fix_value
          FROM canon LEFT JOIN fixes ON key = offer_id)
        SELECT repaired, CASE WHEN repaired OR price_text <> '' THEN 'cny' ELSE '' END AS price_currency, count(*) AS listings,
          round(sum(round(round(CASE WHEN repaired THEN fix_value ELSE cny END, 6), 4)), 2) AS value FROM m GROUP BY 1, 2""",
    "pending_repairs": f"""WITH {LST}, {FIX} SELECT offer_id AS key, offer_id, title, agent_url AS url FROM (
          SELECT DISTINCT offer_id, title, agent_url FROM lst WHERE {BAD}) t WHERE offer_id NOT IN (SELECT key FROM fixes)""",
    "prices_from_pages": f"""WITH {LST} SELECT DISTINCT offer_id AS key,
          '￥' || regexp_replace(regexp_replace(printf('%.6f', p_retailprice), '0+$', ''), '\\.$', '') AS price,
          CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS value FROM lst JOIN part ON p_partkey = part WHERE {BAD}""",
    "catalog_stats": f"""WITH {LST} SELECT CAST(count(*) AS BIGINT) AS total_rows, count(DISTINCT shop) AS total_shops, count(DISTINCT shop) AS total_sources FROM lst""",
    "shop_counts": f"WITH {LST} SELECT shop, count(*) AS listings FROM lst GROUP BY shop",
    "source_counts": f"""WITH {LST}, c AS (SELECT shop, count(*) AS n FROM lst GROUP BY shop)
        SELECT concat(s_name, '/manifest.json') AS source_file, 'manifest' AS kind, coalesce(n, 0) AS rows FROM supplier LEFT JOIN c ON shop = s_name""",
    "shop_panel": f"""WITH {LST}, {PREFS}, c AS (SELECT shop, count(*) AS listings FROM lst GROUP BY shop)
        SELECT c.shop, listings, coalesce(kind = 'favorite', false) AS favorite, coalesce(kind = 'disabled', false) AS disabled,
          CASE WHEN s_nationkey < 20 THEN concat('https://shop.example.com/shops/', CAST(s_suppkey AS VARCHAR)) ELSE '' END AS shop_url
        FROM c JOIN supplier ON s_name = c.shop LEFT JOIN prefs ON prefs.shop = c.shop""",
    "shop_summary": f"""WITH {LST}, {PREFS}, c AS (SELECT DISTINCT shop FROM lst)
        SELECT count(*) AS shops, count(*) FILTER (WHERE kind IS NULL OR kind <> 'disabled') AS active,
          count(*) FILTER (WHERE kind = 'favorite') AS favorites FROM c LEFT JOIN prefs USING (shop)""",
    "known_prefs": f"""WITH {LST}, {PREFS}, oth AS (SELECT concat('Supplier#', lpad(CAST(c_custkey % 1200 AS VARCHAR), 9, '0')) AS shop,
          CASE WHEN c_mktsegment = 'BUILDING' THEN 'favorite' ELSE 'disabled' END AS kind FROM customer)
        SELECT DISTINCT shop, kind FROM (SELECT * FROM prefs WHERE kind = 'favorite' UNION ALL SELECT * FROM oth) x
        WHERE shop IN (SELECT shop FROM lst)""",
    "best_shop_name": """SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN concat(s_name, ' _ ', n_name)
          WHEN s_acctbal > 0 THEN s_name ELSE 'Agent Shop 2024-01-02T03_04_05' END AS shop_name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "image_stats": f"""WITH {LST} SELECT shop, count(*) FILTER (WHERE image_path <> '') AS saved, count(*) FILTER (WHERE image_path = '') AS failed,
          count(*) AS rows FROM lst GROUP BY shop""",
    "new_keys_per_page": f"WITH {FIRSTS} SELECT shop, page, seen, added FROM news",
    "stop_page": f"""WITH {FIRSTS}, g AS (SELECT *, sum(CASE WHEN added > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY shop ORDER BY page) AS island FROM news),
          r AS (SELECT *, count(*) FILTER (WHERE added = 0) OVER (PARTITION BY shop, island ORDER BY page) AS idle FROM g)
        SELECT shop, min(page) AS stop_page FROM r WHERE added = 0 AND idle >= 5 GROUP BY shop""",
    "page_signatures": f"WITH {OBS} SELECT shop, page, string_agg(row_key, '|' ORDER BY seq) AS signature FROM obs GROUP BY shop, page",
    "repeated_pages": f"""WITH {OBS}, k AS (SELECT shop, CAST(floor((seq - 1) / 2.0) AS BIGINT) + 1 AS page, seq, 'G' || right(row_key, 1) AS g FROM obs),
          s AS (SELECT shop, page, string_agg(g, '|' ORDER BY seq) AS signature FROM k GROUP BY shop, page),
          m AS (SELECT shop, page, min(page) OVER (PARTITION BY shop, signature) AS first_page FROM s)
        SELECT shop, page, first_page FROM m WHERE page > first_page""",
    "checkpoint_pages": f"""WITH {OBS}, p AS (SELECT DISTINCT shop, page FROM obs), m AS (SELECT shop, page, max(page) OVER (PARTITION BY shop) AS last FROM p)
        SELECT shop, page FROM m WHERE page % 3 = 0 OR page = last""",
    "merge_observations": f"""WITH {OBS} SELECT shop, row_key, max(seq) AS seq,
          coalesce(arg_max(image_url, seq) FILTER (WHERE image_url <> ''), '') AS image_url, arg_max(value, seq) AS value, arg_max(page, seq) AS page
        FROM obs GROUP BY shop, row_key""",
    "saved_page_rows": f"""WITH {OBS} SELECT concat(shop, '/', row_key) AS key, max(event_id) AS event_id, arg_max(image_url, event_id) AS image_url,
          arg_max(value, event_id) AS value FROM obs GROUP BY shop, row_key""",
    "plan_crawl": f"""WITH {URI}, once AS (SELECT min(page_id) AS pos, url, any_value(shop_key) AS shop_key, any_value(p.host) AS host,
          any_value(lower(p.scheme)) AS scheme FROM keyed GROUP BY url),
          firsts AS (SELECT shop_key, min(pos) AS pos FROM once WHERE scheme IN ('http', 'https') AND host <> '' GROUP BY shop_key)
        SELECT f.pos, o.url, f.shop_key FROM firsts f JOIN once o ON o.pos = f.pos
        WHERE f.shop_key NOT IN (SELECT shop_key FROM keyed WHERE contains(url, 'utm_source=') OR contains(url, '#top'))""",
    "rate_limit_active": f"""WITH {OBS}, m AS (SELECT event_id, shop, ts, max(CASE WHEN http_status IN (429, 403) THEN ts END)
            OVER (PARTITION BY shop ORDER BY ts RANGE BETWEEN INTERVAL 2 MINUTES PRECEDING AND CURRENT ROW) AS last FROM obs)
        SELECT event_id, shop, last IS NOT NULL AND ts - last < INTERVAL 2 MINUTES AS active FROM m""",
    "run_summary": """WITH g AS (SELECT concat('shop-', CAST(user_id % 10 AS VARCHAR)) AS shop, event_type, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT shop, string_agg(concat(event_type, ': ', CAST(CAST(ceil(n / 20.0) AS BIGINT) AS VARCHAR), ' pages (',
            CASE WHEN n % 2 = 0 THEN 'reached end of pagination' ELSE 'no next-page control found' END, ')'), '; ' ORDER BY event_type) AS completion_reason,
          bool_or(n % 3 = 0) AS stopped_early, CAST(sum(CAST(ceil(n / 20.0) AS BIGINT)) AS BIGINT) AS pages_visited, count(*) AS streams FROM g GROUP BY shop""",
    "complete_stores": """SELECT NOT (o_orderstatus = 'P') AND NOT (o_custkey >= 1800 AND o_custkey // 10 >= 90 AND o_orderpriority = '1-URGENT') AS complete,
          count(*) AS stores, CAST(sum(o_custkey) AS BIGINT) AS rows FROM orders WHERE o_custkey > 0 AND o_orderpriority <> '5-LOW' GROUP BY 1""",
    "queue_status": f"""WITH {QUEUE} SELECT count(*) FILTER (WHERE status = 'running') > 0 AS busy,
          coalesce(arg_min(item_id, enqueued) FILTER (WHERE status = 'running'), '') AS active_item_id,
          count(*) FILTER (WHERE status = 'queued') AS queue_length, count(*) AS items FROM qs""",
    "queue_items": f"WITH {QUEUE} SELECT item_id, CASE WHEN status = 'running' THEN 'queued' ELSE status END AS status, seq, enqueued FROM qs",
    "queue_newest": f"WITH {QUEUE} SELECT item_id, status, enqueued FROM qs ORDER BY enqueued DESC LIMIT 40",
    "queue_progress": """SELECT phase, count(*) AS items, round(sum(percent), 2) AS percent, sum(wait) AS wait, max(wait) AS longest FROM (
          SELECT CASE l_returnflag WHEN 'A' THEN 'collecting' WHEN 'N' THEN 'images' ELSE 'saving' END AS phase,
            CASE l_returnflag WHEN 'A' THEN least(85.0, 22.0 + greatest(l_quantity, 1) * 4) WHEN 'N' THEN least(99.0, 90.0 + l_quantity / 50.0 * 9) ELSE 88.0 END AS percent,
            least(60.0 * power(2, greatest(l_linenumber - 1, 0)), 1200.0) AS wait FROM lineitem) x GROUP BY phase""",
    "knn_one": f"WITH {KNN} SELECT id, round(raw, 4) AS score, rank FROM top WHERE rank <= 10",
    "knn_batch": f"""WITH {VEC}, p AS (SELECT CAST(label AS BIGINT) AS query_id, arg_min(e, id) AS qe FROM v GROUP BY label),
          s AS (SELECT query_id, id, list_dot_product(e, p.qe) AS raw FROM v, p),
          r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM s)
        SELECT query_id, id, round(raw, 4) AS score, rank FROM r WHERE rank <= 10""",
    "knn_subset": f"""WITH {KNN} SELECT id, round(raw, 4) AS score, row_number() OVER (ORDER BY raw DESC, id) AS rank FROM near WHERE label IN (1, 3, 5) QUALIFY rank <= 10""",
    "unit_vectors": f"WITH {VEC} SELECT id, 1.0::DOUBLE AS norm, round(sqrt(list_dot_product(e, e)), 4) AS cosine FROM v",
    "fuse_image": f"WITH {FUSE} SELECT id, score, round(raw, 4) AS image_score, exact_terms FROM txt JOIN top USING (id)",
    "fuse_boost": f"""WITH {FUSE} SELECT id, round(coalesce(score, 0) + coalesce(scaled * 300 + boost * 60, 0), 4) AS score,
          coalesce(exact_terms, 0) AS exact_terms, coalesce(matched_terms, 0) AS matched_terms, coalesce(title_terms, 0) AS title_terms,
          round(coalesce(raw, 0), 4) AS image_score, CASE WHEN score IS NULL THEN true ELSE smart_guess OR coalesce(scaled >= 0.62, false) END AS smart_guess
        FROM txt FULL JOIN sc USING (id) WHERE score IS NOT NULL OR (rank <= 300 AND scaled >= 0.72)""",
    "fuse_rerank": f"""WITH {FUSE}, j AS (SELECT id, coalesce(score, 0) + scaled * 260 + boost * 70 AS sc, coalesce(exact_terms, 0) AS exact_terms,
            coalesce(matched_terms, 0) AS matched_terms, coalesce(title_terms, 0) AS title_terms, raw FROM sc LEFT JOIN txt USING (id))
        SELECT id, round(sc, 4) AS score, exact_terms, matched_terms, title_terms, round(raw, 4) AS image_score FROM j
        WHERE (SELECT max(matched_terms) FROM j) = 0 OR matched_terms > 0 OR sc >= 260""",
    "vectors_pending": f"WITH {LST} SELECT CAST(p_size AS BIGINT) AS size, count(*) AS images FROM lst WHERE image_path <> '' AND p_size > 40 GROUP BY p_size",
    "vector_build": f"""WITH {LST} SELECT count(*) AS total, count(*) FILTER (WHERE p_size <= 40) AS reused, count(*) FILTER (WHERE p_size > 40) AS encoded
        FROM lst WHERE image_path <> ''""",
    "image_hashes": f"""WITH {SIG}, h AS (SELECT id, hist, list_sum(list_transform(range(0, 64), lambda n: CAST(bits[n + 1] AS HUGEINT) * CAST(power(2, n) AS HUGEINT))) AS u FROM sig)
        SELECT id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS hash,
          round(hist[8], 6) AS mid, round(hist[1], 6) AS dark FROM h""",
    "signature_neighbours": f"""WITH {SIG}, q AS (SELECT bits AS qb, hist AS qh, ratio AS qr FROM sig ORDER BY id LIMIT 1),
          s AS (SELECT id, round((1 - list_sum(list_transform(range(1, 65), lambda n: CASE WHEN bits[n] <> qb[n] THEN 1 ELSE 0 END)) / 64.0) * 0.74
            + list_sum(list_transform(range(1, 17), lambda k: least(hist[k], qh[k]))) * 0.21
            + greatest(0, 1 - abs(ln(greatest(ratio, 0.01) / greatest(qr, 0.01))) / ln(2.4)) * 0.05, 9) AS score FROM sig, q)
        SELECT id, score FROM s""",
    "token_edit_pairs": f"WITH {DICT} SELECT term, token, CAST(lev AS INTEGER) AS distance FROM pairs WHERE lev <= 2 AND substr(term, 1, 1) = substr(token, 1, 1)",
    "token_dice_pairs": f"WITH {DICT} SELECT term, token, round(dice, 6) AS dice FROM diced WHERE dice >= 0.5",
    "token_similarities": f"WITH {DICT} SELECT term, token, round(ts, 6) AS support FROM sim WHERE ts > 0",
    "fuzzy_tokens": f"""WITH {DICT}, f AS (SELECT term, token, CASE len(term) WHEN 4 THEN 0.82 WHEN 5 THEN 0.72 WHEN 6 THEN 0.72 ELSE 0.62 END AS floor, ts,
            greatest(ts, cs) AS best FROM sim WHERE term <> token),
          g AS (SELECT term, token, CASE WHEN ts >= floor THEN ts ELSE best END AS support, floor FROM f)
        SELECT term, token, round(support, 6) AS support FROM g WHERE support >= floor""",
    "listing_postings": f"""WITH {RICH} SELECT field, token, count(*) AS listings FROM (SELECT field, token FROM tok UNION ALL SELECT 'part', token FROM parts) x GROUP BY 1, 2""",
    "part_prefixes": f"""WITH {RICH}, d AS (SELECT DISTINCT token FROM parts), p AS (SELECT unnest([token[1:3], token[1:4], token[1:5]]) AS prefix, token FROM d)
        SELECT prefix, count(*) AS tokens, min(token) AS first FROM p GROUP BY prefix""",
    "synonym_terms": f"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part)
        SELECT term, unnest(CASE term {" ".join(f"WHEN '{w}' THEN {g}" for w, g in SYNONYMS.items())} ELSE [term] END) AS alt FROM w""",
    "strict_search": f"""WITH {RICH}, w AS (SELECT *, list_contains(string_split(b, ' '), 'small') AS small, list_contains(string_split(b, ' '), 'ring') AS ring,
            contains(b, 'hot gear') OR contains(replace(b, ' ', ''), 'hotgear') AS hot, list_contains(string_split(b, ' '), 'promo') AS promo FROM rx),
          m AS (SELECT offer_id, shop, CASE WHEN small AND ring THEN 720.0 END AS one, CASE WHEN hot AND NOT promo THEN 360.0 END AS two FROM w)
        SELECT offer_id, shop, greatest(one, two) AS score, CASE WHEN one IS NULL THEN 0 ELSE 2 END AS exact_terms,
          CASE WHEN one IS NULL THEN 1 ELSE 2 END AS matched_terms, CASE WHEN one IS NULL THEN 1 ELSE 2 END AS title_terms, false AS smart_guess
        FROM m WHERE one IS NOT NULL OR two IS NOT NULL""",
    "resolved_images": f"""WITH {LST}, f AS (SELECT l_partkey, s_name, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS r
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2)
        SELECT shop, count(*) FILTER (WHERE image_path <> '' AND (a OR r)) AS found, count(*) FILTER (WHERE image_path <> '' AND a) AS in_folder,
          count(*) AS listings FROM lst LEFT JOIN f ON l_partkey = part AND s_name = shop GROUP BY shop""",
    "candidate_rows": f"""WITH {INDEX}, w AS (SELECT list_contains(string_split(t, ' '), 'small')::INTEGER + list_contains(string_split(t, ' '), 'widget')::INTEGER AS n FROM ix)
        SELECT CAST(n AS DOUBLE) AS seed, count(*) AS listings FROM w WHERE n > 0 GROUP BY n""",
    "extract_page_cards": """SELECT page_id, CAST(pos AS INTEGER) AS pos, href, title FROM (SELECT page_id, generate_subscripts(h, 1) AS pos, unnest(h) AS href,
            unnest(t) AS title FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h,
              regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages) x) y""",
}
