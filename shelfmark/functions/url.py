"""URL parsing and rewriting as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .text import clean_text, col, first_filled, let, or_empty, safe_name


@dataclass(frozen=True)
class AgentSite:
    """The buying-agent site whose product links wrap the marketplace URL."""

    name: str = "agent"
    domain: str = "agent.example.com"

    @property
    def product_prefix(self) -> str:
        return f"https://www.{self.domain}/products?productLink="


DEFAULT_AGENT = AgentSite()

# Offer and item id patterns, first match wins, one list per kind of input.
OFFER_PATTERNS = {
    "index": [r"(?i)(?:offer/|id=)(\d+)"],
    "queue": [r"(?i)(?:offer/|item-1688-|id=)(\d+)"],
    "saved_page": [r"(?i)offer/(\d+)\.html", r"(?i)offerId=(\d+)"],
    "live_page": [
        r"(?i)offer/(\d+)\.html",
        r"(?i)offerId=(\d+)",
        r"(?i)item\.taobao\.com/item\.htm\?[^#\s]*\bid=(\d+)",
        r"(?i)[?&]id=(\d+)",
    ],
}
ITEM_ID_PATTERN = r"(?i)(?:[?&]id=|item\.htm\?id=)(\d+)"

# Markers that make a URL a product page.
LISTING_MARKERS = [
    "/products?",
    "productlink=",
    "/product/",
    "detail.1688.com/offer/",
    "item.taobao.com/item.htm",
]
LOGIN_URL_HINTS = ["/register", "/login", "/signin", "/account/login"]
LOGIN_TEXT_HINTS = ["welcome to login", "sign in", "register", "hello!"]

# Generic URI split of RFC 3986, appendix B. Unlike parse_url it never rejects a URL.
_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(c: Column | str, part: str) -> Column:
    group = {"scheme": 1, "netloc": 2, "path": 3, "query": 4, "fragment": 5}[part]
    return F.regexp_extract(or_empty(c), _URI, group)


def _decode(c: Column) -> Column:
    # A stray percent sign is literal text, so escape it before the strict decoder.
    safe = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), c)


def unquote(c: Column | str) -> Column:
    """One round of percent-decoding; ``+`` and broken escapes stay as they are."""
    return _decode(F.replace(or_empty(c), F.lit("+"), F.lit("%2B")))


def unquote_plus(c: Column | str) -> Column:
    """Percent-decoding of form data, where ``+`` is a space."""
    return _decode(or_empty(c))


def decode_repeatedly(c: Column | str, rounds: int | None = 5) -> Column:
    """Percent-decode until nothing changes, at most ``rounds`` times (None: no bound)."""
    start = or_empty(c)
    if rounds is None:
        # Each effective round shortens the text by two characters or more.
        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(start) / 2).cast("int")))
    else:
        start = clean_text(c)
        steps = F.sequence(F.lit(1), F.lit(rounds))

    def state(text: Column, done: Column) -> Column:
        return F.struct(text.alias("text"), done.alias("done"))

    def step(acc: Column, _: Column) -> Column:
        # A text that a round leaves as it is, such as one with a stray percent sign, is not decoded again.
        again = let(unquote(acc["text"]), lambda new: state(new, (new == acc["text"]) | ~F.contains(new, F.lit("%"))))
        return F.when(acc["done"], acc).otherwise(again)

    decoded = F.aggregate(steps, state(start, F.lit(False)), step)["text"]
    return F.when(F.contains(start, F.lit("%")), decoded).otherwise(start)


def query_pairs(query: Column) -> Column:
    """``array<struct<k,v>>`` of a query string, decoded, blanks kept."""
    pieces = F.filter(F.split(or_empty(query), "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unquote_plus(F.substring_index(p, "=", 1)).alias("k"),
            unquote_plus(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )


def first_query_value(query: Column, name: str) -> Column:
    """First non-blank value of a query parameter (case-sensitive), else empty."""
    named = F.filter(query_pairs(query), lambda p: (p["k"] == name) & (clean_text(p["v"]) != ""))
    return or_empty(clean_text(F.try_element_at(named, F.lit(1))["v"]))


def fragment_query(fragment: Column) -> Column:
    return F.regexp_extract(or_empty(fragment), r"(?s)^[^?]*\?(.*)$", 1)


def product_link(c: Column | str) -> Column:
    """Marketplace URL wrapped in an agent link's ``productLink``, fully decoded."""
    pairs = F.filter(query_pairs(url_part(c, "query")), lambda p: p["k"] == "productLink")
    return decode_repeatedly(or_empty(F.try_element_at(pairs, F.lit(1))["v"]), None)


def _first_match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def offer_id(*cs: Column | str, profile: str = "index") -> Column:
    """Offer id found in any of the URLs, tried in order; empty when there is none."""
    patterns = OFFER_PATTERNS[profile]
    if profile == "index":
        texts = [or_empty(c) for c in cs]
    elif profile == "queue":
        texts = [decode_repeatedly(c) for c in cs]
    else:
        # Page profiles look for each pattern over all URLs before the next pattern.
        texts = [F.concat_ws(" ", *[or_empty(c) for c in cs])]
    hits = [_first_match(t, p) for p in patterns for t in texts]
    return F.coalesce(*hits, F.lit(""))


def item_id(*cs: Column | str) -> Column:
    return F.coalesce(*[_first_match(decode_repeatedly(c), ITEM_ID_PATTERN) for c in cs], F.lit(""))


def quote(c: Column | str) -> Column:
    """Percent-encode everything outside the unreserved set (RFC 3986)."""
    encoded = F.url_encode(or_empty(c))
    encoded = F.replace(encoded, F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def agent_url(source_url: Column | str, site: AgentSite = DEFAULT_AGENT) -> Column:
    """Agent product link for a marketplace URL: the URL is encoded twice."""
    url = or_empty(source_url)
    wrapped = F.concat(F.lit(site.product_prefix), quote(quote(url)))
    return F.when(url == "", F.lit("")).otherwise(wrapped)


def agent_link(agent: Column | str, source: Column | str, alternate: Column | str, site: AgentSite = DEFAULT_AGENT) -> Column:
    """The row's own agent link if it has one, else one made from its source URL."""
    return first_filled(agent, agent_url(first_filled(source, alternate), site))


def normalize_url(c: Column | str, site: AgentSite = DEFAULT_AGENT) -> Column:
    """Submitted URL in canonical form: marketplace offers become agent links."""
    url = clean_text(c)
    host = F.lower(clean_text(url_part(url, "netloc")))
    offer = offer_id(url, profile="queue")
    item = item_id(url)
    offer_link = agent_url(F.concat(F.lit("https://detail.1688.com/offer/"), offer, F.lit(".html")), site)
    item_link = agent_url(F.concat(F.lit("https://item.taobao.com/item.htm?id="), item), site)
    wholesale = F.contains(host, F.lit("1688.com")) | F.contains(host, F.lit("cssbuy.com"))
    return (
        F.when(F.contains(host, F.lit(site.domain)), url)
        .when(wholesale & (offer != ""), offer_link)
        .when(F.contains(host, F.lit("taobao.com")) & (item != ""), item_link)
        .otherwise(url)
    )


def shop_key(c: Column | str) -> Column:
    """Identity of the shop behind a URL.

    A shop id in the query or fragment, then a ``/shops/x`` path, then a seller id; a URL
    with none of them is its own identity.
    """
    url = clean_text(c)
    path, query, fragment = url_part(url, "path"), url_part(url, "query"), url_part(url, "fragment")
    inner = fragment_query(fragment)

    def tagged(tag: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(tag), value))

    pairs = F.filter(query_pairs(query), lambda p: clean_text(p["v"]) != "")
    sorted_query = F.array_join(
        F.sort_array(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"]))), "&"
    )
    whole = F.concat_ws(
        "|",
        F.lower(url_part(url, "scheme")),
        F.lower(clean_text(url_part(url, "netloc"))),
        clean_text(path),
        sorted_query,
        clean_text(fragment),
    )
    key = F.coalesce(
        tagged("shopid:", first_query_value(query, "shopid")),
        tagged("shopid:", first_query_value(inner, "shopid")),
        tagged("shops:", clean_text(F.regexp_extract(path, r"(?i)/shops/([^/?#]+)", 1))),
        tagged("shops:", clean_text(F.regexp_extract(fragment, r"(?i)/shops/([^/?#&]+)", 1))),
        tagged("sellerid:", first_query_value(query, "sellerId")),
        tagged("sellerid:", first_query_value(inner, "sellerId")),
        whole,
    )
    return F.when(url == "", F.lit("")).otherwise(key)


def is_store_url(c: Column | str) -> Column:
    """Whether a URL routes to a shop page."""
    url = clean_text(c)
    path, fragment = F.lower(url_part(url, "path")), F.lower(url_part(url, "fragment"))
    routed = path.rlike("/shops/|/shop/home") | fragment.rlike("/shops/|/shop/home")
    keys = F.concat(query_pairs(url_part(url, "query")), query_pairs(fragment_query(url_part(url, "fragment"))))
    named = F.exists(keys, lambda p: F.lower(p["k"]).isin("shopid", "sellerid"))
    return (url != "") & (routed | named)


def detection_text(c: Column | str) -> Column:
    """Lower-cased text in which listing markers are looked for: the URL, its decoded
    form and the decoded product links in its query or fragment."""
    url = clean_text(c)
    pairs = F.concat(query_pairs(url_part(url, "query")), query_pairs(fragment_query(url_part(url, "fragment"))))
    links = F.transform(
        F.filter(pairs, lambda p: F.lower(p["k"]) == "productlink"), lambda p: decode_repeatedly(p["v"])
    )
    parts = F.filter(F.concat(F.array(url, decode_repeatedly(url)), links), lambda p: p != "")
    return F.lower(F.array_join(parts, " "))


def is_listing_url(c: Column | str) -> Column:
    """Whether a URL is a product page (and not a shop page)."""
    text = detection_text(c)
    marked = F.lit(False)
    for marker in LISTING_MARKERS:
        marked = marked | F.contains(text, F.lit(marker))
    return marked & ~is_store_url(c)


def valid_url(c: Column | str) -> Column:
    url = or_empty(c)
    return F.lower(url_part(url, "scheme")).isin("http", "https") & (url_part(url, "netloc") != "")


def needs_login(url: Column | str, text: Column | str, cards: Column | str) -> Column:
    """A login page: its address says so, or its text does twice and it shows no cards."""
    address = F.lower(or_empty(url))
    body = F.lower(clean_text(text))
    by_address = F.lit(False)
    for hint in LOGIN_URL_HINTS:
        by_address = by_address | F.contains(address, F.lit(hint))
    hits = F.lit(0)
    for hint in LOGIN_TEXT_HINTS:
        hits = hits + F.contains(body, F.lit(hint)).cast("int")
    return by_address | ((F.coalesce(col(cards), F.lit(0)) <= 0) & (hits >= 2))


def relative_path(c: Column | str, root: str) -> Column:
    """Path below ``root``, with forward slashes and no scheme."""
    plain = F.regexp_replace(unquote(c), r"^file:/+", "/")
    base = "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/"
    inside = F.startswith(plain, F.lit(base))
    return F.when(inside, F.substring(plain, len(base) + 1, 1 << 30)).otherwise(plain)


def image_link(image_src: Column | str, image_path: Column | str, prefix: str = "/files/") -> Column:
    """Link to a listing's image: the remote one, else the local path encoded part by part."""
    parts = F.transform(F.split(or_empty(image_path), "/"), quote)
    local = F.concat(F.lit(prefix), F.array_join(parts, "/"))
    return F.when(or_empty(image_src) != "", col(image_src)).when(
        or_empty(image_path) != "", local
    ).otherwise(F.lit(""))


# Image formats recognised in a media type, tried in this order.
_IMAGE_FORMATS = [("jpeg", "jpg"), ("jpg", "jpg"), ("png", "png"), ("webp", "webp"),
                  ("gif", "gif"), ("bmp", "bmp"), ("svg", "svg")]


def mime_extension(mime: Column | str) -> Column:
    kind = F.lower(or_empty(mime))
    expr = None
    for word, ext in _IMAGE_FORMATS:
        hit = F.contains(kind, F.lit(word))
        expr = F.when(hit, F.lit(ext)) if expr is None else expr.when(hit, F.lit(ext))
    return expr.otherwise(F.lit("bin"))


def image_extension(url: Column | str) -> Column:
    """Extension from a data URL's media type, else from the path, else ``jpg``."""
    address = or_empty(url)
    media = F.regexp_extract(address, "(?i)^data:([^;,]+)[;,]", 1)
    suffix = F.lower(F.regexp_extract(url_part(address, "path"), r"\.([a-zA-Z0-9]{2,5})$", 1))
    return (
        F.when(address == "", F.lit("bin"))
        .when(F.startswith(address, F.lit("data:")), mime_extension(media))
        .when(suffix != "", suffix)
        .otherwise(F.lit("jpg"))
    )


def image_file(offer: Column | str, title: Column | str, url: Column | str, profile: str = "live_page") -> Column:
    """File name for a listing's image.

    ``live_page`` takes the extension from any URL; ``saved_page`` only from data URLs.
    """
    address = or_empty(url)
    if profile == "saved_page":
        ext = F.when(F.startswith(address, F.lit("data:")), image_extension(address)).otherwise(F.lit("jpg"))
    else:
        ext = image_extension(address)
    return F.concat(safe_name(first_filled(offer, title), profile), F.lit("."), ext)


def saved_image_file(image: Column | str, offer: Column | str, title: Column | str, position: Column | str) -> Column:
    """Final name under which an image is stored: a known suffix is kept, else ``.jpg``."""
    fallback = F.concat(F.lit("item-"), col(position).cast("string"))
    base = let(
        safe_name(first_filled(image, offer, title, fallback), "queue", ""),
        lambda b: F.when(b == "", fallback).otherwise(b),
    )
    known = F.lower(base).rlike(r"[^.]\.(jpg|jpeg|png|webp|gif|bmp|svg)$")
    return F.when(known, base).otherwise(F.concat(base, F.lit(".jpg")))


def shop_name_from_page(heading: Column | str, title: Column | str, url: Column | str, agent: str = "agent") -> Column:
    """Shop name from the page's shop heading, else its title, else its last path part."""
    named = F.regexp_replace(clean_text(title), rf"(?i)\s*[-|]\s*{agent}.*$", "")
    named = F.trim(F.regexp_replace(named, r"(?i)\s*[-|]\s*shop.*$", ""))
    parts = F.filter(F.split(url_part(url, "path"), "/"), lambda p: p != "")
    slug = F.regexp_replace(clean_text(F.try_element_at(parts, F.lit(-1))), "[-_]+", " ")
    return first_filled(clean_text(heading), named, slug)
