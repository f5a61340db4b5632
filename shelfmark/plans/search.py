"""Ranked listing search: filters, score, order and page as one declarative plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import price as P, text as X
from ..operators.listings import has_image
from .query_text import Filters, Query, compile_query, fold, inline_filters, mixes_letters_and_digits, normalize, squeeze

DEFAULT_LIMIT = 240
# Parts that each request's rows are ranked in before the final ranking.
RANK_PARTS = 64
# Rows up to the end of a page that each part keeps while its matches are counted.
PAGE_ROWS = 10_000
SORTS = ("match", "price-asc", "price-desc", "title", "shop")
NO_PRICE_LAST, NO_PRICE_LOW = 1e12, -1.0
# Requests scored in one pass over the index.
BATCH = 16


@dataclass(frozen=True)
class Request:
    query: str = ""
    sort: str = "match"
    offset: int = 0
    limit: int = DEFAULT_LIMIT
    min_price: float | None = None
    max_price: float | None = None
    has_image: bool = False
    shop_exact: str = ""
    shop_filter: str = ""
    offer_filter: str = ""
    disabled_shops: tuple[str, ...] = field(default=())

    def page(self) -> tuple[int, int]:
        limit = max(1, int(self.limit or DEFAULT_LIMIT))
        return max(0, int(self.offset or 0)), limit


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _hit(term: str, text: str, packed: str) -> Column:
    return F.contains(F.col(text if mixes_letters_and_digits(term) else packed), F.lit(term))


def is_match(query: Query | str) -> Column:
    """Whether :func:`search_score` gives an indexed row a score, without working it out."""
    q = compile_query(query) if isinstance(query, str) else query
    # The blob holds title and offer id, so a term found there is found in the blob.
    groups = [reduce(lambda a, b: a & b, [_hit(t, "_blob", "_compact") for t in g], F.lit(True)) for g in q.groups]
    found = _any(groups) if groups else F.lit(True)
    return found & ~_any([F.contains("_blob", F.lit(t)) for t in q.exclude])


def search_score(query: Query | str) -> Column:
    """Score of an indexed row for a query; NULL means no match.

    A term adds 800 in the offer id, 500 in the title and 120 anywhere; a group needs all
    its terms and the best group counts. The whole query written as one word adds 4000 in
    the title, and its compact form 2500 in the title or offer id.

    Terms have no spaces, so looking inside single tokens is a substring test on the
    normalised text; terms that are no part numbers may also run across tokens.
    """
    q = compile_query(query) if isinstance(query, str) else query
    hit = _hit
    bonus = F.lit(0)
    if q.title_word:
        stripped = F.regexp_replace("_raw_title", "[-_ ]", "")
        bonus = bonus + F.when(F.contains(stripped, F.lit(q.title_word)), 4000).otherwise(0)
    if q.compact:
        whole = hit(q.compact, "_title", "_title_compact") | hit(q.compact, "_offer", "_offer_compact")
        bonus = bonus + F.when(whole, 2500).otherwise(0)

    scores = []
    for group in q.groups:
        total, all_found = bonus, F.lit(True)
        for term in group:
            offer = hit(term, "_offer", "_offer_compact")
            title = hit(term, "_title", "_title_compact")
            blob = hit(term, "_blob", "_compact")
            for found, points in ((offer, 800), (title, 500), (blob, 120)):
                total = total + F.when(found, points).otherwise(0)
            # The blob holds title and offer id, so a term found there is found in the blob.
            all_found = all_found & blob
        scores.append(F.when(all_found, total))
    best = F.lit(1) if not scores else scores[0] if len(scores) == 1 else F.greatest(*scores)
    ruled_out = _any([F.contains("_blob", F.lit(t)) for t in q.exclude])
    score = F.when(~ruled_out, best) if q.exclude else best
    return score.cast("double")


def structured_filter(request: Request) -> Column:
    """Conditions of a request other than its text. Range and equality tests on plain
    columns come out as pushed-down Parquet filters."""
    conditions = []
    disabled = sorted({" ".join(s.split()) for s in request.disabled_shops} - {""})
    if disabled:
        conditions.append(~F.col("shop").isin(disabled))
    if request.shop_exact:
        conditions.append(F.col("shop") == " ".join(request.shop_exact.split()))
    if request.min_price is not None:
        conditions.append(F.col("price_value") >= float(request.min_price))
    if request.max_price is not None:
        conditions.append(F.col("price_value") <= float(request.max_price))
    if request.has_image:
        conditions.append(has_image())
    if normalize(request.shop_filter):
        conditions.append(F.contains("_shop", F.lit(normalize(request.shop_filter))))
    if squeeze(request.offer_filter):
        conditions.append(F.contains("_offer_compact", F.lit(squeeze(request.offer_filter))))
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def exclude_shops(df: DataFrame, prefs: DataFrame) -> DataFrame:
    """Leave out the shops a preference table marks as disabled."""
    disabled = prefs.filter(F.col("kind") == "disabled").select("shop").distinct()
    return df.join(disabled, "shop", "left_anti")


def sort_keys(sort: str, get=F.col) -> list[tuple[Column, bool]]:
    """Keys of a total order as ``(value, descending)``, none of them NULL.

    ``get`` turns a column name into a value, so the same keys can be made for one known
    row. Rows that tie keep the order of the stored index.
    """
    shop, title, price = F.lower(get("shop")), F.lower(get("title")), get("price_value")
    stored = [shop, title, price.isNull(), F.coalesce(price, F.lit(0.0)), F.lower(get("source_file")),
              get("source_file"), get("row_number")]
    first, rest = {
        "price-asc": ([(F.coalesce(price, F.lit(NO_PRICE_LAST)), False), (title, False)], stored),
        "price-desc": ([(F.coalesce(price, F.lit(NO_PRICE_LOW)), True), (title, False)], stored),
        "title": ([(title, False)], stored),
        "shop": ([], stored),
    }.get(sort, ([(get("score"), True)], stored))
    return first + [(k, False) for k in rest]


def keyed(df: DataFrame, sort: str) -> tuple[DataFrame, list[Column]]:
    """Rows with their sort keys as columns, and the order over them.

    A sort evaluates its expressions at every comparison, so they are computed before.
    """
    keys = sort_keys(sort)
    df = df.withColumns({f"_k{n}": k for n, (k, _) in enumerate(keys)})
    return df, [F.col(f"_k{n}").desc() if down else F.col(f"_k{n}") for n, (_, down) in enumerate(keys)]


def matches(index: DataFrame, request: Request) -> DataFrame:
    """All matching rows with their score, unordered."""
    scored = index.filter(structured_filter(request)).withColumn("score", search_score(request.query))
    return scored.filter(F.col("score").isNotNull())


def paginate(ordered: DataFrame, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One page of an ordered result: offset from 0, at least one row, 0 meaning the default."""
    start, size = Request(offset=offset, limit=limit).page()
    return ordered.offset(start).limit(size) if start else ordered.limit(size)


def search(index: DataFrame, request: Request, with_total: bool = True) -> DataFrame:
    """One page of ranked results with ``rank`` (from 1) and ``total``.

    Without the total, the order plus limit is planned as a top-k per task, so only page-sized data moves. With it, the
    matches are counted and cut to what can be on the page in parts, so that rows are read and scored once. Where every row
    matches, or a page lies deep, counting apart is the cheaper way.
    """
    found = matches(index, request)
    start, size = request.page()
    rows, order = keyed(found, request.sort)
    query = compile_query(request.query)
    once = with_total and bool(query.groups) and start + size <= PAGE_ROWS
    if once:
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("source_file", "row_number"), F.lit(RANK_PARTS)))
        of_part = Window.partitionBy("_part")
        rows = rows.withColumns({"_place": F.row_number().over(of_part.orderBy(*order)), "_many": F.count("*").over(of_part)})
        rows = rows.filter(F.col("_place") <= start + size)
        many = F.sum(F.when(F.col("_place") == 1, F.col("_many")).otherwise(0)).over(Window.partitionBy(F.lit(0)))
        rows = rows.withColumn("total", many).drop("_part", "_place", "_many")
    page = paginate(rows.orderBy(*order), start, size)
    # Only the rows of the page are left to number here.
    page = page.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + start)
    if with_total and not once:
        # Counted without scores; rows are read once more for it.
        counted = index.filter(structured_filter(request)).filter(is_match(request.query))
        page = page.withColumn("total", counted.agg(F.count("*").alias("n")).scalar())
    return page.select(*[f"`{c}`" for c in found.columns], "rank", *(["total"] if with_total else []))


def next_page(request: Request, shown: int) -> Request:
    """Request for the rows after the ones already shown."""
    return replace(request, offset=shown)


def after(index: DataFrame, request: Request, last: dict) -> DataFrame:
    """The page behind ``last``, the last row shown, found by key instead of by offset.

    Every page costs the same, however deep. ``last`` needs ``score, shop, title,
    price_value, source_file, row_number``.
    """
    found = matches(index, request)
    here = sort_keys(request.sort, lambda c: F.lit(last[c]).cast(found.schema[c].dataType))
    behind, same = F.lit(False), F.lit(True)
    for (key, down), (value, _) in zip(sort_keys(request.sort), here):
        behind = behind | (same & (key < value if down else key > value))
        same = same & (key == value)
    rows, order = keyed(found.filter(behind), request.sort)
    return rows.orderBy(*order).limit(request.page()[1]).select(*found.columns)


def search_batch(index: DataFrame, requests: dict[str, Request]) -> DataFrame:
    """Pages for many requests, with ``request_id, rank, total``.

    The index is scanned once per 16 requests: each row carries an array with the requests
    it matches, which is empty for most rows and exploded after that. Per request, only
    rows that can be on the page reach the ranking shuffle.
    """
    ids = list(requests)
    parts = [_batch(index, {i: requests[i] for i in ids[at : at + BATCH]}) for at in range(0, len(ids), BATCH)]
    return reduce(DataFrame.unionByName, parts)


def _batch(index: DataFrame, requests: dict[str, Request]) -> DataFrame:
    # Scores are columns of a generator, so that they are computed in generated code, and once.
    scores = {f"_s{n}": F.when(structured_filter(r), search_score(r.query)) for n, r in enumerate(requests.values())}
    hits = [F.struct(F.lit(name).alias("request_id"), F.col(f"_s{n}").alias("score")) for n, name in enumerate(requests)]
    found = X.compute_once(index, scores).filter(F.coalesce(*scores).isNotNull())
    found = found.withColumn("_hit", F.explode(F.filter(F.array(*hits), lambda h: h["score"].isNotNull())))
    found = found.withColumns({"request_id": F.col("_hit.request_id"), "score": F.col("_hit.score")})
    found = found.drop("_hit", *scores)
    # All orders are a number, then a text, then the stored order, so one ranking serves
    # requests with different sorts.
    number, text = F.lit(0.0), F.lit("")
    for name, r in requests.items():
        (first, down), *_ = sort_keys(r.sort)
        mine = F.col("request_id") == name
        if r.sort in ("price-asc", "price-desc") or r.sort not in SORTS or r.sort == "match":
            number = F.when(mine, -first if down else first).otherwise(number)
        if r.sort in ("price-asc", "price-desc", "title"):
            text = F.when(mine, F.lower("title")).otherwise(text)
    found, order = keyed(X.compute_once(found, {"_n": number, "_t": text}), "shop")
    # A row on a page is among the best of its part too. So the matches of a request, however many and however deep
    # its page, are cut in parts first and only the rows left meet for the final ranking.
    found = found.withColumn("_part", F.pmod(F.xxhash64("source_file", "row_number"), F.lit(RANK_PARTS)))
    bound = F.element_at(F.create_map(*[x for n, r in requests.items() for x in (F.lit(n), F.lit(sum(r.page())))]), F.col("request_id"))
    last = max(sum(r.page()) for r in requests.values())
    # The parts count their matches too, so that rows are read and scored once.
    of_part, of_request = Window.partitionBy("request_id", "_part"), Window.partitionBy("request_id")
    found = found.withColumns({"_place": F.row_number().over(of_part.orderBy("_n", "_t", *order)), "_many": F.count("*").over(of_part)})
    found = found.filter((F.col("_place") <= last) & (F.col("_place") <= bound))
    ranked = found.withColumns({
        "rank": F.row_number().over(of_request.orderBy("_n", "_t", *order)),
        "total": F.sum(F.when(F.col("_place") == 1, F.col("_many")).otherwise(0)).over(of_request)}).filter(F.col("rank") <= last)
    wanted = _any(
        [
            (F.col("request_id") == n) & (F.col("rank") > r.page()[0]) & (F.col("rank") <= sum(r.page()))
            for n, r in requests.items()
        ]
    )
    page = ranked.filter(wanted)
    return page.drop("_n", "_t", "_part", "_place", "_many", *[c for c in page.columns if c.startswith("_k")])


def resolve_filters(controls: Request, text_filters: Filters, rates: P.Rates, currency: str = "cny",
                    has_query_image: bool = False) -> Request:
    """Combine the controls with filters typed into the text.

    Controls win. Bounds from the text are in the display currency; reversed bounds are
    swapped.
    """

    def to_base(value: float | None) -> float | None:
        if value is None or currency == P.CANONICAL:
            return value
        if not (rates.usd_to_cad > 0 and rates.cny_to_cad > 0):
            return None
        in_cad = value * (rates.usd_to_cad if currency == "usd" else 1.0)
        return in_cad / rates.cny_to_cad

    low = controls.min_price if controls.min_price is not None else to_base(text_filters.min_price)
    high = controls.max_price if controls.max_price is not None else to_base(text_filters.max_price)
    if low is not None and high is not None and low > high:
        low, high = high, low
    return replace(
        controls,
        min_price=low,
        max_price=high,
        has_image=bool(controls.has_image or text_filters.has_image or has_query_image),
        shop_filter=text_filters.shop or controls.shop_filter,
        offer_filter=text_filters.offer or controls.offer_filter,
    )


def request_from_text(text: str, controls: Request = Request(), rates: P.Rates = P.Rates(0, 0),
                      currency: str = "cny") -> Request:
    """What the search box sends: inline filters taken out of the text and resolved."""
    plain, found = inline_filters(text)
    return replace(resolve_filters(controls, found, rates, currency), query=plain)


def is_browse(request: Request) -> bool:
    """No terms and no filters: the plan then skips scoring, since the score is constant."""
    return not (
        compile_query(request.query).groups
        or compile_query(request.query).exclude
        or request.shop_exact
        or normalize(request.shop_filter)
        or squeeze(request.offer_filter)
        or request.has_image
        or request.min_price is not None
        or request.max_price is not None
    )


def search_shops(shops: DataFrame, text: str) -> DataFrame:
    """Shops whose folded name contains the folded text."""
    wanted = fold(text)
    return shops.filter(F.contains(X.normalize_fold("shop"), F.lit(wanted))) if wanted else shops
