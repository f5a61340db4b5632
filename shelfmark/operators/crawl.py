"""Crawl observations: merging repeated sightings and measuring progress.

Observations have ``shop, stream, page, seq, row_key`` and the row's columns. ``seq`` is
the order of sightings within a shop. A shop may hold any share of the data, so nothing
here windows over a whole shop: first sightings, stop rules and repeats are all grouped
aggregates that combine before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X, url as U

BASE_WAIT, MAX_WAIT = 60, 1200
SHOP_LIMIT, CATEGORY_LIMIT = 5, 3
CHECKPOINT_PAGES = 3
MANY_ROWS, MANY_PAGES = 1800, 90

# Texts that show a request was blocked.
BLOCKED_TEXT = (
    r"(?i)too\s+many\s+requests|rate\s*limit|try\s+again\s+later|request\s+too\s+frequent|too\s+frequent"
    r"|access\s+denied|robot|captcha|verify|system\s+busy|频繁|稍后再试|验证码|验证|风控|访问受限"
)
IMAGE_PATH = r"(?i)\.(?:png|jpe?g|gif|webp|svg|bmp)$"


def sequence_number(df: DataFrame, by: list[str], order: list[str], levels: list[Column], name: str) -> DataFrame:
    """``row_number() OVER (PARTITION BY by ORDER BY order)`` without one task per ``by``.

    ``levels`` go from coarse to fine and must not decrease along ``order`` (for a time
    column: hour, then second). Rows are numbered inside the finest group; the groups in
    front are added as offsets from running sums over counts, one level at a time.
    """
    names = [f"_l{n}" for n in range(len(levels))]
    base = df.withColumns(dict(zip(names, levels)))
    finest = [*by, *names]
    counts = base.groupBy(*finest).agg(F.count("*").alias("_n"))
    offsets = None
    for depth in range(1, len(names) + 1):
        keys, inner = [*by, *names[: depth - 1]], names[depth - 1]
        level = counts.groupBy(*keys, inner).agg(F.sum("_n").alias("_n"))
        before = Window.partitionBy(*keys).orderBy(inner).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*keys, inner, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_o{depth}"))
        offsets = level if offsets is None else level.join(offsets, keys)
    total = reduce(lambda a, b: a + b, [F.col(f"_o{d}") for d in range(1, len(names) + 1)])
    offsets = offsets.select(*finest, total.alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*finest).orderBy(*order))
    numbered = base.withColumn("_local", local).join(offsets, finest)
    return numbered.withColumn(name, F.col("_local") + F.col("_offset")).drop(*names, "_local", "_offset")


def row_key(agent: str = "agent") -> Column:
    """Key of an observation: offer id, source URL, alternate URL, agent URL or title."""
    return X.first_filled("offer_id", "source_url", "source_1688_url", f"{agent}_url", "title")


def partial_merge(obs: DataFrame, keys: list[str], seq: str = "seq", keep: tuple[str, ...] = ("image_url", "image_file")) -> DataFrame:
    """Last row per key, and for each ``keep`` column its last filled value with its place.

    Partial results can be merged again in any order by :func:`merge_partials`.
    """
    columns = [c for c in obs.columns if c not in keys]
    kept = [c for c in keep if c in columns]
    spare = [
        F.max(F.when(X.or_empty(c) != "", F.struct(F.col(seq).alias("at"), F.col(c).alias("value")))).alias(f"_{c}")
        for c in kept
    ]
    return obs.groupBy(*keys).agg(F.max_by(F.struct(*columns), seq).alias("_row"), *spare)


def combine_partials(partials: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Combine partial merges to one of the same form, which can be combined with later ones."""
    spare = [c for c in partials.columns if c not in (*keys, "_row")]
    return partials.groupBy(*keys).agg(
        F.max_by("_row", F.col(f"_row.{seq}")).alias("_row"), *[F.max(c).alias(c) for c in spare]
    )


def merge_partials(partials: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Combine partial merges and finish the rows."""
    spare = [c for c in partials.columns if c not in (*keys, "_row")]
    return _finish(combine_partials(partials, keys, seq), keys, spare)


def _finish(merged: DataFrame, keys: list[str], spare: list[str]) -> DataFrame:
    fields = merged.schema["_row"].dataType.fieldNames()
    out = []
    for f in fields:
        own = F.col("_row")[f]
        out.append((X.first_filled(own, F.col(f"_{f}")["value"]) if f"_{f}" in spare else own).alias(f))
    return merged.select(*keys, *out)


def merge_observations(obs: DataFrame, keys: list[str] | None = None, seq: str = "seq",
                       keep: tuple[str, ...] = ("image_url", "image_file")) -> DataFrame:
    """One row per key: the last sighting, but an empty image keeps the last one seen."""
    keys = keys or ["shop", "row_key"]
    obs = obs.filter(X.or_empty(keys[-1]) != "")
    partial = partial_merge(obs, keys, seq, keep)
    return _finish(partial, keys, [c for c in partial.columns if c not in (*keys, "_row")])


def dedupe_last(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Last whole row per non-empty key."""
    columns = [c for c in df.columns if c != key]
    last = df.filter(X.or_empty(key) != "").groupBy(key).agg(F.max_by(F.struct(*columns), pos).alias("_r"))
    return last.select(key, "_r.*")


def export_order(df: DataFrame) -> DataFrame:
    """Order of a saved export: offer id, or title where there is none."""
    return df.orderBy(X.first_filled("offer_id", "title"), "title")


def _streams(obs: DataFrame) -> list[str]:
    return ["shop", "stream"] if "stream" in obs.columns else ["shop"]


def new_keys_per_page(obs: DataFrame) -> DataFrame:
    """Sightings and first sightings per page: ``shop[, stream], page, seen, added``.

    A key counts as new once per shop, over all of its streams.
    """
    by = [*_streams(obs), "page"]
    seen = obs.groupBy(*by).agg(F.count("*").alias("seen"))
    keyed = obs.filter(X.or_empty("row_key") != "")
    first = keyed.groupBy("shop", "row_key").agg(F.min_by(F.struct(*by[1:]), "seq").alias("_f"))
    added = first.groupBy("shop", "_f").agg(F.count("*").alias("added")).select("shop", "_f.*", "added")
    return seen.join(added, by, "left").withColumn("added", F.coalesce("added", F.lit(0)))


def stop_page(pages: DataFrame, limit: int = SHOP_LIMIT) -> DataFrame:
    """First page of a stream that ends ``limit`` pages in a row with nothing new.

    ``pages`` comes from :func:`new_keys_per_page`; pages are numbered without gaps. A page
    without news counts towards itself and the ``limit - 1`` pages behind it, and a page
    that collects ``limit`` such counts is a stop.
    """
    by = _streams(pages)
    idle = pages.filter(F.col("added") == 0)
    spread = idle.select(*by, F.explode(F.sequence(F.col("page"), F.col("page") + (limit - 1))).alias("stop_page"))
    full = spread.groupBy(*by, "stop_page").agg(F.count("*").alias("n")).filter(F.col("n") == limit)
    return full.groupBy(*by).agg(F.min("stop_page").alias("stop_page"))


def page_signatures(obs: DataFrame) -> DataFrame:
    """Ordered keys of each page joined with ``|``. A page holds what one screen showed."""
    by = [*_streams(obs), "page"]
    entries = F.sort_array(F.collect_list(F.struct("seq", "row_key")))
    keyed = obs.filter(X.or_empty("row_key") != "")
    return keyed.groupBy(*by).agg(F.array_join(F.transform(entries, lambda e: e["row_key"]), "|").alias("signature"))


def repeated_pages(pages: DataFrame) -> DataFrame:
    """Pages whose signature an earlier page of the stream had, with that page."""
    by = _streams(pages)
    # Compare fixed-size digests instead of long texts.
    hashed = pages.filter(F.col("signature") != "").withColumn("_h", F.sha2("signature", 256))
    first = hashed.groupBy(*by, "_h").agg(F.min("page").alias("first_page"))
    return hashed.join(first, [*by, "_h"]).filter(F.col("page") > F.col("first_page")).drop("_h", "signature")


def checkpoints(pages: DataFrame, every: int = CHECKPOINT_PAGES) -> DataFrame:
    """Pages after which a checkpoint is due: every ``every`` pages of a stream and its last one.

    The stride starts with the stream's first page, also where pages are numbered on from stream to stream.
    """
    by = _streams(pages)
    numbered = pages.select(*by, "page").distinct()
    ends = numbered.groupBy(*by).agg(F.min("page").alias("_first"), F.max("page").alias("_last"))
    due = ((F.col("page") - F.col("_first") + 1) % every == 0) | (F.col("page") == F.col("_last"))
    return numbered.join(ends, by).filter(due).drop("_first", "_last")


def backoff(attempt: Column | str) -> Column:
    """Seconds to wait before a retry: doubles from one minute up to twenty."""
    n = F.greatest(F.lit(0), X.col(attempt))
    return F.least(F.lit(BASE_WAIT) * F.pow(F.lit(2.0), n), F.lit(float(MAX_WAIT)))


def is_rate_limited(status: Column | str, url: Column | str, text: Column | str | None = None,
                    site: str = "agent.example.com", agent: str = "agent") -> Column:
    """A 429, a 403 on a page of the site itself (images do not count), or a blocking text."""
    code, address = X.col(status), X.or_empty(url)
    host = F.lower(U.url_part(address, "netloc"))
    own = (host == site) | F.contains(host, F.lit(agent))
    page = ~U.url_part(address, "path").rlike(IMAGE_PATH)
    by_status = (code == 429) | ((code == 403) & own & page)
    if text is None:
        return F.coalesce(by_status, F.lit(False))
    return F.coalesce(by_status, F.lit(False)) | X.clean_text(text).rlike(BLOCKED_TEXT)


def rate_limit_active(events: DataFrame, signal: Column, ts: str = "ts", by: str = "shop", seconds: int = 120) -> DataFrame:
    """Mark events with a limit signal in the ``seconds`` up to them.

    Time is cut into buckets of that length. A signal of the same bucket is recent if it is
    not later than the event, for which the bucket's first signal decides; one of the
    bucket before is recent if its last signal is. So two numbers per bucket are enough.
    """
    width = seconds * 1_000_000
    staged = events.withColumns({"_t": F.unix_micros(F.col(ts).cast("timestamp")), "_hit": signal})
    staged = staged.withColumn("_b", F.col("_t") - F.pmod(F.col("_t"), F.lit(width)))
    marks = staged.filter("_hit").groupBy(by, "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    here = marks.select(by, "_b", "_first")
    before = marks.select(by, (F.col("_b") + width).alias("_b"), F.col("_last"))
    joined = staged.join(here, [by, "_b"], "left").join(before, [by, "_b"], "left")
    active = F.coalesce(F.col("_first") <= F.col("_t"), F.lit(False)) | F.coalesce(
        F.col("_last") > F.col("_t") - width, F.lit(False)
    )
    return joined.withColumn("active", active).drop("_t", "_hit", "_b", "_first", "_last")


def run_summary(runs: DataFrame) -> DataFrame:
    """One row per shop over its crawl streams: text, pages and whether any stopped early.

    ``runs`` has one row per stream: ``shop, pos, sort_label, pages, reason, stopped_early``.
    """
    line = F.concat(F.col("sort_label"), F.lit(": "), F.col("pages").cast("string"), F.lit(" pages ("), F.col("reason"), F.lit(")"))
    lines = F.sort_array(F.collect_list(F.struct(F.col("pos"), line.alias("line"))))
    return runs.groupBy("shop").agg(
        F.array_join(F.transform(lines, lambda e: e["line"]), "; ").alias("completion_reason"),
        F.bool_or("stopped_early").alias("stopped_early"),
        F.sum("pages").alias("pages_visited"),
        F.count("*").alias("streams"),
    )


def categories(tabs: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct category labels per shop with their ``place`` in tab order, the first tab left out.

    With ``most``, only the first that many of each shop.
    """
    first = tabs.groupBy("shop", "label").agg(F.min("pos").alias("pos")).filter(F.col("pos") > 0)
    place = F.row_number().over(Window.partitionBy("shop").orderBy("pos"))
    placed = first.withColumn("place", place)
    return placed if most is None else placed.filter(F.col("place") <= most)


def usable(manifests: DataFrame) -> DataFrame:
    """Manifests with rows that are finished: ``row_count, status`` decide."""
    status = F.lower(X.clean_text("status"))
    return manifests.filter((F.col("row_count") > 0) & ~status.isin("checkpoint", "error", "failed"))


def is_complete() -> Column:
    """Whether saved data is complete: not stopped early, and not a big crawl that ended only
    because the next page stopped changing."""
    early = F.coalesce(F.col("stopped_early"), F.lit(False))
    reason = F.lower(X.clean_text("completion_reason"))
    suspicious = (
        (F.coalesce("row_count", F.lit(0)) >= MANY_ROWS)
        & (F.coalesce("pages_visited", F.lit(0)) >= MANY_PAGES)
        & F.contains(reason, F.lit("next page stopped changing"))
    )
    return ~early & ~suspicious


def plan_crawl(urls: DataFrame, saved: DataFrame, queued: DataFrame, force: bool = False,
               site: U.AgentSite = U.DEFAULT_AGENT) -> DataFrame:
    """Submitted URLs still to be collected: ``pos, url, shop_key``.

    ``urls`` has ``pos, url``; ``saved`` (manifests) and ``queued`` have ``shop_key``. URLs
    are made canonical, invalid ones and repeats go, one URL per shop stays, and shops
    already queued, or saved unless forced, are left out.
    """
    canonical = urls.select("pos", U.normalize_url("url", site).alias("url"))
    valid = canonical.filter((F.col("url") != "") & U.valid_url("url"))
    once = valid.groupBy("url").agg(F.min("pos").alias("pos"))
    keyed = once.withColumn("shop_key", U.shop_key("url"))
    first = keyed.groupBy("shop_key").agg(F.min_by(F.struct("pos", "url"), "pos").alias("r"))
    plan = first.select("r.pos", "r.url", "shop_key")
    plan = plan.join(queued.select("shop_key").distinct(), "shop_key", "left_anti")
    if not force:
        plan = plan.join(saved.select("shop_key").distinct(), "shop_key", "left_anti")
    return plan


def existing_store(urls: DataFrame, manifests: DataFrame, agent: str = "agent") -> DataFrame:
    """Saved data of a submitted store: by shop identity, else by a telling shop name.

    ``urls`` has ``url, shop_name``; ``manifests`` has ``path, source_url, shop_name``.
    """
    asked = urls.withColumn("shop_key", U.shop_key("url"))
    by_key = (
        manifests.withColumn("shop_key", U.shop_key("source_url"))
        .filter("shop_key <> ''").groupBy("shop_key").agg(F.min("path").alias("_by_key"))
    )
    by_name = manifests.groupBy("shop_name").agg(F.min("path").alias("_by_name"))
    telling = ~X.is_generic_name("shop_name", agent)
    joined = asked.join(by_key, "shop_key", "left").join(by_name, "shop_name", "left")
    return joined.withColumn(
        "manifest_path", F.coalesce("_by_key", F.when(telling, F.col("_by_name")))
    ).drop("_by_key", "_by_name")
