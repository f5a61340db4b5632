"""Raw source rows to normalised listings and their search columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import price as P, text as X, url as U

PUBLIC = ["id", "shop", "title", "price_text", "price_value", "sales", "offer_id", "source_url",
          "image_path", "image_src", "source_file"]
UNTITLED = "(untitled listing)"


def spellings(name: str) -> list[str]:
    """Accepted headers of a column: ``price_value`` and ``Price Value``."""
    words = [w if w.isdigit() else w.upper() if w in ("url", "id") else w.capitalize() for w in name.split("_")]
    return [name, " ".join(words)]


def alias_picker(df: DataFrame):
    """``pick(name)``: the first filled spelling of a column, from a ``fields`` map or flat columns."""
    in_map = "fields" in df.columns and isinstance(df.schema["fields"].dataType, T.MapType)

    def pick(name: str) -> Column:
        if in_map:
            return X.first_filled(*[F.try_element_at("fields", F.lit(s)) for s in spellings(name)])
        found = [F.col(f"`{s}`").cast("string") for s in spellings(name) if s in df.columns]
        return F.lit("") if not found else X.or_empty(found[0]) if len(found) == 1 else X.first_filled(*found)

    return pick


def normalize_listings(raw: DataFrame, agent: str = "agent") -> DataFrame:
    """Raw rows (``source_file, shop, row_number`` and the listing fields) to listings.

    Fills the price columns from each other, back-fills the two source URLs, derives the
    offer id and a stable id, and drops rows without any title, URL or image.
    """
    pick = alias_picker(raw)
    names = ["title", "price", "price_currency", "price_value", "price_original", "price_original_currency",
             "price_original_value", "sales", f"{agent}_url", "source_url", "source_1688_url", "image_url",
             "image_file", "zip_path", "offer_id"]
    picked = raw.select("shop", "source_file", "row_number", *[pick(n).alias(f"_{n}") for n in names])
    # Tested before anything is cleaned: the first filled one settles it.
    shown = ["title", f"{agent}_url", "source_url", "source_1688_url", "image_url", "image_file"]
    picked = picked.filter(reduce(lambda a, b: a | b, [X.is_filled(f"_{n}") for n in shown]))
    # Texts are tested together; only rows where some text is untidy go through the patterns.
    texts = ["title", "price", "price_original", "sales", f"{agent}_url", "source_url", "source_1688_url", "image_url", "image_file",
             "zip_path", "offer_id"]
    picked = picked.withColumn("_untidy", X.untidy(F.concat_ws("|", *[f"_{n}" for n in texts])))

    def clean(name: str) -> Column:
        return X.clean_text(f"_{name}", F.col("_untidy"))

    staged = picked.select(
        "shop",
        "source_file",
        "row_number",
        clean("title").alias("title0"),
        clean("price").alias("price_text"),
        P.currency_code("_price_currency").alias("currency0"),
        P.coerce_number("_price_value").alias("value0"),
        clean("price_original").alias("original0"),
        P.currency_code("_price_original_currency").alias("original_currency0"),
        P.coerce_number("_price_original_value").alias("original_value0"),
        clean("sales").alias("sales"),
        clean(f"{agent}_url").alias("agent_url"),
        clean("source_url").alias("source0"),
        clean("source_1688_url").alias("alternate0"),
        clean("image_url").alias("image_url"),
        clean("image_file").alias("image_file"),
        clean("zip_path").alias("zip_path"),
        clean("offer_id").alias("offer0"),
    )
    staged = staged.withColumns(
        {
            "source_url": X.first_filled("source0", "alternate0"),
            "alternate_url": X.first_filled("alternate0", "source0"),
            "price_currency": P.currency_of(F.col("price_text"), F.col("currency0")),
            "price_value": F.coalesce("value0", P.number_in(F.col("price_text"))),
            "price_original": X.first_filled("original0", "price_text"),
        }
    )
    # Bound, so that the many patterns do not swell the code that runs for rows with an id of their own.
    urls = F.struct("agent_url", "source_url", "alternate_url", "image_file")
    found_id = X.let(urls, lambda u: U.offer_id(u["agent_url"], u["source_url"], u["alternate_url"], u["image_file"]))
    staged = staged.withColumns(
        {
            "price_original_currency": P.currency_of(
                F.col("price_original"), X.first_filled("original_currency0", "price_currency")
            ),
            "price_original_value": F.coalesce("original_value0", P.number_in(F.col("price_original"))),
            "offer_id": X.first_filled("offer0", found_id),
        }
    )
    key = X.listing_id(
        "shop", "source_file", F.col("row_number").cast("string"), "offer_id", "title0", "agent_url",
        "source_url", "alternate_url",
    )
    return staged.select(
        key.alias("id"),
        "shop",
        X.first_filled("title0", F.lit(UNTITLED)).alias("title"),
        "price_text",
        "price_value",
        "sales",
        "offer_id",
        "source_url",
        F.lit("").alias("image_path"),
        F.col("image_url").alias("image_src"),
        "source_file",
        "row_number",
        "agent_url",
        "image_file",
        "zip_path",
        "price_currency",
        "price_original",
        "price_original_currency",
        "price_original_value",
    )


def index_listings(listings: DataFrame) -> DataFrame:
    """Add the search columns (named with a leading underscore) to normalised listings.

    The blob's title, shop and offer id are taken over as they are normalised already; the
    remaining parts are normalised in one go.
    """
    df = X.compute_once(
        listings,
        {"_title": X.normalize_search("title"), "_offer": X.normalize_search("offer_id"), "_shop": X.normalize_search("shop")},
    )
    tail = X.normalize_search(F.concat_ws(" ", *[X.or_empty(c) for c in ("price_text", "sales", "source_url")]))
    parts = [F.nullif(c, F.lit("")) for c in (F.col("_title"), F.col("_shop"), F.col("_offer"), tail)]
    return X.compute_once(df, {"_blob": F.concat_ws(" ", *parts)}).withColumns(derived_columns())


def derived_columns() -> dict[str, Column]:
    """Search columns that follow at little cost from the normalised texts; a stored index leaves them out."""
    return {
        "_raw_title": F.lower("title"),
        "_title_compact": X.compact("_title"),
        "_offer_compact": X.compact("_offer"),
        "_compact": X.compact("_blob"),
        "_title_tokens": X.tokens("_title"),
        "_offer_tokens": X.tokens("_offer"),
        "_tokens": X.tokens("_blob"),
    }


def with_derived(index: DataFrame) -> DataFrame:
    """A stored index with the search columns that it leaves out."""
    return index.withColumns({c: e for c, e in derived_columns().items() if c not in index.columns})


def index_rich(listings: DataFrame) -> DataFrame:
    """Search columns of the fuzzy ranking: accents folded, token order kept, part numbers found."""
    df = token_columns(compact_columns(rich_texts(listings)))
    own = ["_title", "_shop", "_offer", "_blob"]
    private = [*own, *[f"{f}_compact" for f in own], "_title_seq", "_blob_seq", *[f"{f}_tokens" for f in own], "_part_tokens"]
    return df.select(*[f"`{c}`" for c in listings.columns if c not in private], *private)


def rich_texts(listings: DataFrame) -> DataFrame:
    """Normalised texts that all search columns of the fuzzy ranking follow from; a stored rich index holds no others.

    ``_rest`` is the part of the whole text that is not in the title, shop or offer id.
    """
    rest = F.concat_ws(" ", *[X.or_empty(c) for c in ("price_text", "sales")])
    texts = {"_title": X.or_empty("title"), "_shop": X.or_empty("shop"), "_offer": X.or_empty("offer_id"), "_rest": rest}
    folded = listings.withColumns({f"{c}0": X.strip_marks(t) for c, t in texts.items()})
    return X.compute_once(folded, {c: X.normalize_search(f"{c}0") for c in texts}).drop(*[f"{c}0" for c in texts])


def _whole_text(df: DataFrame) -> Column:
    """``_blob``: the parts are normalised one by one, which gives what normalising them together would."""
    if "_blob" in df.columns:
        return F.col("_blob")
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("_title", "_shop", "_offer", "_rest")])


def _absent(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    columns = {c: e for c, e in columns.items() if c not in df.columns}
    return X.compute_once(df, columns) if columns else df


def compact_columns(df: DataFrame) -> DataFrame:
    """Rich texts with their whole text and all of them without spaces, as far as these are absent."""
    df = _absent(df, {"_blob": _whole_text(df)})
    return _absent(df, {f"{c}_compact": X.compact(c) for c in ("_title", "_shop", "_offer", "_blob")})


def token_columns(df: DataFrame, *of: str) -> DataFrame:
    """Rich texts with the tokens of some fields (all by default), as far as these are absent."""
    of = of or ("title", "offer", "shop", "blob", "part")
    needed = {"title", "offer", "blob"} if "part" in of and "_part_tokens" not in df.columns else set()
    of = {*of, *needed}
    texts = {"title": F.col("_title"), "shop": F.col("_shop"), "offer": F.col("_offer"), "blob": _whole_text(df)}
    df = _absent(df, {f"_{f}_seq": X.token_seq(texts[f]) for f in ("title", "blob") if f in of and f"_{f}_tokens" not in df.columns})
    found = {f"_{f}_tokens": F.array_distinct(f"_{f}_seq") for f in ("title", "blob") if f in of}
    df = _absent(df, found | {f"_{f}_tokens": X.tokens(texts[f]) for f in ("shop", "offer") if f in of})
    if "part" not in of:
        return df
    candidates = F.array_distinct(F.concat("_offer_tokens", "_title_tokens", "_blob_tokens"))
    return _absent(df, {"_part_tokens": F.filter(candidates, X.token_is_part)})


def public_columns(df: DataFrame) -> DataFrame:
    """Drop the private search columns."""
    return df.select(*[f"`{c}`" for c in df.columns if not c.startswith("_")])


def has_image(path: Column | str = "image_path", src: Column | str = "image_src") -> Column:
    return (X.clean_text(path) != "") | (X.clean_text(src) != "")


def load_order(df: DataFrame) -> list[Column]:
    """Order in which rows were loaded: the last tie-break everywhere, because Spark's sort
    is not stable. ``source_file`` and ``row_number`` identify a row."""
    return [F.lower("source_file"), F.col("source_file"), F.col("row_number")]


def base_order(df: DataFrame) -> list[Column]:
    """Order of the stored index: shop, title, priced rows first, price, load order."""
    return [
        F.lower("shop"),
        F.lower("title"),
        F.col("price_value").isNull(),
        F.col("price_value"),
        *load_order(df),
    ]


def index_order(listings: DataFrame) -> DataFrame:
    """The whole index in its base order (a range-partitioned sort)."""
    return listings.orderBy(*base_order(listings))


def union_sources(*parts: DataFrame) -> DataFrame:
    """All rows of sources whose columns differ; absent columns are NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
