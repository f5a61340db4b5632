"""Price jobs over listing rows: normalise, rescale, find bad prices and repair them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import price as P, text as X

# Texts that mean the price is missing.
ZERO_TEXTS = ["", "0", "0.0", "0.00"]
ZERO_PRICES = ["￥0.00", "¥0.00", "CA$0.00", "$0.00", "US$0.00"]

PRICE_COLUMNS = ["price", "price_currency", "price_value", "price_original", "price_original_currency",
                 "price_original_value", "price_exchange_source", "price_exchange_date"]


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit("")


def price_source(df: DataFrame) -> DataFrame:
    """Add ``_text, _currency, _value``: what a row's price comes from. Originals win over
    current ones.

    Built in steps, so that no step repeats the expressions of the one before.
    """
    df = df.withColumns(
        {
            "_original": X.clean_text(_text(df, "price_original")),
            "_current": X.clean_text(_text(df, "price")),
            "_code": P.currency_code(_text(df, "price_original_currency")),
            "_code2": P.currency_code(_text(df, "price_currency")),
        }
    )
    df = df.withColumns(
        {
            "_text": F.when(F.col("_original") != "", F.col("_original")).otherwise(F.col("_current")),
            "_code": F.when(F.col("_code") != "", F.col("_code")).otherwise(F.col("_code2")),
        }
    )
    value = F.coalesce(
        P.coerce_number(_text(df, "price_original_value")),
        P.number_in(F.col("_text")),
        P.coerce_number(_text(df, "price_value")),
        P.number_in(F.col("_current")),
    )
    df = df.withColumns({"_currency": P.currency_of(F.col("_text"), F.col("_code")), "_value": value})
    return df.drop("_original", "_current", "_code", "_code2")


def normalize_prices(df: DataFrame, rates, canonical: str = P.CANONICAL) -> DataFrame:
    """Prices in one currency, with the source price kept and the rates stamped on the row.

    Rows whose price cannot be converted keep their source text, currency and value.
    """
    canonical = canonical if canonical in P.CURRENCIES else P.CANONICAL
    rates = P.rates_column(rates)
    target = F.lit(canonical)
    old = {c: _text(df, c) for c in PRICE_COLUMNS}
    rest = [c for c in df.columns if c not in PRICE_COLUMNS]
    staged = price_source(df.select(*rest, *[F.col(c) for c in PRICE_COLUMNS if c in df.columns]))
    staged = staged.withColumn("_unit", F.when(F.col("_currency") != "", F.col("_currency")).otherwise(target))
    staged = X.compute_once(
        staged, {"_converted": P.convert_known(F.col("_value"), F.col("_unit"), target, rates),
                 **{c: F.col(c) for c in ("_text", "_currency", "_value")}}
    )
    done, has_text = F.col("_converted").isNotNull(), F.col("_text") != ""
    old_value = P.coerce_number(old["price_value"])

    def filled(new: str, name: str) -> Column:
        return F.when(F.col(new) != "", F.col(new)).otherwise(X.or_empty(old[name]))

    out = {
        "price_original": filled("_text", "price_original"),
        "price_original_currency": filled("_currency", "price_original_currency"),
        "price_original_value": F.coalesce(F.round("_value", 6), P.coerce_number(old["price_original_value"])),
        "price": F.when(done, P.format_price("_converted", target))
        .when(has_text, F.col("_text"))
        .otherwise(X.or_empty(old["price"])),
        "price_currency": F.when(done, target)
        .when(has_text, filled("_currency", "price_currency"))
        .otherwise(X.or_empty(old["price_currency"])),
        "price_value": F.when(done, F.round("_converted", 6))
        .when(has_text, F.coalesce(F.round("_value", 6), old_value))
        .otherwise(old_value),
        "price_exchange_source": X.first_filled(rates["source"], old["price_exchange_source"]),
        "price_exchange_date": X.first_filled(rates["source_date"], old["price_exchange_date"]),
    }
    return X.compute_once(staged, out).drop("_text", "_currency", "_value", "_unit", "_converted")


def display_prices(df: DataFrame, rates, currency: str = P.CANONICAL, base: str = P.CANONICAL,
                   text: str = "price_text") -> DataFrame:
    """Add ``primary`` (price in the chosen currency) and ``secondary`` (the other ones, and
    the original text where it differs)."""
    amounts = {f"_{c}": P.convert_known(F.col("price_value").cast("double"), F.lit(base), F.lit(c), rates) for c in P.CURRENCIES}
    df = X.compute_once(df, amounts)
    others = [P.display_amount(f"_{c}", c) for c in P.CURRENCIES if c != currency]
    if "price_original_text" in df.columns:
        original = F.col("price_original_text")
        others.append(F.when((original != "") & (original != F.col(text)), F.concat(F.lit("Original "), original)))
    priced = F.col("price_value").isNotNull()
    return df.withColumns(
        {
            "primary": F.coalesce(P.display_amount(f"_{currency}", currency), X.first_filled(text, F.lit("No price"))),
            "secondary": F.when(priced, F.concat_ws(" · ", *others)).otherwise(F.lit("")),
        }
    ).drop(*amounts)


def rescale_prices(df: DataFrame, shops: list[str], factor: float = 100.0) -> DataFrame:
    """Divide the prices of some shops (a known collection fault); other rows are untouched."""
    hit = F.col("shop").isin(list(shops))
    changes = {}
    for name in ("price", "price_original"):
        if name in df.columns:
            changes[name] = F.when(hit, P.rescale_text(name, factor)).otherwise(F.col(name))
    for name in ("price_value", "price_original_value"):
        if name in df.columns:
            value = F.col(name).try_cast("double")
            changes[name] = F.when(hit & (value != 0), value / factor).otherwise(value)
    return df.withColumns(changes)


def is_bad_price(df: DataFrame) -> Column:
    """A zero price text, or no usable price value."""
    price, original = X.clean_text(_text(df, "price")), X.clean_text(_text(df, "price_original"))
    value = X.clean_text(_text(df, "price_value"))
    return price.isin(ZERO_PRICES) | original.isin(ZERO_PRICES) | value.isin(ZERO_TEXTS)


def row_url(df: DataFrame, agent: str = "agent") -> Column:
    return X.clean_text(
        X.first_filled(_text(df, f"{agent}_url"), _text(df, "source_url"), _text(df, "source_1688_url"))
    )


def row_key(df: DataFrame, agent: str = "agent") -> Column:
    """Key of a row in the repair tables: offer id, else URL."""
    return X.first_filled(X.clean_text(_text(df, "offer_id")), row_url(df, agent))


def repair_targets(df: DataFrame, order: list[str], agent: str = "agent") -> DataFrame:
    """First bad row of each key that has a URL, in the given row order."""
    bad = df.filter(is_bad_price(df))
    staged = bad.select(
        row_key(bad, agent).alias("key"),
        X.clean_text(_text(bad, "offer_id")).alias("offer_id"),
        X.clean_text(_text(bad, "title")).alias("title"),
        row_url(bad, agent).alias("url"),
        F.struct(*order).alias("_at"),
    ).filter((F.col("url") != "") & (F.col("key") != ""))
    first = F.min_by(F.struct("offer_id", "title", "url"), "_at").alias("r")
    return staged.groupBy("key").agg(first).select("key", "r.offer_id", "r.title", "r.url")


def pending_repairs(targets: DataFrame, prices: DataFrame) -> DataFrame:
    """Targets without a price yet."""
    return targets.join(prices.select("key").distinct(), "key", "left_anti")


def prices_from_pages(targets: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Look the target's price up in its page text: ``(prices, failures)``.

    ``pages`` has ``key, text``.
    """
    joined = targets.join(pages.select("key", "text"), "key", "left")
    joined = X.compute_once(joined, {"_body": X.clean_text("text"), "_title": X.clean_text("title")})
    found = X.compute_once(joined, {"_price": P.price_near(F.col("_body"), F.col("_title"))})
    found = X.compute_once(found, {"_value": P.number_in(F.col("_price"))})
    text = F.concat(
        F.lit("￥"), F.regexp_replace(F.regexp_replace(P.fixed_plain(F.col("_value"), 6), "0+$", ""), r"\.$", "")
    )
    good = F.coalesce(F.col("_value") > 0, F.lit(False))
    prices = found.filter(good).select("key", text.alias("price"), F.col("_value").alias("value"))
    failures = found.filter(~good).select("key", F.lit("No yuan product price found.").alias("error"))
    return prices, failures


def apply_repairs(df: DataFrame, repairs: DataFrame, rates, agent: str = "agent") -> DataFrame:
    """Put repaired prices on the bad rows that have one, marked in ``repaired``.

    Only bad rows are joined by key and go through a price step, whose input is empty for those without a repair. Good rows
    stay where they are.
    """
    present = [c for c in PRICE_COLUMNS if c in df.columns]
    numbers = ("price_value", "price_original_value")
    bad, hit = is_bad_price(df), F.col("_fix").isNotNull()

    def before(name: str, column: str) -> Column:
        if name not in present:
            return F.lit(None)
        return P.coerce_number(F.col(column).cast("string")) if name in numbers else F.col(column)

    broken = df.filter(bad).withColumns({**{f"_was_{c}": F.col(c) for c in present}, "_key": row_key(df, agent)})
    fixes = repairs.select(
        F.col("key").alias("_key"), F.col("price").alias("_fix"), F.col("value").alias("_fix_value")
    )
    joined = broken.join(fixes, "_key", "left").withColumn("repaired", hit)
    patched = joined.withColumns(
        {
            **{c: F.when(hit, F.col(c)) for c in present},
            "price_original": F.col("_fix"),
            "price_original_currency": F.when(hit, F.lit("cny")),
            "price_original_value": F.col("_fix_value"),
        }
    )
    done = normalize_prices(patched, rates)
    chosen = {c: F.when(F.col("repaired"), F.col(c)).otherwise(before(c, f"_was_{c}")) for c in PRICE_COLUMNS}
    done = done.withColumns(chosen).drop("_key", "_fix", "_fix_value", *[f"_was_{c}" for c in present])
    kinds = dict(done.dtypes)
    good = df.filter(~bad).withColumns({"repaired": F.lit(False), **{c: before(c, c).cast(kinds[c]) for c in PRICE_COLUMNS}})
    return done.unionByName(good)


def repair_report(targets: DataFrame, repaired: DataFrame, prices: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: targets found, rows updated, prices known, failures."""
    spark = targets.sparkSession

    def count(df: DataFrame) -> Column:
        return df.agg(F.count("*").alias("n")).scalar()

    return spark.range(1).select(
        count(targets).alias("targets"),
        count(repaired.filter("repaired")).alias("updates"),
        count(prices).alias("prices"),
        count(failures).alias("failures"),
    )


def normalize_report(rows: DataFrame) -> DataFrame:
    """Rows and files per kind of source."""
    per_file = rows.groupBy("kind", "source_file").agg(F.count("*").alias("n"))
    return per_file.groupBy("kind").agg(F.sum("n").alias("rows"), F.count("*").alias("files"))
