"""Price text, currencies and conversion as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .text import clean_text, col, first_filled, let, or_empty

CURRENCIES = ("usd", "cad", "cny")
CANONICAL = "cny"
PREFIX = {"usd": "US$", "cad": "CA$", "cny": "￥"}
# Currency signs of the display locales.
DISPLAY_SIGN = {"usd": "$", "cad": "$", "cny": "¥"}
NUMBER = r"-?\d+(?:\.\d+)?"


@dataclass(frozen=True)
class Rates:
    """One exchange-rate record; both rates are quoted in CAD."""

    usd_to_cad: float
    cny_to_cad: float
    source: str = ""
    source_date: str = ""

    @property
    def usd_to_cny(self) -> float:
        return self.usd_to_cad / self.cny_to_cad

    def column(self) -> Column:
        return F.struct(
            F.lit(float(self.usd_to_cad)).alias("usd_to_cad"),
            F.lit(float(self.cny_to_cad)).alias("cny_to_cad"),
            F.lit(self.source).alias("source"),
            F.lit(self.source_date).alias("source_date"),
        )


def rates_column(rates: Rates | DataFrame | Column) -> Column:
    """Rates as one struct value usable on every row.

    A one-row DataFrame becomes a scalar subquery, so no join is planned at all.
    """
    if isinstance(rates, Rates):
        return rates.column()
    if isinstance(rates, DataFrame):
        record = F.struct("usd_to_cad", "cny_to_cad", "source", "source_date")
        return rates.select(record.alias("r")).scalar()
    return rates


def number_in(text: Column) -> Column:
    """:func:`coerce_number` for text that is clean already."""
    found = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), NUMBER, 0)
    # No match gives an empty text, which does not cast. Digits alone can only overflow.
    value = found.try_cast("double")
    return F.when(F.length(text) < 300, value).otherwise(finite(value))


def coerce_number(c: Column | str) -> Column:
    """First signed decimal in a text once commas are gone; NULL if none or not finite."""
    return number_in(clean_text(c))


def finite(c: Column | str) -> Column:
    v = col(c).cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def currency_code(c: Column | str) -> Column:
    """``usd``, ``cad`` or ``cny``, else the empty string."""
    return F.regexp_extract(F.lower(clean_text(c)), "^(?:usd|cad|cny)$", 0)


def marker_in(text: Column) -> Column:
    """:func:`currency_marker` for text that is clean already."""
    # One pass over the text finds every marker it has.
    return (
        F.when(text.rlike(r"(?i)CA?\$|CAD"), F.lit("cad"))
        .when(text.rlike("(?i)[￥¥]|CNY|RMB"), F.lit("cny"))
        .when(text.rlike(r"(?i)USD|\$"), F.lit("usd"))
        .otherwise(F.lit(""))
    )


def currency_marker(c: Column | str) -> Column:
    """Currency named or signed in a price text, most specific sign first."""
    return marker_in(clean_text(c))


def currency_of(text: Column, code: Column) -> Column:
    """:func:`source_currency` for a clean text and a checked code."""
    marker = marker_in(text)
    fallback = F.when(code != "", code).when(text != "", F.lit(CANONICAL)).otherwise(F.lit(""))
    return F.coalesce(F.when(marker != "", marker), fallback)


def source_currency(text: Column | str, code: Column | str | None = None) -> Column:
    """Marker in the text, else the explicit code, else the default; empty without either."""
    return currency_of(clean_text(text), currency_code(code) if code is not None else F.lit(""))


def per_cad(code: Column, rates: Column) -> Column:
    """Value of one unit of a currency in CAD; NULL when the rates are unusable."""
    usd, cny = rates["usd_to_cad"], rates["cny_to_cad"]
    usable = (finite(usd) > 0) & (finite(cny) > 0)
    return F.when(usable, F.when(code == "cad", F.lit(1.0)).when(code == "usd", usd).when(code == "cny", cny))


def convert(value: Column | str, source: Column | str, target: Column | str, rates) -> Column:
    """Convert through CAD. The same currency needs no rates; unusable rates give NULL."""
    return convert_known(finite(value), currency_code(source), currency_code(target), rates)


def convert_known(v: Column, src: Column, dst: Column, rates) -> Column:
    """:func:`convert` for a finite value and checked codes."""
    r = rates_column(rates)
    return F.when((src == dst) & (src != ""), v).otherwise(v * per_cad(src, r) / per_cad(dst, r))


def fixed(v: Column, digits: int) -> Column:
    """Fixed decimals with grouping. This formatter rounds the exact binary value, as
    Python and C do; ``format_string`` rounds the shortest decimal text instead."""
    return F.format_number(v, digits)


def fixed_plain(v: Column, digits: int) -> Column:
    return F.replace(fixed(v, digits), F.lit(","), F.lit(""))


def _trim_decimals(text: Column, keep: int) -> Column:
    """Cut trailing zeros but leave ``keep`` decimals."""
    return F.regexp_replace(text, rf"(\.\d{{{keep}}}\d*?)0+$", "$1")


def format_price(value: Column | str, code: Column | str) -> Column:
    """Currency prefix and amount with two to four decimals."""
    unit = col(code)
    prefix = F.when(unit == "usd", F.lit(PREFIX["usd"])).when(unit == "cad", F.lit(PREFIX["cad"])).otherwise(
        F.lit(PREFIX["cny"])
    )
    v = col(value)
    return F.when(v.isNotNull(), F.concat(prefix, _trim_decimals(fixed_plain(v, 4), 2)))


def display_amount(value: Column | str, currency: str) -> Column:
    """Amount for display with grouping: 2-4 decimals, 3-6 when smaller than a cent."""
    v = col(value)
    size = F.abs(v)
    tiny = (size > 0) & (size < 0.01)
    shown = F.when(tiny, _trim_decimals(fixed(size, 6), 3)).otherwise(
        _trim_decimals(fixed(size, 4), 2)
    )
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(v.isNotNull(), F.concat(sign, F.lit(DISPLAY_SIGN[currency]), shown))


def price_range(c: Column | str) -> Column:
    """``a-b`` or ``a..b`` to a struct of bounds (ends put in order); one number is a lower bound."""
    text = or_empty(c)
    both = r"^\s*(\d+(?:\.\d+)?)\s*(?:-|\.\.)\s*(\d+(?:\.\d+)?)\s*$"
    left = F.nullif(F.regexp_extract(text, both, 1), F.lit("")).try_cast("double")
    right = F.nullif(F.regexp_extract(text, both, 2), F.lit("")).try_cast("double")
    single = coerce_number(text)
    return F.struct(
        F.when(left.isNotNull(), F.least(left, right)).otherwise(single).alias("min_price"),
        F.when(left.isNotNull(), F.greatest(left, right)).alias("max_price"),
    )


def api_price_text(promotion: Column | str, regular: Column | str) -> Column:
    """Price text of an API record: a bare positive number is in hundredths of a yuan."""
    raw = F.trim(first_filled(promotion, regular))
    value = coerce_number(raw)
    marker = currency_marker(raw)
    bare = (marker == "") & (value > 0)
    return (
        F.when(raw == "", F.lit(""))
        .when(value.isNull(), raw)
        .when(bare, format_price(value / 100, F.lit("cny")))
        .otherwise(format_price(value, source_currency(raw)))
    )


def rescale_text(c: Column | str, factor: float = 100.0) -> Column:
    """Divide the first number of a price text, keeping what stands around it."""
    text = col(c)
    whole = r"(?s)^(\D*)([\d.]+)(.*)$"
    number = F.nullif(F.regexp_extract(text, whole, 2), F.lit("")).try_cast("double")
    scaled = F.concat(
        F.regexp_extract(text, whole, 1),
        fixed_plain(number / factor, 2),
        F.regexp_extract(text, whole, 3),
    )
    return F.when(number.isNotNull(), scaled).otherwise(text)


LINKED_PRICE = r"(?i)Product link\s*>\s*([￥¥]\s*\d+(?:\.\d+)?)"
YUAN_PRICE = r"[￥¥]\s*\d+(?:\.\d+)?"


def price_near(body: Column, title: Column, window: int = 1000) -> Column:
    """Yuan price text in a clean page text: next to the product link, else within
    ``window`` characters of the title's first 80. Empty when there is none."""
    needle = F.substring(F.lower(title), 1, 80)
    at = F.position(needle, F.lower(body))
    close = let(at, lambda n: F.regexp_extract(F.substr(body, n, F.lit(window)), YUAN_PRICE, 0))
    linked = F.regexp_extract(body, LINKED_PRICE, 1)
    found = F.coalesce(F.nullif(linked, F.lit("")), F.when((needle != "") & F.contains(F.lower(body), needle), close), F.lit(""))
    return F.replace(F.replace(found, F.lit("¥"), F.lit("￥")), F.lit(" "), F.lit(""))
