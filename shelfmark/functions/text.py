"""Text normalisation as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# White space as the source data's producers collapse it: every Unicode space, no-break
# and ideographic spaces included, plus the ASCII separators 1C-1F. Spelled out because
# the regex engine's Unicode mode is several times slower.
_ODD = r"\t-\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Runs that are not a single plain space already. Tidy text has none, which costs a scan
# but no copy.
_SPACES = f"[{_ODD}][ {_ODD}]*| [ {_ODD}]+"
_ANY_SPACE = f"[ {_ODD}]+"
_NO_SPACE = f"[^ {_ODD}]"
# Anything but a-z and 0-9. Single characters and plain ranges are looked up faster than a negated class.
_NO_WORD = "[" + "".join(f"\\x{n:02x}" for n in range(128) if not (chr(n).islower() or chr(n).isdigit())) + r"\x80-\x{10ffff}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def compute_once(df, columns: dict[str, Column]):
    """Add columns as the output of a generator.

    Spark copies an expression into every filter it moves below a projection. A filter
    cannot pass the generator that makes its column, so a long expression is evaluated one
    time per row. Filters on other columns still pass. The generator interprets what it is
    given, so the expressions stand in a projection of their own, for which code is made.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    rest = [f"`{c}`" for c in df.columns if c not in columns]
    return df.select("*", made.alias("_made")).select(*rest, F.inline(F.array("_made")))


def untidy(text: Column) -> Column:
    """Whether :func:`clean_text` may have anything to collapse in a text."""
    return F.contains(text, F.lit("  ")) | (F.length(text) != F.octet_length(text)) | text.rlike(r"[\x00-\x1f]")


def clean_text(c: Column | str, test: Column | None = None) -> Column:
    """Collapse white space runs, trim, and turn NULL into the empty string.

    For a named column cheap tests find out whether there is anything to collapse;
    tidy ASCII text then skips the pattern. An expression is not tested, since that would
    evaluate it several times. ``test`` is the outcome where it is known, as for all texts of a row at once.
    """
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    collapsed = F.regexp_replace(text, _SPACES, " ")
    if test is None and isinstance(c, str):
        test = untidy(text)
    if test is not None:
        collapsed = F.when(test, collapsed).otherwise(text)
    return F.trim(collapsed)


def is_filled(c: Column | str) -> Column:
    """Whether :func:`clean_text` leaves anything of a text; the first character that is no space tells."""
    return F.coalesce(col(c).cast("string"), F.lit("")).rlike(_NO_SPACE)


def or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def first_filled(*cs: Column | str) -> Column:
    """First argument that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs], F.lit(""))


def normalize_search(c: Column | str) -> Column:
    """Lower case, ``&`` spelled out, anything outside ``[a-z0-9]`` becomes one space."""
    text = or_empty(c)
    # Looking for the sign costs a fraction of replacing it.
    spelled = F.lower(F.when(F.contains(text, F.lit("&")), F.replace(text, F.lit("&"), F.lit(" and "))).otherwise(text))
    return F.trim(F.regexp_replace(spelled, _NO_WORD, " "))


@F.pandas_udf(T.StringType())
def _decomposed(values: pd.Series) -> pd.Series:

    def fold(text):
        if text is None or text.isascii():
            return text
        return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not "̀" <= ch <= "ͯ")

    return values.map(fold, na_action="ignore")


def strip_marks(c: Column | str) -> Column:
    """Compatibility decomposition without combining marks U+0300-U+036F.

    Spark has no normalisation function, so this is the one text step that runs in
    Python (Arrow batches). Pure ASCII values stay where they are; Python gets a null for them.
    """
    text = col(c)
    other = F.length(text) != F.octet_length(text)
    return F.when(other, _decomposed(F.when(other, text))).otherwise(text)


def normalize_fold(c: Column | str) -> Column:
    """Like :func:`normalize_search` after removing accents."""
    return normalize_search(strip_marks(col(c)))


def compact(c: Column | str) -> Column:
    """Remove the spaces of an already normalised text."""
    return F.replace(or_empty(c), F.lit(" "), F.lit(""))


def token_seq(c: Column | str) -> Column:
    """Tokens of a normalised text, in order, repeats kept."""
    return F.array_remove(F.split(or_empty(c), " "), "")


def tokens(c: Column | str) -> Column:
    """Distinct tokens of a normalised text, first-seen order."""
    return F.array_distinct(token_seq(c))


def unique_tokens(c: Column | str) -> Column:
    return F.array_distinct(col(c))


def string_list(c: Column | str) -> Column:
    """Cleaned, distinct list in case-insensitive order; NULL becomes an empty list."""
    cleaned = F.array_distinct(F.filter(F.transform(col(c), lambda t: clean_text(t)), lambda t: t != ""))

    def by_lower(a, b):
        la, lb = F.lower(a), F.lower(b)
        return (
            F.when(la < lb, -1).when(la > lb, 1).when(a < b, -1).when(a > b, 1).otherwise(0)
        )

    return F.coalesce(F.array_sort(cleaned, by_lower), F.array().cast("array<string>"))


def looks_like_part(c: Column | str) -> Column:
    """Whether a normalised text reads like a part number.

    5 to 40 characters without spaces, with a letter and a digit. Two or three tokens
    are accepted only if one token mixes both and none is a plain word of five letters
    or more.
    """
    text = col(c)
    packed = compact(text)
    words = token_seq(text)
    mixed = F.exists(words, lambda t: t.rlike("[a-z]") & t.rlike("[0-9]"))
    plain = F.exists(words, lambda t: t.rlike("^[a-z]{5,}$"))
    shape = F.length(packed).between(5, 40) & packed.rlike("[a-z]") & packed.rlike("[0-9]")
    return shape & (F.size(words) <= 3) & ((F.size(words) <= 1) | (mixed & ~plain))


def token_is_part(c: Column | str) -> Column:
    """:func:`looks_like_part` for a single token, without splitting it."""
    t = col(c)
    return F.length(t).between(5, 40) & t.rlike("[a-z]") & t.rlike("[0-9]")


def is_generic_name(c: Column | str, agent: str = "agent") -> Column:
    """Shop names that say nothing: empty, the agent's own name, or a stamped default."""
    text = F.lower(clean_text(c))
    stamped = rf"^{agent} shop \d{{4}}-\d{{2}}-\d{{2}}t"
    return text.isin("", "shop", agent, f"{agent} shop") | text.rlike(stamped)


def safe_name(c: Column | str, profile: str = "queue", fallback: str | None = None) -> Column:
    """File-system safe name.

    ``queue``: reserved characters become one ``_`` per run, spaces stay, outer dots and
    spaces go, 96 characters. ``saved_page`` and ``live_page``: white space becomes
    ``_``, runs of ``_`` collapse, 80 characters; only ``saved_page`` trims outer ``_``.
    """
    text = clean_text(c)
    if profile == "queue":
        text = F.regexp_replace(text, r'[\\/:*?"<>|]+', "_")
        text = F.regexp_replace(text, _SPACES, " ")
        text = F.regexp_replace(text, r"^[ .]+|[ .]+$", "")
        text = F.trim(F.substring(text, 1, 96))
        fallback = "shop" if fallback is None else fallback
    elif profile in ("saved_page", "live_page"):
        text = F.regexp_replace(text, r'[\\/:*?"<>|]', "_")
        text = F.regexp_replace(F.regexp_replace(text, _ANY_SPACE, "_"), "_+", "_")
        if profile == "saved_page":
            text = F.regexp_replace(text, "^_+|_+$", "")
        text = F.substring(text, 1, 80)
        fallback = "item" if fallback is None else fallback
    else:
        raise ValueError(f"unknown profile {profile!r}")
    return F.when(text == "", F.lit(fallback)).otherwise(text)


def iso_now() -> Column:
    """Current time as ISO text; sessions run in UTC."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def display_time(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Readable time; empty gives ``unknown time``, unreadable text is shown as it is."""
    text = or_empty(c)
    shown = F.date_format(F.try_to_timestamp(text), pattern)
    return F.when(text == "", F.lit("unknown time")).otherwise(F.coalesce(shown, text))


def later_date(a: Column | str, b: Column | str) -> Column:
    """Later of two ISO dates in text order, where missing counts as empty."""
    return F.greatest(or_empty(a), or_empty(b))


def natural_key(c: Column | str) -> Column:
    """Text that sorts as people count: runs of digits by their value, all else as it is.

    Each run of digits becomes its length without leading zeros, in three digits, and these digits.
    """
    runs = F.regexp_extract_all(or_empty(c), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def counted(run: Column) -> Column:
        return let(F.regexp_replace(run, "^0+", ""), lambda r: F.concat(F.lpad(F.length(r).cast("string"), 3, "0"), r))

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), counted(r)).otherwise(r)), "")


def clean_url_lines(c: Column | str) -> Column:
    """Pasted text to an array of lines without list numbers or blank lines."""
    lines = F.transform(
        F.split(or_empty(c), r"\r?\n"),
        lambda line: F.regexp_replace(
            F.regexp_replace(line, r"(?U)^\s*\d+[).\-\s]+", ""), r"(?U)^\s+|\s+$", ""
        ),
    )
    return F.filter(lines, lambda line: line != "")


def listing_id(*parts: Column | str) -> Column:
    """First 16 hex digits of the SHA-1 over the parts joined with ``|``."""
    joined = F.concat_ws("|", *[or_empty(p) for p in parts])
    return F.substring(F.sha1(F.encode(joined, "UTF-8")), 1, 16)


def vector_key(listing: Column | str, path: Column | str, size: Column | str, mtime: Column | str) -> Column:
    """Identity of an image for vector reuse: any change of path, size or time changes it."""
    parts = [or_empty(col(p).cast("string")) for p in (listing, path, size, mtime)]
    return F.sha1(F.encode(F.concat(*parts), "UTF-8"))
