"""Document fingerprints: a threshold-scaled sketch in plain column functions.

Every shingle of five words is hashed, and the hashes below a fixed fraction of their range are kept. Which hashes a
text keeps does not depend on the text's length or on other texts, so sketches can be united, and the share of one in
another estimates containment between very unequal texts. A text without a hash below the threshold keeps its smallest
one instead, so that short texts can be told apart; uniting keeps that meaning, as the smallest of the smallest.

Words are what ASCII blanks, punctuation and control characters leave, in lower case. A text of fewer than five words
is one shingle of them all; a text without words has an empty sketch. Null texts are empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.llm.common import let

SHINGLE = 5
#: Hashes have 31 bits; a quarter of their range is kept.
THRESHOLD = 1 << 29
_BREAKS = "[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+"
#: Least number of ranges that ids are cut into, and of parts of the rows without id.
RANGES, NULL_PARTS = 4096, 64


def words(text: Column) -> Column:
    """Words of a text. Breaks at either end leave an empty word, which is dropped."""
    return F.array_remove(F.split(F.lower(text), _BREAKS), "")


def hashes(ws: Column) -> Column:
    """One 31-bit hash per shingle."""
    spots = F.sequence(F.lit(0), F.greatest(F.size(ws) - SHINGLE, F.lit(0)))

    def one(i: Column) -> Column:
        # Past the end of a short text the elements are null, which the hash passes over.
        parts = [F.get(ws, i + k) for k in range(SHINGLE)]
        return F.shiftrightunsigned(F.xxhash64(*parts), 33).cast("int")

    return F.when(F.size(ws) > 0, F.transform(spots, one)).otherwise(F.array().cast("array<int>"))


def smallest(found: Column) -> Column:
    """The sketch of a set of hashes: those below the threshold, or the smallest, sorted."""
    low = F.array_distinct(F.filter(found, lambda h: h < THRESHOLD))
    least = F.filter(F.array(F.array_min(found)), lambda h: h.isNotNull())
    return F.sort_array(F.when(F.size(low) > 0, low).otherwise(least))


def sketch(text: Column) -> Column:
    """Sorted sketch (``array<int>``) of a text column without nulls."""
    return let(words(text), lambda ws: let(hashes(ws), smallest))


def unite(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together."""
    return smallest(F.array_union(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Estimated likeness, 0 to 1. Two empty sketches are alike."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, F.lit(1.0)).otherwise(common / total)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too. An empty sketch is contained in any."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def printed(of: Column) -> Column:
    """A sketch as text: eight hexadecimal digits per hash."""
    return F.array_join(F.transform(of, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``fingerprint``, a sorted array of hashes."""
    return docs.withColumn("fingerprint", sketch(F.coalesce("text", F.lit(""))))


def _cuts(docs: DataFrame, ranges: int) -> list[int]:
    """Ids that cut the table into about equal ranges, ascending; fewer than ``ranges``."""
    steps = [k / ranges for k in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx("doc_id", F.lit(steps), 10 * ranges).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def _cuts_below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted numbers are at most ``value``: first in steps of a block, then inside the block."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    blocks = [cuts[k:k + step] for k in range(0, len(cuts), step)]

    def at_most(numbers: Column) -> Column:
        return F.size(F.filter(numbers, lambda c: c <= value))

    firsts = F.array(*[F.lit(b[0]) for b in blocks])
    inside = F.array(*[F.array(*[F.lit(c) for c in b]) for b in blocks])
    return let(at_most(firsts), lambda k: F.when(k == 0, 0).otherwise(
        (k - 1) * step + at_most(F.get(inside, k - 1))))


def with_next(docs: DataFrame, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Each row of ``docs`` with ``columns`` of the row that comes next by falling ``doc_id``; after the last, the first.

    New columns are named ``next_...``. Null ids come last; rows of one id are ordered by a hash of their text. No
    task sees the whole order: ids are cut into ranges, a range is ordered by itself, and the first row of each
    range (a bounded table says which) is also dealt to the range before it, to follow that range's last row.
    Rows with one id and one text are alike for every use of the result, so any of them may follow another.
    The number of ranges follows the session's shuffle partitions.
    """
    ranges = ranges or max(RANGES, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cuts(docs, ranges)
    n = len(cuts)
    # Range 0 has the highest ids. Rows without id come in parts behind all others.
    tie = F.xxhash64("text")
    spot = F.when(F.col("doc_id").isNull(), n + 1 + F.pmod(tie, F.lit(NULL_PARTS))).otherwise(
        n - _cuts_below(cuts, F.col("doc_id"))).cast("int")
    rows = docs.withColumn("__range", spot).withColumn("__tie", tie)
    heads = rows.groupBy("__range").agg(
        F.max(F.struct(F.col("doc_id").alias("doc_id"), F.col("__tie").alias("tie"))).alias("head"))
    order = Window.orderBy("__range")
    before = F.lag("__range").over(order)
    last = F.max("__range").over(Window.partitionBy())
    # At most one row per range: a bounded window and a bounded broadcast.
    heads = heads.select(F.col("__range"), F.col("head.doc_id").alias("__head"), F.col("head.tie").alias("__head_tie"),
                         F.coalesce(before, last).alias("__before"))
    marked = rows.join(F.broadcast(heads), "__range")
    is_head = F.col("doc_id").eqNullSafe(F.col("__head")) & (F.col("__tie") == F.col("__head_tie"))
    own = F.struct(F.col("__range").alias("r"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("__before").alias("r"), F.lit(1).alias("guest"))
    dealt = marked.withColumn("__to", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own)))).select(
        *docs.columns, "__tie", F.col("__to.r").alias("__r"), F.col("__to.guest").alias("__guest"))
    within = Window.partitionBy("__r").orderBy("__guest", F.desc_nulls_last("doc_id"), F.desc("__tie"))
    followed = dealt.select("*", *[F.lead(c).over(within).alias(f"next_{c}") for c in columns])
    return followed.where("__guest = 0").drop("__tie", "__r", "__guest")


def edited_text(text: Column, other: Column) -> Column:
    """The last third of a text's code points (rounded down) replaced by as many first ones of another, or all it has."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(other, F.lit(1), third))


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint`` (hexadecimal), ``near_edited``,
    ``near_next`` and ``kept_in_edited`` (share of the fingerprint in the edited text's). Order and ties as in
    :func:`with_next`; a table of one document follows itself. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", text.alias("text"), sketch(text).alias("print"))
    edited = edited_text(F.col("text"), F.col("next_text"))
    rows = with_next(plain, ["text", "print"]).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "print", "next_print",
        F.inline(F.array(F.struct(F.sha2(edited, 256).alias("edited_sha256"), sketch(edited).alias("edited_print")))))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("print")).alias("fingerprint"),
        printed(F.col("edited_print")).alias("edited_fingerprint"),
        jaccard(F.col("print"), F.col("edited_print")).alias("near_edited"),
        jaccard(F.col("print"), F.col("next_print")).alias("near_next"),
        containment(F.col("print"), F.col("edited_print")).alias("kept_in_edited"))
