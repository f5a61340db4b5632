"""Near-duplicates by ProbMinHash sketches, banding and verification.

Sketch. A shingle of five words has the weight 1 + ln(its number of places). Each shingle is a Poisson process: its
points arrive with exponential gaps, shorter for a higher weight, and every point falls on one of the sketch's
registers; a register remembers the shingle whose point came first. Two texts agree in a register with a chance equal
to their probability Jaccard similarity. A shingle's points are drawn until they come later than the last register
filled, so long texts need few points for each shingle. Points depend on the shingle alone.

Banding. Registers are joined to bands; texts that agree in a whole band share a bucket. Nobody is compared with all
others of a bucket: each bucket, and each meeting of two buckets, names leaders, its most central text (the one whose
buckets hold most texts) and two by hash, and the members are compared with these.

Before that, texts that cannot have a partner are put aside: a text takes part only if enough of its shingles are in
other texts too (``prefix_join.covered``, which misses none).

Verification. A pair counts if the Jaccard similarity of the whole sets of shingles (64-bit hashes) is 0.8 or more.
Classes are the connected components of such pairs and of equal texts. Leaders find nearly all of them.

Rest. What buckets and leaders have missed is found by a prefix filter (``prefix_join.pairs_across``): all pairs of
texts that are still in different classes and may be alike are verified too, so that no link depends on a chance.

Words are what ASCII blanks, punctuation and control characters leave, in lower case. A text of fewer than five words is
one shingle of them all. Null texts are empty. Equal texts are one class always, empty ones too; texts count as equal if
their 64-bit hashes are. Very long texts are taken whole. Of rows that repeat an id and a text one stays. An empty table
gives no rows. Columns besides ``doc_id`` and ``text`` are not looked at, whatever their names, and stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import checkpoint, free_name, kept, list_array, map_columns, texts_of, written
from shelfmark.llm.components import components
from shelfmark.llm.prefix_join import covered, first_part, pairs_across

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: A pair of buckets meets if their bands are this far apart.
STRIDES = (1, 7)
#: Leaders of a bucket besides its most central text, by a hash of text and bucket, so that buckets differ in them.
OTHERS = 2
#: Share of a text's shingles that must be found in other texts, among the smallest that are looked at first.
MORE = 0.1
BATCH_TEXTS, BATCH_CHARS = 500, 2_000_000
POINTS = 1 << 16
_BREAKS = bytes(32 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))
_GOLDEN, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit over the whole number."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text and their weights."""
    parts = text.lower().encode("utf-8", "surrogatepass").translate(_BREAKS).split()
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0)
    ws = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    if len(ws) < SHINGLE:
        ws = np.concatenate([ws, np.zeros(SHINGLE - len(ws), np.uint64)])
    n = len(ws) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total = mix(total + ws[k:k + n] + _GOLDEN)
    found, counts = np.unique(total, return_counts=True)
    return found, 1.0 + np.log(counts)


def sketches(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """Registers of each weighted set (sets x registers); a set without elements has zeros."""
    n = len(sets)
    first = np.full(n * registers, np.inf)
    names = np.zeros(n * registers, np.uint64)
    element = np.concatenate([s[0] for s in sets])
    rate = np.concatenate([s[1] for s in sets])
    owner = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    time = np.zeros(len(element))
    drawn = 0
    while len(element):
        # A block of points for each shingle still running; how many at once changes no point.
        block = max(1, min(256, POINTS // len(element)))
        number = np.arange(drawn + 1, drawn + 1 + block, dtype=np.uint64)
        seeds = mix(element[:, None] + number[None, :] * _GOLDEN)
        gap = -np.log1p(-((seeds >> np.uint64(11)) * 2.0**-53)) / rate[:, None]
        at = time[:, None] + np.cumsum(gap, axis=1)
        slot = (owner * registers)[:, None] + (mix(seeds + _M1) % np.uint64(registers)).astype(np.int64)
        flat, when = slot.ravel(), at.ravel()
        sooner = when < first[flat]
        flat, when, who = flat[sooner], when[sooner], np.repeat(element, block)[sooner]
        np.minimum.at(first, flat, when)
        won = first[flat] == when
        names[flat[won]] = who[won]
        latest = first.reshape(n, registers).max(axis=1)
        time = at[:, -1]
        running = time < latest[owner]
        element, rate, owner, time = element[running], rate[running], owner[running], time[running]
        drawn += block
    return names.reshape(n, registers)


def band_keys(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key for each band of each text."""
    rows = registers.reshape(len(registers), bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _GOLDEN
    for r in range(rows.shape[2]):
        key = mix(key + rows[:, :, r])
    return key.view(np.int64)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def banded(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, the text's hash ``gid``, its ``bands``, number ``n`` of distinct shingles and the smallest of them.

    Texts without words have no bands and no shingles.
    """

    def work(texts: pa.Array) -> tuple:
        known = kept("word hashes", WordHashes)
        out: list[np.ndarray] = []
        firsts: list[np.ndarray] = []
        sizes: list[int] = []
        pending: list[tuple] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if pending:
                keys = band_keys(sketches(pending))
                out.extend(k if len(s[0]) else k[:0] for k, s in zip(keys, pending, strict=True))
                firsts.extend(first_part(s[0], similarity, MORE).view(np.int32) for s in pending)
                sizes.extend(len(s[0]) for s in pending)
            pending.clear()
            size = 0

        for text in texts_of(texts):
            pending.append(shingles(text, known))
            size += len(text)
            if len(pending) == BATCH_TEXTS or size > BATCH_CHARS:
                flush()
        flush()
        return list_array(out, pa.int64()), list_array(firsts, pa.int32()), sizes

    return map_columns(docs.select("doc_id", text_hash().alias("gid"), "text"), work,
                       "bands array<bigint>, tokens array<int>, n int", carry=["doc_id", "gid"])


def candidates(texts: DataFrame) -> DataFrame:
    """Distinct pairs ``a``, ``b`` (a member and a leader of a bucket) of distinct texts (``gid``, ``bands``)."""
    spots = texts.select("gid", F.posexplode("bands").alias("band", "key"))
    shared = spots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    member = checkpoint(spots.join(shared, "key").select("gid", "band", "key", "n"))
    by_text = member.groupBy("gid").agg(
        F.sum("n").alias("central"), F.map_from_entries(F.collect_list(F.struct("band", "key"))).alias("keys"))
    # Keys of a text: its shared buckets, and the meetings of two of them.
    def meeting(stride: int):
        def key(band: Column) -> Column:
            other = (band + stride) % BANDS
            return F.when(F.map_contains_key("keys", other), F.xxhash64(
                F.try_element_at("keys", band), F.try_element_at("keys", other), F.lit(stride)))

        return F.array_compact(F.transform(F.map_keys("keys"), key))

    keys = F.concat(F.map_values("keys"), *[meeting(s) for s in STRIDES])
    keyed = checkpoint(by_text.select("gid", "central", F.explode(keys).alias("key")))
    leaders = keyed.groupBy("key").agg(
        F.max(F.struct("central", "gid")).getField("gid").alias("first"),
        *[F.min(F.struct(F.xxhash64("gid", "key", F.lit(k)).alias("h"), F.col("gid"))).getField("gid").alias(f"other{k}")
          for k in range(OTHERS)],
        F.count("*").alias("n")).where("n > 1")
    named = F.array("first", *[f"other{k}" for k in range(OTHERS)])
    return keyed.join(leaders, "key").select("gid", F.explode(F.array_distinct(named)).alias("b")).where(
        "gid <> b").select(F.col("gid").alias("a"), "b").distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``gid``, ``n`` and the whole ``set`` of 64-bit shingle hashes of the texts that ``wanted`` names.

    ``wanted`` has one document (``gid``, ``doc_id``) for each text, so that copies are not read again and again.
    """
    bearers = wanted.select(F.col("gid").alias("g"), F.col("doc_id").alias("i"))
    texts = docs.select("doc_id", text_hash().alias("gid"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(bearers, (F.col("gid") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")
    # A document may be there twice with the same id.
    texts = texts.select("gid", "text").dropDuplicates(["gid"])

    def work(column: pa.Array) -> tuple:
        known = kept("word hashes", WordHashes)
        sets = [shingles(t, known)[0].view(np.int64) for t in texts_of(column)]
        return [len(x) for x in sets], list_array(sets, pa.int64())

    return written(map_columns(texts, work, "n int, set array<bigint>", carry=["gid"]))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose texts are alike, with their ``jaccard`` similarity over whole texts."""
    left = pairs.join(sets.select(F.col("gid").alias("a"), F.col("set").alias("mine")), "a")
    both = left.join(sets.select(F.col("gid").alias("b"), F.col("set").alias("theirs")), "b")
    common = F.size(F.array_intersect("mine", "theirs"))
    scored = both.select("a", "b", (F.size("mine") + F.size("theirs")).alias("sizes"), common.alias("common"))
    return scored.select("a", "b", (F.col("common") / (F.col("sizes") - F.col("common"))).alias("jaccard")).where(
        F.col("jaccard") >= similarity)


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``gid``, ``tag`` (tells rows apart) and ``root`` of its class."""
    keys = checkpoint(banded(docs, similarity).withColumn("tag", F.monotonically_increasing_id()))
    texts = keys.where("n > 0").groupBy("gid").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    texts = written(texts)
    partners = covered(texts.select("gid", F.col("gid").alias("root"), "n", "tokens"), similarity)
    texts = written(texts.drop("tokens").join(partners, "gid"))
    sets = shingle_sets(docs, texts)
    roots = checkpoint(components(verified(candidates(texts), sets, similarity))).withColumnRenamed("node", "gid")
    whole = sets.select("gid", "n", F.transform("set", lambda h: F.shiftright(h, 32).cast("int")).alias("tokens"))
    whole = whole.join(roots, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    missed = verified(pairs_across(whole, similarity), sets, similarity).select("a", "b")
    for end in ("a", "b"):
        missed = missed.join(roots.withColumnRenamed("gid", end), end, "left").withColumn(
            end, F.coalesce("root", end)).drop("root")
    above = checkpoint(components(missed)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    rows = keys.select("doc_id", "gid", "tag").join(roots, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    return rows.join(above, "root", "left").select("doc_id", "gid", "tag", F.coalesce("top", "root").alias("root"))


def _named(rows: DataFrame) -> DataFrame:
    """Of each class its ``root``, first row (smallest id, nulls last) and size."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("tag"), F.col("gid"))
    return rows.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("class_size"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``class_id`` (smallest id of the class), ``class_size`` and ``kept`` (one row of each class).

    One row per row of ``docs``; repeated rows are members of their class. An empty table gives no rows.
    """
    rows = checkpoint(classes(docs, similarity))
    # Written first, so that the join deals its sides anew and can split the rows of a large class.
    named = checkpoint(_named(rows).select(
        "root", F.col("first.doc_id").alias("class_id"), F.col("first.tag").alias("t"), "class_size"))
    return rows.join(named, "root").select("doc_id", "class_id", "class_size", (F.col("tag") == F.col("t")).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest id; columns as they are."""
    rows = checkpoint(classes(docs, similarity))
    first = _named(rows).select(F.col("first.doc_id").alias("i"), F.col("first.gid").alias("g"))
    copies = rows.groupBy(F.col("doc_id").alias("i"), F.col("gid").alias("g")).agg(F.count("*").alias("n"))
    stay = checkpoint(first.join(copies, first["i"].eqNullSafe(copies["i"]) & (first["g"] == copies["g"])).select(
        first["i"], first["g"], "n"))
    gid, mine = free_name(docs, "gid"), [f"`{c}`" for c in docs.columns]
    hashed = docs.withColumn(gid, text_hash())

    def chosen(condition: str) -> DataFrame:
        s = stay.where(condition)
        return hashed.join(s, (F.col(f"`{gid}`") == s["g"]) & hashed["doc_id"].eqNullSafe(s["i"]), "left_semi")

    # Rows that repeat both id and text are told apart by nothing that survives a second reading: any one stays.
    return chosen("n = 1").unionByName(chosen("n > 1").dropDuplicates(["doc_id", gid])).select(*mine)
