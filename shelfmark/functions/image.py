"""Image signatures and vectors as Column expressions. Input is decoded pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .text import col, let

HASH_WIDTH, HASH_HEIGHT, BINS = 9, 8, 16


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def luma_of_rgba(pixels: Column | str) -> Column:
    """Brightness of each pixel of a flat RGBA array."""
    p = col(pixels)
    starts = F.sequence(F.lit(0), (F.size(p) / 4).cast("int") - 1)
    return F.transform(starts, lambda i: luma(p[i * 4], p[i * 4 + 1], p[i * 4 + 2]))


def dhash(grid: Column | str) -> Column:
    """64-bit difference hash of a 9x8 brightness grid in row order.

    Bit ``n`` is set when a pixel is brighter than its right neighbour; the eight bits of
    a row fill one byte from its low end.
    """
    g = col(grid)
    bits = F.sequence(F.lit(0), F.lit(63))

    def step(acc: Column, n: Column) -> Column:
        at = (n / 8).cast("int") * HASH_WIDTH + n % 8
        brighter = g[at] > g[at + 1]
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), n)
        return F.when(brighter, acc.bitwiseOR(one)).otherwise(acc)

    return F.aggregate(bits, F.lit(0).cast("bigint"), step)


def luma_histogram(values: Column | str) -> Column:
    """Share of pixels in each of 16 brightness bins."""
    v = col(values)
    binned = F.transform(v, lambda x: F.least(F.lit(BINS - 1), F.floor(x / 256 * BINS).cast("int")))
    return let(
        binned,
        lambda b: F.transform(
            F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: F.size(F.filter(b, lambda x: x == k)) / F.size(b)
        ),
    )


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of bits in which two hashes differ."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def aspect_similarity(a: Column | str, b: Column | str) -> Column:
    def safe(x: Column) -> Column:
        return F.greatest(F.when(F.coalesce(x, F.lit(0.0)) == 0, 1.0).otherwise(x), F.lit(0.01))

    return F.greatest(F.lit(0.0), 1 - F.abs(F.ln(safe(col(a)) / safe(col(b)))) / math.log(2.4))


def signature_similarity(hash_a, hist_a, ratio_a, hash_b, hist_b, ratio_b) -> Column:
    """0.74 hash agreement, 0.21 histogram overlap, 0.05 shape."""
    same_bits = 1 - F.bit_count(col(hash_a).bitwiseXOR(col(hash_b))) / 64
    overlap = F.aggregate(
        F.zip_with(col(hist_a), col(hist_b), lambda x, y: F.least(x, y).cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return same_bits * 0.74 + overlap * 0.21 + aspect_similarity(ratio_a, ratio_b) * 0.05


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(c: Column | str) -> Column:
    """Vector scaled to unit length; a zero vector stays as it is."""
    v = col(c)
    return let(
        F.sqrt(dot(v, v)),
        lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))),
    )


def decode_payload(c: Column | str) -> Column:
    """Bytes of a base64 text or data URL; NULL when missing or not base64."""
    text = F.coalesce(col(c), F.lit(""))
    body = F.when(F.startswith(text, F.lit("data:")), F.regexp_extract(text, "(?s)^data:[^,]*,(.*)$", 1)).otherwise(text)
    return F.try_to_binary(F.nullif(body, F.lit("")), F.lit("base64"))
