"""Finding the local image file of each listing, and images with like hashes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import image as I, text as X


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def _join(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")


def image_paths(export_prefix: str = "agent_shop_") -> Column:
    """Places where a listing's image may be, in the order in which they are tried.

    The stored archive path below the source file's folder, then the image name in
    ``images`` next to the file, in the folder itself, in ``images`` one folder up, and in
    the image folder that belongs to an export file named ``<prefix><stamp>``.
    """
    source = F.col("source_file")
    here = _folder(source)
    stem = F.regexp_replace(F.regexp_extract(source, r"([^/]*)$", 1), r"\.[^.]+$", "")
    name = F.regexp_extract(X.clean_text("image_file"), r"([^/]*)$", 1)
    stored = F.filter(F.split(X.clean_text("zip_path"), "/"), lambda p: ~p.isin("", ".", ".."))
    stamp = F.regexp_extract(stem, f"^{export_prefix}(.+)$", 1)
    images = F.lit("images")
    places = F.array(
        F.when(F.size(stored) > 0, _join(here, F.array_join(stored, "/"))),
        F.when(name != "", _join(here, images, name)),
        F.when(name != "", _join(here, name)),
        F.when(name != "", _join(_folder(here), images, name)),
        F.when((name != "") & (stamp != ""), _join(here, F.concat(F.lit(f"{export_prefix}images_"), stamp), images, name)),
    )
    return F.array_distinct(F.array_compact(places))


def resolve_images(listings: DataFrame, inventory: DataFrame, export_prefix: str = "agent_shop_") -> DataFrame:
    """Set ``image_path`` to the first candidate that exists; the remote URL stays only
    where no file was found.

    Only ids and candidate paths are exploded and joined with the inventory (``path``).
    """
    tried = listings.select("id", F.posexplode(image_paths(export_prefix)).alias("_pos", "path"))
    found = tried.join(inventory.select("path").distinct(), "path").groupBy("id").agg(
        F.min_by("path", "_pos").alias("_found")
    )
    joined = listings.join(found, "id", "left")
    local = F.col("_found").isNotNull()
    return joined.withColumns(
        {
            "image_path": F.coalesce("_found", F.lit("")),
            "image_src": F.when(local, F.lit("")).otherwise(F.col("image_src")),
        }
    ).drop("_found")


#: A hash is cut into parts of equal width.
PARTS, PART_BITS = 4, 16


def near_hashes(signatures: DataFrame, distance: int, hash_column: str = "hash") -> DataFrame:
    """All pairs of different 64-bit hashes at most ``distance`` bits apart: ``hash_a < hash_b``, ``distance`` and how many
    rows have each (``images_a``, ``images_b``).

    Of two such hashes at least one of the four parts differs in no more than a quarter of the bits, so one side's parts
    with up to that many bits turned meet the other side's parts in an equality join. A pair counts at its first such part.
    Rows with equal hashes are members of their hash and are not paired; null hashes have no neighbours.
    """
    reach = distance // PARTS
    masks = [sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(PART_BITS), n)]
    rows = signatures.filter(F.col(hash_column).isNotNull()).groupBy(F.col(hash_column).alias("h")).agg(F.count("*").alias("images"))

    def part(h: str, number: int) -> Column:
        return F.shiftrightunsigned(h, PART_BITS * number).bitwiseAND(F.lit((1 << PART_BITS) - 1)).cast("int")

    def cut(side: str) -> DataFrame:
        parts = F.array(*[part("h", n) for n in range(PARTS)])
        return rows.select(F.col("h").alias(f"hash_{side}"), F.col("images").alias(f"images_{side}"), F.posexplode(parts).alias("part", "value"))

    turned = cut("b").withColumn("value", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: m.bitwiseXOR(F.col("value")))))
    apart = I.hamming("hash_a", "hash_b")
    earlier = [F.bit_count(part("hash_a", n).bitwiseXOR(part("hash_b", n))) > reach for n in range(PARTS)]
    first = F.lit(True)
    for n in range(1, PARTS):
        first = first & ((F.col("a.part") < n) | earlier[n - 1])
    # Spark takes the turned rows for as small as the hashes they are made of, and would send them through the driver.
    met = cut("a").alias("a").hint("merge").join(turned.alias("b").hint("merge"), (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value"))
                                   & (F.col("hash_a") < F.col("hash_b")) & first & (apart <= distance))
    return met.select("hash_a", "hash_b", apart.alias("distance"), "images_a", "images_b")
