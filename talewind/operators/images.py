"""Equal and nearly equal images by perceptual hash (64 bits). Rows: content_id, platform, hash."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR_BITS = 10
BLOCKS, BLOCK_BITS = 4, 16


def image_hash_matches(hashes: DataFrame) -> DataFrame:
    """Records whose image also appears on another platform: content_id, platform, hash, matches (records elsewhere),
    platforms. The match set of a record is the rows of its hash on other platforms; it is counted, not enumerated,
    so that one image posted everywhere stays linear. ``image_match_members`` resolves one record."""
    rows = hashes.select("content_id", "platform", "hash").distinct()
    per_platform = rows.groupBy("hash", "platform").agg(F.count("*").alias("_here"))
    # At most one row per platform and hash.
    total = per_platform.groupBy("hash").agg(F.sum("_here").alias("_all"), F.count("*").alias("platforms")).filter(F.col("platforms") > 1)
    spread = per_platform.join(total, "hash").select("hash", "platform", (F.col("_all") - F.col("_here")).alias("matches"), "platforms")
    return rows.join(spread, ["hash", "platform"]).select("content_id", "platform", "hash", "matches", "platforms")


def image_match_members(hashes: DataFrame, content_id: object) -> DataFrame:
    """Records on other platforms that show an image of the given record."""
    own = hashes.filter(F.col("content_id") == F.lit(content_id)).select("hash", F.col("platform").alias("_p")).distinct()
    return hashes.join(own, "hash").filter(F.col("platform") != F.col("_p")).select("content_id", "platform", "hash").distinct()


def _block(c: str, number: int):
    return F.shiftright(F.col(c), number * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def image_near_matches(hashes: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """Pairs of distinct hashes that differ in at most ``bits`` of 64 bits: hash_a < hash_b, distance.

    Split in four blocks, two such hashes differ in at most ``bits // 4`` bits of at least one block. One side is
    looked up under its block, the other under the block's neighbours at that distance, so every pair is found. Equal
    images are one hash here, whatever their number; join back to the records for the posts.
    """
    distinct = hashes.select("hash").distinct()
    reach = bits // BLOCKS
    masks = [sum(1 << b for b in flip) for n in range(reach + 1) for flip in combinations(range(BLOCK_BITS), n)]
    mask_array = F.array(*[F.lit(m).cast("long") for m in masks])
    stored = distinct.select(
        F.col("hash").alias("hash_b"),
        F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), _block("hash", i).alias("_k")) for i in range(BLOCKS)])),
    )
    probes = distinct.select(
        F.col("hash").alias("hash_a"),
        F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), _block("hash", i).alias("_own")) for i in range(BLOCKS)])),
    ).select("hash_a", "_i", F.explode(F.transform(mask_array, lambda m: F.col("_own").bitwiseXOR(m))).alias("_k"))
    distance = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))
    near = probes.join(stored, ["_i", "_k"]).filter((F.col("hash_a") < F.col("hash_b")) & (distance <= bits))
    return near.select("hash_a", "hash_b", distance.alias("distance")).distinct()
