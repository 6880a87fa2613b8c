"""Pairs of items that occur together, counted once per distinct basket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsugumi.plans.bounds import broadcast_if_small
from tsugumi.plans.pairs import gathered, narrow_pairs, wide_pairs


def cooccurrences(rows: DataFrame, basket: str, item: str, min_shared: int = 1) -> DataFrame:
    """entity_a < entity_b, shared, n_a, n_b, total, lift, conviction of every pair that shares ``min_shared`` baskets.

    total is the number of baskets with an item; lift is shared * total / (n_a * n_b); conviction of
    "a implies b" is null where it never fails. Null baskets and items count not at all, repeated rows
    once; a wide basket is never gathered in one place, and wide baskets of the same items are told by the number
    of their items and two 64-bit hashes over them. An empty table gives no pair.
    """
    single, wide = gathered(rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")))
    narrow = single.groupBy("items").agg(F.count(F.lit(1)).alias("weight"))  # baskets of the same items are one, with a weight
    # Of wide baskets with the same items one stands for all; its weight goes with its name, so no pair is joined with it.
    marks = wide.groupBy("basket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("item")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("y"))
    kept = broadcast_if_small(marks.groupBy("n", "x", "y").agg(F.min("basket").alias("basket"), F.count(F.lit(1)).alias("weight")).select("basket", "weight"))
    wide = wide.join(kept, "basket").select(F.struct("basket", "weight").alias("basket"), "item")
    each = narrow_pairs(narrow, "weight").unionByName(wide_pairs(wide).select("basket.weight", "lo", "hi"))
    shared = each.groupBy(F.col("lo").alias("entity_a"), F.col("hi").alias("entity_b")).agg(F.sum("weight").alias("shared")).filter(F.col("shared") >= min_shared)
    counts = narrow.select(F.explode("items").alias("item"), "weight").unionByName(wide.select("item", "basket.weight")).groupBy("item").agg(F.sum("weight").alias("n"))
    total = narrow.select(F.sum("weight").alias("t")).unionByName(wide.select("basket").distinct().select(F.sum("basket.weight").alias("t"))).select(F.sum("t").alias("total"))
    scored = shared.join(counts.select(F.col("item").alias("entity_a"), F.col("n").alias("n_a")), "entity_a").join(counts.select(F.col("item").alias("entity_b"), F.col("n").alias("n_b")), "entity_b")
    scored = scored.join(F.broadcast(total))
    fails = 1 - F.col("shared") / F.col("n_a")
    return scored.select(
        "entity_a", "entity_b", "shared", "n_a", "n_b", "total",
        (F.col("shared") * F.col("total") / F.col("n_a") / F.col("n_b")).alias("lift"),
        F.when(fails > 0, (1 - F.col("n_b") / F.col("total")) / fails).alias("conviction"),
    )


def beyond_chance(scored: DataFrame, times: int) -> DataFrame:
    """The pairs that occur together more than ``times`` as often as chance, by exact arithmetic."""
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    return scored.filter(wide("shared") * wide("total") > wide("n_a") * wide("n_b") * times)
