"""Pairs of items within baskets of any width, without gathering a wide basket in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsugumi.plans.bounds import BROADCAST_ROWS

BASKET_ROWS = 512
BLOCK_ITEMS = 256

_PAIRS = "flatten(transform(items, (x, i) -> transform(slice(items, i + 2, size(items)), y -> struct(x AS lo, y AS hi))))"


def gathered(rows: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of rows (basket, item): (basket, items: sorted distinct array) of baskets of at most ``most`` rows, and the distinct (basket, item) rows of the wider ones. Null baskets and items are left out."""
    rows = rows.select("basket", "item").filter("basket is not null and item is not null")
    wide = rows.groupBy("basket").count().filter(F.col("count") > (most or BASKET_ROWS)).select("basket")
    sets = lambda df: df.groupBy("basket").agg(F.sort_array(F.collect_set("item")).alias("items"))
    some = wide.limit(BROADCAST_ROWS + 1).count()  # a job
    if not some:  # plans over the empty side fall away
        return sets(rows), rows.limit(0)
    wide = F.broadcast(wide) if some <= BROADCAST_ROWS else wide
    return sets(rows.join(wide, "basket", "left_anti")), rows.join(wide, "basket", "left_semi").distinct()


def narrow_pairs(narrow: DataFrame, *keep: str) -> DataFrame:
    """``keep``, lo < hi of every pair of every ``items`` array."""
    return narrow.filter(F.size("items") > 1).select(*keep, F.explode(F.expr(_PAIRS)).alias("p")).select(*keep, "p.lo", "p.hi")


def wide_pairs(wide: DataFrame, block: int | None = None) -> DataFrame:
    """basket, lo < hi of every pair within wide baskets: items stand in blocks, and every two blocks of a basket meet in a row of their own."""
    blocks = wide.groupBy("basket").agg(F.ceil(F.count(F.lit(1)) / (block or BLOCK_ITEMS)).cast("int").alias("blocks"))
    rows = wide.join(blocks, "basket").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    held = rows.groupBy("basket", "blocks", "block").agg(F.collect_list("item").alias("items"))
    meet = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.groupBy("basket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")).agg(F.collect_list(F.struct("block", "items")).alias("two"))
    meet = meet.select("basket", F.expr("a = b").alias("own"), F.expr("filter(two, t -> t.block = a)[0].items").alias("l"), F.expr("filter(two, t -> t.block = b)[0].items").alias("r")).filter("l is not null and r is not null")
    pair = meet.select("basket", "own", F.explode("l").alias("x"), "r").select("basket", "own", "x", F.explode("r").alias("y")).filter("not own or x < y")
    return pair.select("basket", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
