"""Candidates for the user dictionary: collected from texts, kept by surface, moved between states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsugumi import params as P
from tsugumi.functions.analysis import candidate_kind, segments
from tsugumi.functions.text import utrim

COLUMNS = ["surface", "frequency", "pos", "source", "first_seen", "last_seen", "status"]


def collected(texts: DataFrame, text: str, known: DataFrame | None = None) -> DataFrame:
    """surface, pos, texts: terms of two characters or more that may enter the dictionary and how many texts have them.

    Within a text, spellings that differ in case count as the first of them. Texts of fewer than four
    bytes give nothing; surfaces in ``known`` (surface, any case) are left out.
    """
    long = texts.filter(F.octet_length(utrim(F.col(text))) >= 4)
    own = long.select(F.filter(segments(F.col(text)), lambda x: candidate_kind(x).isNotNull()).alias("s")).withColumn("l", F.transform("s", F.lower))
    firsts = F.filter("s", lambda x, i: F.array_position("l", F.lower(x)) == i + 1)
    each = own.select(F.explode(firsts).alias("surface")).groupBy("surface").agg(F.count(F.lit(1)).alias("texts"))
    if known is not None:
        each = each.withColumn("_k", F.lower("surface")).join(known.select(F.lower("surface").alias("_k")).distinct(), "_k", "left_anti").drop("_k")
    return each.select("surface", candidate_kind(F.col("surface")).alias("pos"), "texts")


def upserted(candidates: DataFrame, seen: DataFrame, source: str, at: str) -> DataFrame:
    """The candidates after ``seen`` (surface, pos, texts): pending ones gain frequency and a last time, others stay as they are, new ones are pending."""
    joined = candidates.select(*COLUMNS, F.lit(True).alias("_old")).join(seen.select("surface", F.col("pos").alias("_pos"), "texts"), "surface", "full_outer")
    grows = F.col("texts").isNotNull() & (F.coalesce("status", F.lit("pending")) == "pending")
    return joined.select(
        "surface", F.when(grows, F.coalesce("frequency", F.lit(0)) + F.col("texts")).otherwise(F.col("frequency")).alias("frequency"),
        F.when(F.col("_old"), F.col("pos")).otherwise(F.col("_pos")).alias("pos"), F.when(F.col("_old"), F.col("source")).otherwise(F.lit(source)).alias("source"),
        F.when(F.col("_old"), F.col("first_seen")).otherwise(F.lit(at)).alias("first_seen"), F.when(grows, F.lit(at)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.coalesce("status", F.lit("pending")).alias("status"),
    )


def by_surface(rows: DataFrame) -> DataFrame:
    """Rows per term and document (as collected) as one candidate per surface: frequencies summed, pos and source of the first row, accepted before rejected before pending."""
    first = F.struct("first_seen", "candidate_id")
    rank = F.when(F.col("status") == "accepted", 0).when(F.col("status") == "rejected", 1).otherwise(2)
    return rows.filter(utrim(F.col("surface")) != "").groupBy("surface").agg(
        F.coalesce(F.sum("frequency"), F.lit(0)).alias("frequency"), F.min_by("pos", first).alias("pos"), F.min_by("source", first).alias("source"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min_by("status", rank).alias("status"),
    )


def ready(candidates: DataFrame, threshold: int = P.DICTIONARY_THRESHOLD) -> DataFrame:
    """Pending candidates of at least the threshold."""
    return candidates.filter((F.col("status") == "pending") & (F.col("frequency") >= threshold))


def listed(candidates: DataFrame, status: str, limit: int | None = None, threshold: int = P.DICTIONARY_THRESHOLD) -> DataFrame:
    """The ready candidates (status ready) from the most frequent, or those of any other status by surface, ties by surface; the first ``limit`` if given."""
    rows = ready(candidates, threshold).orderBy(F.desc("frequency"), "surface") if status == "ready" else candidates.filter(F.col("status") == status).orderBy("surface")
    return rows.limit(limit) if limit is not None else rows


def to_reject(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """The pending candidates, of any frequency, that a reject list (word, any case) names."""
    return ready(candidates, 0).withColumn("_w", F.lower("surface")).join(words.select(F.lower("word").alias("_w")).distinct(), "_w", "left_semi").drop("_w")


def moved(candidates: DataFrame, surfaces: DataFrame, status: str, only_pending: bool = False) -> DataFrame:
    """The candidates with those in ``surfaces`` (surface) set to ``status``."""
    marked = surfaces.select("surface").distinct().withColumn("_m", F.lit(True))
    change = F.coalesce(F.col("_m"), F.lit(False)) & (F.lit(not only_pending) | (F.col("status") == "pending"))
    return candidates.join(marked, "surface", "left").withColumn("status", F.when(change, F.lit(status)).otherwise(F.col("status"))).drop("_m")


def summary(candidates: DataFrame, threshold: int = P.DICTIONARY_THRESHOLD) -> DataFrame:
    """One row: pending, ready, accepted, rejected."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    return candidates.agg(of("pending").alias("pending"), F.count(F.when((F.col("status") == "pending") & (F.col("frequency") >= threshold), 1)).alias("ready"), of("accepted").alias("accepted"), of("rejected").alias("rejected"))


def export_lines(candidates: DataFrame, existing: DataFrame, threshold: int = P.DICTIONARY_THRESHOLD) -> DataFrame:
    """surface, line of the ready candidates that the dictionary (surface) lacks, as ``surface,POS,reading``."""
    new = ready(candidates, threshold).join(existing.select("surface").distinct(), "surface", "left_anti")
    return new.select("surface", F.concat_ws(",", "surface", F.lit("名詞"), "surface").alias("line"))
