"""Only what is new or changed since the last committed run.

Scans carry a commit sequence (``scan_id``, order of arrival). A run fixes its upper limit once at
its start, works on rows above the last committed watermark up to that limit, and commits its output
together with the new watermark by renaming one small file. A run that dies leaves no commit, so the
next one starts from the same watermark: nothing is skipped and nothing is repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsugumi.functions.text import utrim
from tsugumi.plans.bounds import broadcast_if_small
from tsugumi.plans.commits import Commits


def plain_hash(c: Column) -> Column:
    """Hex digest without letter case and surrounding blanks."""
    return F.lower(utrim(c))


def upper_limit(scans: DataFrame, sequence: str = "scan_id") -> int:
    """The highest sequence number at the start of a run; 0 for an empty table."""
    return scans.agg(F.coalesce(F.max(sequence), F.lit(0)).alias("m")).first().m


def changed_files(scans: DataFrame, documents: DataFrame, after: int, upto: int) -> DataFrame:
    """``file_path``, ``scan_hash``, ``scan_id`` of files whose newest state differs from the indexed one.

    Considered are the paths with a scan in (``after``, ``upto``]; a path's newest state is its last
    by ``scanned_at`` (then by ``scan_id``) of all scans up to ``upto``, so a late row never hides a
    newer one. Scans with null hash or null path are ignored, a null ``scanned_at`` is the oldest. A
    path that is not in ``documents``, or has a null hash there, counts as changed. Repeated scans
    change nothing.
    """
    known = scans.filter(F.col("file_hash").isNotNull() & F.col("file_path").isNotNull() & (F.col("scan_id") <= upto))
    if after > 0:  # only the history of paths that were scanned since is grouped
        known = known.join(broadcast_if_small(known.filter(F.col("scan_id") > after).select("file_path").distinct()), "file_path", "left_semi")
    newest = known.groupBy("file_path").agg(
        F.max_by("file_hash", F.struct("scanned_at", "scan_id")).alias("_hash"), F.max("scan_id").alias("scan_id")
    )
    newest = newest.select("file_path", plain_hash(F.col("_hash")).alias("scan_hash"), "scan_id")
    indexed = documents.filter(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.max(plain_hash(F.col("file_hash"))).alias("_indexed"))
    return newest.join(indexed, "file_path", "left").filter(~F.col("scan_hash").eqNullSafe(F.col("_indexed"))).drop("_indexed")


def stale_chunks(chunks: DataFrame, *more: str) -> DataFrame:
    """``chunk_id`` of chunks whose stored hash is null or not the SHA-256 of their content (null content has no hash)."""
    real = F.sha2(F.encode("content", "UTF-8"), 256)
    return chunks.filter(~F.coalesce(plain_hash(F.col("content_hash")) == real, F.lit(False))).select("chunk_id", *more)


class Progress:
    """Commits of a consumer in a folder that all executors share: one file per commit, named by its number."""

    def __init__(self, spark: SparkSession, folder: str):
        self._commits = Commits(spark, f"{folder}/commits")

    def last(self) -> dict:
        """The last commit: number, watermark and data folder; zero and none before the first."""
        names = self._commits.names()
        return self._commits.read(names[-1]) if names else {"number": 0, "watermark": 0, "data": None}

    def places(self) -> list[str]:
        """The data folders of all commits."""
        return [self._commits.read(name)["data"] for name in self._commits.names()]

    def commit(self, number: int, watermark: int, data: str) -> None:
        """Publishes; raises if another run published this number first."""
        self._commits.publish(number, {"number": number, "watermark": watermark, "data": data})


def fresh_chunks(chunks: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """``chunk_id``, ``state`` of the stale chunks that did not come out in this state last. ``seen``: chunk_id, state, number of what came out before.

    Chunks carry no sequence, so a digest of content and stored hash stands for their state.
    """
    part = lambda c: F.coalesce(F.sha2(F.encode(c, "UTF-8"), 256), F.lit("-"))
    now = stale_chunks(chunks.withColumn("_state", F.concat_ws(" ", part("content"), part("content_hash"))), "_state").withColumnRenamed("_state", "state")
    if seen is None:
        return now
    last = seen.groupBy(F.col("chunk_id").alias("_c")).agg(F.max_by("state", "number").alias("_s"))
    return now.join(last, F.col("chunk_id").eqNullSafe(F.col("_c")) & (F.col("state") == F.col("_s")), "left_anti")


def run_increment(scans: DataFrame, documents: DataFrame, folder: str, chunks: DataFrame | None = None, before_commit: Callable[[], None] = lambda: None) -> dict:
    """One run: writes the changed files above the watermark and the stale ``chunks`` that no run put out, and commits both at once. Returns the commit (the last one if nothing arrived).

    Rows: rec_kind, rec_key, and file_path, scan_hash, scan_id of files, chunk_id, state of chunks, number of the commit.
    ``before_commit`` is called when all is written.
    """
    spark = scans.sparkSession
    progress = Progress(spark, folder)
    last = progress.last()
    upto = upper_limit(scans)
    rows = changed_files(scans, documents, last["watermark"], upto).select(F.lit("file").alias("rec_kind"), F.col("file_path").alias("rec_key"), "*")
    if chunks is not None:
        done = committed(spark, folder)
        fresh = fresh_chunks(chunks, None if done is None else done.filter("rec_kind = 'chunk'"))
        rows = rows.unionByName(fresh.select(F.lit("chunk").alias("rec_kind"), F.col("chunk_id").cast("string").alias("rec_key"), "*"), allowMissingColumns=True)
    else:
        rows = rows.withColumns({"chunk_id": F.lit(None).cast("long"), "state": F.lit(None).cast("string")})
    if last["number"] and upto <= last["watermark"] and (chunks is None or rows.isEmpty()):
        return last
    data = f"{folder}/data/{uuid.uuid4().hex}"
    rows.withColumn("number", F.lit(last["number"] + 1)).write.parquet(data)
    before_commit()
    progress.commit(last["number"] + 1, max(upto, last["watermark"]), data)
    return progress.last()


def committed(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all commits; None before the first."""
    places = Progress(spark, folder).places()
    return spark.read.parquet(*places) if places else None


def unprocessed(scans: DataFrame, documents: DataFrame, chunks: DataFrame, folder: str) -> DataFrame:
    """``rec_kind`` (file, chunk), ``rec_key`` of what the run that starts now puts out: all above the watermark in ``folder``, everything in a new one. The run commits."""
    spark = scans.sparkSession
    before = Progress(spark, folder).last()["number"]
    now = run_increment(scans, documents, folder, chunks)["number"]
    return committed(spark, folder).filter((F.col("number") == now) & F.lit(now > before)).select("rec_kind", "rec_key")
