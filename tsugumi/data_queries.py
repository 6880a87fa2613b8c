"""Queries of the data-preparation operators that belong to the core."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsugumi.operators.incremental import changed_files, committed, run_increment, unprocessed, upper_limit
from tsugumi.operators.times import fit_zones, normalised
from tsugumi.functions.instants import with_instant
from tsugumi.instants_sql import instants
from tsugumi.plans.bounds import checkpointed, shared_folder
from tsugumi.plans.segments import segmented
from tsugumi.tables import table


def written_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_kind, rec_id, field, value, zone of every written time of documents and messages."""
    zones = table(spark, sf_dir, "sources").groupBy("source").agg(F.min("tz_name").alias("zone"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "created", "updated").join(zones, "source", "left")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("created", "updated")]))
    documents = documents.select(F.lit("document").alias("rec_kind"), F.col("doc_id").alias("rec_id"), "zone", each.alias("_x")).select("rec_kind", "rec_id", "_x.field", "_x.value", "zone")
    messages = table(spark, sf_dir, "session_messages").select(
        F.lit("message").alias("rec_kind"), F.col("msg_id").alias("rec_id"), F.lit("msg_timestamp").alias("field"), F.col("msg_timestamp").alias("value"), F.col("client_tz").alias("zone")
    )
    return documents.unionByName(messages)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(written_times(spark, sf_dir), "value", "zone", ["rec_kind", "rec_id", "field"])


ZONED = r"(?i)(Z|[+−-]\d{2}(:?\d{2})?|\]|[A-Z]{3,4})\s*$|^\s*[\d.]+\s*$"


def is_local(value: Column) -> Column:
    """Whether a written time tells no zone."""
    return ~value.rlike(ZONED) | value.rlike("[AP]M *$")


def zone_bounds(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """rec_kind, stated_tz, local_us, lower, upper of the written times (null local_us: those that tell their zone).

    ``messages``: session_id, line_no, msg_id, value, zone. A message lies between the nearest known instants before and after it in its
    session. ``documents``: value, zone, indexed_at. A document was written before it was indexed. Sessions without line
    numbers have no order but that of their times (msg_id is the order of arrival, which is not that of sending), so no bounds.
    """
    def timed(rows: DataFrame) -> DataFrame:
        # Read once, as if in UTC: that is the local time of those without a zone, and the instant of the others.
        rows = with_instant(rows.withColumns({"_utc": F.lit("UTC"), "_local": is_local(F.col("value"))}), "value", "_utc", "_at")
        return rows.withColumns({"local_us": F.when(F.col("_local"), F.col("_at")), "known": F.when(~F.col("_local"), F.col("_at")), "stated_tz": F.coalesce("zone", F.lit("UTC"))})

    all_messages = timed(messages)
    numbered = segmented(all_messages.filter("line_no is not null").select("session_id", "line_no", "msg_id", "stated_tz", "local_us", "known"), ["session_id"], ["line_no", "msg_id"], carried=["known"])
    out = numbered.select(F.lit("message").alias("rec_kind"), "stated_tz", "local_us", F.col("last_known").alias("lower"), F.col("coming_known").alias("upper"))
    none = F.lit(None).cast("long")
    out = out.unionByName(all_messages.filter("line_no is null").select(F.lit("message").alias("rec_kind"), "stated_tz", "local_us", none.alias("lower"), none.alias("upper")))
    return out.unionByName(timed(documents).select(F.lit("document").alias("rec_kind"), "stated_tz", "local_us", none.alias("lower"), F.unix_micros(F.col("indexed_at").cast("timestamp")).alias("upper")))


def p5_zone_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which offset history the local times of each stated zone of clients and sources fit, messages between the known times of their session, documents before they were indexed."""
    messages = table(spark, sf_dir, "session_messages").select("session_id", "line_no", "msg_id", F.col("msg_timestamp").alias("value"), F.col("client_tz").alias("zone"))
    zones = table(spark, sf_dir, "sources").groupBy("source").agg(F.min("tz_name").alias("zone"))
    documents = table(spark, sf_dir, "documents").select("source", F.explode(F.array("created", "updated")).alias("value"), "indexed_at").join(zones, "source", "left").select("value", "zone", "indexed_at")
    candidates = table(spark, sf_dir, "sources").select(F.col("tz_name").alias("zone")).filter("zone is not null")
    return fit_zones(zone_bounds(messages, documents), ["rec_kind", "stated_tz"], "local_us", "lower", "upper", candidates)


def p5_zone_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_kind, stated_tz, zone (the one chosen when the stated zone is hidden), recovered, records, bounded, violations, and same_instants: how many of the local times the chosen zone turns into the instant that the stated one gives."""
    chosen = checkpointed(p5_zone_fit(spark, sf_dir).filter("rank = 1").drop("rank"))  # a row per group, read twice
    written = written_times(spark, sf_dir).withColumn("stated_tz", F.coalesce("zone", F.lit("UTC"))).join(F.broadcast(chosen.select("rec_kind", "stated_tz", F.col("zone").alias("_fit"))), ["rec_kind", "stated_tz"])  # a row per group
    local = written.filter(is_local(F.col("value")))
    both = with_instant(with_instant(local, "value", "stated_tz", "_a"), "value", "_fit", "_b")
    same = both.groupBy("rec_kind", "stated_tz").agg(F.count(F.when(F.col("_a") == F.col("_b"), 1)).alias("same_instants"))
    return chosen.join(same, ["rec_kind", "stated_tz"], "left").select("rec_kind", "stated_tz", "zone", (F.col("zone") == F.col("stated_tz")).alias("recovered"), "records", "bounded", "violations", F.coalesce("same_instants", F.lit(0)).alias("same_instants"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first run of a consumer commits: its upper limit is fixed at the start, rows and watermark are published together."""
    return unprocessed(table(spark, sf_dir, "file_scans"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "chunks"), _fresh_folder(spark))


def _fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/increments-{uuid.uuid4().hex}"


def p7_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What successive runs with watermark and commit put out, one of them lost before its commit: the rows of p7_found.

    The first run sees a third of the scans and half of the chunks, the lost one and its repetition two thirds. A file that a
    run put out and whose newest scan is the indexed state again has nothing left to process, so it is left out at the end.
    """
    scans, documents, chunks = (table(spark, sf_dir, t) for t in ("file_scans", "documents", "chunks"))
    folder = _fresh_folder(spark)
    end = upper_limit(scans)

    def lose() -> None:
        raise InterruptedError

    run_increment(scans.filter(F.col("scan_id") <= end // 3), documents, folder, chunks.filter("chunk_id % 2 = 0"))
    with contextlib.suppress(InterruptedError):
        run_increment(scans.filter(F.col("scan_id") <= end * 2 // 3), documents, folder, chunks, lose)
    run_increment(scans.filter(F.col("scan_id") <= end * 2 // 3), documents, folder, chunks)
    run_increment(scans, documents, folder, chunks)
    rows = committed(spark, folder).select("rec_kind", "rec_key", "file_path")
    files = rows.filter("rec_kind = 'file'").distinct().join(changed_files(scans, documents, 0, end).select("file_path"), "file_path", "left_semi")
    return files.select("rec_kind", "rec_key").unionByName(rows.filter("rec_kind = 'chunk'").select("rec_kind", "rec_key"))


QUERIES = {"p5_found": p5_found, "p5_zone_fit": p5_zone_fit, "p5_zone_recovery": p5_zone_recovery, "p7_found": p7_found, "p7_increments": p7_increments}

SQL = {
    "p7_found": """
WITH newest AS (
  SELECT file_path, arg_max(lower(trim(file_hash)), (scanned_at, scan_id)) AS scan_hash
  FROM file_scans WHERE file_hash IS NOT NULL AND file_path IS NOT NULL GROUP BY file_path)
SELECT 'file' AS rec_kind, n.file_path AS rec_key
FROM newest n LEFT JOIN documents d ON d.file_path = n.file_path
WHERE n.scan_hash IS DISTINCT FROM lower(trim(d.file_hash))
UNION ALL
SELECT 'chunk', CAST(chunk_id AS VARCHAR) FROM chunks
WHERE content_hash IS NULL OR content IS NULL OR lower(trim(content_hash)) <> sha256(content)
""",
}
SQL["p7_increments"] = SQL["p7_found"]
_WRITTEN = """SELECT 'document' AS rec_kind, doc_id AS rec_id, field, CASE field WHEN 'created' THEN created ELSE updated END AS value, z.zone FROM documents CROSS JOIN (SELECT unnest(['created', 'updated']) AS field)
LEFT JOIN (SELECT source, min(tz_name) AS zone FROM sources GROUP BY 1) z USING (source) UNION ALL SELECT 'message', msg_id, 'msg_timestamp', msg_timestamp, client_tz FROM session_messages"""
SQL["p5_found"] = f"WITH {instants(_WRITTEN, 'rec_kind, rec_id, field')} SELECT rec_kind, rec_id, field, utc_us FROM instants WHERE utc_us IS NOT NULL"
