"""A directory of change events as a stream that keeps an index table current.

Events (file_path, file_hash, at; a null hash is a deletion) arrive as files. Every micro-batch keeps the
last event of each path and merges it into a snapshot of the index. A snapshot is a folder named by its
batch; a batch that runs again writes the same folder, so retries change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "file_path string, file_hash string, at timestamp"


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path; of equal times the one with the greater hash."""
    return events.groupBy("file_path").agg(F.max_by("file_hash", F.struct("at", "file_hash")).alias("file_hash"), F.max("at").alias("at"))


def merged(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """The snapshot (file_path, file_hash, at) after the events; an event older than the snapshot's row is late and dropped."""
    rows = snapshot.unionByName(latest(events))
    return latest(rows).filter("file_hash is not null")


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName()[6:]) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The newest complete snapshot, or the newest before a batch."""
    known = [n for n in snapshots(spark, folder) if before is None or n < before]
    return spark.read.schema(EVENT).parquet(f"{folder}/batch={known[-1]}") if known else spark.createDataFrame([], EVENT)


def watch(spark: SparkSession, events: str, folder: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Starts the stream; without ``interval`` it handles what there is and ends. Files are read in batches of a debounce interval, repeats within one count once."""
    stream = spark.readStream.schema(EVENT).parquet(events)

    def apply(batch: DataFrame, number: int) -> None:
        merged(current(batch.sparkSession, folder, number), batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def watch_tree(spark: SparkSession, directories: list[str], index, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Calls ``index()`` once for every batch of new or changed files under ``directories``.

    The file source reports no deletions; ``index`` compares the whole listing with what is indexed (as
    ``Engine.index`` without paths does), so files that are gone are found with the next change, or at the next ``periodic`` run of it.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load("{" + ",".join(directories) + "}" if len(directories) > 1 else directories[0])

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.select("path").isEmpty():
            index()

    writer = stream.select("path").writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def periodic(spark: SparkSession, action, checkpoint: str, interval: str) -> StreamingQuery:
    """Calls ``action()`` once every ``interval``: a sweep that finds deletions, or the filling of vectors that are missing."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, number: action()).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
