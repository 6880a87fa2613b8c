"""Tables of an index as immutable snapshots behind one pointer."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tsugumi.plans.commits import Commits


class Store:
    """A folder of Parquet snapshots. ``commit`` writes the given tables to new folders and then renames one small file that names the current folder of every table, so readers see all of a commit or none of it."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], partitions: dict[str, str] | None = None):
        """``partitions`` names the column by which a table is laid out in folders."""
        self.spark, self.folder, self.schemas, self.partitions = spark, folder, schemas, partitions or {}
        self._commits = Commits(spark, f"{folder}/versions")

    def pointer(self) -> dict:
        names = self._commits.names()
        return self._commits.read(names[-1]) if names else {"version": 0, "tables": {}}

    def table(self, name: str) -> DataFrame:
        """The current snapshot; empty, with the table's schema, before the first."""
        parts = [self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{at}") for at in self.segments(name)]  # a few
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schemas[name])

    def segments(self, name: str) -> list[str]:
        """The folders of a table's current snapshot."""
        return self.pointer()["tables"].get(name, [])

    def commit(self, tables: dict[str, DataFrame], more: dict[str, DataFrame] | None = None) -> int:
        """Writes and publishes ``tables`` as new snapshots, and ``more`` as rows added to the snapshots there are; returns the version. Raises if another writer published first."""
        old = self.pointer()
        places = dict(old["tables"])
        for name, df in [*tables.items(), *(more or {}).items()]:
            schema = self.spark.createDataFrame([], self.schemas[name]).schema
            at = f"data/{name}-{uuid.uuid4().hex}"
            writer = df.select(*[df[f.name].cast(f.dataType) for f in schema]).write
            (writer.partitionBy(self.partitions[name]) if name in self.partitions else writer).parquet(f"{self.folder}/{at}")
            places[name] = [at] if name in tables else [*places.get(name, []), at]
        version = old["version"] + 1
        self._commits.publish(version, {"version": version, "tables": places})
        return version

    def back_to(self, version: int) -> None:
        """Makes an earlier version the current one, by a new commit of its pointer."""
        if Commits.name(version) not in self._commits.names():
            raise ValueError(f"no version {version}")
        current = self.pointer()["version"] + 1
        self._commits.publish(current, {"version": current, "tables": self._commits.read(Commits.name(version))["tables"]})
