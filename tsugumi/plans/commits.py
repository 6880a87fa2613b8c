"""Numbered small files in a shared folder, each published whole and once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Commits:
    """The files ``<number>.json`` of ``folder``. Works on any Hadoop file system that renames or links in one step without overwriting (HDFS, local disks)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self._jvm, self._conf, self._gateway = folder, spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(self._conf)

    def names(self) -> list[str]:
        where = self._path(self.folder)
        return sorted(n for s in self._fs.listStatus(where) if (n := s.getPath().getName()).endswith(".json")) if self._fs.exists(where) else []

    @staticmethod
    def name(number: int) -> str:
        return f"{number:012d}.json"

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, number: int, content: dict) -> None:
        """Writes a draft beside the folder and gives it its name in one step; RuntimeError if another writer has published this number."""
        draft = self._fs.makeQualified(self._path(f"{self.folder}-drafts/{uuid.uuid4().hex}"))
        final = self._fs.makeQualified(self._path(f"{self.folder}/{self.name(number)}"))
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        taken = ("FileAlreadyExists", "exists")
        try:
            if draft.toUri().getScheme() == "file":  # a hard link fails where the name is taken; a local rename would overwrite it
                at = self._jvm.java.nio.file.Paths.get
                self._jvm.java.nio.file.Files.createLink(at(final.toUri()), at(draft.toUri()))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
                context.rename(draft, final, self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if any(t in str(e) for t in taken):
                raise RuntimeError(f"{self.folder}: {number} exists") from e
            raise
        finally:
            self._fs.delete(draft, False)
