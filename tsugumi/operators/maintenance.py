"""Keeping an index current: what to do with each file, chunk and vector."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsugumi import params as P


def document_actions(indexed: DataFrame, seen: DataFrame, complete: bool = False) -> DataFrame:
    """file_path, op of ``seen`` (file_path, file_hash; null hash: the file is gone) against ``indexed``: insert, update, skip, delete.

    With ``complete`` the listing is the whole tree, and indexed paths that it lacks are deleted as well.
    """
    joined = indexed.select("file_path", F.col("file_hash").alias("_old"), F.lit(True).alias("_had")).join(seen.select("file_path", F.col("file_hash").alias("_new"), F.lit(True).alias("_seen")), "file_path", "full_outer")
    op = F.when(F.col("_seen").isNull(), F.lit("delete") if complete else F.lit("skip")).when(F.col("_new").isNull(), F.when(F.col("_had"), "delete").otherwise("skip"))
    op = op.when(F.col("_had").isNull(), "insert").when(F.col("_old").eqNullSafe(F.col("_new")), "skip").otherwise("update")
    return joined.select("file_path", op.alias("op"))


def chunk_actions(old: DataFrame, new: DataFrame) -> DataFrame:
    """document_id, chunk_index, op: keep (same hash), update (other or unknown hash), insert, delete, by position in the document."""
    key = ["document_id", "chunk_index"]
    joined = old.select(*key, F.col("content_hash").alias("_old"), F.lit(1).alias("_a")).join(new.select(*key, F.col("content_hash").alias("_new"), F.lit(1).alias("_b")), key, "full_outer")
    op = F.when(F.col("_b").isNull(), "delete").when(F.col("_a").isNull(), "insert").when(F.col("_old") == F.col("_new"), "keep").otherwise("update")
    return joined.select(*key, op.alias("op"))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of a child table whose parent is not among ``gone``."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def lacking_vectors(chunks: DataFrame, vectors: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Chunks with neither a vector nor an entry on the skip list."""
    missing = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")
    return missing if skipped is None else missing.join(skipped.select("chunk_id"), "chunk_id", "left_anti")


def page(rows: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The next ``size`` rows by key."""
    return rows.filter(F.col(key) > after).orderBy(key).limit(size)


def hashed_embedding(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An encoder without a model: character trigrams hashed into ``dim`` signed buckets, unit length."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for i in range(max(len(t) - 2, 1)):
                h = int.from_bytes(hashlib.blake2b(t[i : i + 3].encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1 if h >> 63 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out

    return encode


def cut_bytes(text: str, limit: int = P.ENCODE_BYTES) -> str:
    """At most ``limit`` bytes of UTF-8, cut between characters."""
    return text.encode()[:limit].decode(errors="ignore")


def _encode(encoder: Callable[[list[str]], list[list[float]]], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(i).to_pylist() for i in range(2))
            for k in range(0, len(ids), size):
                part = [cut_bytes(t or "") for t in texts[k : k + size]]
                try:
                    made = encoder(part)
                    if len(made) != len(part):
                        raise ValueError("embedding_count_mismatch")
                    done = [(v or None, None if v else "empty_embedding") for v in made]
                except Exception:  # one bad text must not cost the batch: again, one by one
                    done = []
                    for t in part:
                        try:
                            v = encoder([t])[0]
                            done.append((v or None, None if v else "empty_embedding"))
                        except Exception:
                            done.append((None, "encode_error"))
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + size], pa.int64()), pa.array([v for v, _ in done], pa.list_(pa.float32())), pa.array([e for _, e in done], pa.string())], names=["chunk_id", "embedding", "reason"])

    return run


def encoded(chunks: DataFrame, encoder: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """chunk_id, embedding, reason of every chunk; reason (for the skip list) where there is no embedding. Whole content is passed up to the encoder's byte limit."""
    return chunks.select("chunk_id", "content").mapInArrow(_encode(encoder, batch), "chunk_id long, embedding array<float>, reason string")


def health(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """section, status, message, value, hint: counts of the index, with a warning and what to do where chunks lack vectors or candidates wait."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("message"), "value")
    rows = count(documents, "documents").unionByName(count(chunks, "chunks")).unionByName(count(vectors, "vectors")).withColumns({"section": F.lit("Database"), "status": F.lit("ok")})
    missing = count(lacking_vectors(chunks, vectors), "chunks_without_vectors").withColumns({"section": F.lit("Embedder"), "status": F.when(F.col("value") > 0, "warning").otherwise("ok")})
    rows = rows.unionByName(missing)
    if candidates is not None:
        from tsugumi.operators.dictionary import ready

        rows = rows.unionByName(count(ready(candidates), "dictionary_ready").withColumns({"section": F.lit("Dictionary"), "status": F.when(F.col("value") > 0, "warning").otherwise("ok")}))
    hint = F.when(F.col("section") == "Embedder", "fill_vectors").when(F.col("section") == "Dictionary", "update_dictionary")
    return rows.select("section", "status", "message", "value", F.when(F.col("status") != "ok", hint).alias("hint"))


def issues(report: DataFrame) -> int:
    """How many lines of a report are no ok."""
    return report.filter("status <> 'ok'").count()


def seconds_left(done: int, total: int, elapsed: float) -> float | None:
    """Time that the rest will take at the rate so far; null before anything is done."""
    return None if done <= 0 or elapsed <= 0 else max(total - done, 0) * elapsed / done
