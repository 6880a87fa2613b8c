"""Ranking: full text, vectors, fusion, and the factors of the final score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsugumi import params as P
from tsugumi.functions.analysis import index_terms
from tsugumi.functions.text import utrim
from tsugumi.operators.fulltext import scored
from tsugumi.plans.bounds import few, limited

TOP = 15


def document_frequencies(chunks: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """term, df, cf. Every term stands once for each place and once for each text; both are summed on the map side, so a hot term moves one row per task."""
    t = F.col("t")
    places, texts = F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(1).alias("cf"), F.lit(0).alias("df"))), F.transform(F.array_distinct(t), lambda x: F.struct(x.alias("term"), F.lit(0).alias("cf"), F.lit(1).alias("df")))
    each = chunks.select(index_terms(F.col(text)).alias("t")).select(F.explode(F.concat(places, texts)).alias("x"))
    return each.groupBy(F.col("x.term").alias("term")).agg(F.sum("x.df").alias("df"), F.sum("x.cf").alias("cf"))


def corpus_statistics(chunks: DataFrame, text: str = "content") -> DataFrame:
    """One row: n (all rows), avgdl (mean number of index terms, null texts as 0)."""
    return chunks.select(F.size(index_terms(F.col(text))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def _phrase_count(tokens: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda x: x == phrase[0]))
    # A look-ahead finds occurrences that overlap; terms hold letters and digits only.
    return F.regexp_count(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(f"(?= {' '.join(phrase)} )"))


def bm25(chunks: DataFrame, groups: list[list[list[str]]], key: str = "chunk_id", text: str = "content", k1: float = P.BM25_K1, b: float = P.BM25_B) -> DataFrame:
    """key, score of the rows that match ``groups``: an OR of groups, a group being an AND of phrases, a phrase a list of terms.

    A phrase gives credit only in the groups that match. An empty phrase (punctuation only) makes its
    group match nothing; without any other group the result is empty. For texts without an index (see ``fulltext``): they are
    scanned, nothing but rows of statistics is moved.
    """
    groups = [g for g in groups if g and all(g)]
    tokens = chunks.select(key, index_terms(F.col(text)).alias("t"))
    flat = [(i, j, p) for i, g in enumerate(groups) for j, p in enumerate(g)]
    if not flat:
        return chunks.select(key, F.lit(0.0).alias("score")).limit(0)
    counted = tokens.select(key, F.size("t").alias("dl"), *[_phrase_count(F.col("t"), p).alias(f"tf_{i}_{j}") for i, j, p in flat])
    return scored(counted, counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")), groups, key, k1, b)


def top(ranked: DataFrame, k: int, score: str = "score", key: str = "chunk_id") -> DataFrame:
    """The k best by score, ties by key."""
    return ranked.orderBy(F.desc(score), key).limit(k)


def ranks(held: DataFrame, score: str, key: str = "chunk_id", first: int = 0, descending: bool = True) -> DataFrame:
    """key, rank (from ``first``) of a result that was limited before: the window sees no more than those rows, and more than it may see are an error."""
    held = limited(held)
    order = Window.orderBy(F.desc(score) if descending else F.asc(score), key)
    return held.select(key, (F.row_number().over(order) - 1 + first).alias("rank"))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, distance (L2) of the k vectors nearest to one query; vectors of another dimension or null are passed over."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.sqrt(F.aggregate(F.zip_with(F.col(vector), q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    return vectors.filter(F.size(vector) == len(query)).select(key, d.alias("distance")).orderBy("distance", key).limit(k)


def _matrix(cells: pa.Array) -> np.ndarray:
    return np.array(cells.to_pylist(), dtype=np.float64)


def _block_top(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qid, qv, vid, vv in zip(*(batch.column(i) for i in range(4))):
                q, v, qi, vi = _matrix(qv.values), _matrix(vv.values), np.array(qid.as_py()), np.array(vid.as_py())
                order = np.argsort(vi, kind="stable")
                v, vi = v[order], vi[order]
                qq, vv2 = (q * q).sum(1), (v * v).sum(1)
                guess = qq[:, None] + vv2[None, :] - 2 * q @ v.T
                # Guesses are off by rounding only: no row of the k best lies further beyond the k-th guess than this, however many tie. NaN is kept.
                margin = 8 * (q.shape[1] + 4) * np.finfo(np.float64).eps * (qq + vv2.max())
                last = np.partition(guess, min(k, len(vi)) - 1, axis=1)[:, min(k, len(vi)) - 1] + margin
                out_q, out_v, out_d = [], [], []
                for i in range(len(q)):
                    cols = np.flatnonzero(~(guess[i] > last[i]))
                    d = np.sqrt(((v[cols] - q[i]) ** 2).sum(1))
                    best = np.lexsort((vi[cols], d))[:k]
                    out_q.append(np.full(len(best), qi[i]))
                    out_v.append(vi[cols][best])
                    out_d.append(d[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_d))], names=["query_id", "key", "distance"])

    return run


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 2048, query_block: int = 512) -> DataFrame:
    """query_id, key, distance, rank of the k nearest vectors of every query, exactly.

    Vectors and queries are gathered into blocks of bounded size; every query block meets every vector
    block once, as one matrix product, and leaves k rows per query. Null vectors are passed over, and so are, for each query, vectors of
    another dimension.
    """
    def blocks(df: DataFrame, size: int, ids: str, values: str) -> DataFrame:
        df = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
        n = max(1, -(-df.count() // size))
        return df.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n))).agg(F.collect_list(F.struct("id", "v")).alias("x")).select("dim", F.col("x.id").alias(ids), F.col("x.v").alias(values))

    pairs = blocks(queries, query_block, "qid", "qv").join(blocks(vectors, block, "vid", "vv"), "dim").drop("dim")  # of blocks, not of rows
    near = pairs.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_block_top(k), "query_id long, key long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "key")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumnRenamed("key", key)


def fuse(rankers: list[tuple[DataFrame, float]], key: str = "chunk_id", k: float = P.RRF_K) -> DataFrame:
    """key, rrf: the sum of weight / (k + rank) over the rankers that have the key. Rankers of weight 0 are left out, as they add nothing."""
    parts = [df.select(key, (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part")) for df, w in rankers if w]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key).agg(F.sum("part").alias("rrf"))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_time(created: Column, updated: Column, after: str | None = None, before: str | None = None) -> Column:
    """Dates are compared as strings; rows without any date pass."""
    date = F.coalesce(updated, created)
    ok = F.lit(True)
    if after:
        ok = ok & (F.coalesce(date >= after, F.lit(True)))
    if before:
        ok = ok & (F.coalesce(date < before, F.lit(True)))
    return ok


def in_paths(path: Column, prefixes: list[str]) -> Column:
    """Whether the path starts with one of the prefixes, ASCII letters in any case. No prefixes: true."""
    if not prefixes:
        return F.lit(True)
    ok = F.lit(False)
    for p in prefixes:
        ok = ok | _ascii_lower(path).startswith("".join(c.lower() if c.isascii() else c for c in p))
    return F.coalesce(ok, F.lit(False))


def parsed_date(c: Column) -> Column:
    """Timestamp of an ISO date or date-time; null for anything else."""
    t = utrim(c)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:\d{2})?$")
    full = F.regexp_replace(F.regexp_replace(t, r"^(.{10})$", "$1T00:00:00"), r"^(.{10})[T ](\d{2}:\d{2})(?=$|Z|[+-])", "$1T$2:00")
    zoned = F.when(full.rlike(r"(Z|[+-]\d{2}:\d{2})$"), full).otherwise(F.concat(full, F.lit("Z")))
    return F.when(iso, zoned.try_cast("timestamp"))


def directory_setting(path: Column, settings: dict[str, float], default: Column) -> Column:
    """The setting of the longest directory that holds the path, else ``default``."""
    out = None
    for d in sorted(settings, key=lambda x: (-len(x), x)):
        holds = path.startswith(d.rstrip("/") + "/")
        out = F.when(holds, F.lit(float(settings[d]))) if out is None else out.when(holds, F.lit(float(settings[d])))
    return default if out is None else out.otherwise(default)


def half_life(path: Column, kind: Column, directories: dict[str, float] | None = None) -> Column:
    by_kind = F.lit(P.DEFAULT_HALF_LIFE_DAYS)
    for k, days in P.HALF_LIFE_DAYS.items():
        by_kind = F.when(kind == k, F.lit(days)).otherwise(by_kind)
    by_kind = directory_setting(path, directories or {}, by_kind)
    return F.when(path.startswith("session:"), F.lit(P.HALF_LIFE_DAYS["session"])).otherwise(by_kind)


def time_decay(updated: Column, days: Column, as_of: str) -> Column:
    """0.5 to the power of whole days since ``updated`` by the half-life; 0.5 where the date is null, blank or unreadable; never above 1."""
    at = parsed_date(updated)
    age = F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(at)) / 86400))
    return F.when(at.isNull(), F.lit(P.UNDATED_DECAY)).otherwise(F.pow(F.lit(0.5), age / days))


def status_penalty(status: Column) -> Column:
    out = F.lit(1.0)
    for s, p in P.STATUS_PENALTY.items():
        out = F.when(status == s, F.lit(p)).otherwise(out)
    return out


def directory_weight(path: Column, kind: Column, weights: dict[str, float] | None = None) -> Column:
    base = F.when(path.startswith("session:") | (kind == "session"), F.lit(P.SESSION_WEIGHT)).otherwise(1.0)
    return directory_setting(path, weights or {}, base)


def final_scores(fused: DataFrame, chunks: DataFrame, documents: DataFrame, as_of: str, after: str | None = None, before: str | None = None, paths: list[str] = (), weights: dict[str, float] | None = None, half_lives: dict[str, float] | None = None, threshold: float = P.SCORE_THRESHOLD) -> DataFrame:
    """Candidates with their document, filtered after ranking, scored, above the threshold.

    chunk_id, doc_id, file_path, source_type, section_path, snippet, status, score. Where the candidates are few by their
    plan (each ranker is limited before) they are the side that is broadcast; otherwise the joins are left to Spark.
    """
    from tsugumi.functions.analysis import snippet

    small = F.broadcast if few(fused) else lambda x: x
    held = chunks.join(small(fused), "chunk_id")  # a chunk_id stands once, so no more rows than candidates
    rows = documents.select("doc_id", "file_path", "source_type", "status", "created", "updated").join(small(held.withColumnRenamed("document_id", "doc_id")), "doc_id")
    rows = rows.filter(in_time(F.col("created"), F.col("updated"), after, before) & in_paths(F.col("file_path"), list(paths)))
    path, kind = F.col("file_path"), F.col("source_type")
    score = F.col("rrf") * time_decay(F.col("updated"), half_life(path, kind, half_lives), as_of) * status_penalty(F.col("status")) * directory_weight(path, kind, weights)
    return rows.withColumn("score", score).filter(F.col("score") >= threshold).select("chunk_id", "doc_id", "file_path", "source_type", "section_path", snippet(F.col("content")).alias("snippet"), "status", "score")
