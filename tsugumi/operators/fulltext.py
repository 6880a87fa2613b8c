"""Full text on a stored inverted index: postings in folders by bucket of the term, and one row of statistics.

A query reads the folders of its own terms only, within them the row groups of its terms, and of those no positions unless it has phrases.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsugumi import params as P
from tsugumi.functions.analysis import index_terms

BUCKETS = 256
#: Texts per task of a bucket; a larger collection spreads every bucket over more tasks and files.
TEXTS_PER_SLICE = 2_000_000

POSTINGS = "chunk_id long, state long, term string, tf int, dl int, positions array<int>"


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, states, terms, tf, dl, ends, places = [], [], [], [], [], [0], []
        for key, state, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own: dict[str, list[int]] = {}
            for i, w in enumerate(words):
                own.setdefault(w, []).append(i)
            keys += [key] * len(own)
            states += [state] * len(own)
            dl += [len(words)] * len(own)
            for w, at in own.items():
                terms.append(w)
                tf.append(len(at))
                places += at
                ends.append(len(places))
        held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(states, pa.int64()), pa.array(terms, pa.string()), pa.array(tf, pa.int32()), pa.array(dl, pa.int32()), held], names=["chunk_id", "state", "term", "tf", "dl", "positions"])


def inverted(chunks: DataFrame, key: str = "chunk_id", text: str = "content", state: Column | None = None) -> DataFrame:
    """chunk_id, state, term, tf, dl (terms of the text), positions (from 0) of every index term of every text, without a shuffle; null texts have none. ``state`` tells the texts apart that a chunk has had."""
    return chunks.select(F.col(key).cast("long").alias("chunk_id"), F.lit(0).cast("long").alias("state") if state is None else state.alias("state"), index_terms(F.col(text)).alias("t")).mapInArrow(_inverted, POSTINGS)


@dataclass
class Index:
    postings: DataFrame  # bucket, and the columns of POSTINGS
    stats: DataFrame  # one row: n (texts), total (terms)
    live: DataFrame | None = None  # chunk_id, state; postings of other states are of texts that are gone


def bucketed(rows: DataFrame, texts: int) -> DataFrame:
    """Postings with their bucket, together by bucket and sorted by term, as they are written."""
    rows = rows.withColumn("bucket", F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(BUCKETS)).cast("int"))
    slices = 1 + texts // TEXTS_PER_SLICE
    spread = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("chunk_id"), F.lit(slices)))
    return spread.sortWithinPartitions("bucket", "term", "chunk_id")


def build(chunks: DataFrame, folder: str, key: str = "chunk_id", text: str = "content") -> Index:
    """Writes the index of ``chunks`` to ``folder`` and opens it. Runs jobs."""
    n = chunks.count()
    bucketed(inverted(chunks, key, text), n).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    total = chunks.sparkSession.read.schema(f"{POSTINGS}, bucket int").parquet(f"{folder}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("total"))
    total.select(F.lit(n).cast("long").alias("n"), "total").write.mode("overwrite").parquet(f"{folder}/stats")
    return opened(chunks.sparkSession, folder)


def opened(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.schema(f"{POSTINGS}, bucket int").parquet(f"{folder}/postings"), spark.read.schema("n long, total long").parquet(f"{folder}/stats"))


def of_terms(index: Index, terms: list[str], *columns: str) -> DataFrame:
    """The postings of ``terms`` in texts that are there: a filter on the folders and on the term."""
    rows = index.postings.filter(F.col("bucket").isin(sorted({bucket_of(t) for t in terms})) & F.col("term").isin(sorted(terms)))
    rows = rows if index.live is None else rows.join(index.live.select("chunk_id", "state"), ["chunk_id", "state"], "left_semi")
    return rows.select("chunk_id", "term", "tf", "dl", *columns)


def _weight(df: Column, tf: Column, k1: float, b: float) -> Column:
    idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(P.BM25_MIN_IDF) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def scored(counted: DataFrame, stats: DataFrame, groups: list[list[list[str]]], key: str = "chunk_id", k1: float = P.BM25_K1, b: float = P.BM25_B) -> DataFrame:
    """key, score of the rows of ``counted`` (key, dl, tf_<i>_<j> for phrase j of group i) that match a group; ``stats``: one row with n and avgdl."""
    flat = [(i, j) for i, g in enumerate(groups) for j in range(len(g))]
    known = counted.agg(*[F.count(F.when(F.col(f"tf_{i}_{j}") > 0, 1)).alias(f"df_{i}_{j}") for i, j in flat]).crossJoin(F.broadcast(stats))
    hit, score = F.lit(False), F.lit(0.0)
    for i, g in enumerate(groups):
        whole = F.lit(True)
        for j in range(len(g)):
            whole = whole & (F.col(f"tf_{i}_{j}") > 0)
        hit = hit | whole
        part = lambda j: _weight(F.col(f"df_{i}_{j}"), F.col(f"tf_{i}_{j}"), k1, b)  # noqa: E731, B023
        score = score + F.when(whole, sum((part(j) for j in range(1, len(g))), part(0))).otherwise(0.0)
    return counted.crossJoin(F.broadcast(known)).filter(hit).select(key, score.alias("score"))


def _mean(stats: DataFrame) -> DataFrame:
    return stats.select("n", (F.col("total") / F.col("n")).alias("avgdl"))


def bm25(index: Index, groups: list[list[list[str]]], k1: float = P.BM25_K1, b: float = P.BM25_B) -> DataFrame:
    """chunk_id, score of the texts that match ``groups``: an OR of groups, a group being an AND of phrases, a phrase a list of terms.

    A phrase gives credit only in the groups that match. An empty phrase (punctuation only) makes its
    group match nothing; without any other group the result is empty. Only postings of the query's terms are read and gathered by text.
    """
    groups = [g for g in groups if g and all(g)]
    terms = sorted({t for g in groups for p in g for t in p})
    if not terms:
        return index.postings.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    phrases = any(len(p) > 1 for g in groups for p in g)
    rows = of_terms(index, terms, *(["positions"] if phrases else []))
    number = {t: k for k, t in enumerate(terms)}
    own = lambda c, t: F.max(F.when(F.col("term") == t, F.col(c)))
    per = rows.groupBy("chunk_id").agg(F.max("dl").alias("dl"), *[own("tf", t).alias(f"n{k}") for t, k in number.items()], *([own("positions", t).alias(f"p{k}") for t, k in number.items()] if phrases else []))

    def times(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return F.coalesce(f"n{number[phrase[0]]}", F.lit(0))
        at = F.col(f"p{number[phrase[0]]}")
        for k, t in enumerate(phrase[1:], 1):
            at = F.array_intersect(at, F.transform(F.col(f"p{number[t]}"), lambda x: x - k))  # noqa: B023
        return F.coalesce(F.size(at), F.lit(0))

    counted = per.select("chunk_id", "dl", *[times(p).alias(f"tf_{i}_{j}") for i, g in enumerate(groups) for j, p in enumerate(g)])
    return scored(counted, _mean(index.stats), groups, k1=k1, b=b)


def bm25_each(index: Index, queries: dict[int, list[str]], k: int, k1: float = P.BM25_K1, b: float = P.BM25_B) -> DataFrame:
    """query_id, chunk_id, score, rank of the ``k`` best texts of each of many queries, a query being an AND of distinct terms; ties by chunk_id. A query without terms has no result.

    The postings of all terms are read once; the queries, held by the driver, go to every task.
    """
    spark = index.postings.sparkSession
    wanted = [(q, t, len(set(ts))) for q, ts in queries.items() for t in dict.fromkeys(ts)]
    asked = F.broadcast(spark.createDataFrame(wanted, "query_id long, term string, need int"))  # as large as the request
    rows = of_terms(index, [t for _, t, _ in wanted])
    dfs = F.broadcast(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # a row per term of the request
    parts = rows.join(dfs, "term").join(asked, "term").crossJoin(F.broadcast(_mean(index.stats))).select("query_id", "chunk_id", "need", _weight(F.col("df"), F.col("tf"), k1, b).alias("part"))
    found = parts.groupBy("query_id", "chunk_id", "need").agg(F.count(F.lit(1)).alias("met"), F.sum("part").alias("score")).filter("met = need")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")
