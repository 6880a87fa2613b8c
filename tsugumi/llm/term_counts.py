"""Counts of terms and n-grams by sorted suffixes.

Every record's terms give suffixes cut to a length. Suffixes are routed by their first term and
sorted in reverse lexicographic order; one pass with a stack then has the count and the record set
of every prefix. A hot first term is spread over buckets of records: record sets of different buckets
are disjoint, so their sizes add up to exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsugumi.functions.analysis import index_terms
from tsugumi.functions.text import SPACE, fold_term

#: Records of one salt; sets of records that a task holds stay below it, whatever the size of the collection.
RECORDS_PER_SALT = 100_000

_SCHEMA = "terms array<string>, whole boolean, frequency long, records long, first_id long"


def _stack(sigma: int, grams: bool):
    class Node:
        __slots__ = ("term", "count", "docs", "own_count", "own_records", "own_id")

        def __init__(self, term: str):
            self.term, self.count, self.docs, self.own_count, self.own_records, self.own_id = term, 0, set(), 0, 0, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Node] = []
        rows: list[tuple] = []
        bucket = None

        def close(depth: int) -> None:
            while len(stack) > depth:
                node, path = stack[-1], [x.term for x in stack]
                if grams and len(path) <= sigma:
                    rows.append((path, False, node.count, len(node.docs), None))
                if node.own_id is not None:
                    rows.append((path, True, node.own_count, node.own_records, node.own_id))
                stack.pop()
                if stack and grams:
                    stack[-1].count += node.count
                    small, large = sorted((stack[-1].docs, node.docs), key=len)
                    large |= small
                    stack[-1].docs = large

        def out() -> pa.RecordBatch:
            a, b, c, d, e = zip(*rows) if rows else ((), (), (), (), ())
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.list_(pa.string())), pa.array(b, pa.bool_()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.int64())], names=["terms", "whole", "frequency", "records", "first_id"])

        for batch in batches:
            for salt, terms, start, doc, weight, ident in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if salt != bucket:
                    close(0)
                    bucket = salt
                same = 0
                while same < min(len(stack), len(terms)) and stack[same].term == terms[same]:
                    same += 1
                close(same)
                stack.extend(Node(t) for t in terms[same:])
                top = stack[-1]
                top.count += weight
                if doc is not None and grams:
                    top.docs.add(doc)
                if start:
                    top.own_count += weight
                    top.own_id = ident if top.own_id is None else min(top.own_id, ident)
                    top.own_records += doc is not None  # a list stands once for each record
            if len(rows) >= 10_000:
                yield out()
        close(0)
        yield out()

    return run


def suffix_counts(records: DataFrame, terms: str, record: str, weight: str, ident: str, sigma: int = 5, grams: bool = True, one_row: bool = False) -> DataFrame:
    """terms, whole, frequency, records, first_id of every n-gram of up to ``sigma`` terms (whole false) and every whole term list (whole true, of any length).

    ``weight`` is how often a row stands (null: not at all), ``record`` what is counted once in
    ``records`` (null: in none), ``ident`` gives the smallest id of a whole list. Empty and null term
    lists count nowhere. With ``grams`` false only whole lists are counted and no inner suffix is made.
    Rows are counted first, as the number of salts grows with them. With ``one_row`` every record has one row and its own
    suffixes are summed by the stack; else they are summed before they are routed.
    """
    spark = records.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(n, -(-records.count() // RECORDS_PER_SALT))
    rows = records.select(F.col(terms).alias("t"), F.col(record).alias("doc"), F.coalesce(F.col(weight), F.lit(0)).cast("long").alias("w"), F.col(ident).cast("long").alias("id")).filter(F.size("t") > 0)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    if grams:
        rows = rows.select("salt", F.posexplode(F.expr(f"transform(t, (x, i) -> IF(i = 0, t, slice(t, i + 1, {sigma})))")).alias("i", "t"), "doc", "w", "id").withColumn("start", F.col("i") == 0)
    else:
        rows = rows.withColumn("start", F.lit(True))
    if not one_row:  # or a hot record with a hot term would meet in one task
        rows = rows.groupBy("salt", "t", "start", "doc").agg(F.sum("w").alias("w"), F.min("id").alias("id"))
    routed = rows.select("salt", "t", "start", "doc", "w", "id").repartition(n, F.col("t")[0], "salt").sortWithinPartitions("salt", F.col("t").desc())
    parts = routed.mapInArrow(_stack(sigma, grams), _SCHEMA)
    return parts.groupBy("terms", "whole").agg(F.sum("frequency").alias("frequency"), F.sum("records").alias("records"), F.min("first_id").alias("first_id"))


def term_frequencies(candidates: DataFrame, min_docs: int = 3, common_share: float = 0.04) -> DataFrame:
    """term, candidate_id (the smallest), frequency, documents and mark (rare, common, null) of every term of ``surface``.

    Spellings that differ in letter case, width or outer blanks are one term; null and blank surfaces
    are none. A null frequency adds nothing, a null doc_id is no document. rare: in fewer than
    ``min_docs`` documents; common: in at least ``common_share`` of all documents of the table.
    """
    terms = F.split(fold_term(F.col("surface")), F.lit(f"{SPACE}+"))
    counted = suffix_counts(candidates.withColumn("_terms", terms), "_terms", "doc_id", "frequency", "candidate_id").filter("whole")
    total = candidates.select("doc_id").filter("doc_id is not null").distinct().select(F.count(F.lit(1)).alias("all_documents"))
    mark = F.when(F.col("records") < min_docs, "rare").when(F.col("records") * 10_000 >= F.col("all_documents") * round(common_share * 10_000), "common")
    return counted.join(F.broadcast(total)).select(F.array_join("terms", " ").alias("term"), F.col("first_id").alias("candidate_id"), "frequency", F.col("records").alias("documents"), mark.alias("mark"))


def ngram_frequencies(texts: DataFrame, record: str, text: str, sigma: int = 3, min_records: int = 3, common_share: float = 0.04) -> DataFrame:
    """ngram, size, frequency, records, mark of every run of up to ``sigma`` index terms of ``text``; marks as in ``term_frequencies``, over all records with a text. Null and empty texts have none. A record has one row, or few."""
    rows = texts.select(F.col(record).cast("long").alias("_id"), index_terms(F.col(text)).alias("_terms"), F.lit(1).alias("_one"))
    counted = suffix_counts(rows, "_terms", "_id", "_one", "_id", sigma, one_row=True).filter("not whole")
    total = texts.filter(F.col(text).isNotNull()).agg(F.count_distinct(record).alias("all_records"))
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") * 10_000 >= F.col("all_records") * round(common_share * 10_000), "common")
    return counted.crossJoin(F.broadcast(total)).select(F.array_join("terms", " ").alias("ngram"), F.size("terms").alias("size"), "frequency", "records", mark.alias("mark"))
