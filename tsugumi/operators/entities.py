"""Entities, their links to chunks, their co-occurrence graph, and retrieval over it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsugumi import params as P
from tsugumi.functions.text import utrim
from tsugumi.plans.bounds import limited
from tsugumi.plans.pairs import gathered, narrow_pairs, wide_pairs


CJK_SIGN = r"[\u3000-\u9fff\uf900-\ufaff\uff00-\uffef]"


def tag_entities(documents: DataFrame) -> DataFrame:
    """doc_id, name: tags of documents, lower case, trimmed, of at least two characters, once per document."""
    return documents.select("doc_id", F.explode("tags").alias("tag")).select("doc_id", F.lower(utrim(F.col("tag"))).alias("name")).filter(F.char_length("name") >= 2).distinct()


#: Terms that one automaton holds, which goes to every task.
MAX_AUTOMATON = 100_000


def _is_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LNM"


def _matched(names: list[str]):
    """Arrow batches of (chunk_id, lower text) to (chunk_id, name) by one automaton over all names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        import regex

        automaton = ahocorasick.Automaton()
        cjk = regex.compile(CJK_SIGN)
        for n in names:
            automaton.add_word(n, (n, bool(cjk.search(n))))
        automaton.make_automaton()
        for batch in batches:
            ids, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set()
                for end, (name, anywhere) in automaton.iter(text):
                    if name in own:
                        continue
                    start = end - len(name) + 1
                    if anywhere or not (start and _is_word(text[start - 1])) and not (end + 1 < len(text) and _is_word(text[end + 1])):
                        own.add(name)
                ids += [key] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["chunk_id", "name"])

    return run


def custom_entities(chunks: DataFrame, terms: DataFrame, text: str = "content", most: int | None = None) -> DataFrame:
    """chunk_id, name of the custom ``terms`` (name) in each text.

    A term with CJK signs matches anywhere, any other between word boundaries, in any case. Up to ``MAX_AUTOMATON`` terms
    are sought by one automaton in one pass; more are looked up, see ``looked_up_entities``. The terms are counted first.
    """
    named = terms.select(F.lower(utrim(F.col("name"))).alias("name")).filter(F.char_length("name") >= 2).distinct()
    most = MAX_AUTOMATON if most is None else most
    held = [r.name for r in named.limit(most + 1).collect()]
    if len(held) > most:
        return looked_up_entities(chunks, terms, text)
    rows = chunks.filter(F.col(text).isNotNull()).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lower(text).alias("t"))
    if not held:
        return rows.select("chunk_id", F.lit("").alias("name")).limit(0)
    return rows.mapInArrow(_matched(sorted(held)), "chunk_id long, name string").distinct()


def looked_up_entities(chunks: DataFrame, terms: DataFrame, text: str = "content") -> DataFrame:
    """``custom_entities`` for any number of terms: instead of
    testing every term on every text, what a text holds that could be a term is looked up: windows of
    as many characters as there are different CJK term lengths, and spans of words joined by dots and dashes.
    Terms of other forms add windows of their own: over all characters for those that mix CJK and other signs, over words
    and single signs between them for the rest (with blanks, slashes and so on); both only if there are such terms.
    """
    named = terms.select(F.lower(utrim(F.col("name"))).alias("name")).filter(F.char_length("name") >= 2).distinct()
    sign = CJK_SIGN
    word = r"[\p{L}\p{N}\p{M}_]+"
    parted = lambda c: F.regexp_extract_all(c, F.lit(rf"{word}|[^\p{{L}}\p{{N}}\p{{M}}_]"), F.lit(0))
    cjk, whole, plain = F.col("name").rlike(sign), F.col("name").rlike(f"^{sign}+$"), F.col("name").rlike(rf"^{word}(?:[.-]{word})*\z")
    lengths = lambda kind, n: sorted(r.n for r in named.filter(kind).select(n.alias("n")).distinct().collect())
    sizes, mixed = (lengths(kind, F.char_length("name")) for kind in (cjk & whole, cjk & ~whole))  # lengths of terms, a few numbers
    low = F.lower(F.col(text))
    joined = F.regexp_extract_all(low, F.lit(f"{word}(?:[.-]{word})*"), F.lit(0))
    pieces = F.transform(joined, lambda x: F.split(x, "(?<=[.-])|(?=[.-])"))
    counts, others = lengths(~cjk & plain, F.size(F.split("name", "(?<=[.-])|(?=[.-])"))), lengths(~cjk & ~plain, F.size(parted(F.col("name"))))  # as few
    found = F.array().cast("array<string>")
    for n in counts:
        spans = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - (n - 1)), lambda i: F.array_join(F.slice(p, i, F.lit(n)), ""))  # noqa: E731, B023
        found = F.concat(found, F.flatten(F.transform(F.filter(pieces, lambda p: F.size(p) >= n), spans)))  # noqa: B023
    runs = F.transform(F.regexp_extract_all(low, F.lit(r"[\u3000-\u9fff\uf900-\ufaff\uff00-\uffef]+"), F.lit(0)), lambda r: F.split(r, ""))
    for n in sizes:
        windows = lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - (n - 1)), lambda i: F.array_join(F.slice(r, i, F.lit(n)), ""))  # noqa: E731, B023
        found = F.concat(found, F.flatten(F.transform(F.filter(runs, lambda r: F.size(r) >= n), windows)))  # noqa: B023
    # An empty sequence where the text is shorter. A cut beside a word piece is a boundary, one beside a single sign must not touch a word.
    starts = lambda p, n: F.filter(F.sequence(F.lit(0), F.size(p)), lambda i: i + n <= F.size(p))
    window = lambda p, i, n: F.array_join(F.slice(p, i + 1, F.lit(n)), "")
    is_word = lambda c: F.coalesce(c.rlike(f"^{word}"), F.lit(False))
    if mixed:
        signs = F.split(low, "")
        for n in mixed:
            found = F.concat(found, F.filter(F.transform(starts(signs, n), lambda i: window(signs, i, n)), lambda x: x.rlike(sign)))  # noqa: B023
    if others:
        marks = parted(low)
        for n in others:
            first, last = lambda i: F.get(marks, i), lambda i: F.get(marks, i + n - 1)  # noqa: E731, B023
            free = lambda i: (is_word(first(i)) | ~is_word(F.when(i > 0, F.get(marks, i - 1)))) & (is_word(last(i)) | ~is_word(F.get(marks, i + n)))  # noqa: E731, B023
            found = F.concat(found, F.transform(F.filter(starts(marks, n), free), lambda i: window(marks, i, n)))  # noqa: B023
    # Not deterministic to the optimizer, so that it doesn't copy the whole expression into a filter before the explode.
    held = chunks.filter(F.col(text).isNotNull()).select("chunk_id", F.array_distinct(found).alias("found"), F.spark_partition_id().alias("_pid"))
    each = held.select("chunk_id", F.explode(F.when(F.col("_pid") >= 0, F.col("found"))).alias("name"))
    return each.join(named, "name").select("chunk_id", "name").distinct()


def edges(chunk_entities: DataFrame, chunks: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """entity_a < entity_b, doc_id, occurrences: pairs of a chunk count once per chunk, pairs of a document's ``tags`` (doc_id, entity_id) once per document and not again in its chunks.

    Repeated rows count once and null entities not at all. A chunk with very many entities is paired in blocks.
    """
    rows = chunk_entities.filter("entity_id is not null").select(F.col("chunk_id").alias("basket"), F.col("entity_id").alias("item"))
    own = chunks.select(F.col("chunk_id").alias("basket"), F.col("document_id").alias("doc_id"))
    if tags is not None:
        of_document = tags.select("doc_id", F.col("entity_id").alias("item"), F.lit(True).alias("tag")).distinct()
        rows = rows.join(own, "basket").join(of_document, ["doc_id", "item"], "left").select("basket", F.struct("item", F.coalesce("tag", F.lit(False)).alias("tag")).alias("item"))
    narrow, wide = gathered(rows)
    pairs = narrow_pairs(narrow.filter(F.size("items") > 1).join(own, "basket"), "doc_id").unionByName(wide_pairs(wide).join(own, "basket").select("doc_id", "lo", "hi"))
    if tags is not None:
        pairs = pairs.filter(~(F.col("lo.tag") & F.col("hi.tag"))).select("doc_id", F.col("lo.item").alias("lo"), F.col("hi.item").alias("hi"))
        few, many = gathered(tags.select(F.col("doc_id").alias("basket"), F.col("entity_id").alias("item")))
        pairs = pairs.unionByName(narrow_pairs(few, "basket").withColumnRenamed("basket", "doc_id")).unionByName(wide_pairs(many).withColumnRenamed("basket", "doc_id"))
    return pairs.groupBy(F.col("lo").alias("entity_a"), F.col("hi").alias("entity_b"), "doc_id").agg(F.count(F.lit(1)).alias("occurrences"))


def neighbours(edge_rows: DataFrame, ids: list[int], limit: int = P.RELATED_ENTITIES) -> DataFrame:
    """related_id, strength: the entities with most occurrences beside ``ids``, without ``ids``, ties by id."""
    a, b = F.col("entity_a").isin(ids), F.col("entity_b").isin(ids)
    other = F.when(a, F.col("entity_b")).otherwise(F.col("entity_a"))
    near = edge_rows.filter(a | b).select(other.alias("related_id"), "occurrences").filter(~F.col("related_id").isin(ids))
    return near.groupBy("related_id").agg(F.sum("occurrences").alias("strength")).orderBy(F.desc("strength"), "related_id").limit(limit)


def entity_ranks(chunk_entities: DataFrame, edge_rows: DataFrame, ids: list[int], limit: int) -> DataFrame:
    """chunk_id, rank: chunks by the number of matched entities, then chunks of the strongest neighbours that are not among the first."""
    links = chunk_entities.filter("entity_id is not null").distinct()

    def hop(found: DataFrame) -> DataFrame:
        return limited(found.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "chunk_id").limit(limit))

    order = Window.orderBy(F.desc("n"), "chunk_id")  # over a limited result
    first = hop(links.filter(F.col("entity_id").isin(ids))).withColumn("rank", F.row_number().over(order) - 1)
    near = F.broadcast(neighbours(edge_rows, ids).select(F.col("related_id").alias("entity_id")))  # a handful
    second = hop(links.join(near, "entity_id", "left_semi").join(F.broadcast(first.select("chunk_id")), "chunk_id", "left_anti"))
    start = first.agg(F.count(F.lit(1)).alias("start"))
    second = second.crossJoin(F.broadcast(start)).withColumn("rank", F.col("start") + F.row_number().over(order) - 1)
    return first.select("chunk_id", "rank").unionByName(second.select("chunk_id", F.col("rank").cast("int").alias("rank")))


def entity_by_name(entities: DataFrame) -> DataFrame:
    """name, entity_id: one entity per name, of the type that sorts first."""
    return entities.filter("name is not null").groupBy("name").agg(F.min_by("entity_id", F.struct("entity_type", "entity_id")).alias("entity_id"))


def expansion(edge_rows: DataFrame, entities: DataFrame, ids: list[int], limit: int = P.MAX_EXPANSIONS) -> DataFrame:
    """name, strength of the strongest neighbours."""
    return entities.join(F.broadcast(neighbours(edge_rows, ids, limit)), F.col("entity_id") == F.col("related_id")).select("name", "strength")
