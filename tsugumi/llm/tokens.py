"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Pre-tokens that are tokens themselves are read off the vocabulary, a table of fixed size, where the
text is. All other words of a batch of documents are collapsed to (word, places) and shuffled by word,
so that each is encoded once; the ids go back to their documents by a second shuffle and are put in
their places. Between the shuffles ids take two bytes each, four if the vocabulary has larger ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsugumi.plans.bounds import repeatable

#: Fixed value: the pre-token pattern of the vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BATCH_CHARS = 3_000_000
_CACHED_WORDS = 100_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Ids by token bytes."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _cell(path: str) -> tuple[str, int]:
    """The type of an id between the shuffles, and the value that stands for a word that is no token: the largest, which no id may have."""
    highest = max(ranks(path).values(), default=0)
    if highest >= 2**31 - 1:
        raise ValueError(f"{path}: ids must be below {2**31 - 1}")
    return ("<u2", 2**16 - 1) if highest < 2**16 - 1 else ("<i4", 2**31 - 1)


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _words(path: str) -> dict[str, int]:
    out = {}
    for token, number in ranks(path).items():
        try:
            out[token.decode()] = number
        except UnicodeDecodeError:
            pass
    return out


_ROWS = "uid long, doc_id long, known binary, word string, docs array<long>, places array<int>"


def _binary(values: np.ndarray, ends: np.ndarray, kind: str) -> pa.Array:
    """Values of one type as binary cells that end at the given value counts."""
    offsets = np.concatenate(([0], ends * np.dtype(kind).itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, kind))])


def _scan(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, get, serial = regex.compile(PATTERN).findall, _words(path).get, 0
        kind, gap = _cell(path)

        def done(docs: list, texts: list[str], first: int) -> pa.RecordBatch:
            words: list[str] = []
            ends = []
            for text in texts:
                words += find(text)
                ends.append(len(words))
            ends = np.array(ends, np.int64)
            ids = np.fromiter(map(get, words, repeat(gap)), np.int32, len(words))
            gaps = np.flatnonzero(ids == gap)
            intern: dict[str, int] = {}
            codes = np.fromiter((intern.setdefault(words[i], len(intern)) for i in gaps.tolist()), np.int64, len(gaps))
            of = np.searchsorted(ends, gaps, "right")
            place = np.arange(len(gaps)) - np.searchsorted(gaps, np.concatenate(([0], ends[:-1])))[of]
            order = np.argsort(codes, kind="stable")
            bounds = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(intern))))).astype(np.int32)
            n, m = len(docs), len(intern)
            lists = lambda x, t: pa.concat_arrays([pa.nulls(n, pa.list_(t)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(x[order], t))])
            uids = np.arange(first, first + n)
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(uids, pa.int64()), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(docs, pa.int64()), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([_binary(ids, ends, kind), pa.nulls(m, pa.binary())]), pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(list(intern), pa.string())]),
                lists(uids[of], pa.int64()), lists(place, pa.int32()),
            ], names=["uid", "doc_id", "known", "word", "docs", "places"])

        for batch in batches:
            docs, texts, size = [], [], 0
            for part, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                docs.append(doc)
                texts.append(text or "")
                size += len(texts[-1])
                if size > _BATCH_CHARS:
                    yield done(docs, texts, (part << 40) + serial)
                    serial += len(docs)
                    docs, texts, size = [], [], 0
            if docs:
                yield done(docs, texts, (part << 40) + serial)
                serial += len(docs)

    return run


_PLACED = "uid long, doc_id long, place int, ids binary"


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cache, kind = encoder(path).encode_ordinary, {}, _cell(path)[0]
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.columns], names=batch.schema.names)
            whole = batch.filter(batch.column(2).is_valid())
            if whole.num_rows:
                yield pa.RecordBatch.from_arrays([whole.column(0), whole.column(1), pa.array(np.full(whole.num_rows, -1, np.int32)), whole.column(2)], names=["uid", "doc_id", "place", "ids"])
            rows = batch.filter(batch.column(3).is_valid())
            if not rows.num_rows:
                continue
            cells = []
            for word in rows.column(3).to_pylist():
                cell = cache.get(word)
                if cell is None:
                    if len(cache) >= _CACHED_WORDS:
                        cache.clear()
                    cell = cache[word] = np.array(encode(word), kind).tobytes()
                cells.append(cell)
            counts = rows.column(4).value_lengths().to_numpy()
            which = np.repeat(np.arange(len(counts)), counts)
            docs, places, cells = rows.column(4).flatten(), rows.column(5).flatten(), pa.array(cells, pa.binary())
            for k in range(0, len(which), 50_000):
                part = which[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([docs.slice(k, len(part)), pa.nulls(len(part), pa.int64()), places.slice(k, len(part)), cells.take(pa.array(part))], names=["uid", "doc_id", "place", "ids"])

    return run


def _values(cells: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of binary cells, and how many each cell has."""
    cells, size = pa.concat_arrays([cells]), np.dtype(kind).itemsize
    _, offsets, data = cells.buffers()
    at = np.frombuffer(offsets, np.int32)[cells.offset : cells.offset + len(cells) + 1]
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return values.view(kind) if values.ctypes.data % size == 0 else values.copy().view(kind), np.diff(at) // size


def _merge(path: str):
    def done(rows: pa.RecordBatch) -> pa.RecordBatch:
        kind, gap_value = _cell(path)
        head = rows.column(2).to_numpy() < 0
        wholes, rest = rows.filter(pa.array(head)), rows.filter(pa.array(~head))
        known, sizes = _values(wholes.column(3), kind)
        found, lengths = _values(rest.column(3), kind)
        gap = known == gap_value
        width = np.ones(len(known), np.int64)
        width[gap] = lengths
        wide = np.repeat(gap, width)
        ids = np.empty(len(wide), np.int32)
        ids[~wide], ids[wide] = known[~gap], found
        total = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(sizes)))].astype(np.int32)
        return pa.RecordBatch.from_arrays([wholes.column(1), pa.ListArray.from_arrays(pa.array(total), pa.array(ids))], names=["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            heads = np.flatnonzero(batch.column(2).to_numpy() < 0)
            if not len(heads):
                held.append(batch)
                continue
            last = int(heads[-1])
            held.append(batch.slice(0, last))
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()
            if rows:
                yield done(rows[0])
            held = [batch.slice(last)]
        rows = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
        if rows:
            yield done(rows[0])

    return run


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids of every row of ``documents``: the ids of ``text`` without special tokens, empty for empty and null text.

    Blank text is text. Repeated rows and null doc_id give a row each. Documents that come out of a shuffle are
    written down first, as a task that is run again must number the same rows alike.
    """
    path = path or vocabulary_path()
    documents = repeatable(documents.select("doc_id", "text"))
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.spark_partition_id().cast("long").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(path), _ROWS)
    # A hot word is spread over more tasks the more tasks there are.
    salt = F.when(F.col("word").isNotNull(), F.pmod(F.xxhash64(F.get("docs", F.lit(0))), F.lit(max(1, n // 12)))).otherwise(F.col("uid"))
    placed = rows.repartition(n, "word", salt).mapInArrow(_encode(path), _PLACED)
    return placed.repartition(n, "uid").sortWithinPartitions("uid", "place").mapInArrow(_merge(path), "doc_id long, ids array<int>")


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    return run


def token_counts(documents: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` and ``tokens``, the number of ids of ``text`` (0 for empty and null)."""
    source = documents.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(_count(path or vocabulary_path()), f"{schema}, tokens long")


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """id, bytes of every token of the vocabulary."""
    return spark.createDataFrame([(number, bytearray(token)) for token, number in ranks(path or vocabulary_path()).items()], "id int, bytes binary")


@lru_cache(maxsize=2)
def _byte_table(path: str) -> pa.Array:
    held = ranks(path)
    table = [None] * (max(held.values()) + 1)
    for token, number in held.items():
        table[number] = token
    return pa.array(table, pa.binary())


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.concat_arrays([batch.column(1)])
            cells = pa.concat_arrays([_byte_table(path).take(ids.flatten())])
            sizes = ids.value_lengths().fill_null(0).to_numpy()
            ends = np.concatenate(([0], np.cumsum(sizes)))
            _, offsets, data = cells.buffers()
            at = np.frombuffer(offsets, np.int32)[cells.offset : cells.offset + len(cells) + 1][ends]
            whole = data.to_pybytes() if data is not None else b""
            texts = [whole[x:y].decode(errors="replace") if known else None for x, y, known in zip(at, at[1:], ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decoded(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows of (doc_id, ids): ids joined with the table of token bytes, put together by position.

    The table has one row per token of the vocabulary, so the join is on the map side. Null ids give
    null, empty ones the empty text; an id that the vocabulary lacks is an error.
    """
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_decode(path or vocabulary_path()), "doc_id long, text string")
