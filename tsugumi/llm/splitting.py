"""Oversized texts cut at natural boundaries, with overlap.

A text is split by a hierarchy of separators: section, paragraph, line, sentence, word, character. Only
units that are still too long go down a level. The units are then packed greedily into pieces. A unit that
went below the sentence holds a stretch without line and sentence end.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsugumi.plans.segments import segmented

LIMIT, OVERLAP = 800, 80
LEVELS = ("section", "paragraph", "line", "sentence", "word", "character")

_SENTENCE = LEVELS.index("sentence")
_CUTS = [re.compile(r"(?<=\n)(?=#{1,6}[ \t])"), re.compile(r"\n(?:[^\S\n]*\n)+"), re.compile(r"[\n\r]+"), re.compile(r"[。！？]+|[.!?]+(?=\s)"), re.compile(r"\s+")]
_END = re.compile(r"[\n\r。！？]|[.!?](?=\s)")


def _boundaries(text: str, limit: int) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Where units end, in order, the level each end belongs to, and (start, end) of the units that went below the sentence.

    All cuts down to the sentence stand right behind a line end or sentence end, so no stretch without them crosses one.
    """
    found: list[list[int] | None] = [None] * len(_CUTS)
    ends: list[int] = []
    levels: list[int] = []
    uncut: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, 0)]
    while todo:
        lo, hi, level, mark = todo.pop()
        if hi - lo <= limit:
            ends.append(hi)
            levels.append(mark)
        elif level == len(_CUTS):
            for at in range(lo + limit, hi, limit):
                ends.append(at)
                levels.append(level)
            ends.append(hi)
            levels.append(mark)
        else:
            if level == _SENTENCE + 1:
                uncut.append((lo, hi))
            if found[level] is None:
                found[level] = [m.end() for m in _CUTS[level].finditer(text)]
            cuts = found[level]
            inner = [lo, *cuts[bisect_right(cuts, lo) : bisect_left(cuts, hi)], hi]
            for i in range(len(inner) - 2, -1, -1):
                todo.append((inner[i], inner[i + 1], level + 1, level if i < len(inner) - 2 else mark))
    return ends, levels, uncut


def _pick(ends: list[int], levels: list[int], start: int, i: int, limit: int, overlap: int) -> int:
    """Which of the unit ends from ``i`` on ends the piece that begins at ``start``.

    Of the ends in the second half of the piece the highest level wins, of equal levels the last; a word or character end
    there only wins if no line or sentence ends earlier in the piece, behind its overlap.
    """
    j = bisect_right(ends, start + limit, i)
    k = bisect_right(ends, start + limit // 2, i, j)
    best = min(range(k, j), key=lambda x: (levels[x], -x), default=j - 1)
    if levels[best] > _SENTENCE:
        return next((x for x in range(min(k, j) - 1, i - 1, -1) if levels[x] <= _SENTENCE and ends[x] > start + overlap), best)
    return best


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, level of the cut at end) of the pieces of ``text``; every piece has at most ``limit`` characters and starts ``overlap`` before the end of the one before."""
    return _split_text(text, limit, overlap)[0]


def _split_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    n = len(text)
    if n <= limit:
        return [(0, n, 0)], []
    ends, levels, uncut = _boundaries(text, limit - overlap)
    pieces, start, i = [], 0, 0
    while True:
        if n - start <= limit:
            pieces.append((start, n, 0))
            return pieces, uncut
        j = _pick(ends, levels, start, i, limit, overlap)
        pieces.append((start, ends[j], levels[j]))
        start, i = ends[j] - overlap, j + 1


def longest_stretch(text: str, lo: int = 0, hi: int | None = None) -> int:
    """Length of the longest stretch without line end and sentence end in ``text[lo:hi]``."""
    hi = len(text) if hi is None else hi
    longest, at = 0, lo
    for m in _END.finditer(text, lo, hi + 1):
        if m.start() >= hi:
            break
        longest, at = max(longest, m.start() - at), m.end()
    return max(longest, hi - at)


def _split(limit: int, overlap: int, texts: bool):
    """Arrow batches whose last column is the content, with ``n`` pieces, ``stretch`` and ``deepest`` (and ``parts``) in its place.

    ``stretch`` is the longest one in the units that went below the sentence, 0 if none did. Content that fits counts as one piece and has no parts.
    """
    kind = pa.list_(pa.struct([("no", pa.int32()), ("text", pa.string()), ("cut", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(batch.num_columns - 1).to_pylist()
            done = [_split_text(t, limit, overlap) if t is not None else ([(0, 0, 0)], []) for t in contents]
            arrays = [
                *batch.columns[:-1], pa.array([len(c) for c, _ in done], pa.int64()),
                pa.array([max((longest_stretch(t, a, b) for a, b in uncut), default=0) for t, (_, uncut) in zip(contents, done)], pa.int32()),
                pa.array([max((x[2] for x in c[:-1]), default=0) for c, _ in done], pa.int32()),
            ]
            names = [*batch.schema.names[:-1], "n", "stretch", "deepest"]
            if texts:
                arrays.append(pa.array([[(k, t[a:b], LEVELS[level]) for k, (a, b, level) in enumerate(c)] if len(c) > 1 else None for t, (c, _) in zip(contents, done)], kind))
                names.append("parts")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _cut(chunks: DataFrame, keep: list[str], limit: int, overlap: int, texts: bool) -> DataFrame:
    rows = chunks.select(*keep, "content")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n long, stretch int, deepest int"
    return rows.mapInArrow(_split(limit, overlap, texts), schema + (", parts array<struct<no int, text string, cut string>>" if texts else ""))


def oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, n (pieces), stretch, deepest of the chunks whose content has more than ``limit`` code points. Null and short content gives no row."""
    return _cut(chunks.filter(F.char_length("content") > limit), ["chunk_id"], limit, overlap, False)


def split_kinds(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, kind: hard if the recursion met a stretch of more than ``limit`` characters without line or sentence end, else natural.

    Candidates are the units that the recursion had to take below the sentence; their stretches are then measured exactly.
    """
    return oversized(chunks, limit, overlap).select("chunk_id", F.when(F.col("stretch") > limit, "hard").otherwise("natural").alias("kind"))


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """document_id, chunk_id, section_path, chunk_index (new, from 0 in the document, short chunks counted), piece, cut of the oversized chunks.

    Rows with a null document_id are one document; ties in chunk_index go by chunk_id. chunk_id must be
    unique and not null. Every chunk is read and split once.
    """
    rows = _cut(chunks, ["document_id", "chunk_index", "chunk_id", "section_path"], limit, overlap, True).drop("stretch", "deepest")
    placed = segmented(rows, ["document_id"], ["chunk_index", "chunk_id"], sums=["n"]).filter("parts is not null")
    each = placed.select("document_id", "chunk_id", "section_path", "before_n", F.explode("parts").alias("p"))
    return each.select("document_id", "chunk_id", "section_path", (F.col("before_n") + F.col("p.no")).alias("chunk_index"), F.col("p.text").alias("piece"), F.col("p.cut").alias("cut"))
