"""Segmentation with a user dictionary: its words first, the longest from the left, and runs of one script between them.

Stands where a morphological analyser would: any object with ``tokens`` can take its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

from tsugumi.functions import analysis

# Fixed value: the mark of proper nouns among parts of speech.
PROPER = "固有名詞"
NOUN = "名詞"

TOKENS = "array<struct<surface string, byte_start int, byte_end int, pos string>>"


@dataclass(frozen=True)
class Token:
    surface: str
    byte_start: int
    byte_end: int
    pos: str


@dataclass(frozen=True)
class Analyser:
    """``entries``: (surface, part of speech) of a user dictionary. Surfaces that begin or end with a Latin letter or digit match whole runs only; without a part of speech they are nouns."""

    entries: tuple[tuple[str, str], ...] = ()
    stopwords: frozenset[str] = field(default_factory=frozenset)

    @cached_property
    def _words(self) -> dict[str, str]:
        return {s: pos or NOUN for s, pos in self.entries if s}

    @cached_property
    def _sizes(self) -> dict[str, list[int]]:
        sizes: dict[str, set[int]] = {}
        for s in self._words:
            sizes.setdefault(s[0], set()).add(len(s))
        return {c: sorted(n, reverse=True) for c, n in sizes.items()}

    @cached_property
    def _patterns(self):
        import regex

        return regex.compile(analysis.segment_pattern("")), regex.compile(r"[\p{Latin}\p{Nd}]"), regex.compile(analysis.NOT_NOUN.replace("Is", ""))

    def _known(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of the dictionary words in ``text``."""
        _, latin, _ = self._patterns
        inside = lambda i: 0 < i < len(text) and latin.match(text[i - 1]) and latin.match(text[i])
        i = 0
        while i < len(text):
            size = next((n for n in self._sizes.get(text[i], ()) if text[i : i + n] in self._words and not inside(i) and not inside(i + n)), 0)
            if size:
                yield i, i + size
            i += size or 1

    def tokens(self, text: str | None) -> list[Token]:
        """Surfaces in order with their places in the UTF-8 bytes of the text; none for null."""
        text = text or ""
        segment, _, not_noun = self._patterns
        out: list[Token] = []
        done = at = 0  # characters and bytes so far

        def put(start: int, end: int, pos: str) -> None:
            nonlocal done, at
            at += len(text[done:start].encode())
            size = len(text[start:end].encode())
            out.append(Token(text[start:end], at, at + size, pos))
            done, at = end, at + size

        last = 0
        for start, end in [*(self._known(text) if self._words else ()), (len(text), len(text))]:
            for m in segment.finditer(text, last, start):
                put(m.start(), m.end(), "" if not_noun.search(m[0]) else NOUN)
            if end > start:
                put(start, end, self._words[text[start:end]])
            last = end
        return out

    def keywords(self, text: str | None) -> list[str]:
        """Distinct nouns in the order they first appear, without stopwords (exact case)."""
        return list(dict.fromkeys(t.surface for t in self.tokens(text) if NOUN in t.pos and t.surface not in self.stopwords))

    def proper_nouns(self, text: str | None) -> list[str]:
        """Surfaces of the words that the dictionary calls proper nouns, as written, in order."""
        return [t.surface for t in self.tokens(text) if PROPER in t.pos]


def _run(analyser: Analyser):
    kind = pa.list_(pa.struct([("surface", pa.string()), ("byte_start", pa.int32()), ("byte_end", pa.int32()), ("pos", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(t.surface, t.byte_start, t.byte_end, t.pos) for t in analyser.tokens(text)] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "tokens"])

    return run


def analysed(texts: DataFrame, key: str, text: str, analyser: Analyser) -> DataFrame:
    """id, tokens of every row; an empty list for null and empty texts. The dictionary goes to every task."""
    return texts.select(texts[key].cast("long").alias("id"), text).mapInArrow(_run(analyser), f"id long, tokens {TOKENS}")
