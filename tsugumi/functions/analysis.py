"""Segmentation, index terms and keywords of text, in built-in functions.

Without a morphological analyser words are runs of one script: kanji, katakana, hiragana, or Latin letters
and digits. Kanji, katakana and Latin runs stand for nouns. Any other segmenter can take the place of
``segments``: a column expression from text to an array of surfaces.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsugumi.functions.text import utrim

_SCRIPTS = r"[\p{%Han}々]+|[\p{%Katakana}ー]+|\p{%Hiragana}+|[\p{%Hangul}\p{%Cyrillic}\p{%Greek}\p{%Arabic}\p{%Thai}]+"


def segment_pattern(prefix: str = "Is") -> str:
    """Runs of one script; Latin terms may hold ``.``, ``_`` and ``-`` inside. ``prefix``: Is for Java, empty for RE2."""
    return _SCRIPTS.replace("%", prefix) + r"|[\p{%Latin}\p{Nd}]+(?:[._-][\p{%Latin}\p{Nd}]+)*".replace("%", prefix)


def term_pattern(prefix: str = "Is") -> str:
    return _SCRIPTS.replace("%", prefix) + r"|[\p{%Latin}\p{Nd}]+".replace("%", prefix)


def _accents() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def segments(text: Column) -> Column:
    """Surfaces in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(segment_pattern()), F.lit(0)), F.array().cast("array<string>"))


def segmented_text(text: Column) -> Column:
    return F.array_join(segments(text), " ")


def index_terms(text: Column) -> Column:
    """Terms as they stand in the index: lower case, Latin letters without accents, split at everything that is no letter or digit."""
    return F.coalesce(F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(term_pattern()), F.lit(0)), F.array().cast("array<string>"))


NOT_NOUN = r"^[\p{IsHiragana}]+$|^[ー〜…wW!-/:-@\[-`{-~]+$|^[\p{IsKatakana}ー]$|^\p{Nd}+(?:[._-]\p{Nd}+)*$"


def keywords(text: Column, stopwords: list[str] = ()) -> Column:
    """Distinct noun-like surfaces in the order they first appear, without digits, single kana, noise and stopwords (exact case)."""
    kept = F.filter(segments(text), lambda x: ~x.rlike(NOT_NOUN))
    if stopwords:
        kept = F.array_except(kept, F.array(*map(F.lit, stopwords)))
    return F.array_distinct(kept)


def is_katakana(c: Column) -> Column:
    return c.rlike(r"^[゠-ヿ]+$")


def is_ascii_term(c: Column) -> Column:
    return c.rlike(r"^(?=.*[A-Za-z])[A-Za-z0-9._-]+$")


def is_cjk(c: Column) -> Column:
    return c.rlike(r"[\u3000-\u9fff\uf900-\ufaff\uff00-\uffef]")


def candidate_kind(surface: Column) -> Column:
    """proper_noun is left to analysers that know parts of speech; katakana and ascii are read off the signs; null for the rest."""
    return F.when(is_katakana(surface) & (F.char_length(surface) >= 2), "katakana").when(is_ascii_term(surface) & (F.char_length(surface) >= 2), "ascii")


def snippet(content: Column, size: int = 200) -> Column:
    """The first ``size`` characters after the first line, or of the whole if there is one line, without outer blanks."""
    rest = F.when(F.instr(content, "\n") > 0, F.substr(content, F.instr(content, "\n") + 1)).otherwise(content)
    return utrim(F.substring(rest, 1, size))


def query_class(query: Column, has_entity: Column, questions: tuple[str, ...]) -> Column:
    """The class of a query, first that applies; null counts as empty."""
    n = F.size(segments(query))
    text = utrim(F.coalesce(query, F.lit("")))
    asks = text.endswith("?") | text.endswith("？")
    for q in questions:
        asks = asks | text.contains(q)
    return F.when(text == "", "Default").when(has_entity, "EntityFocused").when(n == 0, "Default").when(n <= 2, "Keyword").when(asks, "Question").when(n > 10, "Fuzzy").otherwise("Default")
