"""Text functions that stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a Java character class (fixed values of the Unicode White_Space property, and the separators 1C-1F).
SPACE = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def utrim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty, or nothing but Unicode white space."""
    return c.isNull() | ~c.rlike(SPACE.replace("[", "[^", 1))


def _width_table() -> tuple[str, str]:
    import unicodedata

    pairs = []
    for code in range(0xFF01, 0xFFEF):
        to = unicodedata.normalize("NFKC", chr(code))
        if len(to) == 1 and unicodedata.east_asian_width(chr(code)) in "FH":
            pairs.append((chr(code), to))
    pairs.append(("\u3000", " "))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _width_table()


def _voiced() -> list[tuple[str, str]]:
    import unicodedata

    out = []
    for code in range(0x30A1, 0x30FB):
        for mark in "\u3099\u309a":
            one = unicodedata.normalize("NFC", chr(code) + mark)
            if len(one) == 1:
                out.append((chr(code) + mark, one))
    return out


def fold_width(c: Column) -> Column:
    """Full-width signs as ASCII, half-width kana as full-width kana with their voice marks joined."""
    wide = F.translate(c, _FROM, _TO)
    joined = wide
    for two, one in _voiced():
        joined = F.replace(joined, F.lit(two), F.lit(one))
    return F.when(wide.rlike(r"[\u3099\u309a]"), joined).otherwise(wide)


def fold_term(c: Column) -> Column:
    """The form in which spellings that differ in letter case, width or outer blanks are equal; null for null and blank."""
    folded = utrim(F.lower(fold_width(c)))
    return F.when(folded != "", folded)
