"""What a query asks for: dates named in it, its class, its expansions. Plain driver code over one short string."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta

from tsugumi import params as P
from tsugumi.functions import analysis
from tsugumi.functions.analyser import Analyser


@dataclass(frozen=True)
class TimeFilter:
    """``after`` is inclusive, ``before`` exclusive, both YYYY-MM-DD."""

    after: str | None = None
    before: str | None = None


def _month(day: date, offset: int) -> date:
    n = day.year * 12 + day.month - 1 + offset
    return date(n // 12, n % 12 + 1, 1)


def _before(today: date, days: int) -> date:
    return today - timedelta(days) if days < today.toordinal() else date.min


def _span(a: date, b: date | None = None) -> TimeFilter:
    return TimeFilter(a.isoformat(), b.isoformat() if b else None)


# Time words and their spans; 今月 and 今年 have no end.
def _named(today: date) -> dict[str, TimeFilter]:
    year, season = today.year, today.year - (today.month <= 2)
    turn = today.year - 1 if today.month <= 2 else today.year
    return {
        "半年前": _span(today - timedelta(180)),
        "少し前": _span(today - timedelta(P.RECENT_DAYS)),
        "一昨年": _span(date(year - 2, 1, 1), date(year - 1, 1, 1)),
        "おととし": _span(date(year - 2, 1, 1), date(year - 1, 1, 1)),
        "先月": _span(_month(today, -1), _month(today, 0)),
        "去年": _span(date(year - 1, 1, 1), date(year, 1, 1)),
        "昨年": _span(date(year - 1, 1, 1), date(year, 1, 1)),
        "今月": _span(_month(today, 0)),
        "今年": _span(date(year, 1, 1)),
        "最近": _span(today - timedelta(P.RECENT_DAYS)),
        "先週": _span(today - timedelta(7)),
        "年末": _span(date(season, 11, 1), date(season + 1, 1, 1)),
        "年始": _span(date(turn, 1, 1), date(turn, 3, 1)),
        "年初": _span(date(turn, 1, 1), date(turn, 3, 1)),
    }


_TWO_WORDS = ("半年前", "少し前")
_AGO = re.compile(r"([0-9]+)(年|週間?|日|ヶ月|か月)前")
_MONTH = re.compile(r"(?<![0-9])([0-9]{1,2})月[のに]?")
_DAYS = {"年": 365, "週間": 7, "週": 7, "日": 1, "ヶ月": 30, "か月": 30}


def temporal(query: str, today: date) -> tuple[str, TimeFilter | None]:
    """The query without the first time expression, and its range. Expressions of two words go before those of one, and these before a month; of each kind the leftmost counts, of those that start together the longest."""
    found: tuple[int, int, TimeFilter] | None = None
    named = _named(today)

    def first(words, *more: tuple[int, int, TimeFilter]) -> tuple[int, int, TimeFilter] | None:
        hits = [*more, *((query.find(w), query.find(w) + len(w), named[w]) for w in words if w in query)]
        return min(hits, key=lambda h: (h[0], -h[1]), default=None)

    ago = [(m.start(), m.end(), _span(_before(today, int(m[1]) * _DAYS[m[2]]))) for m in [_AGO.search(query)] if m]
    found = first(_TWO_WORDS, *ago) or first([w for w in named if w not in _TWO_WORDS])
    if not found and (m := _MONTH.search(query)) and 1 <= int(m[1]) <= 12:
        n = int(m[1])
        first = date(today.year - (n > today.month), n, 1)
        found = (m.start(), m.end(), _span(first, _month(first, 1)))
    if not found:
        return query.strip(), None
    return (query[: found[0]] + query[found[1] :]).strip(), found[2]


def duration(text: str) -> int | None:
    """Days of ``30d``, ``2w``, ``3m`` or a number of several digits; null for anything else."""
    m = re.fullmatch(r"([+-]?\d+)([dwm])", text.strip())
    if m:
        return int(m[1]) * {"d": 1, "w": 7, "m": 30}[m[2]]
    return int(text) if re.fullmatch(r"[+-]?\d{2,}", text.strip()) else None


def day(text: str) -> str:
    """YYYY, YYYY-MM or YYYY-MM-DD as a day; ValueError for anything else."""
    full = text + {4: "-01-01", 7: "-01"}.get(len(text), "")
    date.fromisoformat(full)
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", full):
        raise ValueError(f"invalid date: {text!r}")
    return full


def merged(today: date, after: str | None = None, before: str | None = None, recent: str | None = None, year: int | None = None, query: TimeFilter | None = None) -> TimeFilter | None:
    """Any explicit flag puts the query's own range aside; of the flags the more exact wins."""
    if after is before is recent is year is None:
        return query
    lo, hi = (f"{year}-01-01", f"{year + 1}-01-01") if year is not None else (None, None)
    if recent is not None:
        days = duration(recent)
        if days is None:
            raise ValueError(f"invalid duration: {recent!r}")
        lo = (today - timedelta(days)).isoformat()
    return TimeFilter(day(after) if after is not None else lo, day(before) if before is not None else hi)


def words(text: str) -> list[str]:
    """Surfaces of a short string, by the pattern that the index uses."""
    import regex

    return regex.findall(analysis.segment_pattern(""), text or "")


def query_keywords(text: str, analyser: Analyser = Analyser()) -> list[str]:
    """The nouns of a request by the analyser, without its stopwords."""
    return analyser.keywords(text)


def index_phrase(surface: str) -> list[str]:
    """The index terms of one surface; a phrase if there are several."""
    import regex

    table = str.maketrans(analysis.ACCENTED, analysis.PLAIN)
    return regex.findall(analysis.term_pattern(""), surface.lower().translate(table))


def is_question(query: str) -> bool:
    return query.strip().endswith(("?", "？")) or any(p in query for p in P.QUESTION_PATTERNS)


def query_class(query: str, entity_ids: list[int]) -> str:
    n = len(words(query.strip()))
    if not query.strip():
        return "Default"
    if entity_ids:
        return "EntityFocused"
    if n == 0:
        return "Default"
    if n <= 2:
        return "Keyword"
    if is_question(query):
        return "Question"
    return "Fuzzy" if n > 10 else "Default"


def text_groups(tokens: list[str], expansions: list[str]) -> list[list[list[str]]]:
    """The full-text query: all tokens together, or all words of any one expansion. Expansions without words are dropped."""
    groups = [[index_phrase(t) for t in tokens]] + [[index_phrase(w) for w in words(e)] for e in expansions]
    return [g for g in groups if g]
