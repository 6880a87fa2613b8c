"""Text statistics of documents, and an ordered rule list learned from them that tells prose from the rest.

The statistics come from one pass over the code points of Arrow batches of texts and a few patterns on lines. Rules are
grown and pruned by incremental reduced-error pruning on labelled documents, on the driver, from at most ``MAX_LABELLED``
rows; they are applied as one SQL CASE expression over the statistics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
MAX_COMMON = 10_000
KINDS = ("list", "table", "junk")

_ITEM = re.compile(r"\s*(?:[-*+•・◦‣–—]|\(?(?:[0-9]{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)）]|[①-⑳])\s+\S")
_CELLS = re.compile(r"\|.*\||\t\S|│|;[^;]*;|,[^,]*,[^,]*,|\S {2,}\S.* {2,}\S")
_KEYED = re.compile(r"\s*[^\s:：].{0,40}[:：]\s+\S")
_LOG = re.compile(r"\b0x[0-9A-Fa-f]{4,}|\b(?:DEBUG|INFO|WARN(?:ING)?|ERROR|TRACE|FATAL)\b|[0-9]{2}:[0-9]{2}:[0-9]{2}|^\S+ \[|^\s*at \S+\(|\b[0-9a-fA-F]{16,}\b")
_ENUMERATED = re.compile(r"^\s*\(?([0-9]{1,3})[.)）]\s", re.M)
_DECIMAL = re.compile(r"[0-9]\.[0-9]")
_STOP = re.compile(r"[.!?。！？]+(?=[ \t\n\x0b\f\r]|\Z|[^\x00-\x7f])")
_SENTENCE = re.compile(r"[.!?。！？\n]+")

#: Classes of code points that are counted; a text is read once for all of them.
CLASSES = {
    "blank": r"[ \t\n\x0b\f\r]", "solid": r"[^\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", "space": r"[ ]",
    "symbol": r"[^\p{L}\p{N}\p{M} \t\n\x0b\f\r.,!?。、！？「」'\"()-]", "punctuation": r"[.,!?。、！？]", "number": r"\p{N}",
    "latin1": r"[\u0080-\u00bf\u00c0-\u00c3\u00e2\u00e3\u00e5-\u00e9\u0152-\u02dc\u2018-\u2122]", "broken": r"[\ufffd\u25a0-\u25ff\uff9e?^~|]",
    "hiragana": r"[\u3040-\u309f]", "katakana": r"[\u30a0-\u30ff]", "han": r"[\u4e00-\u9fff]", "small_kana": r"[ぁぃぅぇぉゃゅょゎっーゐゑ]",
    "vowel": r"[aeiouäöüAEIOUÄÖÜ]", "latin": r"[A-Za-zäöüÄÖÜß]", "bracket": r"[{}<>=+*/#@%&;\\_\[\]$`]", "pipe": r"[|│\t]",
    "letter": r"\p{L}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "stop": r"[.!?。！？]", "pause": r"[.!?。！？、,]",
    "closing": r"[.!?。！？…」』\"”’):：]", "open_end": r"[.!?。！？…」』\"”:：,、]",
}


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    """The atom of every code point, and which atoms each class holds (classes by atoms)."""
    import regex

    bits = np.zeros(0x110000, np.uint32)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for k, pattern in enumerate(CLASSES.values()):
        held = "".join(regex.findall(pattern + "+", every))
        bits[np.frombuffer(held.encode("utf-32-le"), np.uint32)] |= np.uint32(1 << k)
    masks, atoms = np.unique(bits, return_inverse=True)
    return atoms.astype(np.uint8 if len(masks) < 256 else np.uint16), np.array([(masks >> k) & 1 for k in range(len(CLASSES))], bool)


def _batch(texts: list[str], spaced: frozenset[str], joined: re.Pattern | None) -> dict[str, np.ndarray]:
    """The statistics of some texts. Characters are looked up once; what concerns one of them, its neighbours or its line comes from arrays."""
    import regex

    n = len(texts)
    big = "\n".join(texts) + "\n"
    code = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
    atoms, holds = _table()
    atom = atoms[code]
    sizes = np.fromiter(map(len, texts), np.int64, n)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    doc = np.repeat(np.arange(n), sizes + 1)
    counts = np.bincount(doc * holds.shape[1] + atom, minlength=n * holds.shape[1]).reshape(n, -1) @ holds.T.astype(np.int64)
    names = list(CLASSES)
    count = {k: counts[:, i] for i, k in enumerate(names)}
    count["blank"] = count["blank"] - 1  # the line end that was added
    is_ = {k: holds[names.index(k)][atom] for k in ("blank", "space", "letter", "upper", "lower", "stop", "pause", "closing", "open_end")}
    ink = sizes - count["blank"]

    end = np.flatnonzero(code == 10)
    start = np.concatenate(([0], end[:-1] + 1))
    solid = np.concatenate(([0], np.cumsum(~is_["space"], dtype=np.int64)))
    keep = solid[end] > solid[start]
    start, end = start[keep], end[keep]
    line_doc, length, last = doc[start], end - start, end - 1
    strings = [big[a:b] for a, b in zip(start.tolist(), end.tolist())]
    per = lambda values: np.bincount(line_doc, values, n)
    n_lines, line_chars = per(np.ones(len(start))), per(length)
    pauses = np.concatenate(([0], np.cumsum(is_["pause"], dtype=np.int64)))
    held = pauses[end] - pauses[start]
    inked = np.maximum.accumulate(np.where(is_["blank"], -1, np.arange(len(code))))[last]  # the last sign of a line that is no blank
    ended = (inked >= start) & is_["closing"][inked]
    fragment = (length <= 61) & ~is_["open_end"][last]
    lone = ((length >= 2) & (length <= 41) & ~is_["stop"][last]) | ((held == 0) & (length <= 45)) | ((held == 1) & is_["stop"][last] & (length >= 2) & (length <= 46))
    signs = np.concatenate(([0], np.cumsum(~is_["blank"], dtype=np.int64)))
    ink_of = signs[end] - signs[start]
    leading = np.minimum.accumulate(np.where(is_["blank"], len(code), np.arange(len(code)))[::-1])[::-1][start]
    tiny = (ink_of > 0) & (ink_of <= 12) & (inked - leading + 1 == ink_of)
    found = lambda test: np.fromiter((test(x) is not None for x in strings), bool, len(strings))
    item, cell, keyed, log = found(_ITEM.match), found(_CELLS.search), found(_KEYED.match), found(_LOG.search)
    link = np.fromiter(("http://" in x or "https://" in x for x in strings), bool, len(strings))

    # Runs of one sign, and runs of spaces with a sign behind them.
    cut = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    run = np.diff(np.concatenate((cut, [len(code)])))
    runs = np.bincount(doc[cut], np.where(is_["blank"][cut], 0, run // 4), n)
    gap = is_["space"][cut] & (run >= 2)
    behind = np.concatenate((cut[1:], [len(code) - 1]))
    gap &= ~is_["blank"][behind]
    wide = np.bincount(doc[cut], gap, n)
    before = np.concatenate(([False], ~is_["blank"][cut[1:] - 1])) & (np.concatenate(([-1], doc[cut[1:] - 1])) == doc[cut])
    gaps = np.bincount(doc[cut], gap & before, n)
    capital = is_["upper"][:-1] & is_["lower"][1:] & ~np.concatenate(([False], is_["letter"][:-2]))
    capitals = np.bincount(doc[:-1], capital, n)

    word = regex.compile(r"[\p{L}\p{N}\p{M}_'’]+").findall
    words = [word(t.lower()) for t in texts]
    n_words = np.fromiter(map(len, words), float, n)
    sentences = [[y for x in _SENTENCE.split(t) if len(y := x.strip(" ")) > 3] for t in texts]
    bounds = np.searchsorted(line_doc, np.arange(n + 1))
    value = lambda f, xs: np.fromiter((f(x) for x in xs), float, n)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=np.asarray(b) > 0)
    within = lambda flags: share(per(length * flags), line_chars)
    of_lines = lambda flags: share(per(flags), n_lines)
    digits = count["number"] - value(lambda t: sum(map(len, _ENUMERATED.findall(t))), texts)
    return {
        "n_chars": sizes.astype(float), "n_words": n_words, "n_lines": n_lines,
        "mean_word": share(value(lambda w: sum(map(len, w)), words), n_words), "mean_line": share(line_chars, n_lines), "long_lines": within(length > 60),
        "symbols": share(count["symbol"], ink), "punctuation": share(count["punctuation"], ink), "digits": share(digits, ink),
        "decimals": share(value(lambda t: len(_DECIMAL.findall(t)), texts), n_lines), "runs": share(runs * 4, ink),
        "marked_chars": within(item | keyed), "fragment_chars": within(fragment), "lone_lines": of_lines(lone), "cells": share(count["pipe"] + wide, n_lines),
        "latin1": share(count["latin1"], ink), "broken": share(count["broken"], ink), "ended_lines": of_lines(ended), "ended_chars": within(ended),
        "item_lines": of_lines(item), "item_chars": within(item), "cell_lines": of_lines(cell), "cell_chars": within(cell),
        "keyed_lines": of_lines(keyed), "keyed_chars": within(keyed), "log_lines": of_lines(log), "log_chars": within(log), "link_lines": of_lines(link),
        "short_chars": within(length <= 45), "tiny_lines": of_lines(tiny),
        "common_spaced": share(value(lambda w: sum(x in spaced for x in w), words), n_words),
        "common_joined": share(value(lambda t: len(joined.findall(t)), texts) if joined else np.zeros(n), np.maximum(count["hiragana"] + count["katakana"] + count["han"], 1)),
        "distinct_words": share(value(lambda w: len(set(w)), words), n_words),
        "distinct_lines": share(np.fromiter((len(set(strings[a:b])) for a, b in zip(bounds, bounds[1:])), float, n), n_lines),
        "distinct_sentences": share(value(lambda x: len(set(x)), sentences), value(len, sentences)),
        "kana": share(count["hiragana"], ink), "katakana": share(count["katakana"], ink), "han": share(count["han"], ink), "small_kana": share(count["small_kana"], ink),
        "vowels": share(count["vowel"], count["latin"]), "capitals": share(capitals, n_words),
        "full_stops": share(value(lambda t: len(_STOP.findall(t)), texts), n_words + sizes / 40), "quoted_parens": share(count["bracket"], ink),
        "pipes": share(count["pipe"], ink), "gaps": share(gaps, n_lines), "_solid": count["solid"].astype(float),
    }


STATISTICS = tuple(k for k in _batch([""], frozenset(), None) if k != "_solid")
_BATCH_CHARS = 1_000_000


def _measure(spaced: frozenset[str], joined: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile("|".join(map(re.escape, joined))) if joined else None

        def done(ids: list, texts: list[str]) -> pa.RecordBatch:
            got = _batch(texts, spaced, pattern)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got["_solid"] == 0), *(pa.array(np.asarray(got[k], float)) for k in STATISTICS)], names=["doc_id", "blank", *STATISTICS])

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append((text or "").replace("\r\n", "\n").replace("\r", "\n"))
                size += len(texts[-1])
                if size > _BATCH_CHARS:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield done(ids, texts)

    return run


def statistics(documents: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, blank and the ``STATISTICS`` of ``text``, null text as empty text.

    Counts are over the whole text. Shares of an empty whole are 0. ``common`` (lang, word) holds the
    frequent words, a fixed list of some dozens, which goes to every task (more than ``MAX_COMMON`` are an error);
    all languages count together, as lang may be wrong. Words of Japanese are found inside the text, others between word ends.
    """
    listed = common.filter("word is not null").select("lang", "word").distinct().limit(MAX_COMMON + 1).collect()
    if len(listed) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    spaced = frozenset(r.word for r in listed if r.lang != "ja")
    joined = sorted({r.word for r in listed if r.lang == "ja"}, key=lambda w: (-len(w), w))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_measure(spaced, joined), "doc_id long, blank boolean, " + ", ".join(f"{k} double" for k in STATISTICS))


Rule = tuple[str, list[tuple[str, str, float]]]


def _covers(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, op, at in rule:
        out &= x[:, f] <= at if op == "<=" else x[:, f] >= at
    return out


def _grow(x: np.ndarray, y: np.ndarray) -> list[tuple[int, str, float]]:
    """Conditions added by information gain, over every cut between two values, until no negative example is covered or nothing is gained."""
    rule: list[tuple[int, str, float]] = []
    inside = np.ones(len(x), bool)
    while (~y[inside]).any():
        p, n = y[inside].sum(), (~y[inside]).sum()
        if not p:
            break
        base, best, pick = np.log2(p / (p + n)), 0.0, None
        for f in range(x.shape[1]):
            order = np.argsort(x[inside, f], kind="stable")
            v, lab = x[inside, f][order], y[inside][order]
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(k):
                continue
            cp = np.cumsum(lab)[k - 1]
            for op, pp, nn in (("<=", cp, k - cp), (">=", p - cp, n - (k - cp))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), 0)
                j = int(np.argmax(gain))
                if gain[j] > best + 1e-9:
                    best, pick = gain[j], (f, op, float((v[k[j]] + v[k[j] - 1]) / 2))
        if pick is None:
            break
        rule.append(pick)
        inside &= _covers(x, [pick])
    return rule


def _prune(x: np.ndarray, y: np.ndarray, rule: list) -> list:
    """The prefix of the rule with the best (p - n) / (p + n) on held-out examples."""
    best, keep = -2.0, rule
    for k in range(len(rule), 0, -1):
        hit = _covers(x, rule[:k])
        p, n = (hit & y).sum(), (hit & ~y).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best:
            best, keep = worth, rule[:k]
    return keep


def induce(x: np.ndarray, labels: np.ndarray, names: list[str], kinds: tuple[str, ...] = KINDS, seed: int = 7) -> list[Rule]:
    """Ordered rules (kind, conditions), first match wins, else prose.

    Kinds are taken from the rarest to the most frequent; each rule is grown on two thirds of the
    remaining examples and pruned on the other third; rules stop when one errs on half of what it covers.
    """
    rng = np.random.default_rng(seed)
    left = np.ones(len(x), bool)
    rules: list[Rule] = []
    for kind in sorted(kinds, key=lambda k: ((labels == k).sum(), k)):
        while True:
            rows = np.flatnonzero(left)
            y = labels[rows] == kind
            if not y.any():
                break
            fold = np.zeros(len(rows), bool)  # held out, a third of either class
            for side in (y, ~y):
                at = rng.permutation(np.flatnonzero(side))
                fold[at[: len(at) // 3]] = True
            grown = _grow(x[rows[~fold]], y[~fold])
            if not grown:
                break
            rule = _prune(x[rows[fold]], y[fold], grown) if y[fold].sum() >= 2 else grown
            hit = _covers(x[rows], rule)
            if (hit & y).sum() <= (hit & ~y).sum():
                break
            rules.append((kind, [(names[f], op, at) for f, op, at in rule]))
            left[rows[hit]] = False
    return rules


def as_sql(rules: list[Rule]) -> str:
    """The rules as a CASE expression over the statistics; prose where none holds."""
    if not rules:
        return "'prose'"
    whens = " ".join(f"WHEN {' AND '.join(f'{c} {op} {at!r}D' for c, op, at in conditions)} THEN '{kind}'" for kind, conditions in rules)
    return f"CASE {whens} ELSE 'prose' END"


def learned_rules(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the statistics of labelled documents; the sample is the ``max_rows`` rows first in hash order. No labels: no rules."""
    sample = labels.filter("doc_id is not null and label is not null").select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    names = [c for c in stats.columns if c not in ("doc_id", "blank")]
    rows = sample.join(stats, "doc_id").filter("not blank").select("doc_id", "label", *names).toPandas().sort_values("doc_id")
    if not len(rows):
        return []
    return induce(rows[names].to_numpy(float), rows["label"].to_numpy(object), names)


def not_prose(documents: DataFrame, common: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, kind (list, table, junk) of documents with non-blank text that the learned rules hold for no prose."""
    sample = labels.filter("doc_id is not null and label is not null").select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    marked = documents.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")  # at most MAX_LABELLED ids
    rules = learned_rules(statistics(marked, common), sample)
    kind: Column = F.expr(as_sql(rules))
    return statistics(documents, common).filter("not blank").select("doc_id", kind.alias("kind")).filter("kind <> 'prose'")
