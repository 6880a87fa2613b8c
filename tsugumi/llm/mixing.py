"""Mixtures of sources in target shares, routed by min-cost flow over membership patterns.

Texts are aggregated by the set of sources they stand in. On that network (all patterns by sources, held by the driver)
token capacity is routed to the sources' quotas; using a pattern once more costs more each time. The flow then picks
texts: a pattern's texts stand in a seeded order, and every source gets an interval of that sequence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsugumi.llm.tokens import token_counts
from tsugumi.plans.bounds import checkpointed
from tsugumi.plans.segments import segmented


#: The driver holds at most so many target sources; intervals of more patterns than the second are joined by a shuffle, not broadcast.
MAX_TARGETS, MAX_PATTERNS = 10_000, 256


class Network:
    """Flow of tokens from patterns to sources on shortest paths, as arrays with one entry for each source of each pattern.

    Paths are told by their sources alone: a step from one source to the next is taken by all patterns that hold both at
    once, so the number of paths depends on the sources and not on the patterns.
    """

    def __init__(self, capacity: dict[tuple[str, ...], int], repeats: dict[str, int]):
        self.patterns, self.sources = sorted(capacity), sorted(repeats)
        number = {s: j for j, s in enumerate(self.sources)}
        held = np.array([(number[s], i) for i, p in enumerate(self.patterns) for s in p if s in number], dtype=np.int64).reshape(-1, 2)
        self.source, self.pattern = held[np.lexsort((held[:, 1], held[:, 0]))].T
        self.ends = np.searchsorted(self.source, np.arange(len(self.sources) + 1))
        self.whole = np.int64 if sum(capacity.values()) * max(repeats.values(), default=0) * (len(capacity) + 1) < 2**62 else object  # sums over all patterns must fit
        self.capacity = np.array([capacity[p] for p in self.patterns], dtype=self.whole)
        self.repeats = np.array([repeats[s] for s in self.sources], dtype=self.whole)[self.source]
        self.most = np.zeros(len(self.patterns), dtype=self.whole)  # uses of a pattern
        np.maximum.at(self.most, self.pattern, self.repeats)

    def open(self, quotas: dict[str, int]) -> None:
        """No flow yet."""
        self.need = np.array([quotas[s] for s in self.sources], dtype=self.whole)
        self.room = self.repeats * self.capacity[self.pattern]
        self.flow, self.slack = np.zeros_like(self.room), np.zeros_like(self.capacity)

    def once_more(self, use: int) -> None:
        self.slack += np.where(self.most >= use, self.capacity, 0)

    def all_uses(self) -> None:
        self.slack = self.most * self.capacity

    def fill(self) -> None:
        """The largest flow that slack and rooms allow. Where a source still needs tokens, ``before`` tells the sources on its side of the cut (-2)."""
        while self.need.any():
            ends = self._search()
            if not len(ends):
                return
            for t in ends:
                self._push(int(t))

    def _search(self) -> np.ndarray:
        """The nearest sources in need; ``before`` holds the source before each on the path (-1: none, -2: not reached)."""
        self.before, via = np.full(len(self.sources), -2), np.where(self.slack > 0, -1, -2)
        new = self.slack > 0
        while new.any():
            e = new[self.pattern] & (self.room > 0) & (self.before[self.source] == -2)
            found = np.unique(self.source[e])
            self.before[self.source[e]] = via[self.pattern[e]]
            ends = found[self.need[found] > 0]
            if len(ends):
                return ends
            e = np.isin(self.source, found) & (self.flow > 0) & (via[self.pattern] == -2)
            via[self.pattern[e]] = self.source[e]
            new = np.zeros(len(self.patterns), dtype=bool)
            new[self.pattern[e]] = True
        return np.array([], dtype=np.int64)

    def _push(self, end: int) -> None:
        path = [end]
        while self.before[path[0]] >= 0:
            path.insert(0, int(self.before[path[0]]))
        entries = [slice(self.ends[s], self.ends[s + 1]) for s in path]
        give, most = self.slack, []
        for e in entries:
            most.append(np.minimum(give[self.pattern[e]], self.room[e]))
            give = np.zeros_like(self.slack)
            give[self.pattern[e]] = self.flow[e]
        n = min(self.need[end], *(m.sum() for m in most))
        for i, e in enumerate(entries):
            part = np.diff(np.minimum(np.cumsum(most[i]), n), prepend=0)
            self.flow[e] += part
            self.room[e] -= part
            if i == 0:
                self.slack[self.pattern[e]] -= part
            else:
                moved = part > 0
                back = self.ends[path[i - 1]] + np.searchsorted(self.pattern[entries[i - 1]], self.pattern[e][moved])
                self.flow[back] -= part[moved]
                self.room[back] += part[moved]
        self.need[end] -= n


def route(capacity: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens of each pattern given to each source. The r-th use of a pattern costs r squared, so capacity is used evenly before it is repeated.

    A path that adds to a flow takes back no use of a pattern, so the flow is cheapest if no second use is allowed before all first ones are filled, and so on.
    """
    net = Network(capacity, {s: repeats[s] for s in quotas})
    net.open(quotas)
    left, use = net.need.sum() + 1, 0
    while 0 < net.need.sum() < left:
        left, use = net.need.sum(), use + 1
        net.once_more(use)
        net.fill()
    e = np.flatnonzero(net.flow)
    return {(net.patterns[i], net.sources[j]): n for i, j, n in zip(net.pattern[e].tolist(), net.source[e].tolist(), net.flow[e].tolist())}


def quotas_of(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole tokens per source that add up to ``total`` (largest remainders)."""
    exact = {s: total * w / sum(shares.values()) for s, w in shares.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: total - sum(out.values())]:
        out[s] += 1
    return out


def largest_total(capacity: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest mixture in which every source still fills its quota.

    Where the quotas of a total can't be filled, the sources on the far side of the cut and what they can get bound the total; the search goes down from bound to bound.
    """
    net = Network(capacity, {s: repeats[s] for s in shares})
    total, cuts = sum(n * max((repeats[s] for s in p if s in shares), default=0) for p, n in capacity.items()), []
    while total > 0:
        quotas = quotas_of(total, shares)
        if any(sum(quotas[s] for s in far) > most for far, most in cuts):
            total -= 1
            continue
        net.open(quotas)
        net.all_uses()
        net.fill()
        if not net.need.any():
            return total
        far = [s for s, b in zip(net.sources, net.before) if b == -2]
        most = sum(quotas[s] for s in far) - int(net.need.sum())
        cuts.append((far, most))
        # Each quota is less than one below its share.
        total = min(total - 1, int((most + len(far)) * sum(shares.values()) / sum(shares[s] for s in far)) + 1)
    return 0


def mixture(members: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1, unit: list[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(documents, report) of a mixture.

    ``members``: doc_id, source, tokens and ``unit``, the columns that tell what must not be repeated too often; a unit in several sources
    has several rows, repeated rows count once, and the lowest doc_id of the unit in a source stands for it there. ``targets``: source,
    target_share, max_repeats (more than ``MAX_TARGETS`` are an error). Documents: doc_id, source, uses,
    tokens. Report: source, target_share, quota, tokens, reached_share, documents, most_uses, one row
    per target. Without ``total``, the mixture is the largest in which all sources that have tokens keep
    their shares; a source without tokens (or with null or no share or repeats) gets none and the others
    share its part. A source ends within one document of its quota. Empty documents are never used. Runs jobs.
    """
    rows = targets.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    wanted = {r.source: r for r in rows}
    unit = list(unit)
    each = members.filter((F.col("tokens") > 0) & F.col("source").isin(list(wanted))).groupBy(*[F.col(c).alias(f"_u{i}") for i, c in enumerate(unit)], "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    owned = each.groupBy(*[f"_u{i}" for i in range(len(unit))]).agg(F.map_from_entries(F.collect_list(F.struct("source", "doc_id"))).alias("docs"), F.max("tokens").alias("tokens"))  # at most a row per source
    owned = owned.select(F.sort_array(F.map_keys("docs")).alias("pattern"), "docs", F.array_min(F.map_values("docs")).alias("first"), "tokens")
    # Used for the capacities and for the selection; counting tokens twice would cost more.
    owned = checkpointed(owned)
    capacity = {tuple(r.pattern): r.n for r in owned.groupBy("pattern").agg(F.sum("tokens").alias("n")).collect()}
    held = {s for p in capacity for s in p}
    use = {s: r for s, r in wanted.items() if s in held and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0}
    shares, repeats = {s: r.target_share for s, r in use.items()}, {s: r.max_repeats for s, r in use.items()}
    total = largest_total(capacity, shares, repeats) if total is None else total
    quotas = quotas_of(total, shares) if shares else {}
    at: dict[tuple[str, ...], int] = {}
    spans = []
    for (p, s), n in sorted(route(capacity, quotas, repeats).items()):
        lo = at.get(p, 0)
        at[p] = lo + n
        spans.append((list(p), s, lo, lo + n, capacity[p]))
    spark = members.sparkSession
    intervals = spark.createDataFrame(spans, "pattern array<string>, source string, lo long, hi long, size long")  # one row per pattern and source
    placed = segmented(owned.withColumn("_h", F.xxhash64(F.lit(seed), "first")), ["pattern"], ["_h", "first"], sums=["tokens"])
    joined = placed.join(F.broadcast(intervals) if len(capacity) <= MAX_PATTERNS else intervals, "pattern")
    # Copies of the sequence start at 0, size, 2 size, ...; a document's middle stands at the same place in each.
    upto = lambda x: F.ceil((F.col(x) * 2 - F.col("before_tokens") * 2 - F.col("tokens")) / (F.col("size") * 2))
    uses = F.greatest(F.lit(0), upto("hi")) - F.greatest(F.lit(0), upto("lo"))
    chosen = joined.select(F.element_at(F.col("docs"), F.col("source")).alias("doc_id"), "source", uses.cast("int").alias("uses"), "tokens").filter("uses > 0")
    sums = chosen.groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    plan = spark.createDataFrame([(s, r.target_share, quotas.get(s, 0)) for s, r in wanted.items()], "source string, target_share double, quota long")
    whole = sums.select(F.sum("tokens").alias("_all"))
    report = plan.join(sums, "source", "left").join(F.broadcast(whole)).select(
        "source", "target_share", "quota", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.col("_all")).alias("reached_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
    return chosen, report


def document_mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``mixture`` of documents (doc_id, source, text) with sizes in tokens of a public vocabulary. Copies of a text are one unit, told by two 64-bit hashes, whatever their sources: none is used more often for having copies."""
    keyed = documents.select("doc_id", "source", F.xxhash64("text").alias("_a"), F.xxhash64(F.lit(1), "text").alias("_b"), "text")
    return mixture(token_counts(keyed, ["doc_id", "source", "_a", "_b"], path), targets, total, unit=["_a", "_b"])
