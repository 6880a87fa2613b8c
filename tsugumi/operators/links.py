"""Links between documents: written ones, shared tags, shared entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsugumi import params as P
from tsugumi.plans.bounds import broadcast_if_small, checkpointed

BLOCK_SETS, SLAB = 512, 32
OWN_SETS, HELD_SETS, HOT_ITEMS = 4096, 65_536, 512

LINKS = "doc_a long, doc_b long, link_type string, strength double"
TAG_LINKS = "set_a string, set_b string, shared int, strength double, documents_a long, documents_b long"
TARGETS = "doc_id long, suffix string"
TAG_CLASSES = "doc_id long, tag_set string"


def _low(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def link_targets(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, suffix (ASCII lower case) of every link ``[text](target)`` that is no web address, once a document."""
    targets = documents.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1))).alias("target"))
    return targets.filter(~F.col("target").rlike("^https?://")).select("doc_id", _low(F.col("target")).alias("suffix")).distinct()


def resolved_links(targets: DataFrame, documents: DataFrame) -> DataFrame:
    """Links of ``targets`` (see ``link_targets``) to the document whose path ends in the target (the lowest doc_id of several), strength 1. Links to itself are none.

    Path ends of the lengths that targets have are keys, so the join is on equality; only those that are targets are kept. The lengths, at most as many as a path has characters, are read first.
    """
    wanted = targets.select("suffix").distinct()
    lengths = sorted(r.n for r in wanted.select(F.char_length("suffix").alias("n")).distinct().collect())
    path = _low(F.col("file_path"))
    ends = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length(path)), lambda n: F.substring(path, F.char_length(path) - n + 1, n))
    keys = documents.filter("file_path is not null").select(F.col("doc_id").alias("other"), F.explode(ends).alias("suffix")).join(broadcast_if_small(wanted), "suffix", "left_semi")
    found = targets.join(keys.groupBy("suffix").agg(F.min("other").alias("other")), "suffix").filter("doc_id <> other")
    return found.select(F.least("doc_id", "other").alias("doc_a"), F.greatest("doc_id", "other").alias("doc_b"), F.lit("explicit").alias("link_type"), F.lit(1.0).alias("strength")).distinct()


def explicit_links(documents: DataFrame, text: str = "text") -> DataFrame:
    """``resolved_links`` of the ``link_targets`` of all documents."""
    return resolved_links(link_targets(documents, text), documents)


def _meet(least: int, block: int):
    """Rows of (own, id, items, at), a block of sets that hold one item and others that hold it too, to own, other, shared (own < other) of those that first meet on it.

    Overlaps come from products of 0/1 matrices over the items of the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column(0):
                rows = held.values
                mine, at = rows.field("own").to_numpy(zero_copy_only=False), rows.field("at").to_numpy()
                ids, lists = rows.field("id"), rows.field("items")
                x, others = np.flatnonzero(mine), np.flatnonzero(~mine)
                if not len(x) or not len(others):
                    continue
                sizes = lists.value_lengths().to_numpy().astype(np.int64)
                code = lists.flatten().dictionary_encode().indices.to_numpy()
                row = np.repeat(np.arange(len(ids)), sizes)
                early = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < at[row]
                known = np.full(int(code.max()) + 1, -1)
                known[np.unique(code[mine[row]])] = 0
                known[known == 0] = np.arange((known == 0).sum())  # columns: the items of the block
                code = known[code]
                same = pc.rank(ids, tiebreaker="dense").to_numpy()
                starts = np.concatenate(([0], np.cumsum(sizes)))

                def matrices(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    at_ = np.concatenate([np.arange(starts[w], starts[w + 1]) for w in which])
                    line = np.repeat(np.arange(len(which)), sizes[which])
                    use = code[at_] >= 0  # noqa: B023
                    whole = np.zeros((len(which), known.max() + 1), np.float32)  # noqa: B023
                    whole[line[use], code[at_][use]] = 1  # noqa: B023
                    rarer = np.zeros_like(whole)
                    use &= early[at_]  # noqa: B023
                    rarer[line[use], code[at_][use]] = 1  # noqa: B023
                    return whole, rarer

                whole, rarer = matrices(x)
                for k in range(0, len(others), block):
                    y = others[k : k + block]
                    whole_y, rarer_y = matrices(y)
                    shared = (whole @ whole_y.T).astype(np.int64)
                    i, j = np.nonzero((shared >= least) & (rarer @ rarer_y.T == 0) & (same[x][:, None] < same[y][None, :]))
                    if len(i):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[i])), ids.take(pa.array(y[j])), pa.array(shared[i, j], pa.int64())], names=["own", "other", "shared"])

    return run


def overlaps(sets: DataFrame, least: int) -> DataFrame:
    """own, other, shared of all pairs with own < other of sets (id, items: distinct array) that share at least ``least`` items.

    Items of a set are ordered from the rarest; two sets that share ``least`` items share one of their first
    size - least + 1, so only those are met on, and a pair counts on the rarest it shares. The sets of an item stand in
    blocks of about ``BLOCK_SETS``; each block meets all others, ``SLAB`` of them in a row, so a hot item is spread over many rows of
    bounded size.
    """
    kind = sets.schema["id"].dataType.simpleString()
    each = sets.select("id", F.explode("items").alias("item"))
    counts = broadcast_if_small(each.groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    ordered = each.join(counts, "item").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("s")).filter(F.size("s") >= least)
    prefix = ordered.select("id", F.col("s.item").alias("items"), F.posexplode(F.expr(f"slice(s.item, 1, size(s) - {least - 1})")).alias("at", "item"))
    blocks = broadcast_if_small(prefix.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("item", F.ceil(F.col("n") / BLOCK_SETS).cast("int").alias("blocks")))
    spread = prefix.join(blocks, "item").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    slabs = lambda c: F.floor(c / SLAB).cast("int")
    own = F.transform(F.sequence(F.lit(0), slabs(F.col("blocks") - 1)), lambda s: F.struct(F.col("block").alias("a"), s.alias("slab"), F.lit(True).alias("own")))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda a: F.struct(a.alias("a"), slabs(F.col("block")).alias("slab"), F.lit(False).alias("own")))
    spread = spread.select("item", "id", "items", "at", F.explode(F.concat(own, other)).alias("m"))
    met = spread.groupBy("item", "m.a", "m.slab").agg(F.collect_list(F.struct("m.own", "id", "items", "at")).alias("rows"))
    return met.select("rows").mapInArrow(_meet(least, BLOCK_SETS), f"own {kind}, other {kind}, shared long")


def _flat(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, sizes and all items of the sets (id, items) of a partition, by id."""
    ids, sizes, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for batch in batches:
        ids.append(batch.column(0).to_numpy())
        sizes.append(batch.column(1).value_lengths().to_numpy().astype(np.int64))
        items.append(batch.column(1).flatten().to_numpy())
    ids, sizes, items = np.concatenate(ids), np.concatenate(sizes), np.concatenate(items)
    order = np.argsort(ids)
    starts, ends = (np.cumsum(sizes) - sizes)[order], np.cumsum(sizes[order])
    return ids[order], sizes[order], items[np.arange(len(items)) + np.repeat(starts - ends + sizes[order], sizes[order])]


def _row(*values: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], names=names)


def _own_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the sets of the partition."""
    ids, sizes, items = _flat(batches)
    if len(ids):
        yield _row(ids, sizes, items, names=["own", "sizes", "wanted"])


def _held_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the sets of the partition turned round: distinct items, where the places of each end, the places (in ids) of the sets that hold it."""
    ids, sizes, items = _flat(batches)
    if len(ids):
        order = np.argsort(items, kind="stable")
        kinds, counts = np.unique(items, return_counts=True)
        places = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]
        yield pa.RecordBatch.from_arrays([pa.array(ids[:1]), *_row(ids, kinds, np.cumsum(counts), places, names=["ids", "kinds", "ends", "places"]).columns], names=["first", "ids", "kinds", "ends", "places"])


def _first(found: bytearray, most: int) -> list[int]:
    """The first ``most`` places of ones."""
    places, at = [], found.find(1)
    while at >= 0 and len(places) < most:
        places.append(at)
        at = found.find(1, at + 1)
    return places


def _scan(best: int, least: int):
    """Rows of a block of own sets and a block of held sets, all of the former for one of the own ones next to each other, to own, other, shared.

    The sets of a block that hold a frequent item are a line of bytes; the lines of an own set's items are added, places of rare items are counted up.
    """

    def finish(own: np.ndarray, tops: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(own), 1024):
            part = tops[k : k + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[k : k + 1024], [len(c) for c, _ in part])), pa.array(np.concatenate([i for _, i in part])), pa.array(np.concatenate([c for c, _ in part]))], names=["own", "other", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for batch in batches:
            for r in range(batch.num_rows):
                block = {n: np.frombuffer(batch.column(n)[r].as_buffer(), np.int32 if n == "places" else np.int64) for n in ("own", "sizes", "wanted", "ids", "kinds", "ends", "places")}
                if key is None or not np.array_equal(key, block["own"]):
                    if key is not None:
                        yield from finish(key, tops)
                    key, sizes, wanted = block["own"].copy(), block["sizes"].copy(), block["wanted"].copy()
                    line, starts = np.repeat(np.arange(len(key)), sizes), np.concatenate(([0], np.cumsum(sizes)))
                    tops = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(key)
                    bar, last = np.full(len(key), least - 1), np.full(len(key), np.iinfo(np.int64).min)  # what must be exceeded; the highest id kept with it
                ids, kinds, ends, places = block["ids"], block["kinds"], block["ends"], block["places"].astype(np.int64)  # numpy indexes by these fastest
                begins = np.concatenate(([0], ends[:-1]))
                hot = np.argsort(begins - ends, kind="stable")[:HOT_ITEMS]
                hot = hot[(ends - begins)[hot] > len(ids) / 128]  # beyond this share adding a line is faster
                lines, line_of = np.zeros((len(hot), len(ids)), np.uint8), np.full(len(kinds) + 1, -1)
                line_of[hot] = np.arange(len(hot))
                for i, h in enumerate(hot):
                    lines[i, places[begins[h] : ends[h]]] = 1
                code = np.minimum(np.searchsorted(kinds, wanted), len(kinds) - 1)
                code[kinds[code] != wanted] = len(kinds)
                held = np.bincount(line[code < len(kinds)], minlength=len(key))
                # A set of this block with as many shared items counts only if its id is lower than the last one kept.
                most = np.where(ids[0] > last, bar, np.maximum(bar - 1, least - 1))
                found = bytearray(len(ids))
                mask, small, large = np.frombuffer(found, bool), np.empty(len(ids), np.uint8), None
                self_at = np.searchsorted(ids, key)
                self_at[self_at == len(ids)] = 0
                is_self = ids[self_at] == key
                rows = line_of[code]
                for k in np.flatnonzero(held > most):
                    s = slice(starts[k], starts[k + 1])
                    items, adds = code[s], rows[s]
                    if held[k] > 255 and large is None:
                        large = np.empty(len(ids), np.uint32)
                    counts = small if held[k] <= 255 else large
                    counts[:] = 0
                    for i in adds[adds >= 0].tolist():
                        np.add(counts, lines[i], out=counts)
                    for i in items[(adds < 0) & (items < len(kinds))].tolist():
                        counts[places[begins[i] : ends[i]]] += 1
                    if is_self[k]:
                        counts[self_at[k]] = 0
                    low, high = int(most[k]) + 1, int(counts.max())
                    if high < low:
                        continue
                    np.greater_equal(counts, high, out=mask)
                    while high > low and np.count_nonzero(mask) < best:
                        high -= 1
                        np.greater_equal(counts, high, out=mask)
                    np.equal(counts, high, out=mask)  # of the lowest count that is needed those with the lowest ids, and the few with more
                    at = _first(found, best)
                    np.greater(counts, high, out=mask)
                    at = np.array(at + _first(found, best))
                    shared = counts[at]
                    top, other = np.concatenate((tops[k][0], shared.astype(np.int64))), np.concatenate((tops[k][1], ids[at]))
                    keep = np.lexsort((other, -top))[:best]
                    tops[k] = top[keep], other[keep]
                    if len(keep) == best:
                        bar[k], last[k] = top[keep[-1]], other[keep[-1]]
        if key is not None:
            yield from finish(key, tops)

    return run


def nearest(sets: DataFrame, own: DataFrame, least: int, best: int) -> DataFrame:
    """own, other, shared: for every set of ``own`` (id long, items: distinct array of long) exactly its ``best`` others of ``sets`` that share most items, at least ``least``; ties by id.

    ``sets`` stand in blocks of ``HELD_SETS`` by id, ``own`` in blocks of ``OWN_SETS``; a task takes one own block past all blocks of sets, each a row of bounded size,
    and keeps the best so far, so pairs are never rows. From a block with higher ids only a set that shares more than the last one kept can count;
    where an own set has too few of a block's items for that, the block is passed over. Both tables are read several times.
    """
    spread = lambda df, size: max(1, -(-df.count() // size))
    held = sets.select("id", "items").repartitionByRange(spread(sets, HELD_SETS), "id").mapInArrow(_held_block, "first long, ids binary, kinds binary, ends binary, places binary")
    held = held.repartition(1).sortWithinPartitions("first")
    mine = own.select("id", "items").repartition(spread(own, OWN_SETS), "id").mapInArrow(_own_block, "own binary, sizes binary, wanted binary")
    return mine.hint("shuffle_replicate_nl").crossJoin(held).mapInArrow(_scan(best, least), "own long, other long, shared long")


def tag_classes(document_tags: DataFrame) -> DataFrame:
    """doc_id, tag_set: the class of every document with tags (doc_id, name), its sorted distinct tags joined by a line end."""
    return document_tags.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("name")), "\n").alias("tag_set"))


def tag_links(document_tags: DataFrame) -> DataFrame:
    """set_a <= set_b, shared, strength, documents_a, documents_b of the tag sets that share a tag: .7 x shared / the larger number of tags.

    Documents with the same tags are one class (see ``tag_classes``), so equal sets are compared once and
    copies are not expanded into pairs of documents; a set that several documents have is also linked
    with itself. documents_a and documents_b are the numbers of documents with either set. Tags are compared in lower case and counted once, which makes the relation symmetric.
    """
    classes = tag_classes(document_tags).groupBy("tag_set").agg(F.count(F.lit(1)).alias("n"))
    sets = classes.select("tag_set", "n", F.split("tag_set", "\n").alias("items"))
    size = lambda c: F.size(F.split(c, "\n"))
    pairs = overlaps(sets.select(F.col("tag_set").alias("id"), "items"), 1).select(F.col("own").alias("set_a"), F.col("other").alias("set_b"), F.col("shared").cast("int").alias("shared"))
    own = sets.filter("n > 1").select(F.col("tag_set").alias("set_a"), F.col("tag_set").alias("set_b"), F.size("items").alias("shared"))
    both = pairs.unionByName(own)
    for end in ("a", "b"):
        both = both.join(classes.select(F.col("tag_set").alias(f"set_{end}"), F.col("n").alias(f"documents_{end}")), f"set_{end}")
    return both.select("set_a", "set_b", "shared", (F.lit(P.TAG_STRENGTH) * F.col("shared") / F.greatest(size("set_a"), size("set_b"))).alias("strength"), "documents_a", "documents_b")


def entity_links(chunk_entities: DataFrame, chunks: DataFrame, per_document: int = P.ENTITY_LINKS_PER_DOCUMENT, own: DataFrame | None = None) -> DataFrame:
    """Strength min(ln(shared) / 10, .6) above .05, for documents that share at least two entities; the 20 strongest of each document (ties by id) are kept, a link stays if either end keeps it.

    Documents with the same entities are one class, told by two 64-bit hashes; classes are compared, and of a class the lowest ids, one more than are kept, stand for it.
    With ``own`` (doc_id) only the links that those documents keep, against all.
    """
    owned = chunk_entities.filter("entity_id is not null").join(chunks.select("chunk_id", "document_id"), "chunk_id").groupBy(F.col("document_id").alias("doc_id")).agg(F.sort_array(F.collect_set("entity_id")).alias("items")).filter(F.size("items") > 1)
    keyed = checkpointed(owned.select("doc_id", "items", F.struct(F.xxhash64("items"), F.xxhash64(F.lit(1), "items")).alias("h")))  # read for the classes and their members
    lowest = keyed.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("doc_id"))).filter(F.col("r") <= per_document + 1)
    classes = lowest.groupBy("h").agg(F.min_by("items", "r").alias("items"), F.sort_array(F.collect_list("doc_id")).alias("ids"))
    classes = checkpointed(classes.select("h", F.get("ids", F.lit(0)).alias("id"), "items", "ids"))  # read for the pairs, the own class and the members
    asked = keyed.select("doc_id", "h")
    if own is not None:
        asked = asked.join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    mine = classes if own is None else checkpointed(classes.join(asked, "h", "left_semi"))
    order = Window.partitionBy("own").orderBy(F.desc("shared"), "other")
    near = nearest(classes, mine, 2, per_document)
    near = near.unionByName(mine.filter(F.size("ids") > 1).select(F.col("id").alias("own"), F.col("id").alias("other"), F.size("items").cast("long").alias("shared")))
    listed = near.join(classes.select(F.col("id").alias("other"), "ids"), "other").select("own", "shared", F.explode("ids").alias("other"))
    listed = listed.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_document + 1).groupBy("own").agg(F.sort_array(F.collect_list(F.struct("r", "other", "shared"))).alias("l"))
    members = asked.join(mine.select("h", F.col("id").alias("own")), "h").select("doc_id", "own")
    ends = members.join(listed, "own").select("doc_id", F.explode(F.slice(F.filter("l", lambda x: x["other"] != F.col("doc_id")), 1, per_document)).alias("e")).select("doc_id", "e.other", "e.shared")
    strength = F.least(F.log(F.col("shared")) / 10, F.lit(P.ENTITY_LINK_CAP))
    return ends.select(F.least("doc_id", "other").alias("doc_a"), F.greatest("doc_id", "other").alias("doc_b"), F.lit("entity").alias("link_type"), strength.alias("strength")).filter(F.col("strength") > P.ENTITY_LINK_FLOOR).distinct()


def entity_links_of(own: DataFrame, chunk_entities: DataFrame, chunks: DataFrame, per_document: int = P.ENTITY_LINKS_PER_DOCUMENT) -> DataFrame:
    """The entity links that the documents of ``own`` (doc_id) keep, against all: only their classes are compared, so beyond reading the tables the work grows with their number. Ties by id."""
    return entity_links(chunk_entities, chunks, per_document, own)


def entity_links_at(ids: list[int], chunk_entities: DataFrame, chunks: DataFrame, per_document: int = P.ENTITY_LINKS_PER_DOCUMENT) -> DataFrame:
    """The entity links that have one of ``ids`` at an end: what these keep, and what the documents that share two entities with one of them keep."""
    items = chunk_entities.filter("entity_id is not null").join(chunks.select("chunk_id", F.col("document_id").alias("doc_id")), "chunk_id").select("doc_id", "entity_id").distinct()
    mine = items.filter(F.col("doc_id").isin(ids)).select(F.col("doc_id").alias("id"), "entity_id")
    near = items.join(broadcast_if_small(mine), "entity_id").groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")  # with the documents themselves
    links = entity_links(chunk_entities, chunks, per_document, near.select("doc_id"))
    return links.filter(F.col("doc_a").isin(ids) | F.col("doc_b").isin(ids))


def upserted(links: DataFrame, more: DataFrame) -> DataFrame:
    """One row per pair and type with the higher strength."""
    return links.unionByName(more).groupBy("doc_a", "doc_b", "link_type").agg(F.max("strength").alias("strength"))


def without_documents(links: DataFrame, gone: DataFrame) -> DataFrame:
    """``links`` without those of the documents (doc_id) in ``gone``."""
    for end in ("doc_a", "doc_b"):
        links = links.join(gone.select(F.col("doc_id").alias(end)), end, "left_anti")
    return links


def near_classes(tag_links: DataFrame, classes: DataFrame, ids: list[int]) -> DataFrame:
    """doc_id, link_type, strength of the documents linked by tags with ``ids``, which are not among them, once each with the highest strength.

    The classes of ``ids`` are few; a document has one class, so the strongest link of each class near them is the strongest of its members.
    """
    own = [r.tag_set for r in classes.filter(F.col("doc_id").isin(ids)).select("tag_set").distinct().collect()]  # at most one per id
    a, b = F.col("set_a").isin(own), F.col("set_b").isin(own)
    ends = F.array_compact(F.array(F.when(a, F.col("set_b")), F.when(b, F.col("set_a"))))  # of two classes of ``ids``, each is near the other
    near = tag_links.filter(a | b).select(F.explode(ends).alias("tag_set"), "strength").groupBy("tag_set").agg(F.max("strength").alias("strength"))
    members = classes.filter(~F.col("doc_id").isin(ids)).join(broadcast_if_small(near), "tag_set")
    return members.select("doc_id", F.lit("tag").alias("link_type"), "strength")


def related(links: DataFrame, documents: DataFrame, ids: list[int], limit: int = P.RELATED_DOCUMENTS, tag_links: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """file_path, link_type, strength of the strongest neighbours of ``ids``, which are not among them; ties by path.

    ``tag_links`` between ``classes`` of documents (see ``tag_links``, ``tag_classes``) count as links of their members.
    """
    a, b = F.col("doc_a").isin(ids), F.col("doc_b").isin(ids)
    near = links.filter(a | b).select(F.when(a, F.col("doc_b")).otherwise(F.col("doc_a")).alias("doc_id"), "link_type", "strength").filter(~F.col("doc_id").isin(ids))
    if tag_links is not None and classes is not None:
        near = near.unionByName(near_classes(tag_links, classes, ids))
    named = near.join(documents.select("doc_id", "file_path"), "doc_id").groupBy("file_path", "link_type").agg(F.max("strength").alias("strength"))
    return named.orderBy(F.desc("strength"), "file_path", "link_type").limit(limit)
