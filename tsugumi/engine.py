"""The operations of an index as methods: index, ingest, search, fill vectors, keep the dictionary and synonyms, report."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsugumi.operators import chunking, dictionary, entities, fulltext, links, maintenance, sessions, synonyms
from tsugumi.functions.analyser import PROPER, Analyser, analysed
from tsugumi.functions.analysis import index_terms
from tsugumi.plans import search as S
from tsugumi.plans.bounds import checkpointed
from tsugumi import settings as C
from tsugumi.settings import Settings
from tsugumi.sources import files
from tsugumi.store import Store

SCHEMAS = {
    "documents": "doc_id long, file_path string, source_type string, title string, status string, created string, updated string, tags array<string>, file_hash string, text string",
    "chunks": "chunk_id long, document_id long, chunk_index long, section_path string, content string, content_hash string",
    "vectors": "chunk_id long, embedding array<float>",
    "skipped": "chunk_id long, reason string",
    "terms": "name string, entity_type string",
    "entities": "entity_id long, name string, entity_type string",
    "chunk_entities": "chunk_id long, entity_id long",
    "edges": "entity_a long, entity_b long, doc_id long, occurrences long",
    "links": links.LINKS,
    "targets": links.TARGETS,
    "postings": f"{fulltext.POSTINGS}, bucket int",
    "lengths": "chunk_id long, state long, dl int",
    "index_stats": "n long, total long",
    "tag_links": links.TAG_LINKS,
    "tag_classes": links.TAG_CLASSES,
    "synonyms": synonyms.SCHEMA,
    "candidates": "surface string, frequency long, pos string, source string, first_seen string, last_seen string, status string",
}


#: Documents that one change may touch before the graph is made anew as a whole, and segments of postings before they are merged.
MAX_TOUCHED, MAX_SEGMENTS = 10_000, 8
#: Lines of a list that a person keeps.
MAX_LISTED = 100_000


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings, encoder: Callable[[list[str]], list[list[float]]] | None = None):
        self.spark, self.settings = spark, settings
        self.encoder = encoder or maintenance.hashed_embedding(settings.dimension)
        self.store = Store(spark, settings.state, SCHEMAS, {"postings": "bucket"})

    # -- writing

    def index(self, as_of: str, paths: list[str] | None = None) -> dict[str, int]:
        """Brings notes up to date: the whole tree, or only ``paths`` (those that are gone are removed). Returns how many files were inserted, updated, deleted and skipped."""
        s, t = self.settings, self.store.table
        policy = files.policy_of(s.root, s.extensions, s.use_gitignore)
        found = files.roots(s.root, [d.path for d in s.directories] or None, policy)
        seen = files.read_files(self.spark, s.root, found, policy)
        if paths is not None:
            wanted = files.listed_paths(self.spark, paths).filter(policy.column(F.col("file_path")))
            seen = wanted.join(seen, "file_path", "left")
        notes = t("documents").filter(~F.col("file_path").startswith("session:"))
        actions = maintenance.document_actions(notes, seen, complete=paths is None)
        counts = {r.op: r["count"] for r in actions.groupBy("op").count().collect()}
        if not any(counts.get(k) for k in ("insert", "update", "delete")):
            return counts
        changed = seen.join(actions.filter("op in ('insert', 'update')").select("file_path"), "file_path").select(F.xxhash64("file_path").alias("doc_id"), "file_path", "text", "file_hash")
        parsed = chunking.parsed_notes(changed, s.chunk_bytes)
        new = changed.join(parsed.drop("parts"), "doc_id").select("doc_id", "file_path", chunking.source_type(chunking.directory_label(F.col("file_path"))).alias("source_type"), chunking.file_stem(F.col("file_path")).alias("title"), "status", "created", "updated", "tags", "file_hash", "text")
        made = chunking.note_chunks(changed, s.chunk_bytes)
        made = made.select(F.xxhash64("doc_id", "chunk_index").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("chunk_index").cast("long").alias("chunk_index"), "section_path", "content", "content_hash")
        touched = actions.filter("op in ('insert', 'update', 'delete')").select(F.xxhash64("file_path").alias("doc_id"))
        self._publish(touched, new, made, as_of, "document", lambda fresh: fresh.select("content"))
        return counts

    def ingest(self, lines: DataFrame, as_of: str) -> int:
        """Session lines (session, line_no, value: one JSON object) as documents of question-and-answer chunks; synonyms and candidates are learned from what users say. Returns the number of sessions indexed."""
        messages = sessions.message_text(sessions.parsed_lines(lines)).withColumns({"ord": F.col("line_no"), "id": F.col("line_no")})
        parts = sessions.qa_chunks(messages)
        docs = sessions.session_documents(parts).withColumn("doc_id", F.xxhash64("file_path"))
        new = docs.select("doc_id", "file_path", F.lit("session").alias("source_type"), F.regexp_replace("file_path", "^session:", "").alias("title"), "status", "created", "updated", F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("file_hash"), F.lit(None).cast("string").alias("text"))
        doc = F.xxhash64(F.concat(F.lit("session:"), "session"))
        made = parts.select(F.xxhash64(doc, F.col("chunk_index").cast("int")).alias("chunk_id"), doc.alias("document_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.lit("session").alias("section_path"), "content", F.sha2(F.encode("content", "UTF-8"), 256).alias("content_hash"))
        asked = messages.filter("role = 'user'")
        learned = synonyms.learned_pairs(asked, "text", as_of).select(*synonyms.COLUMNS)
        said = lambda fresh: asked.withColumn("document_id", doc).join(fresh.select("document_id").distinct(), "document_id", "left_semi").select(F.col("text").alias("content"))
        self._publish(new.select("doc_id"), new, made, as_of, "session", said, synonyms.upserted(self.store.table("synonyms"), learned))
        return new.count()

    def _publish(self, touched: DataFrame, new: DataFrame, made: DataFrame, as_of: str, source: str, words: Callable[[DataFrame], DataFrame], learned: DataFrame | None = None) -> None:
        """Documents and chunks with the changes; of what hangs on a chunk (vectors, postings, candidates) only new and changed chunks are made anew. ``words`` gives the texts (content) that candidates come from, of those chunks."""
        t = self.store.table
        touched = checkpointed(touched.distinct())  # the listing and the hashes behind it must not be read again when the tables have moved on
        new, made = checkpointed(new), checkpointed(made)
        gone = touched.select(F.col("doc_id").alias("document_id"))
        documents = maintenance.without(t("documents"), touched, "doc_id").unionByName(new)
        old = t("chunks")
        chunks = maintenance.without(old, gone, "document_id").unionByName(made)
        same = chunks.join(old.select("chunk_id", F.col("content_hash").alias("_h")), "chunk_id").filter("content_hash = _h").select("chunk_id")
        vectors = t("vectors").join(same, "chunk_id", "left_semi")
        skipped = t("skipped").join(same, "chunk_id", "left_semi")
        fresh = made.join(same, "chunk_id", "left_anti")
        candidates = dictionary.upserted(t("candidates"), dictionary.collected(words(fresh), "content"), source, as_of)
        tables = {"documents": documents, "chunks": chunks, "vectors": vectors, "skipped": skipped, "candidates": candidates}
        if learned is not None:
            tables["synonyms"] = learned
        state = F.xxhash64("content_hash")
        lengths = t("lengths").join(chunks.select("chunk_id", state.alias("state")), ["chunk_id", "state"], "left_semi")
        lengths = checkpointed(lengths.unionByName(fresh.select("chunk_id", state.alias("state"), F.size(index_terms(F.col("content"))).alias("dl"))))
        tables |= {"lengths": lengths, "index_stats": lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))}
        added = fulltext.bucketed(fulltext.inverted(fresh, state=state), made.count())
        if len(self.store.segments("postings")) < MAX_SEGMENTS:
            self.store.commit(tables, {"postings": added})
        else:  # one segment again, without the postings of texts that are gone
            kept = t("postings").drop("bucket").unionByName(added.drop("bucket")).join(lengths.select("chunk_id", "state"), ["chunk_id", "state"], "left_semi")
            self.store.commit(tables | {"postings": fulltext.bucketed(kept, lengths.count())})
        self.derive(touched)

    def derive(self, touched: DataFrame | None = None) -> None:
        """Entities, their links and edges, and document links, from the current documents and chunks: of the documents ``touched`` (doc_id), what others have staying as it is, or of all."""
        t = self.store.table
        if touched is not None and touched.limit(MAX_TOUCHED + 1).count() > MAX_TOUCHED:
            touched = None
        notes, chunks = t("documents").filter(~F.col("file_path").startswith("session:")), t("chunks")
        mine = notes if touched is None else notes.join(F.broadcast(touched), "doc_id", "left_semi")  # at most MAX_TOUCHED ids
        tags = entities.tag_entities(mine)
        named = chunks.join(mine.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
        spoken = entities.custom_entities(named, t("terms")).join(t("terms").groupBy("name").agg(F.min("entity_type").alias("entity_type")), "name")
        tagged = named.select("chunk_id", F.col("document_id").alias("doc_id")).join(tags, "doc_id").select("chunk_id", "name", F.lit("tag").alias("entity_type"))
        ids = F.xxhash64("name", "entity_type").alias("entity_id")
        analyser = self.analyser()
        if any(PROPER in pos for _, pos in analyser.entries):
            said = analysed(named, "chunk_id", "content", analyser).select(F.col("id").alias("chunk_id"), F.explode(F.filter("tokens", lambda x: x["pos"].contains(PROPER))).alias("t"))
            tagged = tagged.unionByName(said.select("chunk_id", F.lower("t.surface").alias("name"), F.lit("proper_noun").alias("entity_type")))
        rows = checkpointed(spoken.select("chunk_id", "name", "entity_type").unionByName(tagged).select("chunk_id", "name", "entity_type", ids).distinct())
        tag_ids = tags.select("doc_id", F.xxhash64("name", F.lit("tag")).alias("entity_id"))
        made = {
            "entities": rows.select("entity_id", "name", "entity_type").distinct(), "chunk_entities": rows.select("chunk_id", "entity_id"),
            "edges": entities.edges(rows.select("chunk_id", "entity_id"), named, tag_ids), "targets": links.link_targets(mine), "tag_classes": links.tag_classes(tags),
        }
        if touched is not None:
            rest = lambda name, key="doc_id": maintenance.without(t(name), touched.withColumnRenamed("doc_id", key), key)
            others = rest("chunks", "document_id").select("chunk_id")
            made = {
                "entities": t("entities").unionByName(made["entities"]).distinct(), "chunk_entities": t("chunk_entities").join(others, "chunk_id", "left_semi").unionByName(made["chunk_entities"]),
                "edges": rest("edges").unionByName(made["edges"]), "targets": rest("targets").unionByName(made["targets"]), "tag_classes": rest("tag_classes").unionByName(made["tag_classes"]),
            }
        self.store.commit(made)
        by_tags = entities.tag_entities(notes)
        if touched is None:
            shared = links.entity_links(t("chunk_entities"), chunks)
        else:
            shared = links.upserted(links.without_documents(t("links").filter("link_type = 'entity'"), touched), links.entity_links_of(touched, t("chunk_entities"), chunks))
        self.store.commit({"links": links.upserted(links.resolved_links(t("targets"), notes), shared), "tag_links": links.tag_links(by_tags)})

    def fill_vectors(self) -> dict[str, int]:
        """Vectors for chunks that lack one; those that can't be encoded go to the skip list."""
        t = self.store.table
        made = maintenance.encoded(maintenance.lacking_vectors(t("chunks"), t("vectors"), t("skipped")), self.encoder)
        before = t("vectors").count(), t("skipped").count()
        self.store.commit({"vectors": t("vectors").unionByName(made.filter("reason is null").drop("reason")), "skipped": t("skipped").unionByName(made.filter("reason is not null").select("chunk_id", "reason"))})
        return {"filled": t("vectors").count() - before[0], "errors": t("skipped").count() - before[1]}

    def reindex(self, kind: str = "all") -> None:
        """Recomputes derived tables: ``texts`` (postings, as after a change of the terms), ``vectors``, ``graph`` or ``all``. The status file, if there is one, tells how many steps are done."""
        if kind not in ("texts", "vectors", "graph", "all"):
            raise ValueError(f"unknown kind: {kind!r}")
        steps = [s for k, s in (("texts", self._index_texts), ("graph", self.derive), ("vectors", self._encode_all)) if kind in (k, "all")]
        began = time.time()
        for n, step in enumerate(steps):
            self._report({"reindex": {"kind": kind, "processed": n, "total": len(steps), "began": began, "now": time.time()}})
            step()
        self._report({})

    def _report(self, status: dict) -> None:
        if self.settings.status:
            files.write_status(self.settings.status, status)

    def _index_texts(self) -> None:
        chunks, state = self.store.table("chunks"), F.xxhash64("content_hash")
        lengths = chunks.select("chunk_id", state.alias("state"), F.size(index_terms(F.col("content"))).alias("dl"))
        stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
        self.store.commit({"postings": fulltext.bucketed(fulltext.inverted(chunks, state=state), chunks.count()), "lengths": lengths, "index_stats": stats})

    def _encode_all(self) -> None:
        self.store.commit({"vectors": self.spark.createDataFrame([], SCHEMAS["vectors"]), "skipped": self.spark.createDataFrame([], SCHEMAS["skipped"])})
        self.fill_vectors()

    def init(self) -> list[str]:
        """Writes the files a person edits that are not there yet: ignore rules, and the dictionary and stopwords that the settings name. Returns which."""
        texts = {os.path.join(self.settings.root, ".tsugumiignore"): "# paths to leave out, in the syntax of .gitignore\n", self.settings.dictionary: "# surface,part of speech,reading\n", self.settings.stopwords: ""}
        return [path for path, text in texts.items() if path and files.install_default(path, text)]

    def analyser(self) -> Analyser:
        """The segmenter with the user's dictionary and stopwords, lists that a person keeps (more than ``MAX_LISTED`` lines are an error)."""
        def held(path: str, read, *columns: str) -> list:
            rows = read(self.spark, path).select(*columns).limit(MAX_LISTED + 1).collect() if path and os.path.exists(path) else []
            if len(rows) > MAX_LISTED:
                raise ValueError(f"{path}: more than {MAX_LISTED} lines")
            return rows

        words = held(self.settings.dictionary, files.dictionary_entries, "surface", "pos")
        stop = held(self.settings.stopwords, files.word_list, "word")
        return Analyser(tuple(sorted((r.surface, r.pos or "") for r in words)), frozenset(r.word for r in stop))

    def rebuild(self, as_of: str) -> dict[str, int]:
        """Drops what was indexed from notes and indexes the tree again; earlier versions stay in the store as a backup."""
        keep = self.store.table("documents").filter(F.col("file_path").startswith("session:"))
        chunks = self.store.table("chunks").join(keep.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
        self.store.commit({"documents": keep, "chunks": chunks})
        return self.index(as_of)

    def set_terms(self, path: str) -> None:
        self.store.commit({"terms": files.custom_terms(self.spark, path)})
        self.derive()

    def sync_synonyms(self, path: str, as_of: str) -> dict[str, int]:
        """Makes the user's pairs those of a CSV file."""
        own = self.store.table("synonyms")
        actions = synonyms.sync_actions(own, synonyms.parsed_pairs(self.spark.read.text(path)))
        kept = own.join(actions.filter("action = 'delete'").select("word_a", "word_b", F.lit("user").alias("source")), ["word_a", "word_b", "source"], "left_anti").select(*synonyms.COLUMNS)
        add = actions.filter("action = 'insert'").select("word_a", "word_b", F.lit(0.7).alias("score"), F.lit("user").alias("source"), F.lit(0).cast("long").alias("hits"), F.lit(None).cast("string").alias("last_hit"), F.lit(as_of).alias("created"))
        counts = {r.action: r["count"] for r in actions.groupBy("action").count().collect()}
        self.store.commit({"synonyms": kept.unionByName(add)})
        return counts

    def import_wordnet(self, words: DataFrame, senses: DataFrame, as_of: str) -> int:
        """Adds pairs of a synset that the relation lacks; returns how many."""
        own = self.store.table("synonyms")
        new = synonyms.synset_pairs(words, senses).join(own, ["word_a", "word_b"], "left_anti").select("word_a", "word_b", F.lit(0.5).alias("score"), F.lit("wordnet").alias("source"), F.lit(0).cast("long").alias("hits"), F.lit(None).cast("string").alias("last_hit"), F.lit(as_of).alias("created"))
        n = own.count()
        self.store.commit({"synonyms": own.unionByName(new)})
        return self.store.table("synonyms").count() - n

    def cleanup_synonyms(self, as_of: str) -> None:
        self.store.commit({"synonyms": synonyms.without_stale(self.store.table("synonyms"), as_of)})

    def reject(self, words: list[str]) -> None:
        rows = self.spark.createDataFrame([(w,) for w in words], "surface string")
        self.store.commit({"candidates": dictionary.moved(self.store.table("candidates"), rows, "rejected", only_pending=True)})

    def update_dictionary(self, path: str) -> int:
        """Appends ready candidates to a dictionary file and marks them accepted; returns how many lines were added."""
        if os.path.exists(path):
            known = files.dictionary_entries(self.spark, path).select("surface")
        else:
            known = self.spark.createDataFrame([], "surface string")
        own = self.store.table("candidates")
        ready = dictionary.ready(own, self.settings.dictionary_threshold)
        lines = [r.line for r in dictionary.export_lines(own, known, self.settings.dictionary_threshold).orderBy("surface").toLocalIterator()]
        with open(path, "a", encoding="utf-8") as f:
            f.writelines(line + "\n" for line in lines)
        self.store.commit({"candidates": dictionary.moved(own, ready, "accepted")})
        return len(lines)

    def reload(self, settings: Settings) -> list[str]:
        """Takes up settings that need no restart; returns warnings about those that do."""
        warnings = C.reload_warnings(self.settings, settings)
        self.settings = replace(settings, **{name: getattr(self.settings, name) for name in C.STRUCTURAL})
        return warnings

    # -- reading

    def full_text(self) -> fulltext.Index | None:
        """The stored postings; none before anything is indexed."""
        t = self.store.table
        return fulltext.Index(t("postings"), t("index_stats"), t("lengths")) if self.store.segments("postings") else None

    def corpus(self) -> S.Corpus:
        t = self.store.table
        return S.Corpus(t("documents"), t("chunks"), t("vectors"), t("entities"), t("chunk_entities"), t("edges"), t("synonyms"), t("links"), t("tag_links"), t("tag_classes"), self.full_text())

    def search(self, query: str, as_of: str, top_k: int | None = None, paths: list[str] = (), record: bool = False, **flags) -> DataFrame:
        """Ranked results; see ``tsugumi.plans.search``. Paths must be relative and not empty. With ``record`` the words of the query are collected as candidates for the dictionary."""
        if any(not p.strip() or p.startswith("/") for p in paths):
            raise ValueError("paths must be relative and not empty")
        request = S.Request(query, as_of, top_k or self.settings.top_k, encode=lambda text: self.encoder([text])[0], require_vector=self.settings.fallback == "error", paths=list(paths), weights=self.settings.weights, half_lives=self.settings.half_lives, analyser=self.analyser(), **flags)
        if record:
            seen = dictionary.collected(self.spark.createDataFrame([(query,)], "content string"), "content")
            self.store.commit({"candidates": dictionary.upserted(self.store.table("candidates"), seen, "query", as_of)})
        return S.results(self.corpus(), request)

    def status(self) -> dict[str, int]:
        t = self.store.table
        return {"version": self.store.pointer()["version"]} | {n: t(n).count() for n in ("documents", "chunks", "vectors", "skipped", "entities", "edges", "links", "synonyms")} | {"dictionary_ready": dictionary.ready(t("candidates"), self.settings.dictionary_threshold).count()}

    def doctor(self) -> DataFrame:
        """The report of ``maintenance.health``, with a line on a reindex under way: value is the seconds it will still take, if known. ``maintenance.issues`` counts what is not ok."""
        t = self.store.table
        report = maintenance.health(t("documents"), t("chunks"), t("vectors"), t("candidates"))
        try:
            with open(self.settings.status, encoding="utf-8") as f:
                going = json.load(f).get("reindex")
        except (OSError, ValueError):
            going = None
        if going:
            left = maintenance.seconds_left(going["processed"], going["total"], going["now"] - going["began"])
            line = [("Reindex", "warning", f"reindex of {going['kind']}: {going['processed']} of {going['total']} steps", None if left is None else int(left), None)]
            report = report.unionByName(self.spark.createDataFrame(line, "section string, status string, message string, value long, hint string"))
        return report


def as_text(results: DataFrame) -> str:
    """Results for people."""
    rows = results.orderBy("rank").collect()  # at most top_k
    if not rows:
        return "No results found."
    out = [f"Showing {len(rows)} of {rows[0].total_hits} results", ""]
    for r in rows:
        out += [f"{r['rank']}. [{r.source_type}] {r.file_path} — {r.section_path} (score: {r.score:.4f})", f"   {r.snippet}"]
        out += [f"   status: {r.status}"] if r.status else []
        related = getattr(r, "related_docs", None) or []
        out += ["   related:"] * bool(related) + [f"     - [{d.link_type}] {d.file_path} (strength: {d.strength:.2f})" for d in related] + [""]
    return "\n".join(out)


def as_json(results: DataFrame, documents: DataFrame | None = None, with_content: int = 0) -> str:
    """``{total_hits, results}``; the first ``with_content`` results carry the whole text of their document."""
    rows = [r.asDict(recursive=True) for r in results.orderBy("rank").collect()]  # at most top_k
    ids = [r["doc_id"] for r in rows[:with_content]]
    texts = {r.doc_id: r.text for r in documents.filter(F.col("doc_id").isin(ids)).select("doc_id", "text").collect()} if documents is not None and ids else {}
    total = rows[0]["total_hits"] if rows else 0
    keep = ("file_path", "source_type", "section_path", "snippet", "score", "status", "related_docs")
    out = [{("source_file" if k == "file_path" else k): r.get(k) for k in keep if k != "status" or r.get(k)} | ({"content": texts.get(r["doc_id"])} if i < with_content else {}) for i, r in enumerate(rows)]
    return json.dumps({"total_hits": total, "results": [x | {"related_docs": x.get("related_docs") or []} for x in out]}, ensure_ascii=False)
