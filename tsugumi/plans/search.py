"""One search request: three rankers, fusion, scoring, related documents."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsugumi import params as P
from tsugumi.functions.analyser import Analyser
from tsugumi.operators import entities as E
from tsugumi.operators import fulltext as FT
from tsugumi.operators import links as L
from tsugumi.operators import retrieval as R
from tsugumi.operators import synonyms as S
from tsugumi.plans import understanding as U

RESULT = "chunk_id long, doc_id long, file_path string, source_type string, section_path string, snippet string, status string, score double"


@dataclass
class Corpus:
    """The tables of an index. Optional ones switch their ranker or expansion off."""

    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None = None  # chunk_id, embedding
    entities: DataFrame | None = None
    chunk_entities: DataFrame | None = None
    edges: DataFrame | None = None
    synonyms: DataFrame | None = None
    links: DataFrame | Callable[[list[int]], DataFrame] | None = None  # all, or those with one of these doc_id at an end
    tag_links: DataFrame | None = None  # between classes
    tag_classes: DataFrame | None = None
    index: FT.Index | None = None  # without it texts are scanned


@dataclass
class Request:
    query: str
    as_of: str
    top_k: int = 5
    vector: list[float] | None = None
    encode: Callable[[str], list[float]] | None = None  # of the words that are searched for, if ``vector`` is not given
    require_vector: bool = False
    after: str | None = None
    before: str | None = None
    recent: str | None = None
    year: int | None = None
    paths: list[str] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)
    half_lives: dict[str, float] = field(default_factory=dict)
    analyser: Analyser = field(default_factory=Analyser)  # with the user's dictionary and stopwords


def matching_entities(corpus: Corpus, query: str) -> list[int]:
    """Ids of the entities that the whole query or one of its words names."""
    if corpus.entities is None:
        return []
    names = [n for n in dict.fromkeys([query.strip().lower(), *(w.lower() for w in U.words(query)), *U.words(query)]) if len(n) >= 2]
    if not names:
        return []
    rows = E.entity_by_name(corpus.entities.filter(F.col("name").isin(names))).collect()  # at most one row per name of the query
    return [i for _, i in sorted((names.index(r.name), r.entity_id) for r in rows)]


def search(corpus: Corpus, request: Request) -> DataFrame:
    """Scored chunks above the threshold, all of them, unordered; see ``results`` for the answer to the request.

    Each ranker is limited to three times ``top_k`` before time and path filters apply, so a strict filter
    may leave fewer results than exist. A query without keywords has no result.
    """
    spark = corpus.chunks.sparkSession
    today = date.fromisoformat(request.as_of[:10])
    rest, own = U.temporal(request.query, today)
    span = U.merged(today, request.after, request.before, request.recent, request.year, own) or U.TimeFilter()
    tokens = U.query_keywords(rest, request.analyser)
    if not tokens:
        return spark.createDataFrame([], RESULT)
    text, limit = " ".join(tokens), P.CANDIDATES_PER_RESULT * request.top_k
    ids = matching_entities(corpus, text)
    text_weight, vector_weight = P.RANKER_WEIGHTS[U.query_class(text, ids)]
    more: list[str] = []
    if ids and corpus.edges is not None:
        more += [r.name for r in E.expansion(corpus.edges, corpus.entities, ids).orderBy(F.desc("strength"), "name").collect()]
    if corpus.synonyms is not None:
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "position int, word string")
        more += [r.synonym for r in S.expand(corpus.synonyms, rows, request.as_of).orderBy("position", "synonym").collect()]
    rankers = []
    if text_weight:
        groups = U.text_groups(tokens, list(dict.fromkeys(more)))
        found = R.top(R.bm25(corpus.chunks, groups) if corpus.index is None else FT.bm25(corpus.index, groups), limit)
        rankers.append((R.ranks(found, "score"), text_weight))
    vector = request.vector
    if vector is None and request.encode is not None and corpus.vectors is not None:
        try:
            vector = request.encode(text) or None
        except Exception:
            if request.require_vector:
                raise
            logging.getLogger(__name__).warning("the query has no vector", exc_info=True)
    if vector is not None and corpus.vectors is not None:
        near = R.nearest(corpus.vectors, vector, limit, "chunk_id")
        rankers.append((R.ranks(near, "distance", descending=False), vector_weight))
    elif request.require_vector and corpus.vectors is not None:
        raise RuntimeError("vectors are required but the query has none")
    if ids and corpus.chunk_entities is not None and corpus.edges is not None:
        rankers.append((E.entity_ranks(corpus.chunk_entities, corpus.edges, ids, limit), P.ENTITY_WEIGHT))
    if not rankers:
        return spark.createDataFrame([], RESULT)
    return R.final_scores(R.fuse(rankers), corpus.chunks, corpus.documents, request.as_of, span.after, span.before, request.paths, request.weights, request.half_lives)


def results(corpus: Corpus, request: Request) -> DataFrame:
    """The ``top_k`` best results in order (rank from 1), with total_hits and, on the first, the related documents."""
    scored = search(corpus, request)
    total = scored.agg(F.count(F.lit(1)).alias("total_hits"))
    ordered = R.top(scored, request.top_k)
    ranked = R.ranks(ordered, "score", first=1).join(ordered, "chunk_id").crossJoin(F.broadcast(total))
    if corpus.links is None:
        return ranked
    own = ordered.select("doc_id").distinct()
    ids = [r.doc_id for r in own.collect()]  # at most top_k
    ends = corpus.links(ids) if callable(corpus.links) else corpus.links
    near = L.related(ends, corpus.documents, ids, tag_links=corpus.tag_links, classes=corpus.tag_classes).agg(F.sort_array(F.collect_list(F.struct(F.negative("strength").alias("o"), "file_path", "link_type", "strength"))).alias("r"))
    near = near.select(F.transform("r", lambda x: F.struct(x["file_path"].alias("file_path"), x["link_type"].alias("link_type"), x["strength"].alias("strength"))).alias("related_docs"))
    return ranked.crossJoin(F.broadcast(near)).withColumn("related_docs", F.when(F.col("rank") == 1, F.col("related_docs")))
