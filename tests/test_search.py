"""Parsing, retrieval, the entity graph, links, synonyms, dictionary, upkeep, files and the stream on small fixtures."""

import math
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tsugumi import search_queries
from tsugumi.functions.analyser import Analyser, analysed
from tsugumi.operators import chunking, dictionary, entities, fulltext, links, maintenance, retrieval, sessions, synonyms
from tsugumi.plans import search as S
from tsugumi.plans import understanding as U
from tsugumi.sources import files
from tsugumi.streaming import watch


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- query understanding


@pytest.mark.parametrize("query,today,rest,after,before", [
    ("先月の会議", "2026-03-24", "の会議", "2026-02-01", "2026-03-01"), ("最近の記録", "2026-03-24", "の記録", "2026-02-22", None), ("半年前", "2026-03-24", "", "2025-09-25", None),
    ("年末の予定", "2026-01-15", "の予定", "2025-11-01", "2026-01-01"), ("3月の記録", "2026-01-15", "記録", "2025-03-01", "2025-04-01"), ("去年", "2026-03-24", "", "2025-01-01", "2026-01-01"),
    ("一昨年の話", "2026-03-24", "の話", "2024-01-01", "2025-01-01"), ("2週間前 rust", "2026-03-24", "rust", "2026-03-10", None), ("先週", "2026-03-24", "", "2026-03-17", None),
    ("13月", "2026-03-24", "13月", None, None), ("rust", "2026-03-24", "rust", None, None), ("今月", "2026-12-24", "", "2026-12-01", None), ("今年の 少し前", "2026-03-24", "今年の", "2026-02-22", None), ("少し前と3日前", "2026-03-24", "と3日前", "2026-02-22", None), ("今年", "2026-12-24", "", "2026-01-01", None), ("3日前と半年前", "2026-03-24", "と半年前", "2026-03-21", None), ("99999999年前", "2026-03-24", "", "0001-01-01", None), ("年始", "2026-02-01", "", "2025-01-01", "2025-03-01"),
])
def test_temporal(query, today, rest, after, before):
    text, span = U.temporal(query, date.fromisoformat(today))
    assert (text, span and span.after, span and span.before) == (rest, after, before)


def test_flags():
    day = date(2026, 3, 24)
    assert U.duration("30d") == 30 and U.duration("2w") == 14 and U.duration("3m") == 90 and U.duration("45") == 45 and U.duration("5") is None and U.duration("x") is None
    assert U.day("2025") == "2025-01-01" and U.day("2025-03") == "2025-03-01"
    own = U.TimeFilter("2020-01-01")
    assert U.merged(day, query=own) == own
    assert U.merged(day, year=2024, recent="7d", query=own) == U.TimeFilter("2026-03-17", "2025-01-01")
    assert U.merged(day, year=2024, after="2024-05") == U.TimeFilter("2024-05-01", "2025-01-01")
    for bad in ({"recent": "soon"}, {"after": "2025-13"}, {"before": "nope"}):
        with pytest.raises(ValueError):
            U.merged(day, **bad)


def test_classes_and_keywords():
    assert U.query_class("", []) == "Default" and U.query_class("x", [1]) == "EntityFocused" and U.query_class("rust 検索", []) == "Keyword"
    assert U.query_class("どうやって 索引 を 作る", []) == "Question" and U.query_class("a b c d e f g h i j k l", []) == "Fuzzy" and U.query_class("a b c", []) == "Default" and U.query_class("!!", []) == "Default"
    assert U.query_keywords("rust の 検索 2024 ー rust", Analyser(stopwords=frozenset(["検索"]))) == ["rust"]
    assert U.text_groups(["Lora-Wan"], ["", "a b"]) == [[["lora", "wan"]], [["a"], ["b"]]]


# ---- retrieval


def test_analyser(spark):
    plain, own = Analyser(), Analyser((("打ち合わせ", ""), ("港町", "固有名詞"), ("art", "名詞"), ("港", ""), ("v2.5 beta", "固有名詞,製品")))
    text = "打ち合わせは港町 party art v2.5 beta é港"
    for analyser in (plain, own):
        for t in analyser.tokens(text):
            assert text.encode()[t.byte_start : t.byte_end].decode() == t.surface
    assert [t.surface for t in plain.tokens(text)] == U.words(text)
    assert [t.surface for t in own.tokens(text)] == ["打ち合わせ", "は", "港町", "party", "art", "v2.5 beta", "é", "港"]
    assert own.proper_nouns(text) == ["港町", "v2.5 beta"] and own.keywords("港町の打ち合わせ 港町") == ["港町", "打ち合わせ"] and plain.tokens(None) == []
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z")], "doc_id long, title string, tokens string")
    got = {r.id: [tuple(t) for t in r.tokens] for r in analysed(df, "doc_id", "title", own).collect()}
    assert got == {1: [(t.surface, t.byte_start, t.byte_end, t.pos) for t in own.tokens(text)], 2: [], 3: []}


def chunks(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")


def bm25_by_hand(texts, groups):
    docs = [[] if t is None else U.index_phrase(t) for t in texts]
    avg, n = sum(map(len, docs)) / len(docs), len(docs)
    tf = lambda d, p: sum(d[i : i + len(p)] == p for i in range(len(d) - len(p) + 1))
    out = {}
    for k, d in enumerate(docs):
        score = 0
        for g in groups:
            if all(tf(d, p) for p in g):
                for p in g:
                    df = sum(bool(tf(x, p)) for x in docs)
                    idf = math.log((n - df + 0.5) / (df + 0.5))
                    score += (idf if idf > 0 else 1e-6) * tf(d, p) * 2.2 / (tf(d, p) + 1.2 * (0.25 + 0.75 * len(d) / avg))
        if score:
            out[k] = score
    return out


def test_bm25(spark):
    texts = ["Café loom loom", "a a a a", "loom kiln", "kiln relay", "relay", None, "", "x y z x y z x", "古い索引の記録"]
    for groups in ([[["loom"]]], [[["loom"], ["kiln"]]], [[["loom"], ["kiln"]], [["relay"]]], [[["a", "a"]]], [[["x", "y", "z"]]], [[["cafe"]]], [[["索引"]]], [[["loom"]], [["loom"], ["kiln"]]]):
        got = {r.chunk_id: r.score for r in retrieval.bm25(chunks(spark, texts), groups).collect()}
        want = bm25_by_hand(texts, groups)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want), groups
    assert retrieval.bm25(chunks(spark, texts), [[[]]]).count() == 0 and retrieval.bm25(chunks(spark, texts), []).count() == 0
    assert retrieval.bm25(chunks(spark, texts), [[[]], [["relay"]]]).count() == 2


def test_stored_index_equals_the_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "TEXTS_PER_SLICE", 2)
    texts = ["the loom and the kiln", "loom loom loom", None, "", "a kiln is a kiln is a kiln", "the the the", "クレープ 焼く the kiln"]
    df = chunks(spark, texts).withColumn("tf", F.lit(1))
    index = fulltext.build(df, str(tmp_path / "index"))
    for groups in ([[["loom"]]], [[["the"], ["kiln"]]], [[["kiln", "is", "a", "kiln"]]], [[["the", "the"]]], [[["loom"], ["kiln"]], [["the"]]], [[["none"]]], [[[]]], []):
        want = {r.chunk_id: pytest.approx(r.score) for r in retrieval.bm25(df, groups).collect()}
        assert {r.chunk_id: r.score for r in fulltext.bm25(index, groups).collect()} == want
    plan = fulltext.bm25(index, [[["loom"]]])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters" in plan and "positions" not in plan.split("ReadSchema")[1].split("\n")[0]
    each = {(r.query_id, r.chunk_id): r.score for r in fulltext.bm25_each(index, {1: ["the", "kiln"], 2: ["loom"], 3: ["none"], 4: [], 5: ["loom", "none"]}, 5).collect()}
    want = {(q, r.chunk_id): pytest.approx(r.score) for q, g in ((1, [[["the"], ["kiln"]]]), (2, [[["loom"]]])) for r in retrieval.bm25(df, g).collect()}
    assert each == want
    empty = fulltext.build(df.limit(0), str(tmp_path / "empty"))
    assert fulltext.bm25(empty, [[["loom"]]]).count() == 0


def test_fusion_and_scores(spark):
    a, b = chunks(spark, "xyz").select("chunk_id", F.col("chunk_id").cast("int").alias("rank")), spark.createDataFrame([(2, 0), (7, 1)], "chunk_id long, rank int")
    got = {r.chunk_id: r.rrf for r in retrieval.fuse([(a, 1.5), (b, 0.5), (b, 0.0)]).collect()}
    assert got[2] == pytest.approx(1.5 / 62 + 0.5 / 60) and got[7] == pytest.approx(0.5 / 61) and len(got) == 4
    data = [("2025-06-01", "note"), ("2025-07-20", "note"), ("junk", "note"), (None, "note"), ("", "x"), ("2025-06-01T12:00:00Z", "session"), ("2025-06-01T00:00:00+09:00", "x")]
    df = spark.createDataFrame(data, "u string, k string")
    decay = [r[0] for r in df.select(retrieval.time_decay(F.col("u"), retrieval.half_life(F.lit("a/b"), F.col("k")), "2025-07-01")).collect()]
    assert decay == pytest.approx([0.5 ** (30 / 120), 1, 0.5, 0.5, 0.5, 0.5 ** (29 / 30), 0.5 ** (30 / 90)])
    w = spark.range(1).select(*[retrieval.directory_weight(F.lit(p), F.lit("note"), {"a": 2.0, "a/b": 3.0}) for p in ("a/x", "a/b/x", "ab/x", "session:x")]).first()
    assert tuple(w) == (2.0, 3.0, 1.0, 0.3)


def test_only_limited_results_are_ranked_in_one_task(spark):
    many = spark.range(30_000).select(F.col("id").alias("chunk_id"), F.rand(1).alias("score"))
    with pytest.raises(ValueError, match="limited"):
        retrieval.ranks(many, "score")
    assert retrieval.ranks(retrieval.top(many, 5), "score").count() == 5


def test_filters(spark):
    df = spark.createDataFrame([("2026-03-30T08:00:00Z", None, "Daily/Notes/É.md"), (None, None, "x"), ("2026-03-30", "2026-01-01", "daily")], "c string, u string, p string")
    keep = lambda c: [r[0] for r in df.select(c).collect()]
    assert keep(retrieval.in_time(F.col("c"), F.col("u"), None, "2026-03-30")) == [False, True, True] and keep(retrieval.in_time(F.col("c"), F.col("u"), "2026-03-01")) == [True, True, False]
    assert keep(retrieval.in_paths(F.col("p"), ["daily/notes/É"])) == [True, False, False] and keep(retrieval.in_paths(F.col("p"), ["daily/notes/é"])) == [False] * 3 and keep(retrieval.in_paths(F.col("p"), [])) == [True] * 3


def test_nearest_each_equals_nearest(spark):
    import random

    rng = random.Random(4)
    data = [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(60)] + [(99, None)]  # many ties
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = retrieval.nearest_each(df, df.filter("vec_id % 20 = 0"), 5, block=7, query_block=2).collect()
    for q in (0, 20, 40):
        one = [r.vec_id for r in retrieval.nearest(df, data[q][1], 5).collect()]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == one
    assert retrieval.nearest_each(df.limit(0), df.limit(0), 5).count() == 0


def test_nearest_each_passes_over_other_dimensions(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0]), (4, None), (5, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    got = retrieval.nearest_each(df, df, 5)
    assert sorted((r.query_id, r.vec_id) for r in got.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (5, 5)]


def test_nearest_each_with_many_copies_in_a_block(spark):
    import random

    rng = random.Random(7)
    copy, other = [[rng.random() for _ in range(16)] for _ in range(2)]
    rows = [(i, copy if i % 3 == 0 else [rng.random() + (5 if i % 2 else 0) for _ in range(16)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, copy), (2, other), (3, [c + 1e-3 for c in copy])], df.schema)
    got = retrieval.nearest_each(df, queries, 5).collect()
    for q in queries.collect():
        one = [r.vec_id for r in retrieval.nearest(df, q.embedding, 5).collect()]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q.vec_id), key=lambda r: r["rank"])] == one
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 1), key=lambda r: r["rank"])] == [0, 3, 6, 9, 12]


def test_whole_search(spark):
    docs = spark.createDataFrame([(1, "a/x.md", "note", "current", None, "2025-06-30"), (2, "a/y.md", "note", "outdated", None, "2025-06-30"), (3, "b/z.md", "session", None, None, None)], "doc_id long, file_path string, source_type string, status string, created string, updated string")
    parts = spark.createDataFrame([(1, 1, "s", "head\nold loom here"), (2, 2, "s", "old loom there and loom"), (3, 3, "s", "loom"), (4, 1, "s", "nothing")], "chunk_id long, document_id long, section_path string, content string")
    link = spark.createDataFrame([(1, 3, "tag", 0.7), (1, 2, "tag", 0.9)], links.LINKS.replace("doc_a", "doc_a"))
    ents = spark.createDataFrame([(1, "loom", "tag"), (2, "kiln", "tag"), (5, "loom", "custom")], "entity_id long, name string, entity_type string")
    ce = spark.createDataFrame([(1, 5), (1, 2), (4, 2), (1, 5)], "chunk_id long, entity_id long")
    corpus = S.Corpus(docs, parts, None, ents, ce, entities.edges(ce, parts), None, link)
    out = S.results(corpus, S.Request("loom", "2025-07-01", 2)).orderBy("rank").collect()
    assert out[0].chunk_id == 1 and out[0].snippet == "old loom here" and out[0].total_hits >= 2
    assert {r.file_path for r in out[0].related_docs} == {"b/z.md", "a/y.md"} - {r.file_path for r in out} and all(r.related_docs is None for r in out[1:])
    assert S.results(corpus, S.Request("!!", "2025-07-01")).count() == 0
    assert S.results(corpus, S.Request("loom", "2025-07-01", 2, paths=["B/"])).filter("file_path not like 'b/%'").count() == 0
    with pytest.raises(RuntimeError):
        S.search(S.Corpus(docs, parts, parts), S.Request("loom", "2025-07-01", require_vector=True))


# ---- notes and sessions


def test_front_matter():
    got, body = chunking.front_matter("---\nstatus: current\ncreated: 2025-01-02\ntags: [a, 3, null]\nupdated: ~\n---\nbody")
    assert (got["status"], got["created"], got["updated"], got["tags"], body) == ("current", "2025-01-02", None, ["a", "3"], "body")
    assert chunking.front_matter("---\n- a\n---\nx") == (dict(status=None, created=None, updated=None, tags=[], superseded_by=None), "x")
    assert chunking.front_matter("---\na: [\n---\nx")[1] == "x" and chunking.front_matter("---\n---\nx")[1] == "---\n---\nx" and chunking.front_matter("---\ntags: one\n---\nx")[0]["tags"] == []


def test_note_chunks():
    assert chunking.chunk_note("  \n", "d", "f") == []
    assert chunking.chunk_note("text", "d", "f") == [("f", "【d/f】f\ntext")]
    got = chunking.chunk_note("# T\n\nintro\n\n## A\nalpha\n\n## B\nbeta", "d", "f")
    assert [p for p, _ in got] == ["T", "T > A", "T > B"] and got[0][1] == "【d/f】T\n# T\n\nintro"
    deep = chunking.chunk_note("## A\n### x\n" + "p " * 20 + "\n### y\n" + "q " * 20, "d", "f", 50)
    assert [p for p, _ in deep] == ["f > A > x", "f > A > y"]
    paras = chunking.chunk_note("\n\n".join("あ" * 250 for _ in range(3)), "d", "f", 800)
    assert len(paras) == 3 and all("あ" * 250 in c for _, c in paras)


def test_greedy_merge(spark):
    import re

    texts = ["a\n\nb\n\n" + "c" * 20 + "\n\nd", "", "x" * 50 + "\n \n" + "y", None, "é" * 4 + "\n\n" + "é" * 4, " \n\n\n a"]
    got = {r.i: r.g for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.greedy(chunking.paragraphs(F.col("t")), 20).alias("g")).collect()}
    for i, t in enumerate(texts):
        out = []
        for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n", t or ""))):
            if out and len((out[-1] + p).encode()) + 2 <= 20:
                out[-1] += "\n\n" + p
            else:
                out.append(p)
        assert (got[i] or []) == out


def test_sessions(spark):
    lines = [(1, '{"message":{"role":"user","content":"a question here"},"timestamp":"t1"}'), (2, "not json"), (3, '{"message":{"role":"assistant","content":[{"type":"text","text":"the answer"},{"type":"x"},"bare"]}}'), (4, ""), (5, '{"message":{"role":"user","content":"short"}}')]
    lines += [(6, '{"message":{"role":"user","content":"' + "q" * 900 + '"}}'), (7, '{"message":{"role":"assistant","content":"' + "a" * 900 + '"},"timestamp":"t9"}'), (8, '{"message":{"role":"assistant","content":"an orphan answer"}}')]
    df = spark.createDataFrame([("s", *x) for x in lines], "session string, line_no int, value string")
    parsed = sessions.message_text(sessions.parsed_lines(df)).withColumn("ord", F.col("line_no")).withColumn("id", F.col("line_no"))
    got = [(r.chunk_index, r.content[:30], len(r.content)) for r in sessions.qa_chunks(parsed).orderBy("chunk_index").collect()]
    assert got[0] == (0, "Q: a question here\nA: the answ", len("Q: a question here\nA: the answer\nbare")) and got[1][2] == got[2][2] == 806 and got[3] == (3, "an orphan answer", 16)
    doc = sessions.session_documents(sessions.qa_chunks(parsed)).first()
    assert (doc.file_path, doc.created, doc.updated, doc.chunks) == ("session:s", "t1", "t1", 4)


# ---- graph, links, words


def test_custom_terms(spark):
    texts = ["Using LoRa-WAN and a.b.c now", "xlorax", "古い索引器", "loraに", None, "rumonabe.io."]
    terms = spark.createDataFrame([("lora",), ("索引",), ("b.c",), ("x",), (None,), ("rumonabe.io",), ("LORA",)], "name string")
    assert rows(entities.custom_entities(chunks(spark, texts), terms)) == [(0, "b.c"), (0, "lora"), (2, "索引"), (5, "rumonabe.io")]
    assert entities.custom_entities(chunks(spark, texts), terms.limit(0)).count() == 0


def test_custom_entities_of_any_form(spark):
    names = ["raspberry pi", "ci/cd", "o'brien", "r&d", "c++", "c#", "ai索引", "web会議", "a--b", ".net", "foo bar", "データ ベース", "x-y", "索引"]
    texts = [
        "My Raspberry Pi, raspberry pie and CI/CD.", "raspberry  pi; xci/cd ci/cdx O'Brien's R&D", "C++ is c++.", "c++x xc++", "use C# now", "新しいAI索引を", "週次web会議。ai会議", "a--b a--bc",
        "a .NET b", "asp.net", "foo\nbar", "foo bar_", "(foo bar)", "大データ ベースの", "x-y", "",
    ]
    terms = spark.createDataFrame([(n,) for n in names], "name string")
    word = r"[^\W]"
    want = []
    for i, t in enumerate(texts):
        for n in names:
            at = re.escape(n.lower())
            if n.lower() in t.lower() if re.search("[\u3000-\u9fff]", n) else re.search(f"(?<!{word}){at}(?!{word})", t.lower()):
                want.append((i, n))
    for most in (0, None):  # by windows, and by the automaton
        got = rows(entities.custom_entities(chunks(spark, texts), terms, most=most))
        assert got == sorted(want, key=str) and {n for _, n in got} == set(names)
    assert entities.custom_entities(chunks(spark, texts), terms.limit(0)).count() == 0


def test_pairs_of_wide_baskets(spark):
    from itertools import combinations

    from tsugumi.plans import pairs

    held = {1: range(40), 2: range(5), 3: range(30, 60), 4: [7]}
    df = spark.createDataFrame([(b, i) for b, x in held.items() for i in x] + [(1, 3), (None, 1), (2, None)], "basket long, item long")
    narrow, wide = pairs.gathered(df, 20)
    got = [tuple(r) for r in pairs.narrow_pairs(narrow, "basket").unionByName(pairs.wide_pairs(wide, 7)).collect()]
    assert sorted(got) == sorted((b, x, y) for b, s in held.items() for x, y in combinations(s, 2))


def test_edges_and_neighbours(spark):
    parts = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "chunk_id long, document_id long")
    ce = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (3, 2), (3, 3), (3, None)], "chunk_id long, entity_id long")
    edge = entities.edges(ce, parts, spark.createDataFrame([(10, 7), (10, 8)], "doc_id long, entity_id long"))
    assert rows(edge) == [(1, 2, 10, 2), (2, 3, 11, 1), (7, 8, 10, 1)]
    tagged = ce.unionByName(spark.createDataFrame([(c, t) for c in (1, 2) for t in (7, 8)], "chunk_id long, entity_id long"))
    each = entities.edges(tagged, parts, spark.createDataFrame([(10, 7), (10, 8)], "doc_id long, entity_id long"))
    assert rows(each) == [(1, 2, 10, 2), (1, 7, 10, 2), (1, 8, 10, 2), (2, 3, 11, 1), (2, 7, 10, 2), (2, 8, 10, 2), (7, 8, 10, 1)]
    assert rows(entities.neighbours(edge, [2])) == [(1, 2), (3, 1)]
    assert [tuple(r) for r in entities.entity_ranks(ce, edge, [3], 9).orderBy("rank").collect()] == [(3, 0), (1, 1), (2, 2)]


def test_links(spark):
    docs = spark.createDataFrame([(1, "a/x.md", "see [y](y.md) and [w](https://y.md)"), (2, "b/y.md", "[self](y.md) [up](../x.md)"), (3, "c/y.md", None), (4, "d/z.md", "[Y](B/Y.md)"), (5, "e/long.md", "[n](ong.md) [s](z.md)"), (6, "e/f/long.md", "")], "doc_id long, file_path string, text string")
    assert rows(links.explicit_links(docs)) == [(1, 2, "explicit", 1.0), (2, 4, "explicit", 1.0), (4, 5, "explicit", 1.0)]
    tags = spark.createDataFrame([(1, "rust"), (1, "db"), (2, "rust"), (3, "go"), (4, "rust"), (4, "db")], "doc_id long, name string")
    assert rows(links.tag_links(tags)) == [("db\nrust", "db\nrust", 2, 0.7, 2, 2), ("db\nrust", "rust", 1, pytest.approx(0.35), 2, 1)]
    parts = spark.createDataFrame([(i, i) for i in range(4)], "chunk_id long, document_id long")
    ce = spark.createDataFrame([(i, e) for i in range(4) for e in (0, 1)] + [(0, 2), (1, 2), (3, None)], "chunk_id long, entity_id long")
    got = {(r.doc_a, r.doc_b): r.strength for r in links.entity_links(ce, parts).collect()}
    assert len(got) == 6 and got[0, 1] == pytest.approx(math.log(3) / 10) and got[2, 3] == pytest.approx(math.log(2) / 10)
    assert len(links.entity_links(ce, parts, 1).collect()) == 3
    up = links.upserted(spark.createDataFrame([(1, 2, "tag", 0.5)], links.LINKS), spark.createDataFrame([(1, 2, "tag", 0.7)], links.LINKS))
    assert rows(up) == [(1, 2, "tag", 0.7)] and links.without_documents(up, spark.createDataFrame([(2,)], "doc_id long")).count() == 0


def test_entity_links_with_hot_entities_and_copies(spark, monkeypatch):
    """Against brute force, with blocks and slabs of a few sets, one entity in all documents and many copies of one document."""
    import random

    monkeypatch.setattr(links, "BLOCK_SETS", 7)
    monkeypatch.setattr(links, "SLAB", 2)
    rng = random.Random(3)
    sets = {d: {0, *(min(rng.randrange(1, 30), rng.randrange(1, 30)) for _ in range(rng.randrange(6)))} for d in range(120)} | {d: {0, 5, 7} for d in range(200, 260)} | {300: set(), 301: {0}}
    rows = [(d, e) for d, s in sets.items() for e in s] * 2 + [(301, None)]
    chunk_entities = spark.createDataFrame([(*r, "x") for r in rows], "chunk_id long, entity_id long, items string")
    owned = spark.createDataFrame([(d, d) for d in sets], "chunk_id long, document_id long")
    kept = set()
    for d, s in sets.items():
        near = sorted((-len(s & o), x) for x, o in sets.items() if x != d and len(s & o) >= 2)
        kept |= {(min(d, x), max(d, x), round(min(math.log(-n) / 10, 0.6), 6)) for n, x in near[:3]}
    got = links.entity_links(chunk_entities, owned, 3)
    assert {(r.doc_a, r.doc_b, round(r.strength, 6)) for r in got.collect()} == {k for k in kept if k[2] > 0.05} and got.count() == len({k for k in kept if k[2] > 0.05})
    pairs = links.overlaps(spark.createDataFrame([(d, list(s)) for d, s in sets.items()], "id long, items array<long>"), 2)
    assert {(r.own, r.other, r.shared) for r in pairs.collect()} == {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2}
    assert links.entity_links(chunk_entities.limit(0), owned).count() == 0


def test_nearest_sets_are_exactly_the_best(spark, monkeypatch):
    """Against brute force, with many blocks, few frequent items, ties, copies and sets of over 255 items; no more than the best leave it."""
    import random

    monkeypatch.setattr(links, "HELD_SETS", 16)
    monkeypatch.setattr(links, "OWN_SETS", 9)
    monkeypatch.setattr(links, "HOT_ITEMS", 2)
    rng = random.Random(5)
    sets = {d * 3 - 90: {0, *(min(rng.randrange(1, 40), rng.randrange(1, 40)) for _ in range(rng.randrange(7)))} for d in range(110)} | {d: {0, 5, 7} for d in range(400, 430)} | {d: set(range(1000, 1300 + d)) for d in (500, 501)} | {600: {0}, 601: {-1, -2, 9999}}
    df = spark.createDataFrame([(d, sorted(s)) for d, s in sets.items()], "id long, items array<long>")
    wanted = {d: [(x, -n) for n, x in sorted((-len(s & o), x) for x, o in sets.items() if x != d and len(s & o) >= 2)[:4]] for d, s in sets.items()}
    for own in (df, df.filter("id % 2 = 0"), df.filter("id = 500"), df.filter("id = 7000")):
        got = {}
        for r in links.nearest(df, own, 2, 4).collect():
            got.setdefault(r.own, []).append((r.other, r.shared))
        assert {d: sorted(l, key=lambda x: (-x[1], x[0])) for d, l in got.items()} == {r.id: wanted[r.id] for r in own.collect() if wanted[r.id]}
    assert wanted[500] == [(501, 800)]


def test_entity_links_of_some_compares_only_theirs(spark, monkeypatch):
    """The links that a few documents keep, as those of all have them; sets of others are never own."""
    asked = []
    nearest = links.nearest
    monkeypatch.setattr(links, "nearest", lambda sets, own, *a: (asked.append({r.id for r in own.collect()}), nearest(sets, own, *a))[1])
    sets = {d: {0, d % 3, 3 + d % 5} for d in range(40)}
    chunk_entities = spark.createDataFrame([(d, e) for d, s in sets.items() for e in s], "chunk_id long, entity_id long")
    owned = spark.createDataFrame([(d, d) for d in sets], "chunk_id long, document_id long")
    got = links.entity_links_of(spark.createDataFrame([(7,), (11,), (999,)], "doc_id long"), chunk_entities, owned, 2)
    kept = {(min(d, x), max(d, x)) for d in (7, 11) for _, x in sorted((-len(sets[d] & o), x) for x, o in sets.items() if x != d and len(sets[d] & o) >= 2)[:2]}
    assert {(r.doc_a, r.doc_b) for r in got.collect()} == kept and asked == [{7, 11}]


def test_entity_links_at_documents(spark, monkeypatch):
    """Both what they keep and what others keep with them, without the links of documents that share less than two entities with them."""
    asked = []
    nearest = links.nearest
    monkeypatch.setattr(links, "nearest", lambda sets, own, *a: (asked.append(own.count()), nearest(sets, own, *a))[1])
    sets = {d: {0, 10 + d % 4, 20 + d % 6, *({1, 2} if d % 7 == 0 else {})} for d in range(60)} | {90: {50, 51}, 91: {50, 51}}
    chunk_entities = spark.createDataFrame([(d, e) for d, s in sets.items() for e in s], "chunk_id long, entity_id long")
    owned = spark.createDataFrame([(d, d) for d in sets], "chunk_id long, document_id long")
    every = {tuple(r) for r in links.entity_links(chunk_entities, owned, 3).collect()}
    got = {tuple(r) for r in links.entity_links_at([0, 58], chunk_entities, owned, 3).collect()}
    assert got == {r for r in every if {0, 58} & {r[0], r[1]}} and any(58 not in r[:2] for r in got) and asked[1] < asked[0]


def test_search_request_asks_only_for_links_of_its_results(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(links, "entity_links_at", lambda ids, *a: (asked.append(set(ids)), spark.createDataFrame([], links.LINKS))[1])
    got = search_queries.search_request(spark, "/root/testdata/sf0.001").collect()
    documents = {r.doc_id for r in got}
    assert documents and asked == [documents]


def test_link_upkeep_makes_the_links_once(spark):
    plan = search_queries.link_upkeep(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan  # they are read from where they were written


def test_related_by_one_tag(spark):
    docs = spark.createDataFrame([(i, f"{c}.md") for i, c in enumerate("abcdef")], "doc_id long, file_path string")
    tags = spark.createDataFrame([(0, "db"), (1, "db"), (2, "db"), (2, "rust"), (3, "rust"), (3, "web"), (4, "sea")], "doc_id long, name string")
    written = spark.createDataFrame([(0, 5, "explicit", 1.0)], links.LINKS)
    classes = links.tag_classes(tags)
    near = lambda ids, n=5: [tuple(r) for r in links.related(written, docs, ids, n, links.tag_links(tags), classes).collect()]
    assert near([0]) == [("f.md", "explicit", 1.0), ("b.md", "tag", pytest.approx(0.7)), ("c.md", "tag", pytest.approx(0.35))]
    assert near([0, 1, 3]) == [("f.md", "explicit", 1.0), ("c.md", "tag", pytest.approx(0.35))] and near([4]) == []
    assert near([0, 2]) == [("f.md", "explicit", 1.0), ("b.md", "tag", pytest.approx(0.7)), ("d.md", "tag", pytest.approx(0.35))]
    assert near([0, 2], 2) == near([0, 2])[:2]


def syn(spark, data):
    return spark.createDataFrame(data, synonyms.SCHEMA)


def test_synonyms(spark):
    base = syn(spark, [("a", "b", 0.8, "feedback", 0, None, "2025-01-01"), ("a", "c", 0.9, "user", 0, None, "2020-01-01"), ("b", "d", 0.9, "chat", 0, "2025-06-30", "2020-01-01"), ("x", "y", 0.5, "chat", 0, None, None)])
    scores = {(r.word_a, r.word_b): r.e for r in base.select("word_a", "word_b", synonyms.effective_score("2025-07-01").alias("e")).collect()}
    assert scores["a", "c"] == 0.9 and scores["a", "b"] == pytest.approx(0.8 * 0.5 ** (181 / 90)) and scores["x", "y"] == 0.5
    tokens = spark.createDataFrame([(0, "B "), (1, "a"), (2, "b")], "position int, word string")
    assert rows(synonyms.expand(base, tokens, "2025-07-01")) == [("c", 1), ("d", 0)]
    up = synonyms.upserted(base, syn(spark, [("B", "a", 2.0, "user", 5, None, "n"), ("c", "a", 0.1, "chat", 0, None, "n"), ("q", "q", 1.0, "user", 0, None, "n"), ("n", "m", 0.3, "user", 0, None, "n")]))
    assert {(r.word_a, r.word_b): (r.score, r.source, r.hits) for r in up.collect() if r.word_a != "x"} == {("a", "b"): (0.9, "user", 0), ("a", "c"): (0.9, "user", 0), ("b", "d"): (0.9, "chat", 0), ("m", "n"): (0.3, "user", 0)}
    words = spark.createDataFrame([(1, "犬猫", "jpn"), (2, "いぬ", "jpn"), (3, "x", "jpn"), (4, "dog", "eng")], "wordid long, lemma string, lang string")
    senses = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3), ("s", 4), ("t", 1), ("t", 2)], "synset string, wordid long")
    assert rows(synonyms.synset_pairs(words, senses)) == [("いぬ", "犬猫")]
    lines = spark.createDataFrame([("b, A",), ("# no",), ("",), ("x",), ("a,b",), ("p,q,r",), ("z,z",)], "value string")
    assert rows(synonyms.parsed_pairs(lines)) == [("a", "b"), ("p", "q,r")]
    assert rows(synonyms.sync_actions(base, synonyms.parsed_pairs(lines))) == [("a", "c", "delete"), ("p", "q,r", "insert")]
    assert rows(synonyms.without_stale(base, "2025-07-01").select("word_a", "word_b")) == [("a", "c"), ("x", "y")]
    assert rows(synonyms.without_stale(synonyms.hit(base, spark.createDataFrame([("b", "d")], "word_a string, word_b string"), "n"), "2030-01-01").select("word_a")) == [("a",), ("b",), ("x",)]


def test_dictionary(spark):
    texts = spark.createDataFrame([("LoRa lora カタカナ 漢字 12 x",), ("lora",), ("ab",), (None,)], "t string")
    assert rows(dictionary.collected(texts, "t")) == [("LoRa", "ascii", 1), ("lora", "ascii", 1), ("カタカナ", "katakana", 1)]
    assert rows(dictionary.collected(texts, "t", spark.createDataFrame([("LORA",)], "surface string"))) == [("カタカナ", "katakana", 1)]
    own = spark.createDataFrame([("a", 4, "ascii", "query", "1", "2", "pending"), ("b", 9, "ascii", "query", "1", "2", "accepted")], "surface string, frequency long, pos string, source string, first_seen string, last_seen string, status string")
    seen = spark.createDataFrame([("a", "x", 2), ("b", "x", 2), ("c", "katakana", 1)], "surface string, pos string, texts long")
    up = dictionary.upserted(own, seen, "session", "9")
    assert rows(up) == [("a", 6, "ascii", "query", "1", "9", "pending"), ("b", 9, "ascii", "query", "1", "2", "accepted"), ("c", 1, "katakana", "session", "9", "9", "pending")]
    assert tuple(dictionary.summary(up).first()) == (2, 1, 1, 0) and [r.surface for r in dictionary.ready(up).collect()] == ["a"]
    assert rows(dictionary.moved(up, seen, "rejected", True).select("surface", "status")) == [("a", "rejected"), ("b", "accepted"), ("c", "rejected")]
    assert rows(dictionary.export_lines(up, own.filter("surface = 'b'"))) == [("a", "a,名詞,a")]


# ---- upkeep, files, stream


def test_actions(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file_path string, file_hash string")
    seen = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4"), ("e", None)], "file_path string, file_hash string")
    assert rows(maintenance.document_actions(old, seen)) == [("a", "skip"), ("b", "update"), ("c", "skip"), ("d", "insert"), ("e", "skip")]
    assert dict(rows(maintenance.document_actions(old, seen, True)))["c"] == "delete"
    c = lambda d: spark.createDataFrame(d, "document_id long, chunk_index long, content_hash string")
    assert rows(maintenance.chunk_actions(c([(1, 0, "a"), (1, 1, None), (1, 2, "c"), (1, 3, "d")]), c([(1, 0, "a"), (1, 1, "b"), (1, 2, "x"), (2, 0, "n")]))) == [(1, 0, "keep"), (1, 1, "update"), (1, 2, "update"), (1, 3, "delete"), (2, 0, "insert")]


def test_encoding_faults(spark):
    def encoder(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return [[] if t == "none" else [float(len(t))] for t in texts]

    got = {r.chunk_id: (r.embedding, r.reason) for r in maintenance.encoded(chunks(spark, ["a", "bad", "none", None, "é" * 9000]), encoder).collect()}
    assert got == {0: ([1.0], None), 1: (None, "encode_error"), 2: (None, "empty_embedding"), 3: ([0.0], None), 4: ([4096.0], None)}
    assert maintenance.cut_bytes("é" * 5, 5) == "éé" and len(maintenance.hashed_embedding(8)(["", "abc"])[1]) == 8


def test_ignore_rules(spark):
    policy = files.IngestPolicy(("md",), ["*.tmp.md", "private/", "!keep.tmp.md", "/top.md", "docs/**/x.md", "# note", ""])
    paths = {"a.md": True, "a.txt": False, "a.MD": False, "b/a.tmp.md": False, "keep.tmp.md": True, "private/a.md": False, "x/private/a.md": False, "top.md": False, "d/top.md": True, "docs/a/b/x.md": False, "docs/x.md": False, ".git/a.md": False, "/abs.md": False, "noext": False, "private": False}
    assert {p: policy.accepts(p) for p in paths} == paths
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.ok for r in df.select("p", policy.column(F.col("p")).alias("ok")).collect()} == paths


def test_symbolic_links_are_skipped(spark, tmp_path):
    root, outside = tmp_path / "tree", tmp_path / "outside"
    for f in (root / "notes" / "deep" / "a.md", outside / "secret.md"):
        f.parent.mkdir(parents=True)
        f.write_text("x")
    (root / "notes" / "file.md").symlink_to(outside / "secret.md")
    (root / "notes" / "inner.md").symlink_to(root / "notes" / "deep" / "a.md")
    (root / "notes" / "folder").symlink_to(outside)
    (root / "linked").symlink_to(outside)
    got = files.read_files(spark, str(root), ["notes", "linked"], files.IngestPolicy())
    assert [r.file_path for r in got.collect()] == ["notes/deep/a.md"]


def test_reading_a_tree(spark, tmp_path):
    for p, t in {"notes/a.md": "A", "notes/b.txt": "B", "notes/sub/c.md": "C", "skip/d.md": "D", "e.md": "E", ".gitignore": "skip/\n"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    policy = files.policy_of(str(tmp_path))
    found = files.roots(str(tmp_path), policy=policy)
    assert found == ["notes"]
    df = files.read_files(spark, str(tmp_path), found, policy)
    assert [(r.file_path, r.text) for r in df.orderBy("file_path").collect()] == [("notes/a.md", "A"), ("notes/sub/c.md", "C")]
    assert rows(files.listed_paths(spark, [" a ", "", "a", "b\n"])) == [("a",), ("b",)]
    (tmp_path / "terms.toml").write_text('[[terms]]\nname = "LoRa"\n[[terms]]\nname = "x"\n[[terms]]\nname = "窯"\n[[terms]]\nname="kiln"\ntype="tool"\n')
    assert rows(files.custom_terms(spark, str(tmp_path / "terms.toml"))) == [("kiln", "tool"), ("lora", "custom")]
    assert files.custom_terms(spark, str(tmp_path / "none.toml")).count() == 0
    (tmp_path / "dict.csv").write_text("# x\na,名詞,え\n\nb,名詞\n")
    assert rows(files.dictionary_entries(spark, str(tmp_path / "dict.csv"))) == [("a", "名詞", "え"), ("b", "名詞", None)]


def test_stream_keeps_the_index_current(spark, tmp_path):
    from datetime import datetime, timedelta

    t = [datetime(2024, 1, 1) + timedelta(hours=h) for h in range(9)]
    source, folder, marks = (str(tmp_path / x) for x in ("events", "index", "marks"))
    write = lambda data: spark.createDataFrame(data, watch.EVENT).coalesce(1).write.mode("append").parquet(source)
    write([("a", "1", t[1]), ("a", "2", t[2]), ("b", "1", t[1])])
    watch.watch(spark, source, folder, marks).awaitTermination()
    assert rows(watch.current(spark, folder).select("file_path", "file_hash")) == [("a", "2"), ("b", "1")]
    write([("a", "0", t[0]), ("b", None, t[3]), ("c", "1", t[3])])  # late, deleted, new
    watch.watch(spark, source, folder, marks).awaitTermination()
    assert rows(watch.current(spark, folder).select("file_path", "file_hash")) == [("a", "2"), ("c", "1")]
    watch.watch(spark, source, folder, marks).awaitTermination()
    assert len(watch.snapshots(spark, folder)) == 2


def test_small_files(spark, tmp_path):
    import json
    import sqlite3

    con = sqlite3.connect(tmp_path / "wn.db")
    con.executescript("CREATE TABLE word(wordid INTEGER, lemma TEXT, lang TEXT); CREATE TABLE sense(synset TEXT, wordid INTEGER); INSERT INTO word VALUES (1, '犬猫', 'jpn'), (2, 'いぬ', 'jpn'); INSERT INTO sense VALUES ('s', 1), ('s', 2);")
    con.commit()
    con.close()
    assert rows(synonyms.synset_pairs(*files.wordnet_tables(spark, str(tmp_path / "wn.db")))) == [("いぬ", "犬猫")]
    place = str(tmp_path / "a" / "x.toml")
    assert files.install_default(place, "one") and not files.install_default(place, "two") and open(place).read() == "one"
    files.write_status(str(tmp_path / "s.json"), {"filled": 3})
    assert json.loads((tmp_path / "s.json").read_text()) == {"filled": 3}
    assert maintenance.seconds_left(10, 30, 5.0) == 10 and maintenance.seconds_left(0, 30, 5.0) is None


def test_periodic_runs(spark, tmp_path):
    import time

    ran = []
    query = watch.periodic(spark, lambda: ran.append(1), str(tmp_path / "ticks"), "200 milliseconds")
    try:
        until = time.time() + 60
        while len(ran) < 2 and time.time() < until:
            time.sleep(0.2)
    finally:
        query.stop()
    assert len(ran) >= 2


def test_watching_a_tree(spark, tmp_path):
    calls = []
    tree, marks = tmp_path / "tree", str(tmp_path / "marks")
    tree.mkdir()
    (tree / "a.md").write_text("A")
    watch.watch_tree(spark, [str(tree)], lambda: calls.append(1), marks).awaitTermination()
    watch.watch_tree(spark, [str(tree)], lambda: calls.append(1), marks).awaitTermination()
    (tree / "b.md").write_text("B")
    watch.watch_tree(spark, [str(tree)], lambda: calls.append(1), marks).awaitTermination()
    assert len(calls) == 2
