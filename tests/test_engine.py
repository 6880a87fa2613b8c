"""The engine end to end on a small tree, and its settings."""

import json

import pytest

from tsugumi import settings as C
from tsugumi.operators import maintenance
from tsugumi.engine import Engine, as_json, as_text

DAY = "2025-07-01"


def write(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


def test_engine(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, "notes/loom.md", "---\nstatus: current\nupdated: 2025-06-30\ntags: [weaving, tools]\n---\n# Loom\n\nThe old loom is in the attic, see [kiln](kiln.md).\n\n## Care\n\nOil the loom.\n")
    write(root, "notes/kiln.md", "---\nupdated: 2025-06-01\ntags: [tools, weaving]\n---\n# Kiln\n\nThe kiln reaches 1200 degrees.\n")
    write(root, "private/x.md", "secret loom")
    write(root, ".gitignore", "private/\n")
    engine = Engine(spark, C.Settings(root=str(root), state=str(tmp_path / "state"), dimension=16, top_k=3))
    assert engine.index(DAY) == {"insert": 2} and engine.index(DAY) == {"skip": 2}
    assert engine.fill_vectors()["filled"] == engine.status()["chunks"] == 3
    found = engine.search("loom", DAY)
    first = found.orderBy("rank").first()
    assert first.file_path == "notes/loom.md" and "private" not in as_text(found)
    out = json.loads(as_json(found, engine.store.table("documents"), 1))
    assert out["total_hits"] >= 1 and out["results"][0]["source_file"] == "notes/loom.md" and "attic" in out["results"][0]["content"]
    assert engine.status()["links"] >= 1 and "No results" in as_text(engine.search("!!", DAY))

    write(root, "notes/loom.md", "# Loom\n\nA new shuttle arrived.\n")
    (root / "notes/kiln.md").unlink()
    assert engine.index(DAY, ["notes/loom.md", "notes/kiln.md", "private/x.md"]) == {"update": 1, "delete": 1}
    assert [r.content.split("\n")[-1] for r in engine.store.table("chunks").collect()] == ["A new shuttle arrived."]
    assert engine.status()["vectors"] == 0 and engine.doctor().filter("status = 'warning' and section = 'Embedder'").count() == 1

    lines = spark.createDataFrame([("s1", 1, '{"message":{"role":"user","content":"where is the ShuttleBox kept"},"timestamp":"2025-06-30"}'), ("s1", 2, '{"message":{"role":"assistant","content":"on the north shelf"}}')], "session string, line_no int, value string")
    assert engine.ingest(lines, DAY) == 1 and engine.ingest(lines, DAY) == 1
    assert engine.status()["documents"] == 2 and engine.status()["synonyms"] > 0
    version = engine.status()["version"]
    (tmp_path / "syn.csv").write_text("loom,shuttle\n")
    assert engine.sync_synonyms(str(tmp_path / "syn.csv"), DAY) == {"insert": 1}
    engine.reindex("all")
    assert engine.status()["vectors"] == engine.status()["chunks"]
    engine.store.back_to(version)
    assert engine.store.table("synonyms").filter("source = 'user'").count() == 0
    with pytest.raises(ValueError):
        engine.search("x", DAY, paths=["/abs"])
    assert engine.rebuild(DAY) == {"insert": 1}


def test_documents_that_share_one_tag_are_related(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, "notes/loom.md", "---\ntags: [weaving, wool]\n---\n# Loom\n\nThe old loom is in the attic.\n")
    write(root, "notes/kiln.md", "---\ntags: [pots, weaving]\n---\n# Kiln\n\nThe kiln reaches 1200 degrees.\n")
    engine = Engine(spark, C.Settings(root=str(root), state=str(tmp_path / "state"), dimension=16, top_k=1))
    engine.index(DAY)
    first = engine.search("loom", DAY).first()
    assert [(r.file_path, r.link_type, round(r.strength, 3)) for r in first.related_docs] == [("notes/kiln.md", "tag", 0.35)]


def test_a_change_touches_only_its_rows(spark, tmp_path, monkeypatch):
    """After changes of single documents the index is what indexing everything at once gives."""
    root = tmp_path / "tree"
    names = [f"notes/n{i}.md" for i in range(6)]
    for i, n in enumerate(names):
        write(root, n, f"---\ntags: [common, t{i % 2}]\n---\n# Note {i}\n\nThe loom and kiln number {i}, see [next](n{(i + 1) % 6}.md).\n")
    (tmp_path / "terms.toml").write_text('[[terms]]\nname = "loom"\n[[terms]]\nname = "kiln"\n')
    monkeypatch.setattr("tsugumi.engine.MAX_SEGMENTS", 2)
    make = lambda state: Engine(spark, C.Settings(root=str(root), state=str(tmp_path / state), dimension=8, top_k=3))
    one = make("one")
    one.set_terms(str(tmp_path / "terms.toml"))
    one.index(DAY)
    edges = lambda e: {(r.entity_a, r.entity_b, r.doc_id): r.occurrences for r in e.store.table("edges").collect()}
    before = {r.chunk_id for r in one.store.table("postings").select("chunk_id").distinct().collect()}
    write(root, names[0], "---\ntags: [common]\n---\n# Changed\n\nOnly the loom is left, and a shuttlecock.\n")
    one.index(DAY, [names[0]])
    added = spark.read.parquet(f"{one.settings.state}/{one.store.segments('postings')[-1]}")
    assert len(one.store.segments("postings")) == 2 and {r.chunk_id for r in added.select("chunk_id").distinct().collect()} <= before and added.select("chunk_id").distinct().count() == 1
    (root / names[5]).unlink()
    write(root, "notes/n7.md", "# Seven\n\nloom kiln [back](n1.md)\n")
    one.index(DAY)
    two = make("two")
    two.set_terms(str(tmp_path / "terms.toml"))
    two.index(DAY)
    rows = lambda e, name, *c: sorted(tuple(r) for r in e.store.table(name).select(*c).collect())
    assert edges(one) == edges(two) and rows(one, "links", "doc_a", "doc_b", "link_type") == rows(two, "links", "doc_a", "doc_b", "link_type")
    for name in ("chunk_entities", "tag_classes", "tag_links", "targets", "lengths", "index_stats"):
        columns = one.store.table(name).columns
        assert rows(one, name, *columns) == rows(two, name, *columns), name
    found = lambda e, q: [(r.chunk_id, round(r.score, 9)) for r in e.search(q, DAY).orderBy("rank").collect()]
    monkeypatch.setattr(one, "encoder", lambda texts: [None for _ in texts])
    monkeypatch.setattr(two, "encoder", lambda texts: [None for _ in texts])
    one.settings = two.settings = C.Settings(root=str(root), fallback="fts_only", top_k=3)
    assert found(one, "shuttlecock") == found(two, "shuttlecock") != [] and found(one, "number kiln") == found(two, "number kiln") != []
    common = {(r.entity_a, r.entity_b): r.occurrences for r in one.store.table("edges").collect()}
    assert set(common.values()) == {1}  # a pair of tags once a document


def test_what_is_encoded_and_collected(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, "notes/a.md", "# A\n\nThe loom.\n")
    asked = []
    engine = Engine(spark, C.Settings(root=str(root), state=str(tmp_path / "state"), dimension=4))
    engine.index(DAY)
    engine.fill_vectors()
    engine.encoder = lambda texts: asked.append(texts) or [[1.0, 0.0, 0.0, 0.0]]
    engine.search("最近の loom について", DAY)
    assert asked == [["loom"]]  # the words that are searched for, not the request as written

    def broken(texts):
        raise OSError("no model")

    engine.encoder = broken
    with pytest.raises(OSError):
        engine.search("loom", DAY)
    warned = engine.reload(C.Settings(root="elsewhere", state=engine.settings.state, dimension=4, top_k=9))
    assert len(warned) == 1 and engine.settings.top_k == 9 and engine.settings.root == str(root)
    lines = spark.createDataFrame([("s1", 1, '{"message":{"role":"user","content":"where is the ShuttleBox"}}'), ("s1", 2, '{"message":{"role":"assistant","content":"beside the WarpFrame"}}')], "session string, line_no int, value string")
    engine.ingest(lines, DAY)
    known = {r.surface for r in engine.store.table("candidates").collect()}
    assert "ShuttleBox" in known and "WarpFrame" not in known


def test_dictionary_and_report(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, "notes/a.md", "# A\n\nThe Tsurumi kiln, and the loom.\n")
    write(root, "notes/b.md", "# B\n\nA walk to Tsurumi.\n")
    settings = C.Settings(root=str(root), state=str(tmp_path / "state"), dimension=4, fallback="fts_only", dictionary=str(tmp_path / "user.csv"), stopwords=str(tmp_path / "stop.txt"), status=str(tmp_path / "status.json"))
    engine = Engine(spark, settings)
    assert len(engine.init()) == 3 and engine.init() == []
    (tmp_path / "user.csv").write_text("# mine\nTsurumi,固有名詞,ツルミ\n")
    (tmp_path / "stop.txt").write_text("walk\n")
    engine.index(DAY)
    assert [(r.name, r.entity_type) for r in engine.store.table("entities").collect()] == [("tsurumi", "proper_noun")] and engine.store.table("chunk_entities").count() == 2
    assert engine.search("walk", DAY).count() == 0 and engine.search("kiln", DAY, record=True).count() == 1
    assert "kiln" in {r.surface for r in engine.store.table("candidates").filter("source = 'query'").collect()} or engine.store.table("candidates").filter("surface = 'kiln' AND frequency > 1").count() == 1
    assert {r.hint for r in engine.doctor().filter("status <> 'ok'").collect()} == {"fill_vectors"}
    engine.reindex("texts")
    assert len(engine.store.segments("postings")) == 1 and engine.search("kiln", DAY).count() == 1
    engine._report({"reindex": {"kind": "all", "processed": 1, "total": 3, "began": 100.0, "now": 110.0}})
    line = engine.doctor().filter("section = 'Reindex'").first()
    assert line.value == 20 and maintenance.issues(engine.doctor()) == 2


def test_settings(tmp_path):
    a, b = tmp_path / "a.toml", tmp_path / "b.toml"
    a.write_text('top_k = 9\ndirectories = [{path = "n", weight = -3}, {path = "n/deep", weight = 2.0, half_life_days = 10}, {path = "/abs"}, {path = ""}]\n')
    b.write_text('top_k = 1\nfallback = "fts-only"\n')
    got = C.resolve([str(a), str(b), str(tmp_path / "none")], {"TSUGUMI_ROOT": "/r", "TSUGUMI_EXTENSIONS": "md, txt"})
    assert (got.top_k, got.fallback, got.root, got.extensions) == (9, "fts_only", "/r", ("md", "txt"))
    assert [d.path for d in got.directories] == ["n/deep", "n"] and got.weights == {"n/deep": 2.0, "n": 1.0} and got.half_lives["n/deep"] == 10
    assert len(C.reload_warnings(got, C.resolve([], {}))) == 4 and C.reload_warnings(got, got) == []
    with pytest.raises(ValueError):
        C.fallback_mode("maybe")
