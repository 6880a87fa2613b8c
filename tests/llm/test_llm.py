"""The operators of the subpackage against brute force, round trips and held-out rows."""

import base64
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, database
from tsugumi.llm import conversations, cooccurrence, markup, mixing, quality, queries, splitting, term_counts, tokens

MESSAGES = "msg_id long, session_id string, line_no int, message struct<role: string, content: string>, msg_timestamp string, client_tz string, speaker string, text string"
ROLES = [("user", "user"), ("human", "user"), ("assistant", "assistant"), ("system", "system"), ("tool", "tool")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, small, name):
    assert_same(queries.QUERIES[name](spark, small), database(small), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).collect() is not None


def dialogue(spark, sessions):
    rows, n = [], 0
    for name, lines in sessions.items():
        for line_no, role, content, *rest in lines:
            n += 1
            at = rest[0] if rest else "2024-01-01T00:00:00Z"
            rows.append((n, name, line_no, None if role == "none" else (role, content), at, None, "x", "y"))
    return spark.createDataFrame(rows, MESSAGES), spark.createDataFrame(ROLES, "raw_role string, speaker string")


def test_reasons(spark):
    U, A = "user", "assistant"
    sessions = {
        "ok": [(2, " Assistant ", "fine"), (1, "HUMAN", "hi")],
        "retry": [(1, U, "a"), (1, U, "a"), (2, A, "b"), (2, A, "b")],
        "gap": [(1, U, "a"), (3, A, "b")],
        "from_two": [(2, U, "a"), (3, A, "b")],
        "two_messages": [(1, U, "a"), (1, U, "c"), (2, A, "b")],
        "role": [(1, U, "a"), (2, A, "b"), (3, "robot", "c")],
        "no_role": [(1, U, "a"), (2, A, "b"), (3, None, "c")],
        "json": [(1, U, '[{"type":"text","text":"a"}'), (2, A, "b")],
        "json_tail": [(1, U, '["a"] b'), (2, A, "b")],
        "answer_first": [(1, A, "b"), (2, U, "a"), (3, A, "b")],
        "blank_answer_first": [(1, A, " 　"), (2, U, "a"), (3, A, "b")],
        "empty": [(1, U, '[{"type":"image"}]'), (2, A, None), (3, "system", "x")],
        "open": [(1, U, "a"), (2, A, "b"), (3, U, "c")],
        "twice": [(1, U, "a"), (2, U, "b"), (3, A, "c")],
        "tool_between": [(1, U, "a"), (2, "tool", "{}"), (3, A, '["b", {"type":"text","text":"c"}, 4]')],
        "timed": [(None, A, "b", "2024-01-01T09:00:30+09:00"), (None, U, "a", "2024-01-01T00:00:10Z"), (None, U, "a", "2024-01-01T00:00:10Z")],
        "timed_open": [(None, A, "b", "1704067201"), (None, U, "a", "2024-01-01T00:00:10Z"), (None, A, "z", "2024-01-01T00:00:05Z")],
        "mixed": [(None, U, "a"), (1, A, "b")],
    }
    df, roles = dialogue(spark, sessions)
    got = {r.session_id: r.reason for r in conversations.dropped_sessions(df, roles).collect()}
    broken = ["gap", "from_two", "two_messages", "role", "no_role", "json", "json_tail", "answer_first", "timed_open", "mixed"]
    assert got == dict.fromkeys(broken, "broken") | {"empty": "empty", "open": "missing_reply", "twice": "missing_reply"}
    kept = defaultdict(list)
    for r in conversations.conversations(df, roles).orderBy("session_id", "turn").collect():
        kept[r.session_id].append((r.turn, r.speaker, r.text))
    assert kept["ok"] == [(1, "user", "hi"), (2, "assistant", "fine")] and kept["tool_between"][2] == (3, "assistant", "b\nc")
    assert set(kept) == set(sessions) - set(got) and conversations.dropped_sessions(df.limit(0), roles).count() == 0


def test_found_against_brute_force(spark, small):
    speaker = {r.raw_role: r.speaker for r in spark.read.parquet(f"{small}/speaker_roles.parquet").collect()}
    times = {r.rec_id: r.utc_us for r in __import__("tsugumi.data_queries", fromlist=["x"]).p5_found(spark, small).filter("rec_kind = 'message'").collect()}
    groups = defaultdict(dict)
    for r in spark.read.parquet(f"{small}/session_messages.parquet").orderBy("msg_id").collect():
        key = (r.line_no, r.message.role if r.message else None, r.message.content if r.message else None, r.msg_timestamp, r.client_tz)
        groups[r.session_id].setdefault(key, r)
    want = {}
    for sid, messages in groups.items():
        rows, bad = [], False
        for r in messages.values():
            role, content = (r.message.role, r.message.content) if r.message else (None, None)
            who = speaker.get(role.strip().lower()) if role is not None else None
            text = content
            if content is not None and content.startswith(("[{", '["')):
                try:
                    text = "\n".join(x if isinstance(x, str) else x["text"] for x in json.loads(content) if isinstance(x, str) or isinstance(x, dict) and x.get("type") == "text")
                except ValueError:
                    bad, text = True, None
            bad |= who is None
            rows.append((r.line_no, who, bool(text and text.strip()), times.get(r.msg_id), r.msg_id))
        if any(r[0] is not None for r in rows):
            bad |= sorted(x[0] or 0 for x in rows) != list(range(1, len(rows) + 1))
            rows.sort(key=lambda x: x[0] or 0)
        else:
            rows.sort(key=lambda x: (x[3] is not None, x[3] or 0, x[4]))
        said = [x[1] for x in rows if x[2] and x[1] in ("user", "assistant")]
        if bad or "user" in said and said[0] == "assistant":
            want[sid] = "broken"
        elif not said:
            want[sid] = "empty"
        elif any(a == "user" and b != "assistant" for a, b in zip(said, [*said[1:], None])):
            want[sid] = "missing_reply"
    assert {r.session_id: r.reason for r in queries.p1_found(spark, small).collect()} == want


def test_fold_edits_and_deletes(spark):
    rows = [(1, "k", "a", "create"), (2, "k", "a", "retry"), (3, "k", "b", "edit"), (1, "d", "a", "create"), (5, "d", "a", "delete"), (1, "two", "a", "create"), (2, "two", "b", None), (9, None, "n", "create")]
    rows += [(1, "late", "a", "create"), (2, "late", "b", "edit"), (3, "late", "a", "retry"), (1, "dead", "a", "create"), (2, "dead", "a", "delete"), (3, "dead", "a", "retry")]
    rows += [(1, "anew", "a", "create"), (2, "anew", None, "delete"), (3, "anew", "b", "create"), (4, "anew", "a", "retry"), (1, "same", "a", "create"), (2, "same", None, "delete"), (3, "same", "a", "create")]
    rows += [(4, "orphan", "a", "retry"), (1, "gone", "a", "create"), (2, "gone", None, "delete"), (5, "gone", None, "retry"), (1, "back", "a", "create"), (2, "back", "b", "edit"), (3, "back", "a", "edit"), (4, "back", "b", "retry")]
    events = spark.createDataFrame([(*r, "c", 1) for r in rows], "v long, key string, body string, op string, _op string, variants long")
    got = conversations.fold_events(events, ["key"], "v", ["body"], "op")
    want = {("k", "b", 1), ("two", "b", 2), (None, "n", 1), ("late", "b", 1), ("anew", "b", 1), ("same", "a", 1), ("orphan", "a", 1), ("back", "a", 1)}
    assert {(r.key, r.body, r.variants) for r in got.collect()} == want
    assert conversations.fold_events(events.limit(0), ["key"], "v", ["body"], "op").count() == 0


TEXTS = ["", "short", "x" * 800, "x" * 801, "a b " * 900, "語。" * 1000, "\n".join(["line " * 30] * 60), "# h\n\n" + "para one. " * 100 + "\n\n## two\n\n" + "y" * 3000 + "\nend", "é" * 50_000, ("w" * 750 + "\n") * 9, "a" * 30 + "\n" + "word " * 400, "a\n" * 30 + "b" * 900]


@pytest.mark.parametrize("text", TEXTS)
def test_pieces(text):
    parts = splitting.split_text(text)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(b - a <= 800 for a, b, _ in parts)
    assert all(q[0] == p[1] - 80 and q[1] > p[1] for p, q in zip(parts, parts[1:]))
    natural = [p[1] for p in parts[:-1] if p[2] < 4]
    assert all(text[e - 1] in "。！？.!?\n" for e in natural)


def test_split_rows(spark):
    rows = [(1, 1, 0, None, "x" * 801, "c"), (2, 1, 1, "s", "short", "c"), (3, 1, 2, "s", "文。" * 500, "c"), (4, 2, 0, None, None, "c"), (5, None, 0, None, "a. " * 400, "c")]
    df = spark.createDataFrame(rows, "chunk_id long, document_id long, chunk_index long, section_path string, content string, pieces string")
    assert {(r.chunk_id, r.kind) for r in splitting.split_kinds(df).collect()} == {(1, "hard"), (3, "natural"), (5, "natural")}
    out = splitting.pieces(df).orderBy("chunk_id", "chunk_index").collect()
    assert [(r.chunk_id, r.chunk_index) for r in out] == [(1, 0), (1, 1), (3, 3), (3, 4), (5, 0), (5, 1)]
    assert splitting.split_kinds(df.limit(0)).count() == 0


def pair_counts(rows):
    held = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            held[b].add(i)
    return Counter((x, y) for s in held.values() for x in s for y in s if x < y), Counter(i for s in held.values() for i in s), len(held)


def test_pairs_with_wide_baskets(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(b, min(rng.randrange(60), rng.randrange(60))) for b in range(40) for _ in range(rng.randrange(12))] + [(99, i) for i in range(50)] * 2 + [(98, i) for i in range(20, 60)] + [(97, i) for i in range(20, 60)] + [(1, None), (None, 3)]
    monkeypatch.setattr("tsugumi.plans.pairs.BASKET_ROWS", 30)
    monkeypatch.setattr("tsugumi.plans.pairs.BLOCK_ITEMS", 7)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "chunk_id long, entity_id long, weight int, basket string")
    got = {(r.entity_a, r.entity_b): r for r in cooccurrence.cooccurrences(df, "chunk_id", "entity_id").collect()}
    shared, n, total = pair_counts(rows)
    assert {k: (r.shared, r.n_a, r.n_b, r.total) for k, r in got.items()} == {k: (c, n[k[0]], n[k[1]], total) for k, c in shared.items()}
    some = next(iter(got.values()))
    assert some.lift == pytest.approx(some.shared * total / some.n_a / some.n_b)
    assert cooccurrence.cooccurrences(df.limit(0), "chunk_id", "entity_id").count() == 0


def test_suffix_counts(spark, monkeypatch):
    monkeypatch.setattr("tsugumi.llm.term_counts.RECORDS_PER_SALT", 40)
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(30)]), [rng.choice("abcd") for _ in range(rng.randrange(6))], rng.choice([None, 1, 2])) for i in range(400)]
    df = spark.createDataFrame([(*r, "c", 5) for r in rows], "id long, doc long, t array<string>, w long, salt string, start int")
    grams, docs, whole, wdocs, first = Counter(), defaultdict(set), Counter(), defaultdict(set), {}
    for i, doc, t, w in rows:
        for a in range(len(t)):
            for b in range(a + 1, min(a + 3, len(t)) + 1):
                grams[tuple(t[a:b])] += w or 0
                docs[tuple(t[a:b])] |= {doc} - {None}
        if t:
            whole[tuple(t)] += w or 0
            wdocs[tuple(t)] |= {doc} - {None}
            first[tuple(t)] = min(first.get(tuple(t), i), i)
    got = term_counts.suffix_counts(df, "t", "doc", "w", "id", sigma=3).collect()
    assert {tuple(r.terms): (r.frequency, r.records) for r in got if not r.whole} == {k: (c, len(docs[k])) for k, c in grams.items()}
    assert {tuple(r.terms): (r.frequency, r.records, r.first_id) for r in got if r.whole} == {k: (c, len(wdocs[k]), first[k]) for k, c in whole.items()}
    alone = term_counts.suffix_counts(df, "t", "doc", "w", "id", grams=False).collect()
    assert sorted((r.terms, r.frequency, r.records, r.first_id) for r in alone) == sorted((r.terms, r.frequency, r.records, r.first_id) for r in got if r.whole)


def test_term_marks(spark):
    rows = [(9, 1, "ＡＢ", 2), (3, 2, " ab ", None), (4, None, "Ab", 1), (5, 3, "ｶﾞ", 1), (6, 4, "ガ", 1), (7, 5, "ガ", 1), (7, 5, "ガ", 1), (8, 6, "　", 1), (10, 7, None, 1)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "candidate_id long, doc_id long, surface string, frequency long, terms string")
    got = {r.term: (r.candidate_id, r.frequency, r.documents, r.mark) for r in term_counts.term_frequencies(df).collect()}
    assert got == {"ab": (3, 3, 2, "rare"), "ガ": (5, 4, 3, "common")}
    assert term_counts.term_frequencies(df.limit(0)).count() == 0


def test_ngrams(spark):
    rows = [(1, "a b a"), (2, "A b"), (3, "b"), (4, None), (5, ""), (1, "a b a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, text string, records int")
    got = {r.ngram: (r["size"], r.frequency, r.records, r.mark) for r in term_counts.ngram_frequencies(df, "id", "text").collect()}
    assert got == {"a": (1, 5, 2, "rare"), "b": (1, 4, 3, "common"), "a b": (2, 3, 2, "rare"), "b a": (2, 2, 1, "rare"), "a b a": (3, 2, 1, "rare")}
    assert term_counts.ngram_frequencies(df.limit(0), "id", "text").count() == 0


def test_terms_against_brute_force(spark, small):
    import unicodedata

    docs, first, all_docs = defaultdict(set), {}, set()
    for r in spark.read.parquet(f"{small}/dictionary_candidates.parquet").collect():
        all_docs.add(r.doc_id)
        key = unicodedata.normalize("NFKC", r.surface).lower().strip() if r.surface else ""
        if key:
            docs[key].add(r.doc_id)
            first[key] = min(first.get(key, r.candidate_id), r.candidate_id)
    want = {(first[k], "rare" if len(d) < 3 else "common") for k, d in docs.items() if len(d) < 3 or len(d) >= 0.04 * len(all_docs)}
    assert {tuple(r) for r in queries.p4_found(spark, small).collect()} == want


MARKED = [
    ("plain text, a < b and R&D; 5 * 3 * 2; f[i][j]; snake_case_name; $20 to $35; C:\\work\\data; #42; ~/x and ~/y; {key}; a == b", []),
    ("【a/b.md】x # y **z**\nplain", []), ("# head\ntext", ["markdown"]), ("head\n====\n", ["markdown"]), ("see **this**", ["markdown"]), ("- a\n- b", ["markdown"]), ("1. a", ["markdown"]),
    ("> q", ["markdown"]), ("|a|b|\n|---|:-:|\n|1|2|", ["markdown"]), ("x[^1]", ["markdown"]), ("![a](b.png)", ["markdown"]), ("[a](http://x.y)", ["markdown"]), ("```py\n<b>x</b> [[a]] \\emph{x}\n```", ["markdown"]),
    ("`<br>` text", ["markdown"]), ("a ~~b~~ c", ["markdown"]), ("<p\n class=x>a</p>", ["html"]), ("a<br/>b", ["html"]), ("&nbsp;x &#12354; &#x3042;", ["html"]), ("<!-- x -->", ["html"]), ("<!DOCTYPE html>", ["html"]),
    ("<pre><code>if (a && b) { return '''t'''; } # x\n# y</code></pre>", ["html"]), ("Vec<i64> and List<String>", []), ("[[a|b]] x", ["wiki"]), ("'''b''' and ''i''", ["wiki"]), ("== h ==", ["wiki"]), ("{{box|a}}", ["wiki"]),
    ("{| class=\"w\"\n|-\n| a || b\n|}", ["wiki"]), ("[https://x.y z]", ["wiki"]), ("\\section{a}", ["latex"]), ("$x_{1}$ is", ["latex"]), ("\\[ a = b \\]", ["latex"]), ("\\begin{tabular}{ll}\na & 1 \\\\\n\\hline\n\\end{tabular}", ["latex"]),
    ("10\\% of", ["latex"]), ("D:\\text\\emph.txt", []), ("we paid $5 and got $2 back", []), ("x = [[1, 2], [3, 4]]", []), ("<b>x</b> **y** [[z]] \\emph{w}", ["html", "markdown", "wiki", "latex"]), ("", []),
]


@pytest.mark.parametrize("text,kinds", MARKED)
def test_markup_kinds(text, kinds):
    assert markup.convert(text)[1] == kinds


def test_markup_text():
    clean = lambda t: markup.convert(t)[0]
    assert clean("【a/b】x\n<h2>T</h2><ul><li>a</li><li>b</ul>") == "## T\n\n- a\n- b"
    assert clean("# T\n\n* **a** [l](u)\n1) b\n> q") == "# T\n\n- a l\n1. b\n> q"
    assert clean("== T ==\n[[a|b]] '''c''' {{d}}\n{|\n|-\n| a || b\n|}") == "## T\nb c\na | b"
    assert clean("\\section{T}\n$x_1$ \\emph{a} 5\\%\n\\begin{itemize}\n\\item b\n\\end{itemize}") == "# T\n$x_1$ a 5%\n\n- b"
    assert clean("```py\n# not **a** heading\n```") == "```\n# not **a** heading\n```"
    for long in ("<" * 20_000, "[" * 20_000, "*" * 20_000, "_a" * 20_000, "`" * 9_999, "{{" * 9_999, "'' " * 9_999, "a\n" * 20_000, "$" * 9_999):
        markup.convert(long)


def test_hard_comes_from_the_recursion(spark):
    """Units below the sentence hold every stretch over the limit: against a scan of the whole text."""
    rng = random.Random(8)
    signs = ["x" * 90, " ", "  " * 40, "\n", "\n \n", "\r\n", "。", "！", "...", ". ", "?! ", "# h\n", "y" * 795]
    texts = ["a\n\n" + " " * 150 + "x" * 700, "x" * 801, "x" * 800 + ".", "x" * 800 + ". " + "y" * 90, "！" * 900, "x" * 799 + ".. a", *("".join(rng.choice(signs) for _ in range(rng.randrange(5, 60))) for _ in range(3000))]
    for t in texts:
        longest, (_, uncut) = splitting.longest_stretch(t), splitting._split_text(t, 800, 80)
        assert (longest > 800) == (max((splitting.longest_stretch(t, a, b) for a, b in uncut), default=0) > 800), t
    row = splitting.oversized(spark.createDataFrame([(1, texts[0])], "chunk_id long, content string")).first()
    assert row.stretch == 850 and splitting.split_kinds(spark.createDataFrame([(1, texts[0])], "chunk_id long, content string")).first().kind == "hard"


def test_cuts_at_the_highest_level_that_fits():
    level = splitting.LEVELS.index
    paragraph = "a" * 742 + "\n\n" + "word " * 400
    assert splitting.split_text(paragraph)[0] == (0, 744, level("paragraph"))
    early = "a" * 298 + "\n\n" + "word " * 400  # the only line end stands in the first half
    assert splitting.split_text(early)[0] == (0, 300, level("paragraph"))
    sentences = "a" * 600 + ". " + "b" * 150 + ".\n" + "c " * 400
    assert splitting.split_text(sentences)[0][1:] == (754, level("line"))


def test_deep_nesting_is_taken_out():
    for depth in (3, 12, 300):
        assert markup.convert("\\emph{" * depth + "x" + "}" * depth) == ("x", ["latex"])
        assert markup.convert("a " + "{{t|" * depth + "x" + "}}" * depth + "b") == ("a b", ["wiki"])


def test_markup_rows(spark):
    df = spark.createDataFrame([(1, "**a**", "k"), (2, None, "k"), (3, "", "k"), (1, "**a**", "k")], "chunk_id long, content string, kinds string")
    assert sorted(tuple(r) for r in markup.markup_kinds(df).collect()) == [(1, "markdown"), (1, "markdown")]
    assert sorted((r.chunk_id, r.text) for r in markup.cleaned(df).collect()) == [(1, "a"), (1, "a"), (3, "")]
    pages = spark.createDataFrame([(i, f"【h/{i}】x\n<div class='main{i}'><p>{'text ' * 30}</p></div><div class='nav'><a href='x'>home</a></div>") for i in range(4)], "chunk_id long, content string")
    won = markup.consensus_paths(pages)
    best = won.first()
    assert won.count() == 1 and (best.host, best.path, best.votes) == ("h", "div.main#", 4)
    texts = [r.text for r in markup.extracted(pages, won).collect()]
    assert len(texts) == 4 and all(t == ("text " * 30).strip() for t in texts)
    assert markup.extracted(pages.limit(0), won).count() == 0


def test_pages_vote_for_the_densest_container(spark):
    """A plain menu and a footer beside the main block: neither they nor the body around all wins; the one odd page is outvoted."""
    menu = "<ul class='menu'><li>Home</li><li>About us</li><li>Contact</li></ul>"
    body = lambda i: f"<body><div class='top'>{menu}</div><div class='main'><h1>Page {i}</h1><p>{'first part of the text ' * 9}</p><p>{'second part ' * 9}</p></div><div class='foot'>all rights reserved</div></body>"
    rows = [(i, f"【h/{i}】x\n{body(i)}") for i in range(4)] + [(4, f"【h/4】x\n<body><div class='top'>{'menu ' * 300}</div><div class='main'><p>short</p></div></body>")]
    pages = spark.createDataFrame(rows, "chunk_id long, content string")
    assert [(r.path, r.votes) for r in markup.consensus_paths(pages).collect()] == [("body/div.main", 4)]
    texts = {r.chunk_id: r.text for r in markup.extracted(pages, markup.consensus_paths(pages)).collect()}
    assert texts[4] == "short" and all("Home" not in t and "rights" not in t and "second part" in t for i, t in texts.items() if i < 4)


def test_every_page_is_extracted(spark):
    rows = [(i, f"【h/{i}】x\n<style>{'p ' * 300}</style><div class='main'><p>{'text ' * 30}</p></div>") for i in range(3)]
    rows += [(3, "【h/3】x\n<td>only a cell</td>"), (4, "【h/4】x\n<section>other <b>part</b></section>"), (5, "【h/5】x\na < b and no container"), (6, "【k/6】x\n<div>tail <!-- not ended"), (7, "【k/7】x\n<div>one two &am"), (8, "no page")]
    pages = spark.createDataFrame(rows, "chunk_id long, content string")
    got = {r.chunk_id: (r.path, r.text) for r in markup.extracted(pages, markup.host_paths(pages)).collect()}
    assert set(got) == set(range(8)) and all(got[i] == ("div.main", ("text " * 30).strip()) for i in range(3))
    assert got[3] == ("td", "only a cell") and got[4] == ("section", "other part") and got[5] == (None, "a < b and no container")
    assert got[6][1].startswith("tail") and got[7][1].startswith("one two &am")
    first = {r.chunk_id: r.path for r in markup.extracted(pages, markup.consensus_paths(pages)).collect()}
    assert set(first) == set(range(8)) and first[4] is None


def test_ids_equal_the_library(spark, small):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    encoder.encode_special_tokens = True
    documents = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: r.ids for r in queries.p8_ids(spark, small).collect()}
    assert got == {i: encoder.encode(t, add_special_tokens=False).ids if t else [] for i, t in texts.items()}


def test_ids_of_odd_texts(spark):
    odd = [None, "", " ", "\n\n  \n x", "<|endoftext|>", "\u0000a", "é" * 10_000, "👩‍👩‍👧 x", "it's we'll I'M", "　全角　", "a" * 30_000, "x\r\n y\t z  ", "漢字かな" * 5_000]
    rows = [(i, t, b"k", "w") for i, t in enumerate(odd)] + [(None, "null id", b"k", "w"), (3, "\n\n  \n x", b"k", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, known binary, word string").repartition(3)
    want = Counter((i, tuple(tokens.encoder(tokens.vocabulary_path()).encode_ordinary(t or ""))) for i, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokens.token_ids(df).collect()) == want
    assert tokens.token_ids(df.limit(0)).count() == 0 and tokens.decoded(tokens.token_ids(df.limit(0))).count() == 0
    back = Counter((r.doc_id, r.text) for r in tokens.decoded(tokens.token_ids(df)).collect())
    assert back == Counter((i, t or "") for i, t, *_ in rows)
    assert tokens.decoded(spark.createDataFrame([(1, None), (2, []), (3, [72, 75])], "doc_id long, ids array<int>")).orderBy("doc_id").collect()[0].text is None
    counts = {r.doc_id: r.tokens for r in tokens.token_counts(df.filter("doc_id < 13"), ["doc_id"]).collect()}
    assert all(counts[i] == len(ids) for i, ids in want if i is not None)
    spaced = tokens.ranks(tokens.vocabulary_path())
    assert base64.b64decode(base64.b64encode(b" the")) in spaced


def test_ids_of_a_large_vocabulary(spark, tmp_path):
    """Ids beyond two bytes: the public vocabulary with 70 000 added to every id."""
    path, public = tmp_path / "large.tiktoken", tokens.vocabulary_path()
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % (i + 70_000) for t, i in tokens.ranks(public).items()))
    texts = ["the cat", "", None, "漢字 zyx qqqqq", "gibberishly unwordable"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.token_ids(df, str(path)).collect()}
    assert got == {i: [x + 70_000 for x in tokens.encoder(public).encode_ordinary(t or "")] for i, t in enumerate(texts)}
    path.write_bytes(base64.b64encode(b"a") + b" %d\n" % (2**31))
    tokens.ranks.cache_clear()
    with pytest.raises(ValueError, match="below"):
        tokens._cell(str(path))


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, s, rng.randrange(1, 60)) for i, s in enumerate(rng.choice("aaaaab") for _ in range(900))] + [(2000, "tiny", 50), (2001, "a", 0), (2002, "other", 9), (2003, None, 9)]
    members = spark.createDataFrame([(*r, "c") for r in rows + rows[:5]], "doc_id long, source string, tokens long, uses string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.45, 4), ("tiny", 0.03, 3), ("missing", 0.02, 3)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixture(members, targets)
    used, got = chosen.collect(), {r.source: r for r in report.collect()}
    assert all(0 < r.uses <= {"a": 2, "b": 4, "tiny": 3}[r.source] for r in used) and got["missing"].tokens == 0
    assert sum(r.reached_share for r in got.values()) == pytest.approx(1)
    for s, share in (("a", 0.5), ("b", 0.45), ("tiny", 0.03)):
        assert abs(got[s].tokens - got[s].quota) <= 60 and got[s].reached_share == pytest.approx(share / 0.98, abs=0.01)
    small, report = mixing.mixture(members, targets, total=500)
    assert all(abs(r.tokens - r.quota) <= 60 for r in report.collect())
    empty, report = mixing.mixture(members.limit(0), targets)
    assert empty.count() == 0 and report.count() == 4


def test_mixture_of_overlapping_sources(spark):
    rows = [(i, "a", 10) for i in range(100)] + [(i, "b", 10) for i in range(60, 160)]
    members = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixture(members, targets)
    assert all(r.reached_share == 0.5 and r.tokens == 800 for r in report.collect())
    assert chosen.groupBy("doc_id").agg(F.sum("uses").alias("n")).filter("n > 1").count() == 0


def test_mixture_of_copies(spark, monkeypatch):
    """One text in many sources, and more patterns than the network may hold."""
    rows = [(i, "a", "same text") for i in range(50)] + [(100, "b", "same text"), (101, "b", "other words here"), (102, "a", "third text"), (103, "a", None), (104, "b", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, _a int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    used = mixing.document_mixture(df, targets)[0].collect()
    assert {r.doc_id for r in used if r.source == "a"} <= {0, 102} and {r.doc_id for r in used if r.source == "b"} <= {100, 101} and all(r.uses <= 2 for r in used)
    rng = random.Random(4)
    rows = [(i, s, rng.randrange(5, 20)) for i in range(600) for s in rng.sample("abcde", rng.randrange(1, 4))]
    targets = spark.createDataFrame([(s, 0.2, 2) for s in "abcde"], "source string, target_share double, max_repeats int")
    members = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    chosen, report = mixing.mixture(members, targets)
    assert all(abs(r.tokens - r.quota) <= 20 and r.tokens > 0 and r.reached_share == pytest.approx(0.2, abs=0.02) for r in report.collect())
    assert {(r.doc_id, r.source) for r in chosen.collect()} <= {(i, s) for i, s, _ in rows}


def test_mixture_of_many_patterns(spark):
    """Every source keeps all its texts, however many sets of sources there are: the total is bounded by the tokens of each set of sources alone."""
    names, rng = ["big", *"abcdefghi"], random.Random(5)
    capacity = {p: rng.randrange(5, 40) for p in range(1, 1024, 2)}  # patterns as bits, all with "big"
    rows = [(p, s, n) for p, n in capacity.items() for i, s in enumerate(names) if p >> i & 1]
    shares = {s: 0.82 if s == "big" else 0.02 for s in names}
    chosen, report = mixing.mixture(spark.createDataFrame(rows, "doc_id long, source string, tokens long"), spark.createDataFrame([(s, w, 1) for s, w in shares.items()], "source string, target_share double, max_repeats int"))
    got, used = {r.source: r for r in report.collect()}, chosen.collect()
    most = {u: sum(n for p, n in capacity.items() if p & u) for u in range(1, 1024)}
    fits = lambda t: (q := mixing.quotas_of(t, shares)) and all(sum(q[s] for i, s in enumerate(names) if u >> i & 1) <= n for u, n in most.items())
    total = next(t for t in range(most[1023], 0, -1) if fits(t))
    assert len(capacity) > mixing.MAX_PATTERNS and sum(r.quota for r in got.values()) == total
    assert all(abs(r.tokens - r.quota) <= 40 for r in got.values()) and all(n == 1 for n in Counter(r.doc_id for r in used for _ in range(r.uses)).values())


def test_flow_is_cheapest():
    flow = mixing.route({("a",): 10, ("a", "b"): 10}, {"a": 10, "b": 10}, {"a": 2, "b": 2})
    assert flow == {(("a",), "a"): 10, (("a", "b"), "b"): 10}
    assert mixing.quotas_of(10, {"a": 1, "b": 1, "c": 1}) == {"a": 4, "b": 3, "c": 3}


def test_flow_over_several_sources():
    """Tokens are moved on over sources in between, and a second use is made only of what no other source can spare."""
    capacity, twice = {("a", "b"): 10, ("b", "c"): 10, ("c", "d"): 10, ("a",): 1}, dict.fromkeys("abcd", 2)
    flow = mixing.route(capacity, {"a": 11, "b": 0, "c": 10, "d": 10}, twice)
    assert flow == {(("a",), "a"): 1, (("a", "b"), "a"): 10, (("b", "c"), "c"): 10, (("c", "d"), "d"): 10}
    assert mixing.largest_total(capacity, {"a": 0.5, "d": 0.5}, {"a": 3, "d": 2}) == 41  # a gets 21
    assert mixing.largest_total({("a",): 10**12, ("b",): 3}, {"a": 0.5, "b": 0.5}, {"a": 2**31 - 1, "b": 2**31 - 1}) == 2 * 3 * (2**31 - 1) + 1


def test_rules_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    try:
        labels = spark.read.parquet(f"{d}/doc_labels.parquet").filter("doc_id is not null")
    except Exception:
        pytest.skip("no test tables")
    common = spark.read.parquet(f"{d}/common_words.parquet")
    stats = quality.statistics(spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi"), common)
    rows = labels.join(stats, "doc_id").filter("not blank").toPandas().sort_values("doc_id").reset_index(drop=True)
    names = [c for c in rows.columns if c not in ("doc_id", "label", "blank")]
    right = []
    for k in range(3):
        test = rows.index % 3 == k
        rules = quality.induce(rows[~test][names].to_numpy(float), rows[~test]["label"].to_numpy(object), names)
        guess = spark.createDataFrame(rows[test].drop(columns="blank")).selectExpr("label", f"{quality.as_sql(rules)} AS kind").collect()
        right += [r.label == r.kind for r in guess]
    assert np.mean(right) > 0.95


def test_quality_rows(spark):
    text = "The list is long and the day was short. We went on with it.\n" * 3
    rows = [(1, text), (2, None), (3, ""), (4, " \n"), (None, text), (5, "- a\n- b\n- c"), (1, text), (6, "語" * 100_000)]
    df = spark.createDataFrame([(*r, 1.0, "c") for r in rows], "doc_id long, text string, n_words double, lines string")
    common = spark.createDataFrame([("en", "the"), ("ja", "は"), (None, "x"), ("en", None)], "lang string, word string")
    stats = {r.doc_id: r for r in quality.statistics(df, common).collect()}
    assert stats[1].n_lines == 3 and stats[5].item_lines == 1 and stats[2].blank and stats[4].blank and stats[1].ended_lines == 1
    none = spark.createDataFrame([], "doc_id long, label string")
    assert quality.not_prose(df, common, none).count() == 0 and quality.as_sql([]) == "'prose'"
    assert quality.not_prose(df.limit(0), common, none).count() == 0
