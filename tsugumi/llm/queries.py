"""Queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsugumi.functions import analysis, text
from tsugumi.instants_sql import instants
from tsugumi.llm import conversations, cooccurrence, markup, mixing, quality, splitting, term_counts, tokens
from tsugumi.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.dropped_sessions(table(spark, sf_dir, "session_messages"), table(spark, sf_dir, "speaker_roles"))


def p1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(table(spark, sf_dir, "session_messages"), table(spark, sf_dir, "speaker_roles"))


def p1_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log over all messages, folded: every message is created; by its number it is delivered again, edited, deleted or created anew, and late retries of the first event follow all of these."""
    m = F.col("msg_id")
    event = lambda op, add, body, when: F.when(when, F.struct(F.lit(op).alias("op"), (m * 10 + add).alias("version"), body.alias("body")))
    role = F.coalesce("message.role", F.lit(""))
    events = F.array_compact(F.array(
        event("create", 0, role, F.lit(True)), event("edit", 2, F.concat(role, F.lit(" edited")), m % 3 == 0), event("delete", 3, F.lit(None).cast("string"), m % 5 == 0),
        event("retry", 4, F.lit(None).cast("string"), m % 10 == 0), event("retry", 5, role, m % 2 == 0), event("create", 7, F.lit("anew"), m % 35 == 0), event("retry", 8, role, m % 35 == 0),
    ))
    log = table(spark, sf_dir, "session_messages").select("session_id", "msg_id", F.explode(events).alias("e")).select("session_id", "msg_id", "e.*")
    return conversations.fold_events(log, ["session_id", "msg_id"], "version", ["body"], "op").select("session_id", "msg_id", "body", "variants")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_kinds(table(spark, sf_dir, "chunks"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(table(spark, sf_dir, "chunks"))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every oversized chunk the hash of the text that its pieces give without their overlaps, whether all pieces keep the limit, and whether their new numbers follow each other."""
    parts = splitting.pieces(table(spark, sf_dir, "chunks")).groupBy("chunk_id", "section_path").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "piece"))).alias("p"))  # of one text
    rest = F.array_join(F.transform(F.expr("slice(p, 2, size(p))"), lambda x: F.substring(x["piece"], splitting.OVERLAP + 1, splitting.LIMIT)), "")
    whole = F.concat(F.get("p", F.lit(0))["piece"], rest)
    first, last = F.get("p", F.lit(0))["chunk_index"], F.element_at("p", -1)["chunk_index"]
    return parts.select("chunk_id", "section_path", F.sha2(F.encode(whole, "UTF-8"), 256).alias("hash"), F.forall("p", lambda x: F.char_length(x["piece"]) <= splitting.LIMIT).alias("within"), (last - first + 1 == F.size("p")).alias("in_order"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cooccurrence.cooccurrences(table(spark, sf_dir, "chunk_entities"), "chunk_id", "entity_id", min_shared=8)
    return cooccurrence.beyond_chance(scored, 4).select("entity_a", "entity_b")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.cooccurrences(table(spark, sf_dir, "chunk_entities"), "chunk_id", "entity_id").select("entity_a", "entity_b", "shared", "n_a", "n_b", "lift", "conviction")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.term_frequencies(table(spark, sf_dir, "dictionary_candidates")).filter("mark is not null").select("candidate_id", "mark")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts.term_frequencies(table(spark, sf_dir, "dictionary_candidates"))


def p4_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of up to three terms of all chunks."""
    return term_counts.ngram_frequencies(table(spark, sf_dir, "chunks"), "chunk_id", "content")


def p6_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks")
    return markup.extracted(chunks, markup.host_paths(chunks))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_kinds(table(spark, sf_dir, "chunks"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.cleaned(table(spark, sf_dir, "chunks"))


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.consensus_paths(table(spark, sf_dir, "chunks"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of every document's text as its ids decode to."""
    back = tokens.decoded(tokens.token_ids(table(spark, sf_dir, "documents")))
    return back.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, each with the share that its source reached."""
    chosen, report = mixing.document_mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return chosen.join(F.broadcast(report.select("source", "target_share", "reached_share")), "source").select("doc_id", "source", "uses", "tokens", "target_share", "reached_share")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every target source whether the mixture, told by its documents alone, keeps the quota within its largest document, the repeats, the source of every document, and one document for each text."""
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    chosen, report = mixing.document_mixture(documents, targets)
    own = documents.select("doc_id", F.col("source").alias("own"), F.xxhash64("text").alias("h"))
    rows = chosen.join(own, "doc_id").join(F.broadcast(targets.select("source", "max_repeats")), "source")
    by = rows.groupBy("source", "h").agg(F.sum(F.col("uses") * F.col("tokens")).alias("t"), F.min(F.col("uses") <= F.col("max_repeats")).alias("r"), F.min(F.col("own") == F.col("source")).alias("o"), F.count(F.lit(1)).alias("n"))
    by = by.groupBy("source").agg(F.sum("t").alias("t"), F.min("r").alias("r"), F.min("o").alias("o"), F.max("n").alias("n"))
    largest = tokens.token_counts(documents, ["source"]).groupBy("source").agg(F.max("tokens").alias("largest"))
    true = lambda c: F.coalesce(c, F.lit(True))
    near = F.abs(F.coalesce("t", F.lit(0)) - F.col("quota")) <= F.coalesce("largest", F.lit(0))
    return report.select("source", "quota").join(by, "source", "left").join(largest, "source", "left").select("source", near.alias("in_quota"), true(F.col("r")).alias("in_repeats"), true(F.col("o")).alias("from_source"), true(F.col("n") == 1).alias("once_a_text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"), table(spark, sf_dir, "doc_labels"))


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


QUERIES = {f.__name__: f for f in (p1_found, p1_conversations, p1_folded, p2_found, p2_pieces, p2_restored, p3_found, p3_pairs, p4_found, p4_terms, p4_ngrams, p6_found, p6_clean, p6_paths, p6_extracted, p8_ids, p8_round_trip, p9_mix, p9_shares, p9_kept, p10_found, p10_statistics)}

_COUNTS = """
WITH pairs AS (SELECT DISTINCT chunk_id, entity_id FROM chunk_entities WHERE chunk_id IS NOT NULL AND entity_id IS NOT NULL),
n AS (SELECT entity_id, count(*) AS n FROM pairs GROUP BY 1),
total AS (SELECT count(DISTINCT chunk_id) AS total FROM pairs),
shared AS (
  SELECT a.entity_id AS entity_a, b.entity_id AS entity_b, count(*) AS shared
  FROM pairs a JOIN pairs b ON a.chunk_id = b.chunk_id AND a.entity_id < b.entity_id GROUP BY 1, 2)
"""

_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _folded(c: str) -> str:
    quote = lambda x: x.replace("'", "''")
    wide = f"translate({c}, '{quote(text._FROM)}', '{quote(text._TO)}')"
    joined = wide
    for two, one in text._voiced():
        joined = f"replace({joined}, '{two}', '{one}')"
    return f"regexp_replace(lower({joined}), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_TERMS = f"""
WITH f AS (SELECT candidate_id, doc_id, coalesce(frequency, 0) AS frequency, regexp_replace({_folded("surface")}, '{_SPACE}+', ' ', 'g') AS term FROM dictionary_candidates WHERE surface IS NOT NULL),
t AS (SELECT term, min(candidate_id) AS candidate_id, sum(frequency)::BIGINT AS frequency, count(DISTINCT doc_id) AS documents FROM f WHERE term <> '' GROUP BY term),
terms AS (SELECT *, CASE WHEN documents < 3 THEN 'rare' WHEN documents * 100 >= 4 * (SELECT count(DISTINCT doc_id) FROM dictionary_candidates) THEN 'common' END AS mark FROM t)
"""

_SIGNS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_OUTER = f"'^{_SIGNS}+|{_SIGNS}+$'"
_ITEMS = "array_to_string(list_filter(list_transform(from_json(content, '[\"json\"]'), lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' WHEN json_type(x) = 'OBJECT' AND (x ->> '$.type') = 'text' THEN x ->> '$.text' END), lambda t: t IS NOT NULL), chr(10))"
_TIMED = "SELECT msg_id, msg_timestamp AS value, client_tz AS zone FROM session_messages"
_SESSIONS = f"""
WITH {instants(_TIMED, 'msg_id')},
one AS (SELECT session_id, line_no, message.role AS role, message.content AS content, msg_timestamp, client_tz, min(msg_id) AS msg_id FROM session_messages GROUP BY ALL),
r AS (SELECT lower(regexp_replace(raw_role, {_OUTER}, '', 'g')) AS raw_role, min(speaker) AS speaker FROM speaker_roles WHERE raw_role IS NOT NULL GROUP BY 1),
x AS (SELECT one.*, r.speaker, CASE WHEN line_no IS NULL THEN i.rough END AS at_us, starts_with(content, '[{{') OR starts_with(content, '["') AS arr FROM one LEFT JOIN r ON r.raw_role = lower(regexp_replace(role, {_OUTER}, '', 'g')) LEFT JOIN instants i USING (msg_id)),
t AS (SELECT *, coalesce(arr AND NOT json_valid(content), FALSE) AS bad, CASE WHEN arr THEN CASE WHEN json_valid(content) THEN {_ITEMS} END ELSE content END AS text FROM x),
s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no NULLS FIRST, at_us NULLS FIRST, msg_id) AS place, CASE WHEN coalesce(regexp_replace(text, {_OUTER}, '', 'g'), '') <> '' AND speaker IN ('user', 'assistant') THEN speaker END AS who FROM t),
n AS (SELECT *, lead(who) OVER (PARTITION BY session_id ORDER BY place) AS after FROM s WHERE who IS NOT NULL),
o AS (SELECT session_id, bool_or(who = 'user' AND after IS DISTINCT FROM 'assistant') AS open FROM n GROUP BY 1),
g AS (SELECT session_id, bool_or(speaker IS NULL OR bad) AS bad, count(line_no) AS numbered, count(*) AS n, count(DISTINCT line_no) AS lines, min(line_no) AS lo, max(line_no) AS hi, min(place) FILTER (who = 'user') AS u, min(place) FILTER (who = 'assistant') AS a FROM s GROUP BY 1),
d AS (SELECT g.session_id, CASE WHEN bad OR (numbered > 0 AND (numbered < n OR lo <> 1 OR hi <> lines OR lines < numbered)) OR coalesce(a < u, FALSE) THEN 'broken' WHEN u IS NULL AND a IS NULL THEN 'empty' WHEN open THEN 'missing_reply' END AS reason FROM g LEFT JOIN o ON o.session_id IS NOT DISTINCT FROM g.session_id)
"""

SQL = {
    "p8_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents",
    "p1_found": _SESSIONS + "SELECT session_id, reason FROM d WHERE reason IS NOT NULL",
    "p1_conversations": _SESSIONS + f"""SELECT s.session_id, row_number() OVER (PARTITION BY s.session_id ORDER BY place) AS turn, speaker, regexp_replace(text, {_OUTER}, '', 'g') AS text, utc_us
FROM s LEFT JOIN instants USING (msg_id) JOIN d ON d.session_id IS NOT DISTINCT FROM s.session_id WHERE reason IS NULL AND coalesce(regexp_replace(text, {_OUTER}, '', 'g'), '') <> ''""",
    "p9_kept": "SELECT source, TRUE AS in_quota, TRUE AS in_repeats, TRUE AS from_source, TRUE AS once_a_text FROM mix_targets",
    "p4_found": _TERMS + "SELECT candidate_id, mark FROM terms WHERE mark IS NOT NULL",
    "p4_terms": _TERMS + "SELECT term, candidate_id, frequency, documents, mark FROM terms",
    "p4_ngrams": f"""
WITH tok AS (SELECT chunk_id, coalesce(regexp_extract_all(translate(lower(content), '{analysis.ACCENTED}', '{analysis.PLAIN}'), '{analysis.term_pattern("")}'), []) AS t FROM chunks WHERE content IS NOT NULL),
e AS (SELECT chunk_id, t, unnest(range(1, len(t) + 1)) AS i FROM tok),
g AS (SELECT chunk_id, n AS size, array_to_string(t[i:i + n - 1], ' ') AS ngram FROM e, (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(t)),
c AS (SELECT ngram, size, count(*) AS frequency, count(DISTINCT chunk_id) AS records FROM g GROUP BY 1, 2)
SELECT ngram, size, frequency, records, CASE WHEN records < 3 THEN 'rare' WHEN records * 100 >= 4 * (SELECT count(*) FROM tok) THEN 'common' END AS mark FROM c
""",
    "p1_folded": """
WITH e AS (SELECT session_id, msg_id, 0 AS v, 'create' AS op, coalesce(message.role, '') AS body FROM session_messages
UNION ALL SELECT session_id, msg_id, 2, 'edit', coalesce(message.role, '') || ' edited' FROM session_messages WHERE msg_id % 3 = 0
UNION ALL SELECT session_id, msg_id, 3, 'delete', NULL FROM session_messages WHERE msg_id % 5 = 0
UNION ALL SELECT session_id, msg_id, 7, 'create', 'anew' FROM session_messages WHERE msg_id % 35 = 0),
last AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY v DESC) AS r FROM e)
SELECT session_id, msg_id, body, 1 AS variants FROM last WHERE r = 1 AND op <> 'delete'
""",
    "p2_found": """
SELECT chunk_id, CASE WHEN (SELECT max(length(s)) FROM unnest(string_split_regex(content, '[\\n\\r。！？]|[.!?]\\s')) AS u(s)) > 800 THEN 'hard' ELSE 'natural' END AS kind
FROM chunks WHERE length(content) > 800
""",
    "p2_restored": "SELECT chunk_id, section_path, sha256(content) AS hash, TRUE AS within, TRUE AS in_order FROM chunks WHERE length(content) > 800",
    "p3_found": _COUNTS + "SELECT entity_a, entity_b FROM shared JOIN n a ON a.entity_id = entity_a JOIN n b ON b.entity_id = entity_b, total WHERE shared >= 8 AND shared * total > 4 * a.n * b.n",
    "p3_pairs": _COUNTS + "SELECT entity_a, entity_b, shared, a.n AS n_a, b.n AS n_b, shared * total / a.n / b.n AS lift, CASE WHEN 1 - shared / a.n > 0 THEN (1 - b.n / total) / (1 - shared / a.n) END AS conviction FROM shared JOIN n a ON a.entity_id = entity_a JOIN n b ON b.entity_id = entity_b, total",
}
