"""Chat transcripts as question-and-answer chunks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsugumi import params as P
from tsugumi.functions.json import json_array
from tsugumi.functions.text import utrim
from tsugumi.plans.segments import segmented

_ITEM = "CASE WHEN schema_of_variant(x) = 'STRING' THEN variant_get(x, '$', 'string') WHEN try_variant_get(x, '$.type', 'string') = 'text' THEN try_variant_get(x, '$.text', 'string') END"


def parsed_lines(lines: DataFrame) -> DataFrame:
    """session, line_no, role, content (string, or the JSON of an array), timestamp of JSON lines (session, line_no, value); blank and invalid lines are passed over."""
    v = lines.withColumn("_v", F.try_parse_json("value")).filter("_v is not null")
    get = lambda p, t="string": F.try_variant_get("_v", p, t)
    return v.select("session", "line_no", get("$.message.role").alias("role"), get("$.message.content").alias("content"), get("$.timestamp").alias("timestamp"))


def message_text(messages: DataFrame) -> DataFrame:
    """``messages`` with ``text``: a string trimmed; of an array the items of type text and bare strings, joined with line ends."""
    df = messages.withColumn("_v", json_array(F.col("content")))
    joined = F.expr(f"array_join(filter(transform(try_variant_get(_v, '$', 'array<variant>'), x -> {_ITEM}), t -> t IS NOT NULL), '\\n')")
    return df.withColumn("text", utrim(F.coalesce(F.when(F.col("_v").isNotNull(), joined), F.col("content")))).drop("_v")


def truncated(c, limit: int = P.MAX_MESSAGE_CHARS):
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit), F.lit("...")))


def qa_chunks(messages: DataFrame, least: int = P.MIN_MESSAGE_CHARS, limit: int = P.MAX_MESSAGE_CHARS) -> DataFrame:
    """session, chunk_index, content, timestamp of messages (session, ord, id, role, text, timestamp), in order of ord and id.

    Kept are user and assistant messages of at least ``least`` characters. A user message followed by an
    assistant message is a pair, ``Q: ...`` and ``A: ...`` in one chunk, or two if longer than twice
    ``limit``; others stand alone.
    """
    kept = messages.filter(F.col("role").isin("user", "assistant") & (F.char_length("text") >= least))
    near = segmented(kept, ["session"], ["ord", "id"], following=["role", "text"], preceding=["role"])
    user, paired = F.col("role") == "user", F.col("next_role") == "assistant"
    q, a = F.concat(F.lit("Q: "), truncated(F.col("text"), limit)), F.concat(F.lit("A: "), truncated(F.col("next_text"), limit))
    both = F.concat(F.lit("Q: "), F.col("text"), F.lit("\nA: "), F.col("next_text"))
    wide = F.char_length("text") + F.char_length("next_text") > 2 * limit
    parts = F.when(user & paired, F.when(wide, F.array(q, a)).otherwise(F.array(both))).when(user, F.array(q)).when(F.coalesce(F.col("previous_role") != "user", F.lit(True)), F.array(truncated(F.col("text"), limit)))
    made = near.select("session", "ord", "id", "timestamp", parts.alias("parts")).filter("parts is not null").withColumn("n", F.size("parts").cast("long"))
    placed = segmented(made, ["session"], ["ord", "id"], sums=["n"])
    return placed.select("session", "before_n", "timestamp", F.posexplode("parts").alias("k", "content")).select("session", (F.col("before_n") + F.col("k")).alias("chunk_index"), "content", "timestamp")


def session_documents(chunks: DataFrame) -> DataFrame:
    """file_path (``session:`` and the name), status, created and updated (first and last known time), chunks of every session with a chunk."""
    at = F.when(F.col("timestamp").isNotNull(), F.col("chunk_index"))
    agg = chunks.groupBy("session").agg(F.min_by("timestamp", at).alias("created"), F.max_by("timestamp", at).alias("updated"), F.count(F.lit(1)).alias("chunks"))
    return agg.select(F.concat(F.lit("session:"), "session").alias("file_path"), F.lit("current").alias("status"), "created", "updated", "chunks")
