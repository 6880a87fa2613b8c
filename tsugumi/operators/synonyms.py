"""A symmetric relation of words with scores that fade, and what it is filled from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsugumi import params as P
from tsugumi.functions.analysis import keywords
from tsugumi.functions.text import utrim
from tsugumi.operators.retrieval import parsed_date
from tsugumi.plans.pairs import gathered, narrow_pairs, wide_pairs

COLUMNS = ["word_a", "word_b", "score", "source", "hits", "last_hit", "created"]
SCHEMA = "word_a string, word_b string, score double, source string, hits long, last_hit string, created string"


def normal(c: Column) -> Column:
    return F.lower(utrim(c))


def effective_score(as_of: str) -> Column:
    """The score, halved once per half-life of its source since the last hit, else the creation, else not at all."""
    days = F.lit(P.SYNONYM_OTHER_HALF_LIFE)
    for s, d in P.SYNONYM_HALF_LIFE.items():
        days = F.when(F.col("source") == s, F.lit(d)).otherwise(days)
    at = F.coalesce(parsed_date(F.col("last_hit")), parsed_date(F.col("created")), F.lit(as_of).cast("timestamp"))
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(at)) / 86400)
    return F.when(F.col("source").isin(*P.SYNONYM_TIMELESS), F.col("score")).otherwise(F.col("score") * F.pow(F.lit(0.5), age / days))


def both_ways(synonyms: DataFrame, as_of: str) -> DataFrame:
    """word, synonym, effective of the relation in both directions."""
    e = effective_score(as_of).alias("effective")
    return synonyms.select(F.col("word_a").alias("word"), F.col("word_b").alias("synonym"), e).unionByName(synonyms.select(F.col("word_b").alias("word"), F.col("word_a").alias("synonym"), e))


def looked_up(synonyms: DataFrame, words: DataFrame, as_of: str, per_word: int = P.SYNONYMS_PER_TOKEN, threshold: float = P.SYNONYM_THRESHOLD) -> DataFrame:
    """word, synonym, effective: at most ``per_word`` synonyms of each of ``words`` (word) at or above the threshold, ties by synonym."""
    found = both_ways(synonyms, as_of).filter(F.col("effective") >= threshold).join(words.select(normal(F.col("word")).alias("word")).distinct(), "word")
    order = Window.partitionBy("word").orderBy(F.desc("effective"), "synonym")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_word).drop("r")


def expand(synonyms: DataFrame, tokens: DataFrame, as_of: str) -> DataFrame:
    """synonym, position: synonyms of the query's tokens (position, word) that are no tokens themselves, once each, in token order."""
    own = tokens.select("position", normal(F.col("word")).alias("word"))
    found = looked_up(synonyms, own, as_of).join(own, "word").join(own.select(F.col("word").alias("synonym")), "synonym", "left_anti")
    return found.groupBy("synonym").agg(F.min(F.struct("position", -F.col("effective"))).alias("m")).select("synonym", F.col("m.position").alias("position"))


def canonical(pairs: DataFrame) -> DataFrame:
    """Pairs in normal form and order, without equal or blank words, scores capped."""
    p = pairs.withColumns({"_a": normal(F.col("word_a")), "_b": normal(F.col("word_b"))}).filter("_a <> _b AND _a <> '' AND _b <> ''")
    return p.withColumns({"word_a": F.least("_a", "_b"), "word_b": F.greatest("_a", "_b"), "score": F.least("score", F.lit(P.SYNONYM_CAP))}).select(*COLUMNS)


def upserted(synonyms: DataFrame, more: DataFrame) -> DataFrame:
    """The relation after an upsert: the higher score with its source (ties keep the old), other columns of the old row."""
    rows = synonyms.select(*COLUMNS, F.lit(1).alias("old")).unionByName(canonical(more).withColumn("old", F.lit(0)))
    best, first = F.struct("score", "old", "source"), F.struct("old", F.struct("hits", "last_hit", "created").alias("kept"))
    agg = rows.groupBy("word_a", "word_b").agg(F.max(best).alias("b"), F.max_by(first["kept"], F.col("old")).alias("k"))
    return agg.select("word_a", "word_b", F.col("b.score").alias("score"), F.col("b.source").alias("source"), "k.hits", "k.last_hit", "k.created")


def learned_pairs(messages: DataFrame, text: str, created: str, most: int = P.NOUNS_PER_MESSAGE) -> DataFrame:
    """word_a < word_b pairs of the first ``most`` nouns of each text (two characters or more, no digits), with how many texts have them, score and source chat."""
    nouns = F.slice(F.array_distinct(F.filter(F.transform(keywords(F.col(text)), F.lower), lambda x: F.char_length(x) >= 2)), 1, most)
    pair = F.expr("explode(flatten(transform(items, (x, i) -> transform(slice(items, i + 2, size(items)), y -> struct(least(x, y) AS word_a, greatest(x, y) AS word_b)))))")
    each = messages.select(nouns.alias("items")).select(pair.alias("p")).groupBy("p.word_a", "p.word_b").agg(F.count(F.lit(1)).alias("texts"))
    return each.select("word_a", "word_b", "texts", F.lit(P.SYNONYM_LEARNED).alias("score"), F.lit("chat").alias("source"), F.lit(0).cast("long").alias("hits"), F.lit(None).cast("string").alias("last_hit"), F.lit(created).alias("created"))


def synset_pairs(words: DataFrame, senses: DataFrame, lang: str = "jpn") -> DataFrame:
    """word_a < word_b of lemmas of two characters or more that share a synset, once each. words (wordid, lemma, lang), senses (synset, wordid). A wide synset is paired in blocks."""
    own = senses.join(words.filter((F.col("lang") == lang) & (F.char_length("lemma") >= 2)), "wordid")
    narrow, wide = gathered(own.select(F.col("synset").alias("basket"), F.col("lemma").alias("item")))
    pairs = narrow_pairs(narrow.select("items").distinct()).unionByName(wide_pairs(wide).select("lo", "hi"))
    return pairs.select(F.col("lo").alias("word_a"), F.col("hi").alias("word_b")).distinct()


def parsed_pairs(lines: DataFrame) -> DataFrame:
    """word_a < word_b of lines ``a,b`` (column value); comments, blank lines and lines without both words are passed over; split at the first comma only."""
    kept = lines.filter(~F.col("value").rlike(r"^\s*(#|$)")).select(F.split("value", ",", 2).alias("p")).filter("size(p) = 2").select(normal(F.col("p")[0]).alias("a"), normal(F.col("p")[1]).alias("b"))
    return kept.filter("a <> '' AND b <> '' AND a <> b").select(F.least("a", "b").alias("word_a"), F.greatest("a", "b").alias("word_b")).distinct()


def sync_actions(synonyms: DataFrame, wanted: DataFrame) -> DataFrame:
    """word_a, word_b, action of a sync with a user's list: insert what the relation lacks, delete user pairs that left the list; other sources stay."""
    missing = wanted.join(synonyms, ["word_a", "word_b"], "left_anti").select("word_a", "word_b", F.lit("insert").alias("action"))
    stale = synonyms.filter("source = 'user'").join(wanted, ["word_a", "word_b"], "left_anti").select("word_a", "word_b", F.lit("delete").alias("action"))
    return missing.unionByName(stale)


def hit(synonyms: DataFrame, pairs: DataFrame, at: str) -> DataFrame:
    """The relation after a hit on each of ``pairs`` (word_a, word_b in canonical order)."""
    marked = pairs.select("word_a", "word_b").distinct().withColumn("_hit", F.lit(True))
    return synonyms.join(marked, ["word_a", "word_b"], "left").withColumns({"hits": F.col("hits") + F.when(F.col("_hit"), 1).otherwise(0), "last_hit": F.when(F.col("_hit"), F.lit(at)).otherwise(F.col("last_hit"))}).select(*COLUMNS)


def without_stale(synonyms: DataFrame, as_of: str, days: int = P.SYNONYM_STALE_DAYS) -> DataFrame:
    """The relation without pairs never hit, of no lasting source, created more than ``days`` ago."""
    old = parsed_date(F.col("created")) < F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")
    return synonyms.filter(~F.coalesce((F.col("hits") == 0) & ~F.col("source").isin(*P.SYNONYM_TIMELESS) & old, F.lit(False)))
