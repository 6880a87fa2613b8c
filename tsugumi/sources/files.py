"""Files of a tree as rows, under an ignore policy in gitignore syntax."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsugumi.plans.bounds import broadcast_if_small

#: Rows of one table of a WordNet file, which the driver reads.
MAX_WORDNET = 5_000_000
FORCED = (".git", ".tsugumi")


def rule_regex(pattern: str) -> tuple[str, bool, bool] | None:
    """(regular expression over a relative path, negated, directories only) of one line of an ignore file; None for blanks and comments."""
    line = pattern.rstrip("\n")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    directory = line.endswith("/")
    body = line.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i) and i + 2 == len(body):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1).replace("\\", r"\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$", negated, directory


@dataclass
class IngestPolicy:
    """Accepts relative paths with an allowed extension (exact case) that no rule ignores; the last rule that matches a path or one of its parents decides, and an ignored parent can't be undone."""

    extensions: tuple[str, ...] = ("md",)
    rules: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.compiled = [(re.compile(x), n, d) for x, n, d in filter(None, map(rule_regex, self.rules))]

    def ignored(self, path: str) -> bool:
        parts = path.split("/")
        if path.startswith(("/", "..")) or any(p in FORCED for p in parts):
            return True
        for k in range(1, len(parts) + 1):
            part, last = "/".join(parts[:k]), None
            for regex, negated, directory in self.compiled:
                # A path that is gone may have been a directory, so rules for directories count for it too.
                if regex.match(part):
                    last = not negated
            if last:
                return True
        return False

    def accepts(self, path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        return "." in name[1:] and name.rsplit(".", 1)[-1] in self.extensions and not self.ignored(path)

    def column(self, path: Column) -> Column:
        """The same test as one expression, so that a listing is filtered where it is read."""
        ok = path.rlike(rf"\.(?:{'|'.join(map(re.escape, self.extensions))})$") & ~path.rlike(r"(?:^|/)(?:" + "|".join(map(re.escape, FORCED)) + r")(?:/|$)") & ~path.rlike(r"^(?:/|\.\.)")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda k: F.array_join(F.slice(F.split(path, "/"), F.lit(1), k), "/"))

        def gone(part: Column) -> Column:
            last = F.lit(False)
            for regex, negated, _ in self.compiled:
                last = F.when(part.rlike(regex.pattern), F.lit(not negated)).otherwise(last)
            return last

        return ok & ~F.exists(prefixes, gone) if self.compiled else ok


def policy_of(root: str, extensions: tuple[str, ...] = ("md",), gitignore: bool = True, project: str = ".tsugumiignore") -> IngestPolicy:
    """The policy of a tree: its .gitignore first, then the project's own file, whose rules win."""
    rules: list[str] = []
    for name in ([".gitignore"] if gitignore else []) + [project]:
        try:
            with open(os.path.join(root, name), encoding="utf-8") as f:
                rules += f.read().split("\n")
        except OSError:
            pass
    return IngestPolicy(extensions, rules)


def roots(root: str, configured: Iterable[str] | None = None, policy: IngestPolicy | None = None) -> list[str]:
    """Directories to walk: the configured ones that exist and are not ignored, else the root's immediate subdirectories."""
    names = list(configured) if configured is not None else sorted(e.name for e in os.scandir(root) if e.is_dir(follow_symlinks=False))
    return [n for n in names if os.path.isdir(os.path.join(root, n)) and not (policy or IngestPolicy()).ignored(n)]


def _real(base: str, directories: Iterable[str]) -> tuple[list[str], list[str]]:
    """(directories below ``directories`` that no symbolic link leads to, files in them that are symbolic links), as Spark's listing follows links. Only names are held."""
    folders, links = [], []
    for d in directories:
        for at, below, names in os.walk(os.path.join(base, d)):
            if os.path.islink(at):
                continue
            below[:] = sorted(n for n in below if not os.path.islink(os.path.join(at, n)))
            folders.append(at)
            links += [os.path.join(at, n) for n in names if os.path.islink(os.path.join(at, n))]
    return folders, links


def read_files(spark: SparkSession, root: str, directories: list[str], policy: IngestPolicy) -> DataFrame:
    """file_path (relative), text, file_hash (SHA-256 of the bytes) of the accepted files; symbolic links to files and directories are not followed."""
    base = os.path.abspath(root)
    folders, links = _real(base, directories)
    if not folders:
        return spark.createDataFrame([], "file_path string, text string, file_hash string")
    files = spark.read.format("binaryFile").load(folders)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/", "")
    kept = files.withColumn("file_path", path).filter(policy.column(F.col("file_path")))
    if links:
        linked = spark.createDataFrame([(os.path.relpath(p, base),) for p in links], "file_path string")
        kept = kept.join(broadcast_if_small(linked), "file_path", "left_anti")
    return kept.select("file_path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("file_hash"))


def listed_paths(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """file_path of lines: trimmed, without blanks and repeats."""
    return spark.createDataFrame([(p,) for p in dict.fromkeys(x.strip() for x in lines) if p], "file_path string")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word of a file with one word per line; blanks and comments are passed over."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> '' AND NOT startswith(word, '#')").distinct()


def dictionary_entries(spark: SparkSession, path: str) -> DataFrame:
    """surface, pos, reading of ``surface,POS,reading`` lines."""
    parts = F.split("value", ",", 3)
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    return rows.select(F.trim(parts[0]).alias("surface"), F.trim(F.get(parts, F.lit(1))).alias("pos"), F.trim(F.get(parts, F.lit(2))).alias("reading"))


def custom_terms(spark: SparkSession, path: str) -> DataFrame:
    """name, entity_type of ``[[terms]]`` in a TOML file; names under two characters are left out, the type is custom by default, a file that can't be parsed has none."""
    import tomllib

    try:
        with open(path, "rb") as f:
            terms = tomllib.load(f).get("terms", [])
        rows = [(t["name"].strip().lower(), t.get("type", "custom")) for t in terms if len(t["name"].strip()) >= 2]
    except (OSError, tomllib.TOMLDecodeError, KeyError, AttributeError, TypeError):
        rows = []
    return spark.createDataFrame(rows, "name string, entity_type string")


def wordnet_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(words, senses) of a WordNet SQLite file: word(wordid, lemma, lang) and sense(synset, wordid). Such a file holds one language's words, some hundred thousand rows."""
    import sqlite3

    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        rows = [con.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("word", "sense")]
        if max(rows) > MAX_WORDNET:
            raise ValueError(f"{path}: more than {MAX_WORDNET} rows")
        words = con.execute("SELECT wordid, lemma, lang FROM word").fetchall()
        senses = con.execute("SELECT synset, wordid FROM sense").fetchall()
    finally:
        con.close()
    return spark.createDataFrame(words, "wordid long, lemma string, lang string"), spark.createDataFrame(senses, "synset string, wordid long")


def install_default(path: str, text: str) -> bool:
    """Writes a file that is not there yet; tells whether it did."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    try:
        with open(path, "x", encoding="utf-8") as f:
            f.write(text)
        return True
    except FileExistsError:
        return False


def write_status(path: str, status: dict) -> None:
    """A status file, replaced as a whole: readers see the old one or the new one."""
    import json

    draft = f"{path}.{os.getpid()}.tmp"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(status, f, ensure_ascii=False, indent=2)
    os.replace(draft, path)
