"""Markdown notes as front matter, sections and chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsugumi import params as P

_FRONT = re.compile(r"\A---\s*\n(.*?)\n---\s*\n", re.S)
FRONT = "status string, created string, updated string, tags array<string>, superseded_by string, body string"


def _scalar(value) -> str | None:
    return None if value in (None, "", "~") or not isinstance(value, str) or value.lower() == "null" else value


def front_matter(text: str) -> tuple[dict, str]:
    """Fields of a front matter block and the rest of the text; a block that is no mapping gives no fields but is still cut off."""
    m = _FRONT.match(text)
    fields = {"status": None, "created": None, "updated": None, "tags": [], "superseded_by": None}
    if not m:
        return fields, text
    import yaml

    try:
        data = yaml.load(m[1], Loader=yaml.BaseLoader)  # all scalars as written
    except yaml.YAMLError:
        data = None
    if isinstance(data, dict):
        fields |= {k: _scalar(data.get(k)) for k in ("status", "created", "updated", "superseded_by")}
        tags = data.get("tags")
        fields["tags"] = [t for t in tags if _scalar(t) is not None] if isinstance(tags, list) else []
    return fields, text[m.end() :]


def _sections(body: str, level: int) -> list[tuple[str, str]]:
    """(heading, text) of a body split at headings of one level; text before the first has no heading."""
    marks = list(re.finditer(rf"^#{{{level}}}\s+(.+)", body, re.M))
    out = [("", body[: marks[0].start()] if marks else body)]
    for m, after in zip(marks, [*[x.start() for x in marks[1:]], len(body)]):
        out.append((m[1].strip(), body[m.end() : after]))
    return [(h, t) for h, t in out if h or t.strip()]


def _merged(text: str, limit: int) -> list[str]:
    out: list[str] = []
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if out and len(out[-1].encode()) + len(p.encode()) + 2 <= limit:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def chunk_note(body: str, directory: str, name: str, limit: int = P.MAX_CHUNK_BYTES) -> list[tuple[str, str]]:
    """(section path, content) of a note: by second-level headings, third-level where a section is over ``limit`` bytes, then merged paragraphs, of which one over the limit stays whole."""
    if not body.strip():
        return []
    first = next(line for line in body.split("\n") if line.strip())
    title = first[2:].strip() if first.startswith("# ") else name
    out: list[tuple[str, str]] = []

    def add(path: str, text: str) -> None:
        if text.strip():
            out.append((path, f"【{directory}/{name}】{path}\n{text.strip()}"))

    for h2, text in _sections(body, 2):
        path = f"{title} > {h2}" if h2 else title
        if len(text.encode()) <= limit:
            add(path, text)
            continue
        for h3, part in _sections(text, 3):
            deep = f"{path} > {h3}" if h3 else path
            for piece in [part] if len(part.encode()) <= limit else _merged(part, limit):
                add(deep, piece)
    return out


def directory_label(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def source_type(directory: Column) -> Column:
    last = F.element_at(F.split(directory, "/"), -1)
    known = F.create_map(*[F.lit(x) for kv in P.SOURCE_TYPES.items() for x in kv])
    return F.coalesce(known[last], last)


def paragraphs(text: Column) -> Column:
    from tsugumi.functions.text import utrim

    return F.filter(F.transform(F.split(text, r"\n\s*\n"), utrim), lambda x: x != "")


def greedy(parts: Column, limit: int = P.MAX_CHUNK_BYTES) -> Column:
    """An array of texts merged from the left, blank line between, while a piece stays within ``limit`` bytes."""
    empty = F.array().cast("array<string>")
    last = lambda a: F.element_at(a, -1)
    fits = lambda a, x: (F.size(a) > 0) & (F.octet_length(F.when(F.size(a) > 0, last(a))) + F.octet_length(x) + 2 <= limit)
    step = lambda a, x: F.when(fits(a, x), F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(F.when(F.size(a) > 0, last(a)), F.lit("\n\n"), x)))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(parts, empty, step)


def _notes(limit: int):
    kind = pa.list_(pa.struct([("section_path", pa.string()), ("content", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, dirs, names = (batch.column(i).to_pylist() for i in range(4))
            fronts = [front_matter(t) for t in texts]
            cols = {k: [f[k] for f, _ in fronts] for k in ("status", "created", "updated", "tags", "superseded_by")}
            made = [chunk_note(b, d, n, limit) for (_, b), d, n in zip(fronts, dirs, names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.list_(pa.string()) if k == "tags" else pa.string()) for k, v in cols.items()], pa.array(made, kind)], names=["doc_id", *cols, "parts"])

    return run


def parsed_notes(documents: DataFrame, limit: int = P.MAX_CHUNK_BYTES) -> DataFrame:
    """doc_id, front matter fields, parts (array of section_path and content) of documents (doc_id, text, file_path); null text gives no row."""
    rows = documents.filter("text is not null and file_path is not null").select("doc_id", "text", directory_label(F.col("file_path")).alias("d"), file_stem(F.col("file_path")).alias("n"))
    return rows.mapInArrow(_notes(limit), "doc_id long, status string, created string, updated string, tags array<string>, superseded_by string, parts array<struct<section_path string, content string>>")


def note_chunks(documents: DataFrame, limit: int = P.MAX_CHUNK_BYTES) -> DataFrame:
    """doc_id, chunk_index, section_path, content, content_hash of the chunks of every note."""
    each = parsed_notes(documents, limit).select("doc_id", F.posexplode("parts").alias("chunk_index", "p"))
    return each.select("doc_id", "chunk_index", "p.section_path", "p.content", F.sha2(F.encode("p.content", "UTF-8"), 256).alias("content_hash"))
