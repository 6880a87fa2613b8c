"""Documents with HTML, Markdown, wiki and LaTeX marks as clean text with one plain notation of structure.

Marks are taken out in order: context line, code, comments, tables and formulas first, as what stands in
them must not be read as marks, then tags, wiki marks, LaTeX commands and Markdown. Kept structure is
written as ``# heading``, ``- item``, ``1. item``, ``> quote``, ``a | b`` rows, fenced code and ``$formula$``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import name2codepoint
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsugumi.plans.bounds import broadcast_if_small

KINDS = ("html", "markdown", "wiki", "latex")

# Element names of HTML and its predecessors.
ELEMENTS = """a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas
caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font
footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark
math menu meta meter nav noframes noscript object ol optgroup option output p param picture pre progress q ref rp rt ruby s samp script
section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr
track tt u ul var video wbr""".split()
_BARE = "disabled|checked|selected|hidden|open|async|defer|controls|nowrap|noshade|border|compact|required|readonly|multiple|autoplay|loop"
_ATTRIBUTE = rf"(?:\s+(?:[\w:.-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+)|(?:{_BARE})(?=[\s/>])))"

_CONTEXT = re.compile(r"\A\ufeff?【[^】\n]*】[^\n]*(?:\n|\Z)")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\n`]*)\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$\n?|\Z)", re.M | re.S)
_CODE_TAG = re.compile(r"<(pre|script|style|code|textarea|samp)\b[^<>]*>(.*?)</\1\s*>", re.I | re.S)
_NOWIKI = re.compile(r"<(nowiki|syntaxhighlight|source)\b[^<>]*>(.*?)</\1\s*>", re.I | re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(.*?)\\end\{\1\*?\}", re.S)
_VERB = re.compile(r"\\verb\*?([^\w\s*])([^\n]*?)\1")
_INLINE = re.compile(r"(?<![`\\])(`+)(?!`)([^\n]+?)(?<!`)\1(?!`)")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)
_DECLARATION = re.compile(r"<(?:!(?:doctype|element|entity|attlist)\b[^<>]*|\?xml\b[^<>]*\??)>", re.I)
_TAG = re.compile(rf"<(/?)((?:{'|'.join(sorted(ELEMENTS, key=len, reverse=True))})|[a-z]\w*:[a-z]\w*)({_ATTRIBUTE}*)\s*/?>", re.I)
_ENTITY = re.compile(rf"&(?:#\d{{1,7}}|#[xX][0-9A-Fa-f]{{1,6}}|(?:{'|'.join(sorted({*name2codepoint, 'apos'}, key=len, reverse=True))}));")
_BRACE_TABLE = re.compile(r"^[ \t:]*\{\|([^\n]*)\n(.*?)^[ \t]*\|\}", re.M | re.S)
_PARAMETER = re.compile(r"\{\{\{[^{}\n]+\}\}\}")
_TEMPLATE = re.compile(r"\{\{(?![\s{])([^{}]+)\}\}")
_EXTERNAL = re.compile(r"\[(?:https?|ftp)://[^\s\]\[]+(?:[ \t]+([^\]\[\n]*))?\](?!\()")
_BRACKET = re.compile(r"\[\[(?!\s*[\d,\s]*\]\])([^\[\]\n]+)\]\]")
_APOSTROPHES = re.compile(r"(?<!')('{5}|'{3}|'{2})(?!')(?=\S)([^\n]*?[^\s'])\1(?!')")
# The patterns of lines start with the line end before, which makes the search for them fast.
_EQUALS = re.compile(r"\n(={1,6})[ \t]*([^=\s](?:[^\n]*[^=\s])?)[ \t]*\1[ \t]*$", re.M)
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z]+)\*?\}((?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?)")
_MATH_ENVIRONMENT = re.compile(r"\\begin\{(equation|align|gather|multline|displaymath|math|eqnarray)(\*?)\}(.*?)\\end\{\1\2\}", re.S)
_DISPLAY = re.compile(r"(?<!\\)\$\$(.+?)(?<!\\)\$\$|\\\[(.+?)\\\]", re.S)
_ROUND = re.compile(r"\\\((.+?)\\\)", re.S)
_DOLLAR = re.compile(r"(?<![\\$])\$(?=[^\s$])([^$\n]*?[^\s\\$])\$(?![\d$])|(?<![\\$])\$([^\s\\$])\$(?![\d$])")
_SECTION = re.compile(r"\\(part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_LINE_COMMAND = re.compile(r"^[ \t]*\\(item|hline|maketitle|noindent|tableofcontents|newpage|clearpage|centering|par|bigskip|medskip|smallskip|toprule|midrule|bottomrule)(?![A-Za-z])[ \t]*", re.M)
_ESCAPE = re.compile(r"(?<![\\A-Za-z:])\\([%&$#_,;])")
_SETEXT = re.compile(r"\n(?!\s*[>|#*+-])([^\n]*\S)[ \t]*\n(=+|-{2,})[ \t]*$", re.M)
_ATX = re.compile(r"\n {0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
_RULE = re.compile(r"\n {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M)
_DELIMITER = re.compile(r"^(?=[^\n]*\|)[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$\n?", re.M)
_ROW = re.compile(r"^[ \t]*\|(.+)\|[ \t]*$", re.M)
_BULLET = re.compile(r"\n([ \t]*)[-*+][ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)", re.M)
_NUMBERED = re.compile(r"\n([ \t]*)(\d{1,9})[.)][ \t]+(?=\S)", re.M)
_QUOTE = re.compile(r"\n {0,3}>[ \t]?(?=[^\n])", re.M)
_FOOTNOTE = re.compile(r"\[\^([^\]\s]+)\]:?")
_IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\([^()\n]*\)")
_LINK = re.compile(r"\[([^\[\]\n]*)\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)")
_DEFINITION = re.compile(r"^ {0,3}\[[^\]\n^]+\]:[ \t]+\S+[^\n]*$", re.M)
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_STARS = re.compile(r"\*(?<![*\\]\*)(?:(?<!\w\*)(\*{0,2})(?=[^\s*])([^*\n]*[^\s*])\*\1(?![*\w])|(\*{1,2})(?=[^\s*])([^*\n]*[^\s*])\*\3(?!\*))")
_UNDERSCORES = re.compile(r"_(?<![\\\w]_)(_{0,2})(?=[^\s_])([^\n]*?[^\s_])_\1(?![_\w])", re.A)
_STRIKE = re.compile(r"(?<![~\\])~~(?=[^\s~])([^~\n]*[^\s~])~~(?!~)")
_SLOT = re.compile("\ue000(\\d+)\ue001")

_BLOCK = {"p", "div", "br", "tr", "ul", "ol", "table", "section", "article", "header", "footer", "hr", "body", "html", "details", "summary", "dl", "dt", "dd", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
_SILENT = {"label", "ref", "cite", "vspace", "hspace", "includegraphics", "bibliography", "usepackage", "documentclass"}


def convert(text: str) -> tuple[str, list[str]]:
    """The clean text, and the kinds of markup that were found, in the order of ``KINDS``."""
    found: set[str] = set()
    slots: list[str] = []

    def keep(value: str) -> str:
        slots.append(value)
        return f"\ue000{len(slots) - 1}\ue001"

    def sub(pattern: re.Pattern, kind: str, to) -> None:
        nonlocal t
        t, n = pattern.subn(to, t)
        if n:
            found.add(kind)

    t = text
    for a, b in (("\r\n", "\n"), ("\r", "\n"), ("\ue000", " "), ("\ue001", " "), ("\ue002", " ")):
        t = t.replace(a, b)
    t = "\n" + _CONTEXT.sub("", t, count=1)
    fence = lambda body: keep(f"```\n{body.strip(chr(10))}\n```") + "\n"
    if "```" in t or "~~~" in t:
        sub(_FENCE, "markdown", lambda m: fence(m[3]))
    if "\\" in t:
        sub(_VERBATIM, "latex", lambda m: fence(m[2]))
        sub(_VERB, "latex", lambda m: keep(m[2]))
    if "<" in t:
        sub(_NOWIKI, "wiki", lambda m: keep(m[2]))
        sub(_CODE_TAG, "html", lambda m: "" if m[1].lower() in ("script", "style") else fence(unescape(re.sub("<[^<>]*>", "", m[2]))) if m[1].lower() == "pre" else keep(unescape(m[2])))
    if "`" in t:
        sub(_INLINE, "markdown", lambda m: keep(m[2].strip()))
    if "<!" in t or "<?" in t:
        sub(_COMMENT, "html", "")
        sub(_CDATA, "html", lambda m: keep(m[1]))
        sub(_DECLARATION, "html", "")
    if "{|" in t:
        def brace(m: re.Match) -> str:
            rows = [" | ".join(c.strip() for c in re.split(r"\|\||!!", line.lstrip("|!"))) for line in m[2].split("\n") if line[:1] in "|!" and line.strip() and not line.startswith("|-")]
            return "\n".join(map(keep, rows)) + "\n"
        sub(_BRACE_TABLE, "wiki", brace)
    formula = lambda body: keep(f"${body.strip()}$")
    if "\\" in t or "$" in t:
        sub(_MATH_ENVIRONMENT, "latex", lambda m: formula(m[3]))
        sub(_DISPLAY, "latex", lambda m: formula(m[1] or m[2]))
        sub(_ROUND, "latex", lambda m: formula(m[1]))
        sub(_DOLLAR, "latex", lambda m: formula(m[1] or m[2]))
    if "<" in t:
        def tag(m: re.Match) -> str:
            name = m[2].lower()
            if name == "li":
                return "" if m[1] else "\n" + keep("- ")
            if name in ("td", "th"):
                return "" if m[1] else keep(" | ")
            if re.fullmatch("h[1-6]", name) and not m[1]:
                return "\n" + keep("#" * int(name[1]) + " ")
            return "\n" if name in _BLOCK else ""
        sub(_AUTOLINK, "markdown", lambda m: keep(m[1]))
        sub(_TAG, "html", tag)
    if "{{" in t:
        sub(_PARAMETER, "wiki", "")
        before = None
        while t != before:  # from the innermost template outwards; every round takes braces out
            before = t
            sub(_TEMPLATE, "wiki", "")
    if "[" in t:
        sub(_EXTERNAL, "wiki", lambda m: m[1] or "")
        sub(_BRACKET, "wiki", lambda m: "" if m[1].startswith("Category:") else m[1].rpartition("|")[2])
    if "''" in t:
        sub(_APOSTROPHES, "wiki", lambda m: m[2])
    if "\n=" in t:
        sub(_EQUALS, "wiki", lambda m: "\n" + keep("#" * len(m[1]) + " ") + m[2])
    if "\\" in t:
        sub(_SECTION, "latex", lambda m: keep("# ") + m[2])
        sub(_ENVIRONMENT, "latex", "")
        before = None
        while t != before:
            before = t
            sub(_COMMAND, "latex", lambda m: "" if m[1] in _SILENT else m[2])
        sub(_LINE_COMMAND, "latex", lambda m: keep("- ") if m[1] == "item" else "")
        if "latex" in found:
            t = re.sub(r"[ \t]*\\\\[ \t]*$", "", t, flags=re.M)
        sub(_ESCAPE, "latex", lambda m: " " if m[1] in ",;" else m[1])
    if "\n=" in t or "\n--" in t:
        sub(_SETEXT, "markdown", lambda m: "\n" + keep("# " if m[2][0] == "=" else "## ") + m[1])
    if "#" in t:
        sub(_ATX, "markdown", lambda m: "\n" + keep(m[1] + " ") + m[2])
    sub(_RULE, "markdown", "\n")
    if "|" in t and "-" in t:
        sub(_DELIMITER, "markdown", "\ue002")
        if "\ue002" in t:
            t = _ROW.sub(lambda m: " | ".join(c.strip() for c in m[1].split("|")), t.replace("\ue002", ""))
    sub(_BULLET, "markdown", lambda m: "\n" + m[1] + keep("- "))
    sub(_NUMBERED, "markdown", lambda m: "\n" + m[1] + keep(m[2] + ". "))
    if ">" in t:
        sub(_QUOTE, "markdown", lambda m: "\n" + keep("> "))
    if "[" in t:
        sub(_FOOTNOTE, "markdown", "")
        sub(_IMAGE, "markdown", lambda m: m[1])
        sub(_LINK, "markdown", lambda m: m[1])
        sub(_DEFINITION, "markdown", "")
    if "*" in t:
        sub(_STARS, "markdown", lambda m: m[2] or m[4])
    if "_" in t:
        sub(_UNDERSCORES, "markdown", lambda m: m[2])
    if "~~" in t:
        sub(_STRIKE, "markdown", lambda m: m[1])
    if "&" in t:
        sub(_ENTITY, "html", lambda m: unescape(m[0]))
    while "\ue000" in t:
        t = _SLOT.sub(lambda m: slots[int(m[1])], t)
    if " \n" in t or "\t\n" in t:
        t = re.sub(r"[ \t]+\n", "\n", t)
    while "\n\n\n" in t:
        t = t.replace("\n\n\n", "\n\n")
    t = t.strip()
    return t, [k for k in KINDS if k in found]


def _convert(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [convert(t) for t in batch.column(1).to_pylist()]
            arrays, names = [batch.column(0), pa.array([k for _, k in done], pa.list_(pa.string()))], ["chunk_id", "kinds"]
            if texts:
                arrays.append(pa.array([t for t, _ in done], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def cleaned(chunks: DataFrame) -> DataFrame:
    """chunk_id, kinds, text (clean) of every chunk; null content gives no row, content without markup itself without the context line and outer blanks."""
    return chunks.select("chunk_id", "content").filter("content is not null").mapInArrow(_convert(True), "chunk_id long, kinds array<string>, text string")


def markup_kinds(chunks: DataFrame) -> DataFrame:
    """chunk_id, markup: a row for each kind of markup that the conversion of the chunk met."""
    kinds = chunks.select("chunk_id", "content").filter("content is not null").mapInArrow(_convert(False), "chunk_id long, kinds array<string>")
    return kinds.select("chunk_id", F.explode("kinds").alias("markup"))


class _Containers(HTMLParser):
    """What every container of a page is worth, by its generalised path of tags and classes.

    Text counts for the innermost division around it (a paragraph, list or table passes its text on to the division that
    holds it, or stands for itself if none does), and half for the next one outwards; text of links counts against both.
    """

    VOID = {"br", "hr", "img", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr"}
    DIVISIONS = {"div", "section", "article", "main", "body", "aside", "nav", "header", "footer", "form", "fieldset", "details", "center", "html"}
    BLOCKS = {"p", "pre", "blockquote", "ul", "ol", "dl", "table", "li", "dd", "dt", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "figure"}

    def __init__(self):
        super().__init__()
        self.path: list[str] = []
        self.worth: dict[str, float] = {}

    def handle_starttag(self, tag, attrs):
        if tag not in self.VOID:
            names = re.sub(r"\d+", "#", " ".join(v for k, v in attrs if k == "class" and v)).split()
            self.path.append(".".join([tag, *sorted(names)]))

    def handle_endtag(self, tag):
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i].split(".")[0] == tag:
                del self.path[i:]
                return

    def hidden(self) -> bool:
        return any(p.split(".")[0] in ("script", "style") for p in self.path)

    def handle_data(self, data):
        n = len(data.strip())
        if not n or not self.path or self.hidden():
            return
        tags = [p.split(".")[0] for p in self.path]
        around = [i for i in range(len(tags) - 1, -1, -1) if tags[i] in self.DIVISIONS] or [i for i, t in enumerate(tags) if t in self.BLOCKS][:1]
        for i, part in zip(around, (1.0, 0.5)):
            name = "/".join(self.path[: i + 1])
            self.worth[name] = self.worth.get(name, 0.0) + n * (-part if "a" in tags else part)

    def best(self) -> str | None:
        """The container this page votes for: worth most, of equals the longer path, then the one that sorts last."""
        return max((p for p, w in self.worth.items() if w > 0), key=lambda p: (self.worth[p], len(p), p), default=None)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for chunk, host, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            page = _Containers()
            page.feed(text)
            page.close()
            own = page.best()
            rows += [(chunk, host, path, worth, path == own) for path, worth in page.worth.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()))], names=["chunk_id", "host", "path", "worth", "chosen"])


def _pages(chunks: DataFrame) -> DataFrame:
    host = F.regexp_extract("content", r"^【([^/】\n]+)", 1)
    return chunks.filter(F.col("content").contains("<")).select(F.col("chunk_id").alias("chunk_id"), host.alias("host"), F.regexp_replace("content", r"^【[^】\n]*】[^\n]*\n?", "").alias("content"))


def _scored(chunks: DataFrame) -> DataFrame:
    """chunk_id, host, path, worth, chosen of every container of every page."""
    return _pages(chunks).mapInArrow(_score, "chunk_id long, host string, path string, worth double, chosen boolean")


def _best() -> Column:
    """The order of a host's paths: most votes, then most worth, then the longer path, then the one that sorts last."""
    return F.struct("votes", "worth", F.length("path").alias("n"), F.col("path"))


def host_paths(chunks: DataFrame) -> DataFrame:
    """host, path, votes, worth of every generalised container path that a page of the host votes for: votes are pages, worth is that of the container in them.

    The host of a chunk is the first directory of its context line (empty without one). Scripts and styles are no text.
    """
    return _scored(chunks).filter("chosen").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("worth").alias("worth"))


def consensus_paths(chunks: DataFrame) -> DataFrame:
    """host, path, votes, worth: the path that most pages of a host vote for.

    Votes and winners are aggregates, so no host is gathered in one place.
    """
    return host_paths(chunks).groupBy("host").agg(F.max_by(F.struct("path", "votes", "worth"), _best()).alias("b")).select("host", "b.path", "b.votes", "b.worth")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    class Held(_Containers):
        def __init__(self, path: str):
            super().__init__()
            self.wanted, self.texts = path, []

        def handle_data(self, data):
            own = "/".join(self.path)
            if (own == self.wanted or own.startswith(self.wanted + "/")) and not self.hidden():
                self.texts.append(data)

    for batch in batches:
        rows = []
        for chunk, content, path in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = ""
            if path is not None:
                page = Held(path)
                page.feed(content)
                page.close()
                text = convert("".join(page.texts))[0]
            if not text:
                text, path = convert(content)[0], None
            if text:
                rows.append((chunk, path, text))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["chunk_id", "path", "text"])


def extracted(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """chunk_id, path, text: what stands under the best path of its host that the page has; the whole converted page, with a null path, if it has none.

    ``paths`` (host, path, votes, worth) has any number of rows per host, see ``host_paths``. Pages without any text give no row.
    """
    ranked = broadcast_if_small(paths.select("host", "path", "votes", "worth"))
    chosen = _scored(chunks).filter("worth > 0").select("chunk_id", "host", "path").join(ranked, ["host", "path"]).groupBy("chunk_id").agg(F.max_by("path", _best()).alias("path"))
    held = _pages(chunks).join(chosen, "chunk_id", "left").select("chunk_id", "content", "path")
    return held.mapInArrow(_extract, "chunk_id long, path string, text string")
