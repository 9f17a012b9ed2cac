"""Program text: blanking out comments and the contents of strings, and scanning what is left for banned constructs."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What code is made of, up to the next place where something else can begin.
_CODE = re.compile(r"[^/'\"`}]+")
_LINE, _BLOCK = re.compile(r"//[^\n]*\n"), re.compile(r"/\*.*?\*/", re.DOTALL)
_QUOTED = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*{q}", re.DOTALL) for q in "'\""}
#: A template's text up to its end or its next expression.
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(`|\$\{)", re.DOTALL)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])*/", re.DOTALL)
#: A slash begins a pattern after these, as no value can end there; elsewhere it divides.
_BEFORE_REGEX = re.compile(r"(?:^|[({\[,;:=&|!?+%*/^~-]|\b(?:return|typeof|case|in|of|delete|void|await|yield))\s*\Z")


def _blank(text: str) -> str:
    """Blanks in the place of all characters but line breaks; an escaped character goes with its backslash."""
    return re.sub(r"[^\n]", " ", re.sub(r"\\.", "  ", text, flags=re.DOTALL))


def blanked(text: str) -> str:
    """`text` with comments and the contents of strings and templates as blanks, each character in its place.

    Expressions inside templates and patterns are code. Where a string, pattern, template or comment does not end, nothing
    is certain and the whole text is given back as it is.
    """
    out: list[str] = []
    nested: list[bool] = []  # of the templates that are open, one entry each
    at, n = 0, len(text)

    def tail() -> str:
        """The end of what is written, as far as it decides what a slash means."""
        k, end = len(out), ""
        while k and not end.strip():
            k -= 1
            end = out[k] + end
        if k and re.fullmatch(r"\w+\s*", end):
            end = out[k - 1][-12:] + end
        return end

    def template(start: int) -> int | None:
        """Copies a template's text from `start` on, to its end or its next expression."""
        m = _TEMPLATE.match(text, start)
        if m is None:
            return None
        out.append(_blank(m[0][: -len(m[1])]) + ("`" if m[1] == "`" else "  "))
        if m[1] == "`":
            nested.pop()
        return m.end()

    while at < n:
        c, two = text[at], text[at : at + 2]
        m = None
        if c == "`" or (c == "}" and nested):
            if c == "`":
                nested.append(True)
            out.append(c)
            end = template(at + 1)
            if end is None:
                return text
            at = end
            continue
        if two in ("//", "/*"):
            m = (_LINE if two == "//" else _BLOCK).match(text, at)
            if m is None:
                return text
            out.append(_blank(m[0].replace("\\", " ")))
        elif c in _QUOTED:
            m = _QUOTED[c].match(text, at)
            if m is None:
                return text
            out.append(c + _blank(m[0][1:-1]) + c)
        elif c == "/" and _BEFORE_REGEX.search(tail()):
            m = _REGEX.match(text, at)
            if m is None:
                return text
            out.append(m[0])
        else:
            m = _CODE.match(text, at)
            out.append(m[0] if m else c)
        at = m.end() if m else at + 1
    return text if nested else "".join(out)


@F.pandas_udf(T.StringType())
def blanked_source(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same for a column; each distinct text of a batch is scanned once."""
    for text in texts:
        done = {x: blanked(x) for x in text.dropna().unique()}
        yield text.map(done, na_action="ignore")


#: Constructs that generated programs may not hold, by name. Fixed values.
BANS = {
    "eval": r"\b(?:window\s*\.\s*)?eval\s*\(",
    "function-synthesis": r"\bnew\s+Function\s*\(|\bFunction\s*\(",
    "implied-eval": r"\b(?:setTimeout|setInterval|requestAnimationFrame)\s*\(\s*['\"`]",
    "with": r"(^|[;{}])\s*with\s*\(",
    "await": r"\bawait\s|\bfor\s+await\s*[(/]",
    "for-in": r"\bfor\s*\(\s*(?:(?:const|let|var)\s+)?[A-Za-z_$][\w$]*(?:\s*:\s*[^)]+?)?\s+in\s+",
    "proxy": r"\bnew\s+Proxy\s*\(|\bProxy\s*\.\s*revocable\s*\(",
    "math-random": r"\bMath\s*\.\s*random\s*\(",
    "explicit-any": r":\s*any\b|\bas\s+any\b|\bArray<\s*any\s*>|\bany\s*\[\s*\]",
    "location": r"\b(?:window|globalThis|self|document)\s*\.\s*location\b|\blocation\s*\.\s*(?:hash|href|pathname|search|host|origin)\b",
    "document-write": r"\bdocument\s*\.\s*write(?:ln)?\s*\(",
    "html-injection": r"\b(?:innerHTML|outerHTML|insertAdjacentHTML)\b",
}


def ban_hits(code: Column) -> Column:
    """Names of the banned constructs in blanked text."""
    found = [F.when(code.rlike(p), F.lit(n)) for n, p in BANS.items()]
    return F.array_compact(F.array(*found))


def ban_places(files: DataFrame, *, path: str = "path", text: str = "text") -> DataFrame:
    """Every hit in a file: `path`, `line` and `column` from 1, `ban`, and an `excerpt` of the authored line."""
    rules = {name: re.compile(p, re.ASCII) for name, p in BANS.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for where, body in zip(frame["path"], frame["text"]):
                code, lines = blanked(body), body.split("\n")
                starts = [0, *(m.end() for m in re.finditer("\n", body))]
                for name, rule in rules.items():
                    for m in rule.finditer(code):
                        line = bisect.bisect_right(starts, m.start())
                        rows.append((where, line, m.start() - starts[line - 1] + 1, name, lines[line - 1].strip()[:120]))
            yield pd.DataFrame(rows, columns=["path", "line", "column", "ban", "excerpt"])

    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInPandas(run, "path string, line int, column int, ban string, excerpt string")


#: A decision's id, and the traces of a host. Fixed values.
DECISION = r"\b[A-Z][A-Z0-9]{1,6}-D\d{2,3}\b"
HOST_PATH = r"(?:^|[\"'\s(=])(?:/(?:home|Users|mnt|private|Volumes|var|etc|workspace|actions-runner)\b|[A-Za-z]:[\\/])"
CLOCK = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
EPOCH = r"(?<![\d.])1[6-9]\d{8}(?:\d{3})?(?![\d.])"


def cited_decisions(text: Column) -> Column:
    """Ids named in comments: what follows `//` in a line, or a whole line that starts with a star."""
    comments = F.transform(F.split(text, "\n"), lambda l: F.when(F.instr(l, "//") > 0, l.substr(F.instr(l, "//"), F.length(l))).when(l.rlike(r"^\s*\*"), l).otherwise(""))
    ids = F.flatten(F.transform(comments, lambda c: F.regexp_extract_all(c, F.lit(DECISION), F.lit(0))))
    return F.array_sort(F.array_distinct(ids))


def host_leaks(text: Column, host: str | None = None) -> Column:
    """Traces of the build host in a text: 'path', 'clock' and 'host'."""
    found = [F.when(text.rlike(HOST_PATH), "path"), F.when(text.rlike(CLOCK), "clock")]
    if host:
        found.append(F.when(text.contains(host), "host"))
    return F.array_compact(F.array(*found))


def looks_like_epoch(number: Column) -> Column:
    """Whether a number looks like seconds or milliseconds since 1970."""
    return number.cast("string").rlike(EPOCH)
