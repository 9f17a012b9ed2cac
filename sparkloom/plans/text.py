"""Text functions: identifiers, patterns, paths, sizes. Oracles state the results for given texts, or other ways to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import sources
from sparkloom.plans.registry import Tables, query

#: Words that may not be identifiers. Fixed values.
RESERVED = (
    "arguments", "await", "break", "case", "catch", "class", "const", "constructor", "continue", "debugger", "default", "delete", "do", "else", "enum", "eval", "export", "extends", "false",
    "finally", "for", "frame", "function", "if", "implements", "import", "in", "instanceof", "interface", "let", "new", "null", "package", "private", "protected", "public", "return", "static",
    "super", "switch", "target", "this", "throw", "true", "try", "typeof", "undefined", "var", "vm", "void", "while", "with", "yield",
)


def sanitised(c: Column, fallback: Column | str = "symbol") -> Column:
    """An identifier: other characters are dropped at the edges and become one underscore between two parts.

    Authored underscores stay. A leading digit gets an underscore before it, a reserved word one behind it. Where nothing
    is left, the fallback is made an identifier in the same way, and `symbol` stands in for that.
    """

    def made(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r"^[^A-Za-z0-9_$]+|[^A-Za-z0-9_$]+$", ""), r"[^A-Za-z0-9_$]+", "_")
        x = F.when(x.rlike("^[0-9]"), F.concat(F.lit("_"), x)).otherwise(x)
        return F.when(x.isin(*RESERVED), F.concat(x, F.lit("_"))).otherwise(x)

    spare = made(F.lit(fallback) if isinstance(fallback, str) else fallback)
    return F.coalesce(F.nullif(made(c), F.lit("")), F.nullif(spare, F.lit("")), F.lit("symbol"))


#: Names and what they must become.
_NAMES = (
    ("_root_", "_root_"), ("_level0", "_level0"), ("3rd Prize", "_3rd_Prize"), ("class", "class_"), ("---", "Character7"), ("___", "___"), ("a--b..c", "a_b_c"), ("/a/b/", "a_b"),
    ("vm", "vm_"), ("frame", "frame_"), ("red", "red"), ("$x", "$x"), ("é-x", "x"), ("x é", "x"), ("a_ _b", "a___b"), ("", "Character7"), ("  new ", "new_"), ("undefined", "undefined_"),
    ("_ class", "__class"), ("9", "_9"),
)


def _values(rows: tuple, *columns: str) -> str:
    def shown(x: object) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    body = ", ".join(f"({i}, {', '.join(shown(x) for x in row)})" for i, row in enumerate(rows))
    return f"(VALUES {body}) AS given(i, {', '.join(columns)})"


def _given(t: Tables, rows: tuple) -> DataFrame:
    """The texts by number; rows of a table take them in turn."""
    return t.spark.createDataFrame([(i, row[0]) for i, row in enumerate(rows)], "i long, x string")


@query(
    f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN want ELSE '_' || p_partkey || '_' || replace(p_name, ' ', '_') END AS name
    FROM part JOIN {_values(_NAMES, 'x', 'want')} ON given.i = p_partkey % {len(_NAMES)}"""
)
def sanitise_name(t: Tables) -> DataFrame:
    """Names made into identifiers: given ones, and a number with a name behind it."""
    k = F.col("p_partkey")
    p = t.part.join(F.broadcast(_given(t, _NAMES)), F.col("i") == k % len(_NAMES))
    raw = F.when(k % 2 == 0, F.col("x")).otherwise(F.concat(F.lit("- "), k, F.lit("!?"), "p_name", F.lit(" #")))
    return p.select("p_partkey", sanitised(raw, "Character7").alias("name"))


#: Program lines and the ids that they cite.
_LINES = (
    ("let a = 1; // as ONE-D04 and TWO-D123 say", "ONE-D04 TWO-D123"), ("const s = 'ONE-D05';", ""), ("  * ABC-D02, again ABC-D02", "ABC-D02"), ("x * ONE-D06", ""), ("// A-D01 AB-D1 AB-D1234 ABCDEFGH-D01", ""),
    ("u = 'http://SIX-D07'", "SIX-D07"), ("\t* lower-d01 OK9-D99x Z9-D88", "Z9-D88"), ("no comment at all", ""), ("a / b // TEN-D010", "TEN-D010"),
)


@query(
    f"""SELECT id AS decision, count(*) AS n, count(DISTINCT p_partkey) AS files FROM (
      SELECT p_partkey, unnest(string_split(want, ' ')) AS id FROM part JOIN {_values(_LINES, 'x', 'want')} ON i IN (p_partkey % {len(_LINES)}, p_partkey % 4) WHERE want <> ''
      UNION SELECT p_partkey, 'PT-D' || (10 + p_size % 90) FROM part) GROUP BY ALL"""
)
def regex_extract(t: Tables) -> DataFrame:
    """Decision ids cited in the comments of program files (distinct in a file), with how often they are cited."""
    k, n = F.col("p_partkey"), len(_LINES)
    lines = F.array(*[F.lit(x) for x, _ in _LINES])
    own = F.concat(F.lit("call('x'); // PT-D"), F.lit(10) + F.col("p_size") % 90)
    text = F.concat_ws("\n", F.get(lines, (k % n).cast("int")), F.get(lines, (k % 4).cast("int")), own)
    ids = t.part.select("p_partkey", F.explode(sources.cited_decisions(text)).alias("decision"))
    return ids.groupBy("decision").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("files"))


#: Programs and the bans that they break, in the order of the list.
_PROGRAMS = (
    ("eval(x);", "eval"), ("window . eval (x)", "eval"), ("const u = '//'; eval(code)", "eval"), ("// eval(x)\nok()", ""), ("s = 'eval(x)';", ""), ("medieval(x)", ""), ("new Function('a')", "function-synthesis"),
    ("Function (a)", "function-synthesis"), ("setTimeout('f()', 1)", "implied-eval"), ("setTimeout(f, 1)", ""), ("with (a) b();", "with"), ("a; with(b) {}", "with"), ("x.with(b)", ""), ("await f();", "await"),
    ("for (const k in o) {}", "for-in"), ("for (const k of o) {}", ""), ("new Proxy(a, b)", "proxy"), ("Math . random()", "math-random"), ("let a: any = 1;", "explicit-any"), ("a as any", "explicit-any"),
    ("many[1]", ""), ("location.hash", "location"), ("self.location", "location"), ("document.writeln(x)", "document-write"), ("a.innerHTML = b", "html-injection"), ("`${eval(a)} eval(b)`", "eval"), ("`eval(a)`", ""),
    ("r = /'/; eval(a) // '", "eval"), ("a / b; 'eval(' / c", ""), ("'open eval(a)", "eval"), ("/* eval(a) */ Math.random()", "math-random"), ("/* open eval(a)", "eval"), ("return /[/'\"]/.test(x), eval(x)", "eval"),
    ("a = 'it\\'s'; eval('x: any')", "eval"), ("`a ${ `b ${c} innerHTML` } d`", ""), ("eval(a); Math.random()", "eval math-random"),
)


@query(f"SELECT page_id, want AS bans FROM pages JOIN {_values(_PROGRAMS, 'x', 'want')} ON i = page_id % {len(_PROGRAMS)} UNION ALL SELECT -1 - page_id, CASE WHEN regexp_matches(html, 'innerHTML|outerHTML') THEN 'some' ELSE '' END FROM pages")
def ban_scan(t: Tables) -> DataFrame:
    """Banned constructs outside comments and strings: in given programs, and in pages read as they are."""
    p = t.pages.join(F.broadcast(_given(t, _PROGRAMS)), F.col("i") == F.col("page_id") % len(_PROGRAMS))
    bans = F.array_join(sources.ban_hits(sources.blanked_source("x")), " ")
    pages = t.pages.select((-1 - F.col("page_id")).alias("page_id"), F.when(F.array_contains(sources.ban_hits(F.col("html")), "html-injection"), "some").otherwise("").alias("bans"))
    return p.select("page_id", bans.alias("bans")).unionByName(pages)


#: Texts and the traces of a host in them, the host being named builder-07.
_TRACES = (
    ("/home/me/x", "path"), ("see '/Users/me'", "path"), ("at C:\\\\temp", "path"), ("(D:/x", "path"), ("a/home/me", ""), ("/homework", ""), ("/usr/lib", ""), ("https://x.org/a", ""), ("built 2024-01-31T10:22:01Z", "clock"),
    ("2024-01-31 10:22", "clock"), ("2024-01-31", ""), ("by builder-07.local", "host"), ("=/var/x at 2020-02-02 02:02 on builder-07", "path clock host"), ("plain", ""), ("", ""),
)


@query(
    f"""SELECT doc_id, want AS traces, doc_id % 3 = 0 OR (doc_id % 3 = 1 AND 1500000000 + doc_id * 100003 BETWEEN 1600000000 AND 1999999999) AS epoch
    FROM documents JOIN {_values(_TRACES, 'x', 'want')} ON i = doc_id % {len(_TRACES)}"""
)
def leak_scan(t: Tables) -> DataFrame:
    """Traces of the build host in texts, and numbers that look like a clock's (milliseconds, seconds, small ones)."""
    k = F.col("doc_id")
    d = t.documents.select("doc_id").join(F.broadcast(_given(t, _TRACES)), F.col("i") == k % len(_TRACES))
    number = F.when(k % 3 == 0, 1_700_000_000_000 + k).when(k % 3 == 1, 1_500_000_000 + k * 100_003).otherwise(k)
    return d.select("doc_id", F.array_join(sources.host_leaks(F.col("x"), "builder-07"), " ").alias("traces"), sources.looks_like_epoch(number).alias("epoch"))


def target_path(c: Column) -> tuple[Column, Column, Column]:
    """Kind (`file` or `path`), path and name of a target.

    With a leading slash, clips are parted by slashes and a name follows the last colon; else dots part the clips and the
    last part is the name. Clips are trimmed and empty ones dropped; nothing at all means the current file. A missing path
    or name is null.
    """

    def parts(x: Column, mark: str) -> Column:
        return F.filter(F.transform(F.split(x, mark), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    slash, named = c.startswith("/"), F.instr(c, ":") > 0
    clips, dots = parts(F.regexp_replace(c, ":[^:]*$", ""), "/"), parts(c, r"\.")
    inner = F.slice(dots, 1, F.greatest(F.size(dots) - 1, F.lit(0)))
    empty = (c == "") | (slash & ~named & (F.size(clips) == 0)) | (~slash & (F.size(dots) == 0))
    path = F.when(slash, F.array_join(clips, "/")).otherwise(F.array_join(inner, "/"))
    name = F.when(slash, F.when(named, F.nullif(F.regexp_extract(c, ":([^:]*)$", 1), F.lit("")))).otherwise(F.get(dots, F.size(dots) - 1))
    return F.when(empty, "file").otherwise("path"), F.when(~empty, F.nullif(path, F.lit(""))), F.when(~empty, name)


#: Targets with kind, path and name.
_TARGETS = (
    ("", "file", None, None), ("/", "file", None, None), ("...", "file", None, None), ("/A/B", "path", "A/B", None), ("/A/B:foo", "path", "A/B", "foo"), ("/A:b:c", "path", "A:b", "c"), ("/:x", "path", None, "x"),
    ("/A:", "path", "A", None), ("/ A // B ", "path", "A/B", None), ("a.b.c", "path", "a/b", "c"), ("a", "path", None, "a"), (".a. b ", "path", "a", "b"), ("a/b:c", "path", None, "a/b:c"), ("a.b:c", "path", "a", "b:c"),
    ("/A.b/C: d", "path", "A.b/C", " d"),
)


@query(f"SELECT page_id, kind, path, name FROM pages JOIN {_values(_TARGETS, 'x', 'kind', 'path', 'name')} ON i = page_id % {len(_TARGETS)}")
def path_parse(t: Tables) -> DataFrame:
    """Targets taken apart into kind, path and name."""
    kind, path, name = target_path(F.col("x"))
    p = t.pages.select("page_id").join(F.broadcast(_given(t, _TARGETS)), F.col("i") == F.col("page_id") % len(_TARGETS))
    return p.select("page_id", kind.alias("kind"), path.alias("path"), name.alias("name"))


def human_size(n: Column) -> Column:
    """Bytes below 1024, else KiB with one decimal or MiB with two, rounded half up."""

    def decimal(unit: int, places: int) -> Column:
        scale = 10**places
        x = F.floor((n * (2 * scale) + unit) / (2 * unit)).cast("long")
        return F.concat(F.floor(x / scale).cast("long"), F.lit("."), F.lpad((x % scale).cast("string"), places, "0"))

    return F.when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 1 << 20, F.concat(decimal(1024, 1), F.lit(" KiB"))).otherwise(F.concat(decimal(1 << 20, 2), F.lit(" MiB")))


@query(
    """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CAST(CAST(n / 1024.0 AS DECIMAL(18, 1)) AS VARCHAR) || ' KiB'
    ELSE CAST(CAST(CAST(n AS DECIMAL(18, 0)) / 1048576 AS DECIMAL(18, 2)) AS VARCHAR) || ' MiB' END AS size FROM (SELECT doc_id, n_chars * (doc_id % 3 * 2000 + 1) + doc_id % 7 AS n FROM documents)"""
)
def format_size(t: Tables) -> DataFrame:
    """Sizes as people read them."""
    k = F.col("doc_id")
    return t.documents.select("doc_id", human_size(F.col("n_chars") * (k % 3 * 2000 + 1) + k % 7).alias("size"))
