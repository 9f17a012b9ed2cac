"""Run reports: exit codes, decisions, frame ranges, linkage keys, properties, residual bytes, content of the newer engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.aggregates import _FOLDED, folded
from sparkloom.plans.registry import Tables, query
from sparkloom.plans.text import _given, _values
from sparkloom.plans.timeline import ROWS, rows
from sparkloom.sources import actions


def view(items: DataFrame, project: dict[str, Column], render: Column) -> DataFrame:
    """Items in two forms side by side: `row` (JSON of the projected fields, nulls left out) and `line` (text)."""
    return items.select(F.to_json(F.struct(*[c.alias(n) for n, c in project.items()])).alias("row"), render.alias("line"))


def exit_decision_of(facts: DataFrame) -> DataFrame:
    """Adds `exit_code` and `rule` to rows of run facts; the first rule that holds decides.

    Facts: `internal` and `unreadable` (reasons or null), `status` (complete, dry-run, refused, failed, cancelled), `codes`
    (of diagnostics), `errors` (rows), `warnings` (occurrences), `read_failed`, `fail_on`, `max_warnings`, `over_budget`.
    """
    refused = (F.col("status") == "refused") | F.array_contains("codes", "SF1000")
    rules = (
        (F.col("internal").isNotNull(), 5, "internal"),
        (F.col("unreadable").isNotNull(), 2, "unreadable"),
        (refused, 3, "avm2"),
        (F.col("status") == "cancelled", 1, "cancelled"),
        (F.col("read_failed"), 2, "read-failed"),
        (F.col("status") == "failed", 1, "stage-failed"),
        ((F.col("errors") > 0) & F.array_contains("codes", "SF0001"), 2, "no-container"),
        (F.col("errors") > 0, 1, "errors"),
        ((F.col("fail_on") == "warning") & (F.col("warnings") > 0), 4, "fail-on"),
        (F.col("warnings") > F.col("max_warnings"), 4, "max-warnings"),
        (F.col("over_budget"), 4, "budget"),
    )
    out = F.when(rules[0][0], F.struct(F.lit(rules[0][1]).alias("c"), F.lit(rules[0][2]).alias("r")))
    for holds, code, name in rules[1:]:
        out = out.when(holds, F.struct(F.lit(code).alias("c"), F.lit(name).alias("r")))
    out = out.otherwise(F.struct(F.lit(0).alias("c"), F.lit("ok").alias("r")))
    return facts.withColumn("decided", out).withColumns({"exit_code": F.col("decided.c"), "rule": F.col("decided.r")}).drop("decided")


@query(
    f"""WITH d AS (SELECT timeline, count(*) FILTER (severity = 'error') AS errors, CAST(coalesce(sum(n) FILTER (severity = 'warning'), 0) AS BIGINT) AS warnings FROM {_FOLDED} WHERE timeline % 4 > 0 OR code <> 'error' GROUP BY ALL)
    SELECT timeline, errors, warnings, CASE timeline % 13 WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 1
      ELSE CASE WHEN errors > 0 THEN CASE timeline % 13 WHEN 7 THEN 2 ELSE 1 END WHEN timeline % 13 = 8 AND warnings > 0 THEN 4 WHEN warnings > 12 THEN 4 WHEN timeline % 13 = 9 THEN 4 ELSE 0 END END AS exit_code,
    CASE timeline % 13 WHEN 0 THEN 'internal' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'avm2' WHEN 3 THEN 'avm2' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'read-failed' WHEN 6 THEN 'stage-failed'
      ELSE CASE WHEN errors > 0 THEN CASE timeline % 13 WHEN 7 THEN 'no-container' ELSE 'errors' END WHEN timeline % 13 = 8 AND warnings > 0 THEN 'fail-on' WHEN warnings > 12 THEN 'max-warnings' WHEN timeline % 13 = 9 THEN 'budget' ELSE 'ok' END END AS rule FROM d"""
)
def exit_decision(t: Tables) -> DataFrame:
    """Exit codes of runs: all rules in order, errors by rows, warnings by occurrences against a limit."""
    k = F.col("timeline") % 13
    d = folded(t).where("timeline % 4 > 0 or code <> 'error'").groupBy("timeline").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.coalesce(F.sum(F.when(F.col("severity") == "warning", F.col("n"))), F.lit(0)).alias("warnings"))
    facts = d.select(
        "timeline", "errors", "warnings", F.when(k == 0, "a crash").alias("internal"), F.when(k.isin(0, 1), "not there").alias("unreadable"),
        F.when(k.isin(1, 2), "refused").when(k == 4, "cancelled").when(k.isin(5, 6), "failed").otherwise("complete").alias("status"),
        F.when(k == 3, F.array(F.lit("SF0102"), F.lit("SF1000"))).when(k == 7, F.array(F.lit("SF0001"))).otherwise(F.array().cast("array<string>")).alias("codes"),
        (k == 5).alias("read_failed"), F.when(k == 8, "warning").otherwise("error").alias("fail_on"), F.lit(12).alias("max_warnings"), (k == 9).alias("over_budget"),
    )
    return exit_decision_of(facts).select("timeline", "errors", "warnings", "exit_code", "rule")


def reported(verdicts: DataFrame, blocks: DataFrame, blockers: DataFrame) -> DataFrame:
    """The decisions worth a reader's time: `subject`, `action`, `reason`; roots, reachable characters and kept blocks are left out."""
    state = F.col("state")
    a = verdicts.where(~state.isin("root", "reachable")).select(
        F.concat(F.lit("character "), "id", F.lit(" ("), "kind", F.lit(")")).alias("subject"), F.when(state == "pruned", "pruned").when(state == "prunable", "reported as unreferenced").otherwise("kept").alias("action"), "reason"
    )
    b = blocks.where(state != "kept").select(
        F.concat(F.lit("action block "), "id").alias("subject"), F.when(state == "pruned", "pruned").when(state == "prunable", "reported as unreachable").otherwise("reported").alias("action"), "reason"
    )
    c = blockers.select(F.concat(F.lit("character "), "id", F.lit(" ("), "reason", F.lit(")")).alias("subject"), F.lit("pruning disabled for the movie").alias("action"), F.lit("the closure ends at this payload").alias("reason"))
    return a.unionByName(b).unionByName(c)


@query(
    """WITH d AS (SELECT 'character ' || p_partkey || ' (' || p_type || ')' AS subject, CASE p_size % 5 WHEN 2 THEN 'pruned' WHEN 3 THEN 'reported as unreferenced' ELSE 'kept' END AS action, 'r' || p_size AS reason, 'dead-code' AS source FROM part WHERE p_size % 5 > 1
      UNION ALL SELECT 'action block ' || s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN 'pruned' WHEN 2 THEN 'reported as unreachable' ELSE 'reported' END, 'b', 'dead-code' FROM supplier WHERE s_suppkey % 4 > 0
      UNION ALL SELECT 'character ' || n_nationkey || ' (' || n_name || ')', 'pruning disabled for the movie', 'the closure ends at this payload', 'dead-code' FROM nation WHERE n_regionkey = 0
      UNION ALL SELECT 'scene ' || r_regionkey, 'written', r_name, 'emit' FROM region)
    SELECT source, subject, action, reason, row_number() OVER (ORDER BY source || '/' || subject, action, reason) AS n FROM d"""
)
def decision_report(t: Tables) -> DataFrame:
    """Decisions of all passes and stages in the order of source and subject; the number states the order."""
    from sparkloom.operators.sorting import number_rows

    z, s = F.col("p_size") % 5, F.col("s_suppkey") % 4
    states = F.when(z == 0, "root").when(z == 1, "reachable").when(z == 2, "pruned").when(z == 3, "prunable").otherwise("kept-unproven")
    verdicts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), states.alias("state"), F.concat(F.lit("r"), "p_size").alias("reason"))
    blocks = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(s == 0, "kept").when(s == 1, "pruned").when(s == 2, "prunable").otherwise("unproven").alias("state"), F.lit("b").alias("reason"))
    blockers = t.nation.where("n_regionkey = 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("reason"))
    dead = reported(verdicts, blocks, blockers).withColumn("source", F.lit("dead-code"))
    emitted = t.region.select(F.lit("emit").alias("source"), F.concat(F.lit("scene "), "r_regionkey").alias("subject"), F.lit("written").alias("action"), F.col("r_name").alias("reason"))
    rows_ = dead.unionByName(emitted).withColumn("key", F.concat_ws("/", "source", "subject"))
    return number_rows(rows_, ["key", "action", "reason"], "n").drop("key")


def frame_span(spec: Column, frames: Column) -> Column:
    """The half-open range that `n` or `a-b` (inclusive) asks for, held to the frames there are; nothing asks for all.

    Null for what is no such text, or starts after its end.
    """
    text = F.trim(spec)
    first, last = F.regexp_extract(text, r"^([0-9]+)(-[0-9]+)?$", 1), F.regexp_extract(text, r"^[0-9]+-([0-9]+)$", 1)
    a = first.try_cast("long")
    b = F.when(last != "", last.try_cast("long")).otherwise(a)
    span = F.struct(a.alias("start"), F.least(frames, b + 1).alias("end"))
    whole = F.struct(F.lit(0).cast("long").alias("start"), frames.cast("long").alias("end"))
    return F.when(spec.isNull() | (spec == ""), whole).when((first != "") & (a <= b), span)


_SPECS = ((None, 0, 90), ("", 0, 90), ("7", 7, 8), ("3-9", 3, 10), (" 12-12 ", 12, 13), ("80-200", 80, 90), ("9-3", None, None), ("a-b", None, None), ("-4", None, None), ("1-2-3", None, None), ("5-", None, None), ("95", 95, 90))


@query(f"SELECT p_partkey, want_start AS start, want_end AS stop, (SELECT count(*) FROM events WHERE event_id >= want_start AND event_id < want_end) AS n FROM part JOIN {_values(_SPECS, 'x', 'want_start', 'want_end')} ON i = p_partkey % {len(_SPECS)}")
def frame_range(t: Tables) -> DataFrame:
    """Frame ranges from their texts, and the rows in them."""
    p = t.part.select("p_partkey").join(F.broadcast(_given(t, _SPECS)), F.col("i") == F.col("p_partkey") % len(_SPECS))
    p = p.select("p_partkey", frame_span(F.col("x"), F.lit(90)).alias("s")).select("p_partkey", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))
    spans = p.where("start < stop").select("start", "stop").distinct().withColumn("frame", F.explode(F.expr("sequence(start, stop - 1)")))
    counts = spans.join(t.events.select(F.col("event_id").alias("frame")), "frame").groupBy("start", "stop").agg(F.count("*").alias("n"))
    return p.join(counts, ["start", "stop"], "left").select("p_partkey", "start", "stop", F.coalesce("n", F.lit(0)).alias("n"))


def linkage_key(url: Column) -> Column:
    """A URL with its scheme in lower case, as linkage compares it; all else is told apart by case."""
    scheme = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.when(scheme != "", F.concat(F.lower(scheme), url.substr(F.length(scheme) + 1, F.length(url)))).otherwise(url)


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https' || substr(url, strpos(url, ':')) WHEN 1 THEN url WHEN 2 THEN 'Lib/' || page_id ELSE 'file+x:/A' END AS key, page_id % 4 <> 2 AS found FROM pages WHERE starts_with(url, 'http')"""
)
def linkage_join(t: Tables) -> DataFrame:
    """URLs joined to a list of inputs by their keys, whatever the case of their schemes."""
    k = F.col("page_id") % 4
    asked = F.when(k == 0, F.concat(F.lit("HtTPs"), F.expr("substring(url, instr(url, ':'))"))).when(k == 1, F.col("url")).when(k == 2, F.concat(F.lit("Lib/"), "page_id")).otherwise(F.lit("File+X:/A"))
    p = t.pages.where(F.col("url").startswith("http")).select("page_id", "url", linkage_key(asked).alias("key"))
    upper = F.concat(F.upper(F.substring_index("url", ":", 1)), F.expr("substring(url, instr(url, ':'))"))
    given = p.where("page_id % 4 = 0").select(linkage_key(F.concat(F.lit("HTTPS"), F.expr("substring(url, instr(url, ':'))"))).alias("key"))
    given = given.unionByName(p.where("page_id % 4 = 1").select(linkage_key(upper).alias("key"))).unionByName(p.where("page_id % 4 = 2").select(F.lower("key").alias("key")))
    given = given.unionByName(t.spark.createDataFrame([("FILE+x:/A",)], "key string").select(linkage_key(F.col("key")).alias("key"))).distinct()
    return p.join(given.withColumn("found", F.lit(True)), "key", "left").select("page_id", "key", F.coalesce("found", F.lit(False)).alias("found"))


#: Names of properties by number. Fixed values.
PROPERTIES = (
    "_x", "_y", "_xscale", "_yscale", "_currentframe", "_totalframes", "_alpha", "_visible", "_width", "_height", "_rotation", "_target", "_framesloaded", "_name", "_droptarget", "_url",
    "_highquality", "_focusrect", "_soundbuftime", "_quality", "_xmouse", "_ymouse",
)


def property_name(number: Column) -> Column:
    """The property of a number; null for what is none of 0 to 21."""
    whole = F.when((number >= 0) & (number < len(PROPERTIES)) & (number == F.floor(number)), number.cast("int"))
    return F.get(F.array(*[F.lit(p) for p in PROPERTIES]), whole)


@query(
    """SELECT event_id, CASE n WHEN 0 THEN '_x' WHEN 1 THEN '_y' WHEN 2 THEN '_xscale' WHEN 3 THEN '_yscale' WHEN 4 THEN '_currentframe' WHEN 5 THEN '_totalframes' WHEN 6 THEN '_alpha' WHEN 7 THEN '_visible'
    WHEN 8 THEN '_width' WHEN 9 THEN '_height' WHEN 10 THEN '_rotation' WHEN 11 THEN '_target' WHEN 12 THEN '_framesloaded' WHEN 13 THEN '_name' WHEN 14 THEN '_droptarget' WHEN 15 THEN '_url' WHEN 16 THEN '_highquality'
    WHEN 17 THEN '_focusrect' WHEN 18 THEN '_soundbuftime' WHEN 19 THEN '_quality' WHEN 20 THEN '_xmouse' WHEN 21 THEN '_ymouse' END AS property, coalesce(n IN (20, 21), false) AS mouse FROM (SELECT event_id, (event_id % 60 - 6) / 2.0 AS n FROM events)"""
)
def property_names(t: Tables) -> DataFrame:
    """Property numbers, halves and numbers out of range included, with their names."""
    name = property_name((F.col("event_id") % 60 - 6) / 2.0)
    return t.events.select("event_id", name.alias("property"), F.coalesce(name.isin("_xmouse", "_ymouse"), F.lit(False)).alias("mouse"))


@query(
    f"""WITH c AS (SELECT timeline, CASE kind WHEN 'signup' THEN 8 WHEN 'purchase' THEN 5 ELSE 1 END AS size FROM {ROWS})
    SELECT 'u' || timeline AS block_id, CAST(sum(size) + 1 AS BIGINT) AS bytes FROM c GROUP BY timeline"""
)
def residual_bytes(t: Tables) -> DataFrame:
    """Bytes of the basic blocks that are kept as they are; empty blocks have no slice."""
    from sparkloom.plans.containers import blocks

    b = actions.block_table(blocks(t)).withColumn("length", F.col("end") - F.col("start")).where("length > 0")
    return b.groupBy("block_id").agg(F.sum("length").alias("bytes"))


def engine_verdicts(tags: DataFrame) -> DataFrame:
    """Files with content of the newer engine, by `path`: `source` and `offset` of what shows it, and the code of the refusal.

    The flag in the file's attributes is looked at first, then the first tag of such code.
    """
    flagged = (F.col("code") == 69) & (F.conv(F.hex(F.substring("body", 1, 1)), 16, 10).cast("int").bitwiseAND(8) != 0)
    marks = tags.where(F.col("sprite").isNull()).select("path", "index", "head", "offset", flagged.alias("flag"), (F.col("code") == 82).alias("code82")).where("flag or code82")
    first = marks.groupBy("path").agg(F.min_by(F.struct("flag", "head", "offset"), F.struct(F.when(F.col("flag"), 0).otherwise(1).alias("rank"), "index")).alias("m"))
    source = F.when(F.col("m.flag"), "fileAttributes").otherwise("doAbc")
    return first.select("path", source.alias("source"), F.when(F.col("m.flag"), F.col("m.offset")).otherwise(F.col("m.head")).alias("offset"), F.lit("SF1000").alias("code"))


@query(
    f"""WITH s AS (SELECT timeline, idx, CASE WHEN kind = 'error' THEN 6 WHEN kind = 'click' AND character % 5 = 0 THEN 4 ELSE 2 END AS size, kind, character FROM {ROWS}),
    p AS (SELECT *, 21 - 8 + coalesce(sum(size) OVER (PARTITION BY timeline ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head FROM s),
    m AS (SELECT timeline, min(head) FILTER (kind = 'error' AND character % 3 = 0) AS flagged, min(head) FILTER (kind = 'click' AND character % 5 = 0) AS coded FROM p GROUP BY ALL)
    SELECT 'u' || timeline AS path, CASE WHEN flagged IS NULL THEN 'doAbc' ELSE 'fileAttributes' END AS source, CAST(coalesce(flagged + 2, coded) AS BIGINT) AS "offset", 'SF1000' AS code FROM m WHERE flagged IS NOT NULL OR coded IS NOT NULL"""
)
def engine_refusal(t: Tables) -> DataFrame:
    """Files that are refused: attributes with the flag, or tags of the newer engine's code."""
    from sparkloom.plans.containers import _FRAME, _RATE, _joined, _le, _tag
    from sparkloom.sources import container

    kind, c = F.col("kind"), F.col("character")
    attributes = _tag(69, 4, F.when(c % 3 == 0, "08000000").otherwise("10000000"))
    tag = F.when(kind == "error", attributes).when((kind == "click") & (c % 5 == 0), _tag(82, 2, F.lit("0000"))).otherwise(_tag(1, 0))
    f = _joined(rows(t).withColumn("hex", tag), "timeline")
    body = F.concat(F.lit(_FRAME + _RATE), _le(F.col("frames"), 2), F.col("hex"), F.lit("0000"))
    f = f.withColumn("body", body)
    content = F.unhex(F.concat(F.lit("46575309"), _le(F.length("body") / 2 + 8, 4), F.col("body")))
    files = f.select(F.concat(F.lit("u"), F.col("timeline")).alias("path"), content.alias("content"))
    return engine_verdicts(container.tag_table(files))


@query("SELECT p_partkey, '{\"code\":' || p_partkey || CASE WHEN p_size > 25 THEN ',\"sprite\":' || p_size ELSE '' END || '}' AS \"row\", p_partkey || ' ' || p_name AS line FROM part")
def dual_view(t: Tables) -> DataFrame:
    """Rows as JSON without nulls, and as lines of text."""
    k = F.col("p_partkey")
    out = view(t.part, {"code": k, "sprite": F.when(F.col("p_size") > 25, F.col("p_size"))}, F.concat(k, F.lit(" "), "p_name"))
    return out.select(F.get_json_object("row", "$.code").cast("long").alias("p_partkey"), "row", "line")


