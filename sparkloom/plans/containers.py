"""Container queries: each user's events are written as a movie, byte by byte, and read back by the scans.

A purchase shows a frame, a signup places a character, an error removes what is at a depth, a click labels the frame and a
view sets the background. The oracles say what must come out, from the events alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import movies
from sparkloom.plans.registry import Tables, query
from sparkloom.plans.timeline import ROWS, rows
from sparkloom.sources import actions, container, tagdata

#: A frame of 550 by 400 pixels and twelve frames a second, as the header has them. Fixed values.
_FRAME, _RATE = "7800055F00000FA000", "000C"


def _le(value: Column, size: int) -> Column:
    """A number's bytes, lowest first, as hex digits."""
    value = value.cast("long")
    return F.concat(*[F.lpad(F.hex(F.shiftright(value, 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)])


def _tag(code: int, size: int, *body: Column) -> Column:
    return F.concat(_le(F.lit(code << 6 | size), 2), *body)


def _joined(df: DataFrame, key: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("idx", "hex")))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["hex"]), "").alias("hex"), F.count_if(F.col("kind") == "purchase").alias("frames"))


def files(t: Tables) -> DataFrame:
    kind = F.col("kind")
    tag = (
        F.when(kind == "purchase", _tag(1, 0)).when(kind == "signup", _tag(26, 6, F.lit("06"), _le(F.col("depth") + 1, 2), _le(F.col("character") + 1, 2), F.lit("00")))
        .when(kind == "error", _tag(28, 2, _le(F.col("depth") + 1, 2))).when(kind == "click", _tag(43, 3, _le(65 + F.col("depth"), 1), _le(97 + F.col("character") % 26, 1), F.lit("00")))
        .otherwise(_tag(9, 3, _le(F.col("character") % 256, 1), F.lit("00FF")))
    )
    f = _joined(rows(t).withColumn("hex", tag), "timeline")
    body = F.concat(F.lit(_FRAME + _RATE), _le(F.col("frames"), 2), F.col("hex"), F.lit("0000"))
    f = f.withColumn("body", body)
    content = F.unhex(F.concat(F.lit("46575306"), _le(F.length("body") / 2 + 8, 4), F.col("body")))
    return f.select(F.concat(F.lit("u"), F.col("timeline")).alias("path"), content.alias("content"))


_SIZES = f"""(SELECT *, CASE kind WHEN 'purchase' THEN 1 WHEN 'signup' THEN 26 WHEN 'error' THEN 28 WHEN 'click' THEN 43 ELSE 9 END AS code,
  CASE kind WHEN 'purchase' THEN 0 WHEN 'signup' THEN 6 WHEN 'error' THEN 2 ELSE 3 END AS size FROM {ROWS}) AS z"""


@query(
    f"""SELECT 'u' || timeline AS path, 'none' AS compression, 6 AS version, CAST(21 + sum(size + 2) + 2 AS BIGINT) AS declared_length, 12.0 AS frame_rate,
    CAST(count(*) FILTER (kind = 'purchase') AS INTEGER) AS frame_count, 550.0 AS width_px, 400.0 AS height_px FROM {_SIZES} GROUP BY timeline"""
)
def container_header(t: Tables) -> DataFrame:
    """Header fields of every written file."""
    return container.file_table(files(t)).select("path", "compression", "version", "declared_length", "frame_rate", "frame_count", "width_px", "height_px")


@query(
    f"""WITH s AS (SELECT timeline, idx, code, size FROM {_SIZES} UNION ALL SELECT timeline, max(idx) + 1, 0, 0 FROM {ROWS} GROUP BY timeline)
    SELECT 'u' || timeline AS path, CAST(row_number() OVER w - 1 AS INTEGER) AS "index", code, CAST(13 + coalesce(sum(size + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2 AS BIGINT) AS "offset",
    CAST(size AS BIGINT) AS length FROM s WINDOW w AS (PARTITION BY timeline ORDER BY idx)"""
)
def container_scan(t: Tables) -> DataFrame:
    """Every tag of every written file, in stream order."""
    return container.tag_table(files(t), with_body=False).select("path", "index", "code", "offset", "length")


@query(
    f"""SELECT 'u' || timeline AS path, idx_ AS "index", depth, character, label, red FROM (
    SELECT timeline, CAST(row_number() OVER (PARTITION BY timeline ORDER BY idx) - 1 AS INTEGER) AS idx_, CASE WHEN kind IN ('signup', 'error') THEN CAST(depth + 1 AS INTEGER) END AS depth,
      CASE WHEN kind = 'signup' THEN CAST(character + 1 AS INTEGER) END AS character, CASE WHEN kind = 'click' THEN chr(CAST(65 + depth AS INTEGER)) || chr(CAST(97 + character % 26 AS INTEGER)) END AS label,
      CASE WHEN kind = 'view' THEN CAST(character % 256 AS INTEGER) END AS red FROM {ROWS})"""
)
def container_fields(t: Tables) -> DataFrame:
    """Decoded fields of every tag; the end tag has none."""
    d = tagdata.decoded(container.tag_table(files(t))).where("code <> 0")
    return d.select("path", "index", movies.field("depth").alias("depth"), movies.field("character").alias("character"), F.when(F.col("code") == 43, movies.field("name", "string")).alias("label"), F.get_json_object("fields", "$.colour[0]").cast("int").alias("red"))


@query(
    f"""WITH o AS (SELECT timeline, idx, depth + 1 AS depth, kind, character + 1 AS character, coalesce(sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER
      (PARTITION BY timeline ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS frame FROM {ROWS}),
    p AS (SELECT * FROM o WHERE kind IN ('signup', 'error')),
    l AS (SELECT *, row_number() OVER (PARTITION BY timeline, depth, frame ORDER BY idx DESC) AS n FROM p),
    s AS (SELECT timeline, depth, frame, kind, character, coalesce(lead(frame) OVER (PARTITION BY timeline, depth ORDER BY frame) - 1, max(frame) OVER (PARTITION BY timeline)) AS until FROM l WHERE n = 1)
    SELECT 'u' || timeline AS path, CAST(unnest(range(CAST(frame AS BIGINT), CAST(until AS BIGINT) + 1)) AS BIGINT) AS frame, CAST(depth AS INTEGER) AS depth, CAST(character AS INTEGER) AS character FROM s WHERE kind = 'signup'"""
)
def container_display(t: Tables) -> DataFrame:
    """The display list at the end of every frame, from bytes to rows."""
    return movies.display_list(tagdata.decoded(container.tag_table(files(t)))).select("path", "frame", "depth", "character")


@query(f"SELECT 'u' || timeline AS path, 'SF0102' AS code, 'info' AS severity FROM {ROWS} GROUP BY timeline")
def container_notes(t: Tables) -> DataFrame:
    """What is wrong with the files once their last two bytes, the end tag, are cut off and the stated length is set right."""
    cut = F.unhex(F.concat(F.substring("h", 1, 8), _le(F.length("h") / 2 - 2, 4), F.expr("substring(h, 17, length(h) - 20)")))
    f = files(t).withColumn("h", F.hex("content")).select("path", cut.alias("content"))
    return container.note_table(f).select("path", "code", "severity")


def blocks(t: Tables) -> DataFrame:
    """Each user's events as an action block: integers pushed, values added, doubled, dropped, a branch, an end."""
    kind = F.col("kind")
    code = (
        F.when(kind == "signup", F.concat(F.lit("96050007"), _le(F.col("character"), 4))).when(kind == "click", F.lit("47")).when(kind == "view", F.lit("4C"))
        .when(kind == "error", F.lit("17")).otherwise(F.lit("9D02000000"))
    )
    b = _joined(rows(t).withColumn("hex", code), "timeline")
    return b.select(F.concat(F.lit("u"), F.col("timeline")).alias("block_id"), F.unhex(F.concat("hex", F.lit("00"))).alias("bytes"), F.lit(6).alias("version"))


_CODES = f"""(SELECT *, CASE kind WHEN 'signup' THEN 150 WHEN 'click' THEN 71 WHEN 'view' THEN 76 WHEN 'error' THEN 23 ELSE 157 END AS code,
  CASE kind WHEN 'signup' THEN 8 WHEN 'purchase' THEN 5 ELSE 1 END AS size FROM {ROWS}) AS z"""
_STEPS = f"(SELECT timeline, idx, kind, character, code, size FROM {_CODES} UNION ALL SELECT timeline, max(idx) + 1, 'end', 0, 0, 1 FROM {ROWS} GROUP BY timeline) AS s"


@query(
    f"""SELECT 'u' || timeline AS block_id, CAST(row_number() OVER w - 1 AS INTEGER) AS seq, CAST(coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS "offset", code,
    CASE code WHEN 150 THEN 'Push' WHEN 71 THEN 'Add2' WHEN 76 THEN 'PushDuplicate' WHEN 23 THEN 'Pop' WHEN 157 THEN 'If' ELSE 'End' END AS name,
    CASE WHEN kind = 'signup' THEN CAST(character AS INTEGER) END AS pushed, CASE WHEN kind = 'purchase' THEN CAST(sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS INTEGER) END AS target
    FROM {_STEPS} WINDOW w AS (PARTITION BY timeline ORDER BY idx)"""
)
def action_scan(t: Tables) -> DataFrame:
    """Every record of every block with its operands."""
    r = actions.record_table(blocks(t))
    return r.select("block_id", "seq", "offset", "code", "name", F.get_json_object("fields", "$.values[0].value").cast("int").alias("pushed"), "target")


@query(
    f"""WITH r AS (SELECT timeline, idx, kind, size, CAST(coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS pos, lag(kind) OVER w AS before FROM {_STEPS} WINDOW w AS (PARTITION BY timeline ORDER BY idx)),
    m AS (SELECT *, sum(CASE WHEN before IS NULL OR before = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY timeline ORDER BY idx ROWS UNBOUNDED PRECEDING) AS block FROM r)
    SELECT 'u' || timeline AS block_id, min(pos) AS start, CAST(max(pos + size) AS INTEGER) AS "end" FROM m GROUP BY timeline, block"""
)
def action_blocks(t: Tables) -> DataFrame:
    """Basic blocks: a branch ends one."""
    return actions.block_table(blocks(t)).select("block_id", "start", "end")
