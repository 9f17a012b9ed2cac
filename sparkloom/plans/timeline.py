"""Ordered-row queries over the event stream read as timelines.

A user's events are a timeline in the order of their ids; a purchase shows a frame, a signup places, an error removes,
anything else moves; the depth is the id modulo 5 and the character the whole part of the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import ordered as o
from sparkloom.plans.registry import Tables, query

KEY, AT = ["timeline"], ["idx"]
#: Marks the end of a frame.
SHOW = "purchase"

ROWS = """(SELECT user_id AS timeline, event_id AS idx, event_type AS kind, event_id % 5 AS depth,
  CAST(floor(value) AS BIGINT) AS character, CAST(floor(value * 100) AS BIGINT) AS cents FROM events) AS e"""


def rows(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("timeline"), F.col("event_id").alias("idx"), F.col("event_type").alias("kind"), (F.col("event_id") % 5).alias("depth"),
        F.floor("value").cast("long").alias("character"), F.floor(F.col("value") * 100).cast("long").alias("cents"),
    )


def shown() -> Column:
    return F.col("kind") == SHOW


FRAMED = f"""(SELECT *, CAST(coalesce(sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER
  (PARTITION BY timeline ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frame FROM {ROWS}) AS f"""


def framed(t: Tables) -> DataFrame:
    return o.segment(rows(t), KEY, AT, shown())


@query(f"SELECT timeline, frame, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx, CAST(sum(cents) AS BIGINT) AS cents FROM {FRAMED} GROUP BY ALL")
def frame_segment(t: Tables) -> DataFrame:
    """Frames: segments closed by each show marker; the trailing partial frame stays."""
    return framed(t).groupBy("timeline", "frame").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.sum("cents").alias("cents"))


@query(
    f"""SELECT timeline, idx, greatest(0, CAST(sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER
    (PARTITION BY timeline ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1) AS frame FROM {ROWS}"""
)
def frame_segment_alt(t: Tables) -> DataFrame:
    """The other frame numbering, in which the first marker does not advance."""
    return o.segment_lagging(rows(t), KEY, AT, shown()).select("timeline", "idx", "frame")


@query(f"SELECT timeline, count(*) FILTER (kind = 'purchase') AS frames, count(*) AS tags FROM {ROWS} GROUP BY ALL")
def frame_counts(t: Tables) -> DataFrame:
    """Show markers per timeline."""
    return rows(t).groupBy("timeline").agg(F.count_if(shown()).alias("frames"), F.count("*").alias("tags"))


@query(
    f"""WITH d AS (SELECT timeline, count(*) FILTER (kind = 'purchase') + 1 AS declared FROM {ROWS} GROUP BY ALL),
    c AS (SELECT timeline, frame, count(*) FILTER (kind = 'signup') AS places, count(*) FILTER (kind = 'error') AS removes,
      count(*) FILTER (kind NOT IN ('signup', 'error', 'purchase')) AS moves, min(kind) FILTER (kind = 'view') AS label FROM {FRAMED} GROUP BY ALL)
    SELECT timeline, frame, coalesce(places, 0) AS places, coalesce(removes, 0) AS removes, coalesce(moves, 0) AS moves, coalesce(label, '') AS label
    FROM (SELECT timeline, unnest(range(0, declared)) AS frame FROM d) LEFT JOIN c USING (timeline, frame)"""
)
def frame_summary(t: Tables) -> DataFrame:
    """Counts per frame, padded to the declared number of frames; a missing label is empty."""
    f = framed(t)
    kind = F.col("kind")
    counts = f.groupBy("timeline", "frame").agg(
        F.count_if(kind == "signup").alias("places"), F.count_if(kind == "error").alias("removes"),
        F.count_if(~kind.isin("signup", "error", "purchase")).alias("moves"), F.min(F.when(kind == "view", kind)).alias("label"),
    )
    declared = rows(t).groupBy("timeline").agg((F.count_if(shown()) + 1).alias("declared"))
    out = o.padded_segments(counts, declared, KEY, "frame", "declared")
    return out.select("timeline", "frame", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("places", "removes", "moves")], F.coalesce("label", F.lit("")).alias("label"))


_SPANS = f"""(SELECT *, CAST(sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY timeline ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS span FROM {ROWS}) AS s"""


def spans(t: Tables) -> DataFrame:
    return o.islands(rows(t), KEY, AT, F.col("kind") == "signup")


@query(
    f"""SELECT timeline, idx, span, CAST(coalesce(sum(character) OVER (PARTITION BY timeline, span ORDER BY idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sample_offset FROM {_SPANS}"""
)
def running_offset(t: Tables) -> DataFrame:
    """Sample offset of each block in its span; a head starts a span."""
    return o.running_offset(spans(t), ["timeline", "span"], AT, "character", "sample_offset").select("timeline", "idx", "span", "sample_offset")


@query(
    f"""SELECT timeline, idx, span, span = 0 AS headless, coalesce(character < max(character) OVER (PARTITION BY timeline, span ORDER BY idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM {_SPANS}"""
)
def out_of_order(t: Tables) -> DataFrame:
    """Blocks that lie behind the furthest one since the last head, and blocks without a head."""
    s = o.falls_behind(spans(t), ["timeline", "span"], AT, "character")
    return s.select("timeline", "idx", "span", (F.col("span") == 0).alias("headless"), "late")


@query(f"SELECT timeline, kind, min(idx) AS idx, count(*) AS total FROM {ROWS} GROUP BY ALL")
def once_per_kind(t: Tables) -> DataFrame:
    """The first row of each kind on a timeline, reported once with its total."""
    return rows(t).groupBy("timeline", "kind").agg(F.min("idx").alias("idx"), F.count("*").alias("total"))


@query(
    f"SELECT * FROM (SELECT timeline, depth, idx, row_number() OVER (PARTITION BY timeline, depth ORDER BY idx) AS nth FROM {ROWS} WHERE kind = 'signup') WHERE nth > 1"
)
def nth_duplicate(t: Tables) -> DataFrame:
    """Second and later initialisers of the same target."""
    return o.occurrence(rows(t).where("kind = 'signup'"), ["timeline", "depth"], AT).where("nth > 1").select("timeline", "depth", "idx", "nth")


@query(
    f"""SELECT timeline, count(*) AS n, count(*) FILTER (changed) AS param_changes FROM (
    SELECT timeline, row_number() OVER w > 1 AND (kind IS DISTINCT FROM lag(kind) OVER w OR depth IS DISTINCT FROM lag(depth) OVER w) AS changed
    FROM {ROWS} WINDOW w AS (PARTITION BY timeline ORDER BY idx)) GROUP BY ALL"""
)
def param_changes(t: Tables) -> DataFrame:
    """How often neighbouring rows differ in their parameters."""
    c = o.changes(rows(t), KEY, AT, ["kind", "depth"])
    return c.groupBy("timeline").agg(F.count("*").alias("n"), F.count_if("changed").alias("param_changes"))


@query(
    f"""WITH s AS (SELECT timeline, idx, character AS raw, 200 AS total FROM {ROWS} WHERE kind = 'view'),
    h AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE least(raw, total) END AS held, coalesce(raw < lag(raw) OVER w, false) AS backward
          FROM s WINDOW w AS (PARTITION BY timeline ORDER BY idx)),
    r AS (SELECT *, max(held) OVER (PARTITION BY timeline ORDER BY idx ROWS UNBOUNDED PRECEDING) AS start FROM h)
    SELECT timeline, idx, start, coalesce(lead(start) OVER (PARTITION BY timeline ORDER BY idx), total) AS "end", backward FROM r"""
)
def scene_ranges(t: Tables) -> DataFrame:
    """Scene starts normalised to rise, with the raw offsets that go backward flagged."""
    s = rows(t).where("kind = 'view'").select("timeline", "idx", F.col("character").alias("raw"), F.lit(200).cast("long").alias("total"))
    return o.scene_ranges(s, KEY, AT, "raw", "total").select("timeline", "idx", "start", "end", "backward")


@query(
    f"""WITH m AS (SELECT *, row_number() OVER w = 1 OR lag(kind) OVER w = 'error' OR kind = 'signup' AS boundary FROM {ROWS} WINDOW w AS (PARTITION BY timeline ORDER BY idx)),
    b AS (SELECT *, CAST(sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER (PARTITION BY timeline ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM m)
    SELECT timeline, block, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n FROM b GROUP BY ALL"""
)
def block_segment(t: Tables) -> DataFrame:
    """Basic blocks: a block starts at the first row, at a branch target and after a terminator."""
    w = o.window(KEY, AT)
    boundary = (F.row_number().over(w) == 1) | (F.lag("kind").over(w) == "error") | (F.col("kind") == "signup")
    b = o.islands(rows(t).withColumn("boundary", boundary), KEY, AT, F.col("boundary"), "block")
    return b.groupBy("timeline", "block").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n"))


@query(
    f"""SELECT timeline, idx, last_value(CASE WHEN kind = 'signup' THEN idx END IGNORE NULLS) OVER
    (PARTITION BY timeline ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pool FROM {ROWS}"""
)
def pool_in_force(t: Tables) -> DataFrame:
    """The pool record before each record."""
    p = o.value_in_force(rows(t), KEY, AT, F.when(F.col("kind") == "signup", F.col("idx")), "pool", inclusive=False)
    return p.select("timeline", "idx", "pool")


@query(
    f"""SELECT timeline, span, idx, last_value(CASE WHEN kind = 'click' THEN character END IGNORE NULLS) OVER
    (PARTITION BY timeline, span ORDER BY idx ROWS UNBOUNDED PRECEDING) AS target FROM {_SPANS}"""
)
def target_in_force(t: Tables) -> DataFrame:
    """The target in force at each record of a scope; a change holds for itself and what follows."""
    p = o.value_in_force(spans(t), ["timeline", "span"], AT, F.when(F.col("kind") == "click", F.col("character")), "target", inclusive=True)
    return p.select("timeline", "span", "idx", "target")


@query(
    f"""SELECT timeline, idx, shade FROM (SELECT timeline, idx, character % 3 AS shade, lag(character % 3) OVER (PARTITION BY timeline ORDER BY idx) AS before, row_number() OVER (PARTITION BY timeline ORDER BY idx) AS n
    FROM {ROWS} WHERE kind = 'view') WHERE n = 1 OR shade <> before"""
)
def background_changes(t: Tables) -> DataFrame:
    """The background's colours in order, each where it comes up; setting the same again changes nothing."""
    from sparkloom.operators.ordered import changes, occurrence

    v = rows(t).where("kind = 'view'").select("timeline", "idx", (F.col("character") % 3).alias("shade"))
    v = occurrence(changes(v, ["timeline"], ["idx"], ["shade"]), ["timeline"], ["idx"], "n")
    return v.where("n = 1 or changed").select("timeline", "idx", "shade")
