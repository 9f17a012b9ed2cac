"""Display-list queries over the event timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import folds as f
from sparkloom.plans.registry import Tables, query
from sparkloom.plans.timeline import AT, KEY, ROWS, framed, rows

_OPS = f"""(SELECT timeline, idx, depth, kind, CASE WHEN kind = 'signup' THEN character END AS character, CASE WHEN kind IN ('signup', 'view') THEN cents END AS pos
  FROM {ROWS} WHERE kind <> 'purchase') AS o"""
_STATE = f"""(SELECT *, last_value(CASE WHEN kind <> 'error' THEN character END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN kind <> 'error' THEN pos END IGNORE NULLS) OVER w AS p
  FROM (SELECT *, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY timeline, depth ORDER BY idx ROWS UNBOUNDED PRECEDING) AS epoch FROM {_OPS})
  WINDOW w AS (PARTITION BY timeline, depth, epoch ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS s"""


def ops(df: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return df.where("kind <> 'purchase'").withColumns(
        {"character": F.when(kind == "signup", F.col("character")), "pos": F.when(kind.isin("signup", "view"), F.col("cents"))}
    )


@query(
    f"""SELECT timeline, depth, c AS character, coalesce(p, 0) AS pos, CAST(placed AS BIGINT) AS placed FROM (
    SELECT *, sum(CASE WHEN kind <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY timeline, depth, epoch) AS placed,
           row_number() OVER (PARTITION BY timeline, depth ORDER BY idx DESC) AS last FROM {_STATE}) WHERE last = 1 AND kind <> 'error'"""
)
def display_fold(t: Tables) -> DataFrame:
    """The display list after all operations: later fields over earlier ones, a removal clears its depth."""
    out = f.fold_slots(ops(rows(t)), KEY, "depth", AT, F.col("kind") == "error", ["character", "pos"])
    return out.select("timeline", "depth", "character", F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), "placed")


@query(
    f"""WITH fr AS (SELECT timeline, idx, CAST(coalesce(sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER
      (PARTITION BY timeline ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frame FROM {ROWS}),
    s AS (SELECT st.*, frame FROM {_STATE.replace(") AS s", ")")} AS st JOIN fr USING (timeline, idx)),
    e AS (SELECT *, row_number() OVER (PARTITION BY timeline, depth, frame ORDER BY idx DESC) AS last,
      min(CASE WHEN kind <> 'error' THEN frame END) OVER (PARTITION BY timeline, depth, epoch) AS since FROM s),
    g AS (SELECT timeline, max(frame) AS final FROM s GROUP BY ALL),
    all_frames AS (SELECT timeline, unnest(range(0, final + 1)) AS frame FROM g),
    slots AS (SELECT DISTINCT timeline, depth FROM s),
    j AS (SELECT a.timeline, a.frame, sl.depth, e.kind, e.c, e.p, e.since, row_number() OVER (PARTITION BY a.timeline, a.frame, sl.depth ORDER BY e.frame DESC) AS n
      FROM all_frames a JOIN slots sl USING (timeline) JOIN e ON e.timeline = a.timeline AND e.depth = sl.depth AND e.frame <= a.frame AND e.last = 1)
    SELECT timeline, frame, depth, c AS character, p AS pos, since FROM j WHERE n = 1 AND kind <> 'error'"""
)
def frame_snapshot(t: Tables) -> DataFrame:
    """The display list at the end of every frame, with the frame each depth was filled in."""
    o = ops(framed(t))
    return f.snapshots(o, KEY, "frame", "depth", AT, F.col("kind") == "error", ["character", "pos"]).select("timeline", "frame", "depth", "character", "pos", "since")


@query(
    f"""WITH m AS (SELECT timeline, idx, depth, CASE WHEN kind = 'error' THEN depth + 1 + character % 3 END AS clip_to FROM {ROWS}),
    l AS (SELECT *, last_value(CASE WHEN clip_to IS NOT NULL THEN depth END IGNORE NULLS) OVER w AS s, last_value(clip_to IGNORE NULLS) OVER w AS e FROM m
      WINDOW w AS (PARTITION BY timeline ORDER BY depth, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT timeline, idx, depth, CASE WHEN depth > s AND depth <= e THEN s END AS clip FROM l"""
)
def clip_ranges(t: Tables) -> DataFrame:
    """The mask in force for each item in depth order; masks reach over a range of depths."""
    m = rows(t).withColumn("clip_to", F.when(F.col("kind") == "error", F.col("depth") + 1 + F.col("character") % 3))
    return f.clip_ranges(m, KEY, ["depth", "idx"], "depth", "clip_to").select("timeline", "idx", "depth", "clip")


@query(
    f"""WITH r AS (SELECT timeline, idx, depth, character, kind = 'error' AND character % 4 > 0 AS masks, depth + 1 + character % 3 AS reach, row_number() OVER (PARTITION BY timeline ORDER BY depth, idx) AS n FROM {ROWS}),
    m AS (SELECT r.timeline, r.idx, max(k.n) AS last FROM r JOIN r AS k ON k.timeline = r.timeline AND k.masks AND k.n < r.n GROUP BY ALL)
    SELECT r.timeline, r.idx, CASE WHEN k.n IS NULL THEN p.x0 ELSE greatest(p.x0, k.character) END AS cut_x0, CASE WHEN k.n IS NULL THEN p.x1 ELSE least(p.x1, k.character + 20) END AS cut_x1
    FROM r JOIN (SELECT DISTINCT timeline, CASE WHEN timeline % 2 = 0 THEN 10 END AS x0, CASE WHEN timeline % 2 = 0 THEN 40 END AS x1 FROM {ROWS}) AS p ON p.timeline = r.timeline
    LEFT JOIN m ON m.timeline = r.timeline AND m.idx = r.idx LEFT JOIN r AS k ON k.timeline = m.timeline AND k.n = m.last AND r.depth > k.depth AND r.depth <= k.reach"""
)
def clip_boxes(t: Tables) -> DataFrame:
    """What each item is cut to: the mask in force and the parent's box, either of which may be missing."""
    even, c = F.col("timeline") % 2 == 0, F.col("character")
    r = rows(t).withColumns({"reach": F.when(F.col("kind") == "error", F.col("depth") + 1 + c % 3), "b0": c, "b1": F.lit(0), "b2": c + 20, "b3": F.lit(9), "x0": F.when(even, 10), "y0": F.lit(0), "x1": F.when(even, 40), "y1": F.lit(9)})
    out = f.clip_boxes(r, KEY, ["depth", "idx"], "depth", "reach", ["b0", "b1", "b2", "b3"], ["x0", "y0", "x1", "y1"], c % 4 > 0)
    return out.select("timeline", "idx", F.col("cut_x0").cast("long").alias("cut_x0"), F.col("cut_x1").cast("long").alias("cut_x1"))


@query(f"SELECT timeline, idx, clock, (clock // 83) % 24 AS frame FROM (SELECT timeline, idx, CAST(sum(character) OVER (PARTITION BY timeline ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS clock FROM {ROWS})")
def playback_clock(t: Tables) -> DataFrame:
    """The frame shown after adding up elapsed time, wrapped at the end."""
    return f.playback(rows(t), KEY, AT, "character", 83, 24).select("timeline", "idx", "clock", "frame")


@query(
    f"""WITH o AS (SELECT timeline, depth, idx, kind, CASE WHEN kind <> 'error' OR character % 2 > 0 THEN character END AS character FROM {ROWS}),
    p AS (SELECT timeline, depth, max(idx) AS idx, arg_max(character, idx) AS character FROM o WHERE kind = 'signup' GROUP BY timeline, depth)
    SELECT timeline, depth AS slot, character FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.timeline = p.timeline AND o.depth = p.depth AND o.idx > p.idx AND o.kind = 'error' AND coalesce(o.character = p.character, true))"""
)
def removal_by_character(t: Tables) -> DataFrame:
    """The list under the stricter rule: a removal holds only if it names the character in its depth, or none.

    Each state depends on the state before, so rows are folded in order. The oracle asks of each depth's last placement
    whether a removal that fits comes behind it.
    """
    kind = F.when(F.col("kind") == "signup", "place").when(F.col("kind") == "error", "remove").otherwise("skip")
    own = F.when((F.col("kind") == "error") & (F.col("character") % 2 == 0), None).otherwise(F.col("character"))
    o = rows(t).select("timeline", "idx", "depth", kind.alias("kind"), own.alias("character"))
    return f.fold_matching_removals(o, "timeline", "depth", "idx", "kind", "character")
