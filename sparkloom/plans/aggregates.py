"""Histograms, folds of diagnostics, verdicts and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.registry import Tables, query
from sparkloom.plans.timeline import FRAMED, ROWS, framed, rows

SEVERITY = {"error": "error", "purchase": "warning"}
_SEV = "CASE kind WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END"


def _severity(c):
    return F.when(c == "error", "error").when(c == "purchase", "warning").otherwise("info")


@query("SELECT event_type AS code, count(*) AS n FROM events GROUP BY ALL")
def tag_histogram(t: Tables) -> DataFrame:
    """Rows per code."""
    return t.events.groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"))


def folded(t: Tables) -> DataFrame:
    d = rows(t).withColumn("severity", _severity(F.col("kind")))
    first = F.min_by(F.struct("idx", "cents", "severity"), "idx").alias("first")
    d = d.groupBy(F.col("kind").alias("code"), F.col("depth").alias("context"), "timeline").agg(F.count("*").alias("n"), first)
    return d.select("code", "context", "timeline", "n", "first.idx", "first.cents", "first.severity")


_FOLDED = f"(SELECT kind AS code, depth AS context, timeline, count(*) AS n, min(idx) AS idx, arg_min(cents, idx) AS cents, min({_SEV}) AS severity FROM {ROWS} GROUP BY ALL) AS f"


@query(f"SELECT * FROM {_FOLDED}")
def diag_fold(t: Tables) -> DataFrame:
    """Diagnostics folded by key: the first row's fields stay, the count goes up."""
    return folded(t)


@query(f"SELECT severity, count(*) AS n FROM {_FOLDED} GROUP BY ALL")
def severity_summary(t: Tables) -> DataFrame:
    """Folded rows (not occurrences) per severity."""
    return folded(t).groupBy("severity").agg(F.count("*").alias("n"))


@query("SELECT coalesce(CAST(quality AS VARCHAR), '') AS key, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def count_by(t: Tables) -> DataFrame:
    """Rows by a key, where null counts as the empty one."""
    d = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return d.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("key")).agg(F.count("*").alias("n"))


@query(
    """SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (text IS NULL) AS unreadable,
    count(*) FILTER (contains(text, '@')) AS with_sign, bool_or(length(text) > 5000) AS any_long FROM documents GROUP BY ALL"""
)
def census(t: Tables) -> DataFrame:
    """Counts per format label, and which files hold something."""
    return t.documents.groupBy("lang").agg(
        F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.count_if(F.col("text").isNull()).alias("unreadable"),
        F.count_if(F.col("text").contains("@")).alias("with_sign"), F.bool_or(F.length("text") > 5000).alias("any_long"),
    )


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS codes FROM events GROUP BY ALL")
def distinct_codes(t: Tables) -> DataFrame:
    """Sorted distinct codes of each file."""
    return t.events.groupBy("user_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("codes"))


@query(
    """SELECT source, n_a, n_b, n_both, n_none, CASE WHEN n_both > 0 THEN 'mixed' WHEN n_a > 0 AND n_b > 0 THEN 'split' WHEN n_a > 0 THEN 'a' WHEN n_b > 0 THEN 'b' ELSE 'none' END AS verdict FROM (
    SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS n_a, count(*) FILTER (quality = 0 AND toxic = 1) AS n_b, count(*) FILTER (quality = 1 AND toxic = 1) AS n_both,
    count(*) FILTER (quality IS NULL) AS n_none FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)"""
)
def verdict_tally(t: Tables) -> DataFrame:
    """Independent counts of outcomes, and the verdict that follows from which are not zero."""
    q, x = F.col("quality"), F.col("toxic")
    d = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").groupBy("source").agg(
        F.count_if((q == 1) & (x == 0)).alias("n_a"), F.count_if((q == 0) & (x == 1)).alias("n_b"), F.count_if((q == 1) & (x == 1)).alias("n_both"), F.count_if(q.isNull()).alias("n_none")
    )
    verdict = F.when(F.col("n_both") > 0, "mixed").when((F.col("n_a") > 0) & (F.col("n_b") > 0), "split").when(F.col("n_a") > 0, "a").when(F.col("n_b") > 0, "b").otherwise("none")
    return d.withColumn("verdict", verdict)


@query(
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"""
)
def corpus_rollup(t: Tables) -> DataFrame:
    """Totals, per group and per group and head, in one pass."""
    o = t.orders.select("o_orderstatus", "o_orderpriority", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    a, b = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.rollup(a, b).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.sum("c").alias("cents"))


_REASON = f"(SELECT timeline * 100000 + frame AS block, idx, CASE kind WHEN 'error' THEN 'hard' WHEN 'view' THEN 'soft' WHEN 'click' THEN 'odd' END AS reason FROM {FRAMED}) AS r"


def reasons(t: Tables) -> DataFrame:
    k = F.col("kind")
    reason = F.when(k == "error", "hard").when(k == "view", "soft").when(k == "click", "odd")
    return framed(t).select((F.col("timeline") * 100000 + F.col("frame")).alias("block"), "idx", reason.alias("reason"))


@query(
    f"""SELECT block, CASE WHEN bool_or(reason = 'hard') THEN 2 WHEN count(reason) > 0 THEN 1 ELSE 0 END AS tier, min(idx) FILTER (reason = 'hard') AS first_hard,
    count(DISTINCT reason) AS reasons FROM {_REASON} GROUP BY ALL"""
)
def tier_assign(t: Tables) -> DataFrame:
    """The tier of a block from its reasons: any hard one gives 2, any other (known or not) 1, none 0."""
    r = reasons(t).groupBy("block").agg(
        F.coalesce(F.bool_or(F.col("reason") == "hard"), F.lit(False)).alias("hard"), F.count("reason").alias("n"),
        F.min(F.when(F.col("reason") == "hard", F.col("idx"))).alias("first_hard"), F.countDistinct("reason").alias("reasons"),
    )
    return r.select("block", F.when(F.col("hard"), 2).when(F.col("n") > 0, 1).otherwise(0).alias("tier"), "first_hard", "reasons")


@query(
    f"""WITH x AS (SELECT timeline, frame, CASE WHEN bool_or(kind = 'error') THEN 2 WHEN bool_or(kind = 'view') THEN 1 ELSE 0 END AS tier FROM (
      SELECT *, coalesce(sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY timeline ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS frame FROM {ROWS}) GROUP BY ALL)
    SELECT timeline, count(*) FILTER (tier = 0) AS t0, count(*) FILTER (tier = 1) AS t1, count(*) FILTER (tier = 2) AS t2, count(*) AS entries FROM x GROUP BY ALL"""
)
def tier_pivot(t: Tables) -> DataFrame:
    """Entries per tier, as columns that add up to all entries."""
    k = F.col("kind")
    x = framed(t).groupBy("timeline", "frame").agg(F.when(F.bool_or(k == "error"), 2).when(F.bool_or(k == "view"), 1).otherwise(0).alias("tier"))
    x = x.groupBy("timeline").pivot("tier", [0, 1, 2]).agg(F.count(F.lit(1)))
    return x.select("timeline", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"t{i}") for i in range(3)]).withColumn("entries", F.col("t0") + F.col("t1") + F.col("t2"))


@query(f"SELECT kind AS feature, min(idx) AS seq, arg_min(timeline, idx) AS via FROM {ROWS} GROUP BY ALL")
def first_via(t: Tables) -> DataFrame:
    """Per required feature what asked for it first."""
    return rows(t).groupBy(F.col("kind").alias("feature")).agg(F.min("idx").alias("seq"), F.min_by("timeline", "idx").alias("via"))


@query(
    f"""WITH g(grp, rank) AS (VALUES ('view', 1), ('click', 2), ('signup', 3), ('purchase', 4)),
    e AS (SELECT timeline, frame, kind FROM {FRAMED}),
    f AS (SELECT timeline, frame, bool_or(kind = 'error') AS forced FROM e GROUP BY ALL),
    u AS (SELECT DISTINCT timeline, frame, CASE kind WHEN 'signup' THEN 'view' ELSE kind END AS grp FROM e)
    SELECT f.timeline, f.frame, g.grp, g.rank, f.forced, f.forced OR u.grp IS NOT NULL AS kept FROM f CROSS JOIN g LEFT JOIN u ON u.timeline = f.timeline AND u.frame = f.frame AND u.grp = g.grp"""
)
def shake_groups(t: Tables) -> DataFrame:
    """Which feature groups an entry keeps: those it uses, some folded into another, or all where one part is opaque."""
    groups = ["view", "click", "signup", "purchase"]
    e = framed(t)
    used = F.collect_set(F.when(F.col("kind") == "signup", "view").otherwise(F.col("kind")))
    e = e.groupBy("timeline", "frame").agg(F.bool_or(F.col("kind") == "error").alias("forced"), used.alias("used"))
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(i + 1).alias("rank")) for i, g in enumerate(groups)]))
    e = e.withColumn("g", each)
    return e.select("timeline", "frame", "g.grp", "g.rank", "forced", (F.col("forced") | F.array_contains("used", F.col("g.grp"))).alias("kept"))


@query(
    """SELECT lang, count(*) FILTER (NOT ok) AS bad, coalesce(array_to_string(list_sort(list(doc_id) FILTER (NOT ok AND n_chars > 8000)), ','), '') AS longest FROM (
    SELECT lang, doc_id, n_chars, length(text) % 7 <> 0 AS ok FROM documents) GROUP BY ALL"""
)
def integrity_lists(t: Tables) -> DataFrame:
    """Failing files per class, and the sorted list of those that matter most."""
    d = t.documents.select("lang", "doc_id", "n_chars", (F.length("text") % 7 != 0).alias("ok"))
    longest = F.array_sort(F.collect_list(F.when(~F.col("ok") & (F.col("n_chars") > 8000), F.col("doc_id"))))
    return d.groupBy("lang").agg(F.count_if(~F.col("ok")).alias("bad"), F.concat_ws(",", F.transform(longest, lambda x: x.cast("string"))).alias("longest"))


_XY = "CAST(l_quantity AS BIGINT) AS x, CAST(floor(l_extendedprice) AS BIGINT) AS y"


@query(f"SELECT l_suppkey, min(least(x, w)) AS x0, min(y) AS y0, max(greatest(x, w)) AS x1, max(y) AS y1 FROM (SELECT l_suppkey, {_XY}, l_linenumber * 10 AS w FROM lineitem) GROUP BY ALL")
def rect_union(t: Tables) -> DataFrame:
    """The rectangle around all rectangles of a group; inverted ones are read either way round."""
    li = t.lineitem.select("l_suppkey", F.col("l_quantity").cast("long").alias("x"), F.floor("l_extendedprice").cast("long").alias("y"), (F.col("l_linenumber") * 10).cast("long").alias("w"))
    return li.groupBy("l_suppkey").agg(F.min(F.least("x", "w")).alias("x0"), F.min("y").alias("y0"), F.max(F.greatest("x", "w")).alias("x1"), F.max("y").alias("y1"))


@query(
    """SELECT s.doc_id, count(l.doc_id) AS frames, CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS payload, CAST(coalesce(sum(l.quality + 10), 0) AS BIGINT) AS bytes
    FROM documents s LEFT JOIN labels l USING (doc_id) GROUP BY ALL"""
)
def stream_extent(t: Tables) -> DataFrame:
    """Frames of each stream with their bytes, a header of ten counted for each; streams without frames stay."""
    d = t.documents.select("doc_id").join(t.labels.withColumn("hit", F.lit(1)), "doc_id", "left")
    q = F.col("quality")
    return d.groupBy("doc_id").agg(F.count("hit").alias("frames"), F.coalesce(F.sum(q), F.lit(0)).alias("payload"), F.coalesce(F.sum(q + 10), F.lit(0)).alias("bytes"))


@query(
    r"""SELECT grp, count(*) AS n, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM (
    SELECT html, CASE WHEN len(p) > 2 THEN p[1] || '/' || p[2] ELSE p[1] END AS grp FROM (SELECT html, string_split(regexp_replace(url, '^https?://', ''), '/') AS p FROM pages)) GROUP BY ALL"""
)
def bytes_by_group(t: Tables) -> DataFrame:
    """Bytes per module group: the first two parts of a path of more than two, else the first."""
    p = F.split(F.regexp_replace("url", "^https?://", ""), "/")
    d = t.pages.select(F.octet_length("html").cast("long").alias("bytes"), p.alias("p"))
    grp = F.when(F.size("p") > 2, F.concat_ws("/", F.slice("p", 1, 2))).otherwise(F.element_at("p", 1))
    return d.groupBy(grp.alias("grp")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def font_metrics(fonts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """`font`, `ascent`, `descent`, `leading`, `derived`: as authored where a font states both extremes, else from its glyphs' bounds.

    Glyph space points down from the base line, so the ascent is the greatest -`y_min` and the descent the greatest `y_max`,
    neither below zero; glyphs without bounds count for nothing, and leading cannot be derived.
    """
    bounds = glyphs.groupBy("font").agg(F.max(-F.col("y_min")).alias("up"), F.max("y_max").alias("down"))
    f = fonts.select("font", F.col("ascent").alias("a"), F.col("descent").alias("d"), "leading").join(bounds, "font", "left")
    authored = F.col("a").isNotNull() & F.col("d").isNotNull()
    up, down = F.greatest(F.lit(0), F.coalesce("up", F.lit(0))), F.greatest(F.lit(0), F.coalesce("down", F.lit(0)))
    return f.select("font", F.when(authored, F.col("a")).otherwise(up).alias("ascent"), F.when(authored, F.col("d")).otherwise(down).alias("descent"), F.coalesce("leading", F.lit(0)).alias("leading"), (~authored).alias("derived"))


@query(
    f"""WITH g AS (SELECT timeline AS font, max(CASE WHEN kind <> 'error' THEN 2 - depth END) AS up, max(CASE WHEN kind <> 'error' THEN depth - 1 END) AS down FROM {ROWS} GROUP BY ALL),
    f AS (SELECT c_custkey AS font, CASE WHEN c_custkey % 3 = 0 THEN 700 END AS a, CASE WHEN c_custkey % 2 = 0 THEN 90 END AS d, CASE WHEN c_custkey % 5 = 0 THEN 11 END AS l FROM customer)
    SELECT font, CAST(CASE WHEN font % 6 = 0 THEN 700 WHEN coalesce(up, 0) > 0 THEN up ELSE 0 END AS BIGINT) AS ascent, CAST(CASE WHEN font % 6 = 0 THEN 90 WHEN coalesce(down, 0) > 0 THEN down ELSE 0 END AS BIGINT) AS descent,
    CASE WHEN l = 11 THEN 11 ELSE 0 END AS leading, font % 6 <> 0 AS derived FROM f LEFT JOIN g USING (font)"""
)
def derived_metrics(t: Tables) -> DataFrame:
    """Font metrics as authored, or derived from glyph bounds; some fonts have no glyphs, some glyphs no bounds."""
    k, shown = F.col("c_custkey"), F.col("kind") != "error"
    glyphs = rows(t).select(F.col("timeline").alias("font"), F.when(shown, F.col("depth") - 2).alias("y_min"), F.when(shown, F.col("depth") - 1).alias("y_max"))
    fonts = t.customer.select(k.alias("font"), F.when(k % 3 == 0, 700).alias("ascent"), F.when(k % 2 == 0, 90).alias("descent"), F.when(k % 5 == 0, 11).alias("leading"))
    m = font_metrics(fonts, glyphs)
    return m.select("font", F.col("ascent").cast("long").alias("ascent"), F.col("descent").cast("long").alias("descent"), "leading", "derived")
