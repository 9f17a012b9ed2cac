"""Scalar functions over numeric columns. Oracles spell the rules out in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import scalars as s
from sparkloom.plans.registry import Tables, query

_V = "CAST(event_id AS BIGINT) * 7919 % 65536"


def raw(t: Tables, *more: str) -> DataFrame:
    return t.events.select("event_id", *more, (F.col("event_id") * 7919 % 65536).alias("v"))


@query(f"SELECT event_id, CASE WHEN v & 511 >= 256 THEN (v & 511) - 512 ELSE v & 511 END AS x FROM (SELECT event_id, {_V} AS v FROM events)")
def sign_extend(t: Tables) -> DataFrame:
    """Nine bits read as a signed number."""
    return raw(t).select("event_id", s.sign_extend(F.col("v"), 9).cast("long").alias("x"))


@query(f"SELECT event_id, v / 65536.0 AS f16, v / 256.0 AS f8 FROM (SELECT event_id, CAST({_V} AS DOUBLE) AS v FROM events)")
def fixed_point(t: Tables) -> DataFrame:
    """Fixed-point fields as doubles."""
    return raw(t).select("event_id", s.fixed16(F.col("v")).alias("f16"), s.fixed8(F.col("v")).alias("f8"))


@query(
    f"""SELECT event_id, CASE WHEN e = 31 THEN NULL WHEN e = 0 THEN s * m / 16777216.0 ELSE s * CAST(1024 + m AS DOUBLE) * pow(2.0, e - 25) END AS x,
    CASE WHEN e < 31 THEN 'none' WHEN m = 0 THEN 'inf' ELSE 'nan' END AS special
    FROM (SELECT event_id, (v // 1024) % 32 AS e, v % 1024 AS m, CASE WHEN v >= 32768 THEN -1.0 ELSE 1.0 END AS s FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 31744 + event_id % 3 ELSE {_V} END AS v FROM events))"""
)
def half_float(t: Tables) -> DataFrame:
    """Half-precision fields with the class of special values (shown as null)."""
    i = F.col("event_id")
    v = raw(t).select("event_id", F.when(i % 50 == 0, 31744 + i % 3).otherwise(F.col("v")).alias("v"))
    special = s.float16_special(F.col("v"))
    return v.select("event_id", F.when(special == "none", s.float16(F.col("v"))).alias("x"), special.alias("special"))


@query("SELECT event_id, CAST(CASE WHEN h >= 0 THEN floor(h + 0.5) ELSE -floor(-h + 0.5) END AS BIGINT) AS x FROM (SELECT event_id, (event_id % 41 - 20) / 2.0 AS h FROM events)")
def quantise(t: Tables) -> DataFrame:
    """Rounding half away from zero."""
    return t.events.select("event_id", s.round_away((F.col("event_id") % 41 - 20) / 2.0).alias("x"))


@query("SELECT event_id, CAST(round_even(h, 0) AS BIGINT) AS x FROM (SELECT event_id, (event_id % 41 - 20) / 2.0 AS h FROM events)")
def round_even(t: Tables) -> DataFrame:
    """Rounding half to even."""
    return t.events.select("event_id", s.round_even((F.col("event_id") % 41 - 20) / 2.0).alias("x"))


@query("SELECT event_id, CAST(floor(h + 0.5) AS BIGINT) AS x FROM (SELECT event_id, (event_id % 41 - 20) / 2.0 AS h FROM events)")
def round_half_up(t: Tables) -> DataFrame:
    """Rounding half up."""
    return t.events.select("event_id", s.round_up((F.col("event_id") % 41 - 20) / 2.0).alias("x"))


@query("SELECT event_id, CASE WHEN n < 0 THEN -((-n + d // 2) // d) ELSE (n + d // 2) // d END AS x FROM (SELECT event_id, event_id % 201 - 100 AS n, event_id % 7 + 1 AS d FROM events)")
def rounded_div(t: Tables) -> DataFrame:
    """Integer division to the nearest."""
    return t.events.select("event_id", s.rounded_div(F.col("event_id") % 201 - 100, F.col("event_id") % 7 + 1).alias("x"))


@query(f"SELECT event_id, least(255, greatest(0, v - 30000)) AS byte, least(32767, greatest(-32768, v * 3 - 90000)) AS pcm, least(88, greatest(0, v % 200 - 60)) AS step FROM (SELECT event_id, {_V} AS v FROM events)")
def clamp(t: Tables) -> DataFrame:
    """Values held to a byte, a 16-bit sample and a step index."""
    v = F.col("v")
    return raw(t).select("event_id", s.clamp(v - 30000, 0, 255).cast("long").alias("byte"), s.clamp(v * 3 - 90000, -32768, 32767).cast("long").alias("pcm"), s.clamp(v % 200 - 60, 0, 88).cast("long").alias("step"))


@query(f"SELECT event_id, CAST(least(255, greatest(0, floor((v % 256) * (event_id % 513) / 256.0 + (event_id % 101 - 50) + 0.5))) AS BIGINT) AS x FROM (SELECT event_id, {_V} AS v FROM events)")
def colour_transform(t: Tables) -> DataFrame:
    """Colour channels under a transform."""
    i = F.col("event_id")
    return raw(t).select("event_id", s.colour_transform(F.col("v") % 256, i % 513, i % 101 - 50).cast("long").alias("x"))


@query(f"SELECT event_id, CAST(least(255, greatest(0, round_even((a * b + c * (255 - b)) / 255.0, 0))) AS BIGINT) AS x FROM (SELECT event_id, v % 256 AS a, event_id % 256 AS b, v // 256 AS c FROM (SELECT event_id, {_V} AS v FROM events))")
def blend(t: Tables) -> DataFrame:
    """Source over target."""
    v = F.col("v")
    return raw(t).select("event_id", s.blend(v % 256, F.col("event_id") % 256, F.floor(v / 256)).cast("long").alias("x"))


_M = "(SELECT p_partkey AS k, p_size % 5 - 2 AS a, p_size % 3 AS b, p_partkey % 4 - 1 AS c, p_partkey % 7 - 3 AS d, p_size * 2 AS tx, p_partkey % 50 AS ty FROM part)"


def matrices(t: Tables) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    return t.part.select(k.alias("k"), (z % 5 - 2).alias("a"), (z % 3).alias("b"), (k % 4 - 1).alias("c"), (k % 7 - 3).alias("d"), (z * 2).alias("tx"), (k % 50).alias("ty"))


def _m() -> list:
    return [F.col(x) for x in ("a", "b", "c", "d", "tx", "ty")]


@query(f"SELECT k, a * 3 + c * 5 + tx AS x, b * 3 + d * 5 + ty AS y, abs(a * d - b * c) AS area FROM {_M}")
def affine(t: Tables) -> DataFrame:
    """A point under a matrix, and by how much the matrix scales areas."""
    x, y = s.affine(*_m(), F.lit(3), F.lit(5))
    return matrices(t).select("k", x.cast("long").alias("x"), y.cast("long").alias("y"), F.abs(F.expr("a * d - b * c")).cast("long").alias("area"))


@query(f"SELECT k, round(degrees(atan2(b, a)), 6) + 0 AS rotation, round(sqrt(a * a + b * b), 6) AS scale_x, CASE WHEN a = 0 AND b = 0 THEN NULL ELSE round((a * d - b * c) / sqrt(a * a + b * b), 6) + 0 END AS scale_y FROM {_M}")
def matrix_decompose(t: Tables) -> DataFrame:
    """Rotation and scales of a matrix; without a first axis there is no second scale."""
    scale = F.sqrt((F.col("a") * F.col("a") + F.col("b") * F.col("b")).cast("double"))
    det = F.expr("double(a * d - b * c)")
    turn = F.round(F.degrees(F.atan2(F.col("b").cast("double"), F.col("a").cast("double"))), 6) + 0
    return matrices(t).select("k", turn.alias("rotation"), F.round(scale, 6).alias("scale_x"), (F.round(F.try_divide(det, scale), 6) + 0).alias("scale_y"))


@query(
    f"""SELECT k, least(0, a * 10, c * 20, a * 10 + c * 20) + tx AS x0, least(0, b * 10, d * 20, b * 10 + d * 20) + ty AS y0,
    greatest(0, a * 10, c * 20, a * 10 + c * 20) + tx AS x1, greatest(0, b * 10, d * 20, b * 10 + d * 20) + ty AS y1 FROM {_M}"""
)
def rect_transform(t: Tables) -> DataFrame:
    """The upright rectangle around a transformed one."""
    box = s.transformed_rect(*_m(), (F.lit(0), F.lit(0), F.lit(10), F.lit(20)))
    return matrices(t).select("k", *[c.cast("long").alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])


@query("SELECT p_partkey, greatest(CASE WHEN p_size > 10 THEN p_size END, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 60 END) AS lo, least(CASE WHEN p_size > 10 THEN p_size + 20 END, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 60 + 15 END) AS hi FROM part")
def clip_intersect(t: Tables) -> DataFrame:
    """Intersection of two clips, where null is no clip."""
    z, k = F.col("p_size"), F.col("p_partkey")
    a, b = F.when(z > 10, z), F.when(k % 3 > 0, k % 60)
    return t.part.select("p_partkey", F.greatest(a, b).cast("long").alias("lo"), F.least(a + 20, b + 15).cast("long").alias("hi"))


@query(
    """SELECT user_id, CAST(abs(sum(x * ny - nx * y)) AS BIGINT) AS twice_area, count(*) AS n FROM (
    SELECT user_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM (
      SELECT user_id, event_id, event_id % 100 AS x, CAST(floor(value) AS BIGINT) AS y FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY ALL HAVING count(*) >= 3 AND sum(x * ny - nx * y) <> 0"""
)
def polygon_area(t: Tables) -> DataFrame:
    """Twice the area of each polygon; those with fewer than three points or no area are left out."""
    from pyspark.sql import Window as W

    e = t.events.select("user_id", "event_id", (F.col("event_id") % 100).alias("x"), F.floor("value").cast("long").alias("y"))
    w = W.partitionBy("user_id").orderBy("event_id")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = e.withColumns({f"n{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("x", "y")})
    out = e.groupBy("user_id").agg(F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))).alias("twice_area"), F.count("*").alias("n"))
    return out.where("n >= 3 and twice_area >= 2e-9")


@query(
    """SELECT event_id, d AS distance, CASE WHEN d / 2 <= 4 THEN 1 WHEN d / 2 <= 16 THEN 2 WHEN d / 2 <= 36 THEN 3 WHEN d / 2 <= 64 THEN 4 WHEN d / 2 <= 100 THEN 5 WHEN d / 2 <= 144 THEN 6 WHEN d / 2 <= 196 THEN 7 ELSE 8 END AS n
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN abs(y) WHEN 1 THEN abs(x) WHEN 2 THEN abs(4 * x - 3 * y) / 5 ELSE sqrt(x * x + y * y) END AS d
      FROM (SELECT event_id, CAST(event_id % 97 - 48 AS DOUBLE) AS x, CAST(floor(value) AS DOUBLE) AS y FROM events))"""
)
def curve_segments(t: Tables) -> DataFrame:
    """Segments that a curve is cut into, by its control point's distance from a level, an upright, a 3-4-5 or no line."""
    i, zero = F.col("event_id"), F.lit(0.0)
    e = t.events.select("event_id", (i % 97 - 48).cast("double").alias("x"), F.floor("value").cast("double").alias("y"), F.when(i % 4 == 0, 7.0).when(i % 4 == 2, 3.0).otherwise(0.0).alias("bx"), F.when(i % 4 == 1, 5.0).when(i % 4 == 2, 4.0).otherwise(0.0).alias("by"))
    e = e.select("event_id", s.distance_to_line(F.col("x"), F.col("y"), zero, zero, F.col("bx"), F.col("by")).alias("distance"))
    return e.select("event_id", "distance", s.segments(F.col("distance") / 2, 4.0).alias("n"))


@query("SELECT event_id, CASE WHEN u = 0 THEN a WHEN u = 1 THEN b ELSE (1 - u) * a + u * b END AS x FROM (SELECT event_id, CAST(event_id % 50 AS DOUBLE) AS a, CAST(event_id % 70 AS DOUBLE) AS b, event_id % 5 / 4.0 AS u FROM events)")
def lerp(t: Tables) -> DataFrame:
    """Linear interpolation, exact at the ends."""
    i = F.col("event_id")
    return t.events.select("event_id", s.lerp((i % 50).cast("double"), (i % 70).cast("double"), i % 5 / 4.0).alias("x"))


@query("SELECT event_id, greatest(0, least(n, a) - 10) AS start, greatest(0, least(n, b) - 10) AS stop FROM (SELECT event_id, event_id % 90 AS a, event_id % 90 + 30 AS b, 80 AS n FROM events)")
def rebase_clamp(t: Tables) -> DataFrame:
    """Loop points moved by the leading gap and held to the samples there are."""
    a = F.col("event_id") % 90
    return t.events.select("event_id", *[F.greatest(F.lit(0), F.least(F.lit(80), x) - 10).cast("long").alias(n) for x, n in ((a, "start"), (a + 30, "stop"))])


@query(
    """SELECT event_id, least(1.0, greatest(0.0, u)) AS pad, u - floor(u) AS repeated, CASE WHEN u - 2 * floor(u / 2) > 1 THEN 2 - (u - 2 * floor(u / 2)) ELSE u - 2 * floor(u / 2) END AS reflected
    FROM (SELECT event_id, (event_id % 33 - 16) / 8.0 AS u FROM events)"""
)
def spread_mode(t: Tables) -> DataFrame:
    """Gradient positions padded, repeated and reflected."""
    u = (F.col("event_id") % 33 - 16) / 8.0
    return t.events.select("event_id", s.spread(u, "pad").alias("pad"), s.spread(u, "repeat").alias("repeated"), s.spread(u, "reflect").alias("reflected"))


@query("SELECT event_id, CASE WHEN n <= 1 THEN 1 WHEN n > 1024 THEN 2048 ELSE CAST(pow(2, length(bin(n - 1))) AS INTEGER) END AS side FROM (SELECT event_id, event_id % 3000 AS n FROM events)")
def next_pow2(t: Tables) -> DataFrame:
    """Page sides: powers of two up to a maximum."""
    return t.events.select("event_id", s.next_pow2(F.col("event_id") % 3000, 2048).alias("side"))


@query(
    f"""SELECT event_id, round(CASE WHEN c <= 10.31475 THEN c / 255.0 / 12.92 ELSE pow((c / 255.0 + 0.055) / 1.055, 2.4) END, 9) AS linear,
    CASE WHEN l <= 0 THEN 0 WHEN l >= 1 THEN 255 ELSE CAST(floor(255 * CASE WHEN l <= 0.0031308 THEN l * 12.92 ELSE 1.055 * pow(l, 1 / 2.4) - 0.055 END + 0.5) AS INTEGER) END AS channel,
    CAST(round_even(CASE WHEN r = 0 THEN a WHEN r = 1 THEN b ELSE (1 - r) * a + r * b END, 0) AS BIGINT) AS morphed
    FROM (SELECT event_id, event_id % 256 AS c, (event_id % 1300 - 100) / 1000.0 AS l, CAST(event_id % 800 - 400 AS DOUBLE) AS a, CAST(event_id % 640 AS DOUBLE) AS b, {_V} / 65535.0 AS r FROM events)"""
)
def light_and_morph(t: Tables) -> DataFrame:
    """Channels to linear light and back, and coordinates between two shapes."""
    i = F.col("event_id")
    light, channel = F.round(s.srgb_to_linear(i % 256), 9), s.linear_to_srgb((i % 1300 - 100) / 1000.0)
    return raw(t).select("event_id", light.alias("linear"), channel.alias("channel"), s.morph(i % 800 - 400, i % 640, F.col("v")).alias("morphed"))
