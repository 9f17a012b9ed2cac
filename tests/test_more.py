"""Planners, geometry, hashes, program text, the stage cache, streams and literal folding."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import folding, geometry, hashes, sources
from sparkloom.operators import planning
from sparkloom.plans.cache import StageCache
from sparkloom.streaming import timelines


def test_batches(spark):
    rows = [(1, 0, 7, True, None, 0, 0, 5, 5), (1, 1, 7, True, None, 6, 0, 9, 5), (1, 2, 8, True, None, 10, 0, 12, 5), (1, 3, 7, False, None, 20, 0, 22, 5), (1, 4, 7, True, None, 30, 0, 32, 5),
            (1, 5, 9, True, None, 4, 4, 7, 7), (1, 6, 9, True, 3, 50, 50, 60, 60)]
    df = spark.createDataFrame(rows, "scene long, idx long, material long, opaque boolean, clip int, x0 int, y0 int, x1 int, y1 int")
    got = [(r.segment, r.material, r.n) for r in planning.plan_batches(df).orderBy("segment", "batch").collect()]
    # Opaque, opaque, opaque | translucent, which nothing passes | opaque, opaque beside it | another clip.
    assert got == [(0, 7, 2), (0, 8, 1), (1, 7, 1), (2, 7, 1), (2, 9, 1), (3, 9, 1)]
    clear = spark.createDataFrame([(2, i, 5, i % 2 == 0, None, 0, 0, 9, 9) for i in range(4)], df.schema)
    assert [(r.segment, r.n) for r in planning.plan_batches(clear).orderBy("segment").collect()] == [(0, 1), (1, 1), (2, 1), (3, 1)]
    many = spark.createDataFrame([(1, i, i % 9, True, None, 10 * i, 0, 10 * i + 5, 5) for i in range(130)], df.schema)
    assert planning.plan_batches(many).agg(F.sum("n")).first()[0] == 130
    assert planning.plan_batches(many).where("material = 8").agg(F.min("segment")).first()[0] == 1


def test_fifo_cache(spark):
    rnd = random.Random(4)
    keys = [rnd.randrange(12) for _ in range(300)]
    held, hits, out = [], 0, 0
    for k in keys:
        if k in held:
            hits += 1
        else:
            held.append(k)
            if len(held) > 5:
                held.pop(0)
                out += 1
    r = planning.fifo_cache(spark.createDataFrame([(1, i, k) for i, k in enumerate(keys)], "run long, idx long, key long"), 5).first()
    assert (r.hits, r.misses, r.evictions) == (hits, 300 - hits, out)


def test_shelves(spark):
    rnd = random.Random(2)
    glyphs = [(1, i, rnd.randrange(1, 40), rnd.randrange(1, 40)) for i in range(120)] + [(1, 120, 200, 3)]
    got = planning.pack_shelves(spark.createDataFrame(glyphs, "font long, idx long, width int, height int"), side=100, most=100).collect()
    size = {i: (w, h) for _, i, w, h in glyphs}
    boxes = [(r.page, r.x, r.y, r.x + size[r.idx][0], r.y + size[r.idx][1]) for r in got if r.page is not None]
    assert len(boxes) == 120 and all(b[3] <= 98 and b[4] <= 98 for b in boxes)
    few = [(1, 0, 100, 30), (1, 1, 100, 50), (1, 2, 300, 10), (1, 3, 0, 9), (1, 4, 2045, 9), (1, 5, 20, 448), (1, 6, 20, 460)]
    few = spark.createDataFrame(few, "font long, idx long, width int, height int")
    placed = [(r.side, r.page, r.x, r.y) for r in planning.pack_shelves(few).orderBy("idx").collect()]
    assert placed == [(512, 0, 2, 2), (512, 0, 106, 2), (512, 0, 210, 2), (512, None, None, None), (512, None, None, None), (512, 0, 2, 56), (512, 1, 2, 2)]
    sides = spark.createDataFrame([(n,) for n in (0, 83, 84, 1337, 1400, 5000)], "n long")
    assert [r.s for r in sides.select(planning.page_side(F.col("n")).alias("s")).collect()] == [512, 512, 1024, 2048, 2048, 2048]
    for i, a in enumerate(boxes):
        assert not any(a[0] == b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4] for b in boxes[:i])


def test_names_skip_those_taken(spark):
    bases = ["a", "a_2", "a", "a", "b", "a_2"]
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(bases)], "scope long, idx long, base string")
    assert [r.name for r in planning.taken_names(df).orderBy("idx").collect()] == ["a", "a_2", "a_3", "a_4", "b", "a_2_2"]


def test_unknown_reasons_are_of_the_middle_tier(spark):
    df = spark.createDataFrame([(1, 0, "soft"), (1, 1, "bad:x"), (1, 2, "bad:y"), (2, 0, "never heard of"), (3, 0, None)], "block long, idx long, reason string")
    got = {r.block: (r.tier, r.first, r.reasons) for r in planning.tiers(df, ("bad",)).collect()}
    assert got == {1: (2, "bad:x", 3), 2: (1, None, 1), 3: (0, None, 0)}


def test_geometry():
    assert [geometry.round_away(x) for x in (-2.5, -0.4, 0.5, 2.5)] == [-3, 0, 1, 3]
    assert geometry.quantise([(12, -13)], 5) == [(10, -15)]
    edges = [("line", 10, 0), ("line", 20, 0), ("line", 20, 0), ("curve", 20, 5, 20, 10), ("line", 20, 5)]
    assert geometry.simplify((0, 0), edges) == [("line", 20, 0), ("line", 20, 10), ("line", 20, 5)]
    flat = geometry.flatten((0, 0), [("curve", 50, 100, 100, 0)], 1.0)
    assert len(flat) == 9 and flat[4] == (50.0, 50.0)
    square = [(1, 1), (3, 1), (3, 3), (1, 3)]
    assert geometry.area(square) == 4 and not geometry.degenerate(square) and geometry.degenerate([(0, 0), (1, 1), (2, 2)])
    assert sum(abs(geometry.area(list(t))) for t in geometry.fan(square)) == 4
    c = geometry.coverage([square], 4, 4)
    assert sum(map(sum, c)) == pytest.approx(4) and c[1][1] == 1 and c[0][0] == 0
    hole = [(1.5, 1.5), (2.5, 1.5), (2.5, 2.5), (1.5, 2.5)]
    assert sum(map(sum, geometry.coverage([square, hole], 4, 4))) == pytest.approx(3)
    assert sum(map(sum, geometry.coverage([square, hole], 4, 4, nonzero=True))) == pytest.approx(4)


def test_flattened_paths(spark):
    kind = "path_id long, x double, y double, edges array<struct<kind:string,cx:double,cy:double,x:double,y:double>>"
    df = spark.createDataFrame([(1, 0.0, 0.0, [("line", None, None, 4.0, 0.0), ("line", None, None, 4.0, 4.0)])], kind)
    r = geometry.flatten_paths(df).first()
    assert r.area == 8.0 and len(r.points) == 3


def test_hashes(spark):
    values = [b"", b"a", b"foobar", bytes(range(256)), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v binary").select("i", hashes.fnv1a64_hex("v").alias("f"), hashes.adler32("v").alias("a"))
    got = {r.i: (r.f, r.a) for r in df.collect()}
    assert got[0][0] == "cbf29ce484222325" and got[1][0] == "af63dc4c8601ec8c" and got[2][0] == "85944171f73967e8"
    assert got[3] == (format(hashes.fnv1a64(values[3]), "016x"), zlib.adler32(values[3])) and got[4] == (None, None)


def test_banned_constructs(spark):
    text = "// eval(\nlet a = 'eval(' + `with(` /* new Function */;\nevil(); x: any"
    quiet = sources.blanked(text)
    assert len(quiet) == len(text) and quiet.count("\n") == 2 and "eval" not in quiet and "evil()" in quiet
    df = spark.createDataFrame([(text,), ("eval (1); 'never closed",)], "t string")
    assert sorted(r.h for r in df.select(sources.ban_hits(sources.blanked_source("t")).alias("h")).collect()) == [["any"], ["eval"]]


def test_stage_cache(spark, tmp_path):
    cache, made = StageCache(spark, str(tmp_path)), []

    def make():
        made.append(1)
        return spark.range(5)

    for _ in range(2):
        assert cache.get("s", ["x"], {"a": 1, "b": 2}, make).count() == 5
    assert len(made) == 1
    cache.get("s", ["x"], {"b": 2, "a": 1}, make, verify=True)
    cache.get("s", ["x"], {"a": 2}, make)
    assert len(made) == 3
    with pytest.raises(ValueError):
        cache.get("s", ["x"], {"a": 1, "b": 2}, lambda: spark.range(6), verify=True)


def test_streams(spark, tmp_path):
    like = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    like.repartitionByRange(3, "event_id").write.parquet(str(tmp_path / "in"))
    stream = timelines.event_stream(spark, str(tmp_path / "in"), like)
    got = timelines.run_to_memory(timelines.counts(stream), "counted", "complete")
    assert got.agg(F.sum("n")).first()[0] == like.count()
    assert timelines.run_to_memory(timelines.sessions(stream, late="9999 days"), "sessions", "complete").agg(F.sum("n")).first()[0] == like.count()
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("place")
    stream = timelines.event_stream(spark, str(tmp_path / "in"), like, files=10)
    ops = stream.select(F.col("user_id").alias("timeline"), (F.col("event_id") % 5).alias("slot"), F.col("event_id").alias("idx"), kind.alias("kind"), F.floor("value").cast("long").alias("character"))
    out = timelines.run_to_memory(timelines.fold_slots(ops), "folded", "update").collect()
    last = {}
    for r in out:
        if r.idx >= last.get((r.timeline, r.slot), (-1,))[0]:
            last[r.timeline, r.slot] = (r.idx, r.character)
    want = {}
    for e in like.orderBy("event_id").collect():
        want[e.user_id, e.event_id % 5] = (e.event_id, None if e.event_type == "error" else int(e.value // 1))
    assert last == want


def test_folding_edges(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first().v

    n, s, u = (lambda x: folding.literal("number", x)), (lambda x: folding.literal("string", text=x)), folding.literal("undefined")
    assert one(folding.arithmetic("/", n(1.0), n(0.0)))["num"] == float("inf") and one(folding.arithmetic("/", n(1.0), n(-0.0)))["num"] == float("-inf")
    assert one(folding.arithmetic("/", n(1.0), n(0.0), version=4))["str"] == "#ERROR#"
    assert one(folding.arithmetic("%", n(3.0), n(-7.0)))["num"] == -1.0  # the top modulo the other
    assert math.isnan(one(folding.arithmetic("-", s("abc"), n(1.0)))["num"])
    assert one(folding.add(s("a"), n(2.0), either=False)) is None and one(folding.add(n(2.0), s("3"), either=False))["num"] == 5.0
    assert one(folding.add(n(2.0), s("3"), either=True)) is None
    assert one(folding.bits("<<", n(1.0), n(33.0)))["num"] == 2.0 and one(folding.bits(">>>", n(-1.0), n(28.0)))["num"] == 15.0 and one(folding.bits("|", n(4294967295.0), n(0.0)))["num"] == -1.0
    assert one(folding.bits("|", n(1e20), n(0.0)))["num"] == 1661992960.0 and one(folding.bits("|", s("abc"), u))["num"] == 0.0
    assert one(folding.less(s("a"), s("b")))["num"] == 1.0 and one(folding.less(s("é"), s("b")))["num"] == 0.0 and one(folding.less(u, n(1.0)))["num"] == 0.0
    assert one(folding.less(s("\ufb01"), s("😀")))["num"] == 0.0  # by 16-bit units, not by code points
    assert one(folding.less(n(1.0), n(2.0), version=4))["type"] == "number"
    assert one(folding.strict_equals(u, u))["num"] == 1.0 and one(folding.strict_equals(n(1.0), s("1"))) is None
    assert [one(folding.truthy(v)) for v in (n(0.0), n(2.0), s(""), s("0"), u)] == [False, True, False, True, False]
    spelled = {"0x1F": 31.0, "0b101": 5.0, "0o17": 15.0, " 1e3\n": 1000.0, ".5": 0.5, "5.": 5.0, "+7": 7.0, "-Infinity": float("-inf"), "": 0.0, "\u00a0": 0.0}
    assert {t: one(folding.spelled(F.lit(t))) for t in spelled} == spelled
    assert all(math.isnan(one(folding.spelled(F.lit(t)))) for t in ("1f", "NaN", "infinity", "1 2", "-0x1", "0x", ".", "1e", "NULL"))


def test_stages(spark, tmp_path):
    from sparkloom.plans.stages import Pass, Stage, conflicts, run_stages

    ran = []

    def read(state):
        ran.append("read")
        return {"rows": spark.range(6)}

    def keep(state):
        kept = state["rows"].where("id % 2 = 0")
        return {"rows": kept}, state["rows"].select(F.lit("keep").alias("source"), F.col("id").cast("string").alias("subject"), (F.col("id") % 2).cast("string").alias("state"))

    steps = [Stage("read", read, ("rows",), cached=True), Pass("keep", keep, ("rows",))]
    cache = StageCache(spark, str(tmp_path))
    for _ in range(2):
        out = run_stages(steps, {}, cache=cache, inputs=["x"])
        assert out["rows"].count() == 3 and out["decisions"].count() == 6
    assert ran == ["read"] and conflicts(steps + steps) == ["rows"]
    with pytest.raises(ValueError):
        run_stages([Stage("a", lambda s: {"other": None}, ("rows",))], {})
    with pytest.raises(InterruptedError):
        run_stages(steps, {}, cancelled=lambda: True)


def test_more_folding(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first().v

    n, s = (lambda x: folding.literal("number", x)), (lambda x: folding.literal("string", text=x))
    null, undefined, yes = folding.literal("null"), folding.literal("undefined"), folding.literal("boolean", 1.0)
    assert one(folding.loose_equals(null, undefined))["num"] == 1.0 and one(folding.loose_equals(null, n(0.0)))["num"] == 1.0
    assert one(folding.loose_equals(s("12"), n(12.0)))["num"] == 1.0 and one(folding.equals(n(float("nan")), n(1.0))) is None
    assert one(folding.logic("and", yes, n(0.0)))["num"] == 0.0 and one(folding.logic("or", yes, n(0.0)))["num"] == 1.0
    assert one(folding.compare_text("lt", s("a"), s("b")))["num"] == 1.0 and one(folding.compare_text("gt", s("é"), s("b"))) is None
    assert one(folding.compare_text("eq", yes, s("true"))) is None and one(folding.compare_text("eq", s("é"), s("é")))["num"] == 1.0
    assert one(folding.concat_text(s("a"), yes))["str"] == "atrue" and one(folding.concat_text(s("a"), n(1.0))) is None
    assert one(folding.unary("chr", n(65.0)))["str"] == "A" and one(folding.unary("chr", n(65.9))) is None and one(folding.unary("chr", n(0x3042)))["str"] == "あ"
    assert one(folding.unary("chr", n(0xD800))) is None and one(folding.unary("chr", n(65536.0))) is None
    assert one(folding.unary("mbchr", n(0x4142)))["str"] == "AB" and one(folding.unary("mbchr", n(65.0)))["str"] == "A" and one(folding.unary("mbord", s("AB")))["num"] == 0x4142
    assert one(folding.unary("ord", s("😀")))["num"] == 0xD83D and one(folding.unary("ord", s("é")))["num"] == 233.0 and one(folding.unary("ord", n(65.0))) is None
    assert one(folding.unary("int", n(-2.7)))["num"] == -2.0 and one(folding.unary("int", n(1e300)))["num"] == 1e300
    assert one(folding.unary("mblength", s("é😀")))["num"] == 3.0 and one(folding.unary("length", s("éa"))) is None and one(folding.unary("length", s("a\tb"))) is None


def test_strokes():
    def covered(polygons):
        return sum(map(sum, geometry.coverage(polygons, 60, 60, nonzero=True, rows=8)))

    line, corner = [(10, 30), (50, 30)], [(10, 10), (50, 10), (50, 50)]
    assert covered(geometry.stroke(line, 4, cap="none")) == pytest.approx(160)
    assert covered(geometry.stroke(line, 4, cap="square")) == pytest.approx(176)
    assert covered(geometry.stroke(line, 4, cap="round")) == pytest.approx(160 + 3.1416 * 4, abs=0.6)
    assert covered(geometry.stroke(corner, 4, cap="none", join="bevel")) == pytest.approx(160 + 160 - 4 + 2, abs=0.3)
    assert covered(geometry.stroke(corner, 4, cap="none", join="miter")) == pytest.approx(160 + 160 - 4 + 4, abs=0.3)
    assert covered(geometry.stroke(corner, 4, cap="none", join="miter", miter=1.0)) == pytest.approx(318, abs=0.3)
    square = [(10, 10), (50, 10), (50, 50), (10, 50), (10, 10)]
    assert covered(geometry.stroke(square, 2, join="miter", closed=True)) == pytest.approx(42**2 - 38**2, abs=0.3)
    assert geometry.stroke([(5, 5)], 2, cap="none") == [] and covered(geometry.stroke([(5, 5), (5, 5)], 2, cap="square")) == pytest.approx(4)
