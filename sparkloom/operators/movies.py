"""What follows from tag rows: definitions, frames, display operations, ordering problems and the action blocks.

All of it is DataFrame work over the rows that the scans give; `path` and the timeline are the partition keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import folds, graphs, ordered

#: Tags that place, remove, show and act. Fixed values of the format.
_PLACE, _REMOVE, _SHOW, _ACTION, _INIT = (4, 26, 70), (5, 28), 1, 12, 59


def field(name: str, kind: str = "int") -> Column:
    """A top-level field of a decoded tag."""
    return F.get_json_object("fields", f"$.{name}").cast(kind)


def definitions(tags: DataFrame) -> DataFrame:
    """One row per definition, with those flagged that a later one with the same id shadows."""
    d = tags.where("defines is not null").select("path", F.col("defines").alias("id"), "index", "code", "offset", "length")
    from sparkloom.operators.keyed import flag_shadowed

    return flag_shadowed(d, ["path", "id"], "index")


def dictionary(tags: DataFrame) -> DataFrame:
    """The definitions that hold: the last of each id."""
    return definitions(tags).where("not shadowed").drop("shadowed")


def timelines(tags: DataFrame) -> DataFrame:
    """Tags with their timeline (0 is the main one) and frame."""
    t = tags.withColumn("timeline", F.coalesce("sprite", F.lit(0)))
    return ordered.segment(t, ["path", "timeline"], ["index"], F.col("code") == _SHOW)


def frames(decoded: DataFrame) -> DataFrame:
    """One row per frame that shows or holds something: operations, actions and the first label ('' if none)."""
    t = timelines(decoded)
    code = F.col("code")
    label = F.min_by(F.when(code == 43, field("name", "string")), F.when(code == 43, F.col("index")))
    f = t.where(code != 0).groupBy("path", "timeline", "frame").agg(
        F.count_if(code.isin(*_PLACE)).alias("places"), F.count_if(code.isin(*_REMOVE)).alias("removes"), F.count_if(code == _ACTION).alias("actions"),
        F.bool_or(code == _SHOW).alias("shown"), F.coalesce(label, F.lit("")).alias("label"),
    )
    return f


def display_operations(decoded: DataFrame) -> DataFrame:
    """Placements and removals by timeline, frame and order."""
    code = F.col("code")
    t = timelines(decoded).where(code.isin(*_PLACE, *_REMOVE))
    return t.select(
        "path", "timeline", "frame", "index", F.when(code.isin(*_REMOVE), "remove").otherwise("place").alias("kind"), field("depth").alias("depth"),
        field("character").alias("character"), F.get_json_object("fields", "$.matrix").alias("matrix"), field("ratio").alias("ratio"), field("name", "string").alias("name"),
        field("clipDepth").alias("clip_depth"), F.coalesce(field("visible", "boolean"), F.lit(True)).alias("visible"),
    )


def display_list(decoded: DataFrame) -> DataFrame:
    """The display list at the end of every frame; a placement merges over what its depth holds."""
    ops = display_operations(decoded)
    return folds.snapshots(ops, ["path", "timeline"], "frame", "depth", ["index"], F.col("kind") == "remove", ["character", "matrix", "ratio", "name", "clip_depth"])


def undefined_placements(decoded: DataFrame) -> DataFrame:
    """Placements whose character is neither defined nor imported in the file."""
    known = dictionary(decoded).select("path", F.col("id").alias("character"))
    imported = decoded.where("code in (57, 71)").select(
        "path", F.explode(F.from_json(F.get_json_object("fields", "$.symbols"), "array<struct<character:int,name:string>>")["character"]).alias("character")
    )
    placed = display_operations(decoded).where("kind = 'place' and character is not null")
    return placed.join(known.unionByName(imported).distinct(), ["path", "character"], "left_anti").select("path", "timeline", "frame", "index", "depth", "character")


def exports(decoded: DataFrame) -> DataFrame:
    """Exported names in file order; the first of a name holds."""
    e = decoded.where("code in (56, 76)").select("path", "index", F.posexplode(F.from_json(F.get_json_object("fields", "$.symbols"), "array<struct<character:int,name:string>>")).alias("at", "s"))
    e = e.select("path", "index", "at", "s.character", "s.name")
    return ordered.occurrence(e, ["path", "name"], ["index", "at"], "nth")


def _listed(path: str, item: str):
    """The elements of a list in the decoded fields; a missing list gives none."""
    return F.explode(F.from_json(F.get_json_object("fields", path), f"array<{item}>"))


def references(decoded: DataFrame) -> DataFrame:
    """Edges of the character graph (`path`, `src`, `dst`); 0 is the main timeline.

    A timeline refers to what it places, removes by name and sounds; a text to its fonts, an editable text to its own, a
    button to its records' characters and its sounds, a shape to the pictures that fill it.
    """
    own = field("character").alias("src")
    edges = display_operations(decoded).where("character is not null").select("path", F.col("timeline").alias("src"), F.col("character").alias("dst"))
    started = timelines(decoded).where("code = 15").select("path", F.col("timeline").alias("src"), field("sound").alias("dst"))
    texts = decoded.where("code in (11, 33)").select("path", own, _listed("$.runs", "struct<font:int>").alias("r")).select("path", "src", F.col("r.font").alias("dst"))
    edits = decoded.where("code = 37").select("path", own, field("font").alias("dst"))
    buttons = decoded.where("code in (7, 34)").select("path", own, _listed("$.records", "struct<character:int>").alias("r")).select("path", "src", F.col("r.character").alias("dst"))
    sounds = decoded.where("code = 17").select("path", field("button").alias("src"), _listed("$.sounds", "struct<sound:int>").alias("r")).select("path", "src", F.col("r.sound").alias("dst"))
    fills = decoded.where("code in (2, 22, 32, 83, 46, 84)").select("path", own, _listed("$.styles.fills", "struct<bitmap:int>").alias("r")).select("path", "src", F.col("r.bitmap").alias("dst"))
    for more in (started, texts, edits, buttons, sounds, fills.where("dst <> 65535")):
        edges = edges.unionByName(more.where("dst is not null"))
    return edges.distinct()


def reference_blockers(decoded: DataFrame) -> DataFrame:
    """Characters whose references are not all known (`path`, `character`, `why`): from them on no closure is complete.

    Those are definitions that could not be read to the end, text runs and editable texts without a font, videos and fonts
    that may name pictures, and definitions of no known kind.
    """
    code, own = F.col("code"), field("character").alias("character")
    runs = F.from_json(F.get_json_object("fields", "$.runs"), "array<struct<font:int>>")
    why = (
        F.when(code.isin(2, 22, 32, 83, 46, 84, 11, 33, 37, 7, 34) & (F.size("problems") > 0), "not read to the end")
        .when(code.isin(11, 33) & F.coalesce(F.exists(runs, lambda r: r["font"].isNull()), F.lit(True)), "a run without a font")
        .when((code == 37) & field("font").isNull() & field("fontClass", "string").isNull(), "a text without a font")
        .when(code == 60, "a video may name a picture").when(code.isin(48, 75), "a font may name pictures")
    )
    known = decoded.select("path", own, why.alias("why")).where("why is not null and character is not null")
    unknown = decoded.where("defines is not null and name is null").select("path", F.col("defines").alias("character"), F.lit("of no known kind").alias("why"))
    return known.unionByName(unknown)


def live_characters(decoded: DataFrame) -> DataFrame:
    """Definitions with `live` (reachable from the main timeline, from exports or from started sounds of the same file) and
    `prunable`: not live, in a file where nothing live has references that are not known."""
    key = F.struct("path", "src")
    refs = references(decoded)
    edges = refs.select(F.to_json(key).alias("src"), F.to_json(F.struct("path", F.col("dst").alias("src"))).alias("dst"))
    roots = refs.select("path").distinct().select("path", F.lit(0).alias("src"))
    roots = roots.unionByName(exports(decoded).select("path", F.col("character").alias("src")))
    roots = roots.unionByName(decoded.where("code = 15").select("path", field("sound").alias("src"))).select(F.to_json(key).alias("node"))
    seen = graphs.closure(roots, edges)
    d = dictionary(decoded)
    own = F.to_json(F.struct("path", F.col("id").alias("src")))
    d = d.withColumn("node", own).join(seen.withColumn("live", F.lit(True)), "node", "left").withColumn("live", F.coalesce("live", F.lit(False))).drop("node")
    stopped = reference_blockers(decoded).select("path", F.col("character").alias("id")).join(d.where("live").select("path", "id"), ["path", "id"], "left_semi")
    d = d.join(stopped.select("path").distinct().withColumn("stopped", F.lit(True)), "path", "left")
    return d.withColumn("prunable", ~F.col("live") & F.col("stopped").isNull()).drop("stopped")


def action_blocks(tags: DataFrame) -> DataFrame:
    """Action blocks as `block_id`, `bytes`, `version`: frame actions, and initialisers without their sprite id."""
    own = F.concat_ws(":", "path", F.col("index").cast("string"))
    code = F.col("code")
    body = F.when(code == _INIT, F.substring("body", 3, 1 << 30)).otherwise(F.col("body"))
    return tags.where(code.isin(_ACTION, _INIT)).select(own.alias("block_id"), body.alias("bytes"), "version")


def residual_blobs(tags: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Byte ranges cut out of tag bodies, and the requests that can't be served.

    `requests` has `path`, `index` (of the tag), `subject`, `start`, `length` and `registers`. A request is invalid if its tag
    is missing, its range leaves the body, or it names more than 256 registers; the first valid one of a subject holds.
    """
    r = requests.join(tags.select("path", "index", "body", F.lit(True).alias("there")), ["path", "index"], "left")
    start, size = F.col("start"), F.col("length")
    why = (
        F.when(F.col("there").isNull(), "no tag").when((start < 0) | (size < 0) | (start + size > F.length("body")), "outside the body").when(F.col("registers") > 256, "registers")
    )
    r = r.withColumn("why", why)
    good = ordered.occurrence(r.where("why is null"), ["path", "subject"], ["index", "start", "length"], "nth").where("nth = 1")
    blob = F.substring(F.col("body"), start + 1, size)
    good = good.select("path", "subject", "index", "start", "length", "registers", blob.alias("bytes"), F.sha2(blob, 256).alias("sha256"))
    return good, r.where("why is not null").select("path", "subject", "index", "start", "length", "why")


def _hit_areas(buttons: dict[int, list[dict]], bounds: dict[int, tuple]) -> list[tuple]:
    """(button, box or None, source, problems) of one file's buttons; see `hit_areas`."""
    done: dict[int, tuple] = {}
    open_: set[int] = set()

    def area(button: int) -> tuple:
        if button in done:
            return done[button]
        if button in open_:
            return None, None, ["cycle"]
        open_.add(button)
        records, problems, boxes = buttons[button], [], []
        hit = [r for r in records if "hitTest" in r["states"]]
        used = hit or [r for r in records if "up" in r["states"]]
        for r in used:
            if r["a"] * r["d"] == r["b"] * r["c"]:
                problems.append("singular")
                continue
            child = r["character"]
            box = bounds.get(child)
            if child in buttons:
                box, _, inner = area(child)
                problems += ["cycle"] * (inner == ["cycle"] and child in open_)
            if box is None:
                continue
            xs = [r["a"] * x + r["c"] * y + r["tx"] for x in box[0::2] for y in box[1::2]]
            ys = [r["b"] * x + r["d"] * y + r["ty"] for x in box[0::2] for y in box[1::2]]
            if min(xs) < max(xs) and min(ys) < max(ys):
                boxes.append((min(xs), min(ys), max(xs), max(ys)))
            else:
                problems.append("degenerate")
        open_.discard(button)
        whole = (*(min(x[k] for x in boxes) for k in (0, 1)), *(max(x[k] for x in boxes) for k in (2, 3))) if boxes else None
        if used and whole is None:
            problems.append("none")
        done[button] = whole, ("hitTest" if hit else "up" if used else None), problems
        return done[button]

    return [(button, *area(button)) for button in buttons]


def hit_areas(records: DataFrame, bounds: DataFrame) -> DataFrame:
    """The rectangle of each button, around its children's transformed bounds: `path`, `button`, x0, y0, x1, y1, `source`, `problems`.

    `records` has `path`, `button`, `seq` (file order), `states`, `character` and a matrix a, b, c, d, tx, ty; `bounds` has
    `path`, `character`, x0, y0, x1, y1. Records for hit tests count, or where a button has none those for its up state.
    A button inside a button counts with its own area; one that holds itself is left out there. Singular matrices and empty
    boxes are left out and named among the problems. A file's buttons stream through one task, file by file.
    """
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = ("a", "b", "c", "d", "tx", "ty")
    none = F.lit(None)
    rows = records.select("path", F.lit(0).alias("kind"), F.col("seq").cast("long").alias("seq"), F.col("button").cast("int").alias("button"), "states", F.col("character").cast("int").alias("character"), *[F.col(n).cast("double").alias(n) for n in numbers])
    boxes = bounds.select("path", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seq"), none.cast("int").alias("button"), none.cast("array<string>").alias("states"), F.col("character").cast("int").alias("character"),
                          *[F.col(x).cast("double").alias(n) for x, n in zip(("x0", "y0", "x1", "y1"), numbers)], none.cast("double").alias("tx"), none.cast("double").alias("ty"))
    rows = rows.unionByName(boxes).repartition(parts, F.xxhash64("path")).sortWithinPartitions("path", "kind", "seq")
    schema = "path string, button int, x0 double, y0 double, x1 double, y1 double, source string, problems array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(path: str, part: list[dict]) -> pa.RecordBatch:
            buttons: dict[int, list[dict]] = {}
            for r in part:
                if r["kind"] == 0:
                    buttons.setdefault(r["button"], []).append(r)
            known = {r["character"]: (r["a"], r["b"], r["c"], r["d"]) for r in part if r["kind"] == 1 and r["a"] is not None}
            out = [{"path": path, "button": n, "source": source, "problems": problems} | dict(zip(("x0", "y0", "x1", "y1"), box or (None,) * 4, strict=True)) for n, box, source, problems in _hit_areas(buttons, known)]
            kinds = [("path", pa.string()), ("button", pa.int32()), *((x, pa.float64()) for x in ("x0", "y0", "x1", "y1")), ("source", pa.string()), ("problems", pa.list_(pa.string()))]
            return pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

        part: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if part and row["path"] != part[0]["path"]:
                    yield solved(part[0]["path"], part)
                    part = []
                part.append(row)
        if part:
            yield solved(part[0]["path"], part)

    return rows.mapInArrow(run, schema)


def model_dump(decoded: DataFrame) -> DataFrame:
    """One JSON text per file with its tags in order and their fields, equal for equal files."""
    t = F.struct("index", "code", "name", "sprite", F.col("fields").alias("fields"))
    d = decoded.groupBy("path").agg(F.array_sort(F.collect_list(t)).alias("tags"))
    each = F.transform("tags", lambda x: F.concat(F.lit('{"code":'), x["code"], F.lit(',"name":"'), F.coalesce(x["name"], F.lit("")), F.lit('","sprite":'), F.coalesce(x["sprite"].cast("string"), F.lit("null")), F.lit(',"fields":'), x["fields"], F.lit("}")))
    return d.select("path", F.concat(F.lit('{"schemaVersion":1,"tags":['), F.array_join(each, ","), F.lit("]}")).alias("dump"))


#: A static scene as JSON.
SCENE = "schemaVersion int, width int, height int, frames array<struct<items: array<struct<shape: int, depth: int, matrix: array<double>, clipDepth: int>>>>"


def read_scenes(texts: DataFrame, column: str = "scene") -> DataFrame:
    """Scene texts as structs; a text that does not fit the schema fails the query."""
    return texts.withColumn(column, F.from_json(column, SCENE, {"mode": "FAILFAST"}))


def write_scenes(scenes: DataFrame, column: str = "scene") -> DataFrame:
    """The other way round."""
    return scenes.withColumn(column, F.to_json(column))
