"""Containers as tables: one pass over each file gives its header, its tags and what is wrong with it.

Files come from Spark's `binaryFile` source. A file is a unit of work: its tag stream can only be walked from the
start. Malformed input gives diagnostic rows and as many tags as can be told; only `strict` raises.
"""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources import tagcodes
from sparkloom.sources.bits import PastEnd, Reader

#: Bytes that a file may unpack to, and sprites that may lie inside each other.
MOST_BYTES, MOST_DEPTH = 512 << 20, 32


#: Problem codes and their severities. Fixed values.
SEVERITY = {
    "SF0001": "error", "SF0002": "warning", "SF0003": "error", "SF0004": "warning", "SF0005": "warning", "SF0007": "error", "SF0013": "error",
    "SF0021": "warning", "SF0022": "info", "SF0023": "warning", "SF0024": "info", "SF0027": "warning", "SF0028": "warning", "SF0029": "error",
    "SF0030": "info", "SF0033": "info", "SF0101": "warning", "SF0102": "info", "SF0103": "warning", "SF0104": "info", "SF0107": "warning",
    "SF0109": "warning", "SF0128": "warning", "SF0129": "info", "SF0174": "warning",
}


def problem(code: str, message: str, offset: int, context: str, character: int | None = None) -> dict:
    """A diagnostic row."""
    return {"code": code, "severity": SEVERITY[code], "message": message, "offset": offset, "context": context, "character": character}


class Malformed(Exception):
    """Raised in strict mode for the first structural error."""


@dataclass
class Opened:
    """What one file holds."""

    compression: str | None = None
    version: int | None = None
    declared: int | None = None
    body: bytes = b""
    header: dict = field(default_factory=dict)
    tags: list[dict] = field(default_factory=list)
    notes: list[dict] = field(default_factory=list)


Inflate = Callable[[bytes, int], bytes]


def unpack(data: bytes, most: int = MOST_BYTES, inflate: dict[str, Inflate] | None = None) -> tuple[str | None, bytes, list[tuple[str, str]]]:
    """Compression, body and problems (code, message) of a file. A damaged stream keeps its decoded beginning.

    `inflate` takes decoders of one's own, by compression: called with the packed bytes behind the file's first eight and
    the bytes wanted at most, they return the body or raise ValueError.
    """
    kind = {b"FWS": "none", b"CWS": "zlib", b"ZWS": "lzma"}.get(bytes(data[:3]))
    if kind is None or len(data) < 8:
        return None, b"", [("SF0001", "not a container of this kind")]
    problems = []
    if kind == "none":
        return kind, bytes(data[8:]), problems
    if inflate and kind in inflate:
        try:
            body = inflate[kind](bytes(data[8:]), most)
        except ValueError as e:
            return kind, b"", [("SF0003", f"the packed stream is damaged: {e}")]
        return kind, body[:most], [("SF0007", f"more than {most} bytes unpacked")] if len(body) > most else []
    if kind == "zlib":
        decoder, packed = zlib.decompressobj(), data[8:]
    else:
        if len(data) < 17:
            return kind, b"", [("SF0003", "the packed stream has no header")]
        size = struct.unpack_from("<I", data, 8)[0]
        if size != len(data) - 17:
            problems.append(("SF0027", f"packed length {size} is stated, {len(data) - 17} bytes are there"))
        # The stand-alone format with an unknown length, which an end mark or the data's end closes.
        decoder, packed = lzma.LZMADecompressor(lzma.FORMAT_ALONE), data[12:17] + b"\xff" * 8 + data[17:]
    out, size, at = [], 0, 0
    try:
        while at < len(packed) and size <= most and not decoder.eof:
            chunk = decoder.decompress(packed[at : at + (1 << 16)])
            at += 1 << 16
            out.append(chunk)
            size += len(chunk)
        if kind == "zlib" and not decoder.eof:
            problems.append(("SF0003", "the packed stream ends early"))
    except (zlib.error, lzma.LZMAError) as e:
        problems.append(("SF0003", f"the packed stream is damaged: {e}"))
    if size > most:
        problems.append(("SF0007", f"more than {most} bytes unpacked"))
    return kind, b"".join(out)[:most], problems


def read_header(o: Opened, file_size: int) -> int:
    """Fills in the header; returns where the tags begin."""

    def note(code: str, message: str, offset: int = 0, context: str = "header") -> None:
        o.notes.append(problem(code, message, offset, context))

    r = Reader(o.body)
    try:
        box, rate, frames = r.rect(), r.u16(), r.u16()
    except PastEnd:
        note("SF0013", "the header is cut off")
        return len(o.body)
    width, height = box["xMax"] - box["xMin"], box["yMax"] - box["yMin"]
    o.header = box | {"frame_rate_raw": rate, "frame_rate": rate / 256, "frame_count": frames, "width_px": width / 20, "height_px": height / 20}
    if o.declared < 8 or o.declared > 2**31:
        note("SF0028", f"length {o.declared} is implausible", 4)
    if 0 < o.version < 4:
        note("SF0002", f"version {o.version} is below 4", 3)
    if o.compression == "zlib" and 0 < o.version < 6:
        note("SF0033", f"packed, at version {o.version}")
    if box["xMin"] or box["yMin"]:
        note("SF0021", "the frame does not start at the origin", 8, "FrameSize")
    if width <= 0 or height <= 0:
        note("SF0029", "the frame has no area", 8, "FrameSize")
    if rate == 0 or rate / 256 > 240:
        note("SF0022", f"{rate / 256} frames a second", r.at, "FrameRate")
    there = file_size if o.compression == "none" else len(o.body) + 8
    if there != o.declared:
        note("SF0004" if there > o.declared else "SF0005", f"length {o.declared} is stated, {there} bytes are there", 0 if o.compression != "none" else 4, "container")
    return r.at


def index_tags(body: bytes, start: int, declared_frames: int, note, most_depth: int = MOST_DEPTH) -> list[dict]:
    """All tags in stream order; a sprite's own tags follow it and name it. `note` takes diagnostics."""
    tags: list[dict] = []
    defined: dict[int, int] = {}
    # Open levels: sprite id or None, end of its bytes, frames declared and shown, codes reported once.
    levels: list[dict] = [{"sprite": None, "end": len(body), "declared": declared_frames, "shown": 0, "reported": set()}]
    at, saw_end = start, False

    def close(ended: bool) -> None:
        nonlocal at
        level = levels.pop()
        if level["sprite"] is None:
            return
        where = f"sprite {level['sprite']}"
        if not ended:
            note("SF0174", "the sprite has no end tag", at, where, level["sprite"])
        if level["declared"] != level["shown"]:
            note("SF0023", f"{level['declared']} frames are declared, {level['shown']} are shown", 0, where, level["sprite"])
        if ended:
            at = level["after"]

    while levels:
        level = levels[-1]
        where = "tag stream" if level["sprite"] is None else f"sprite {level['sprite']}"
        if at >= level["end"]:
            if level["sprite"] is None:
                break
            close(False)
            continue
        head = at
        if level["end"] - at < 2:
            note("SF0013", "a tag header is cut off", at, where, level["sprite"])
            at = level["end"]
            continue
        word = body[at] | body[at + 1] << 8
        code, size, long_ = word >> 6, word & 63, False
        at += 2
        if size == 63:
            if level["end"] - at < 4:
                note("SF0013", "a tag header is cut off", head, where, level["sprite"])
                at = level["end"]
                continue
            size, long_ = struct.unpack_from("<I", body, at)[0], True
            at += 4
            if size < 63:
                note("SF0030", f"tag {code} has a long header for {size} bytes", head, f"long header {code}")
        held = min(size, level["end"] - at)
        tags.append({"index": len(tags), "code": code, "head": head, "offset": at, "length": held, "long_header": long_, "depth": len(levels) - 1, "sprite": level["sprite"]})
        if held < size:
            note("SF0101", f"tag {code} needs {size} bytes, {held} are there", head, where, level["sprite"])
            at = level["end"]
            continue
        if code not in tagcodes.NAMES:
            note("SF0104", f"tag {code} is unknown", head, f"unknown tag {code}")
        elif level["sprite"] is not None and code not in tagcodes.IN_SPRITE and code not in level["reported"]:
            level["reported"].add(code)
            note("SF0129", f"tag {code} is not meant for sprites", head, where, level["sprite"])
        if code in tagcodes.DEFINITIONS:
            own = body[at] | body[at + 1] << 8 if size >= 2 else 0
            if level["sprite"] is not None:
                note("SF0128", f"tag {code} defines nothing inside a sprite", head, where, level["sprite"])
            elif own == 0:
                note("SF0107", f"tag {code} defines character 0", head, where)
            else:
                if own in defined:
                    note("SF0109", f"character {own} is defined again", head, where, own)
                defined[own] = len(tags) - 1
                tags[-1]["defines"] = own
        if code == tagcodes.END:
            if level["sprite"] is None:
                saw_end = True
                if len(body) > at + size:
                    note("SF0024", f"{len(body) - at - size} bytes follow the end", at + size, where)
                levels.pop()
            else:
                close(True)
            continue
        if code == tagcodes.SHOW_FRAME:
            level["shown"] += 1
        if code == tagcodes.SPRITE:
            own = body[at] | body[at + 1] << 8 if size >= 2 else 0
            declared = body[at + 2] | body[at + 3] << 8 if size >= 4 else 0
            if len(levels) > most_depth:
                note("SF0103", f"sprite {own} lies too deep", head, where, own)
            elif size >= 4:
                levels.append({"sprite": own, "end": at + size, "after": at + size, "declared": declared, "shown": 0, "reported": set()})
                at += 4
                continue
        at += size
    if not saw_end:
        note("SF0102", "the stream has no end tag", len(body), "tag stream")
    shown = sum(t["code"] == tagcodes.SHOW_FRAME and t["sprite"] is None for t in tags)
    if declared_frames and declared_frames != shown:
        note("SF0023", f"{declared_frames} frames are declared, {shown} are shown", 0, "header")
    return tags


def open_bytes(data: bytes, *, strict: bool = False, most: int = MOST_BYTES, inflate: dict[str, Inflate] | None = None) -> Opened:
    """Opens one file."""
    o = Opened()

    def note(code: str, message: str, offset: int, context: str, character: int | None = None) -> None:
        o.notes.append(problem(code, message, offset, context, character))

    o.compression, o.body, problems = unpack(data, most, inflate)
    for code, message in problems:
        note(code, message, 0, "container")
    if o.compression is not None:
        o.version, o.declared = data[3], struct.unpack_from("<I", data, 4)[0]
        start = read_header(o, len(data))
        o.tags = index_tags(o.body, start, o.header.get("frame_count", 0), note)
    if strict and any(n["severity"] == "error" for n in o.notes):
        raise Malformed(next(n["message"] for n in o.notes if n["severity"] == "error"))
    return o


FILES = (
    "path string, size long, compression string, version int, declared_length long, body_length long, x_min int, y_min int, x_max int, y_max int, "
    "frame_rate_raw int, frame_rate double, frame_count int, width_px double, height_px double"
)
TAGS = "path string, index int, code int, head long, offset long, length long, long_header boolean, depth int, sprite int, defines int, version int, body binary"
NOTES = "path string, seq int, code string, severity string, message string, offset long, context string, character int"


def read_files(spark: SparkSession, path: str, glob: str | None = None, most: int | None = None) -> DataFrame:
    """Files under `path` as `path` and `content`; those over `most` bytes come without content, unread."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    if most is None:
        return files.select("path", "content")
    return files.where(F.col("length") <= most).select("path", "content").unionByName(files.where(F.col("length") > most).select("path", F.lit(None).cast("binary").alias("content")))


def _scan(files: DataFrame, schema: str, make, strict: bool, inflate: dict[str, Inflate] | None = None) -> DataFrame:
    arrow = files.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(arrow)
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py() or b""
                yield pa.RecordBatch.from_pylist(make(path.as_py(), data, open_bytes(data, strict=strict, inflate=inflate)), schema=kinds)

    return files.select("path", "content").mapInArrow(run, schema)


def file_table(files: DataFrame, *, strict: bool = False, inflate: dict[str, Inflate] | None = None) -> DataFrame:
    """One row per file: container and header fields; null for what is not of this kind."""

    def make(path: str, data: bytes, o: Opened) -> list[dict]:
        h = o.header
        box = {"x_min": h.get("xMin"), "y_min": h.get("yMin"), "x_max": h.get("xMax"), "y_max": h.get("yMax")}
        rest = {k: h.get(k) for k in ("frame_rate_raw", "frame_rate", "frame_count", "width_px", "height_px")}
        return [{"path": path, "size": len(data), "compression": o.compression, "version": o.version, "declared_length": o.declared, "body_length": len(o.body)} | box | rest]

    return _scan(files, FILES, make, strict, inflate)


def tag_table(files: DataFrame, *, strict: bool = False, with_body: bool = True, inflate: dict[str, Inflate] | None = None) -> DataFrame:
    """One row per tag in stream order, with its bytes unless told otherwise."""

    def make(path: str, data: bytes, o: Opened) -> list[dict]:
        return [
            {"path": path, "defines": None, "version": o.version} | t | {"body": o.body[t["offset"] : t["offset"] + t["length"]] if with_body else None}
            for t in o.tags
        ]

    return _scan(files, TAGS, make, strict, inflate)


def note_table(files: DataFrame) -> DataFrame:
    """One row per problem, in the order found."""

    def make(path: str, data: bytes, o: Opened) -> list[dict]:
        return [{"path": path, "seq": i} | n for i, n in enumerate(o.notes)]

    return _scan(files, NOTES, make, False)


def with_digest(files: DataFrame) -> DataFrame:
    """Files with the SHA-256 of their bytes, to be held against a manifest of pinned digests."""
    return files.withColumn("sha256", F.sha2("content", 256))
