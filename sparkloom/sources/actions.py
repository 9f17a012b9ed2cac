"""Action blocks as record rows: scanning, operands, regions, basic blocks and the literal stack.

A block is a run of records: one byte of code and, from 0x80 on, two bytes of length and that many bytes of operands.
"""

from __future__ import annotations

import itertools
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkloom.sources.bits import PastEnd, Reader, legacy_text
from sparkloom.sources.tagdata import _plain

#: Code, name, values popped and pushed (-1: it depends). Fixed values of the format.
OPCODES = (
    (0x00, "End", 0, 0), (0x04, "NextFrame", 0, 0), (0x05, "PreviousFrame", 0, 0), (0x06, "Play", 0, 0), (0x07, "Stop", 0, 0),
    (0x08, "ToggleQuality", 0, 0), (0x09, "StopSounds", 0, 0), (0x0A, "Add", 2, 1), (0x0B, "Subtract", 2, 1), (0x0C, "Multiply", 2, 1),
    (0x0D, "Divide", 2, 1), (0x0E, "Equals", 2, 1), (0x0F, "Less", 2, 1), (0x10, "And", 2, 1), (0x11, "Or", 2, 1), (0x12, "Not", 1, 1),
    (0x13, "StringEquals", 2, 1), (0x14, "StringLength", 1, 1), (0x15, "StringExtract", 3, 1), (0x17, "Pop", 1, 0), (0x18, "ToInteger", 1, 1),
    (0x1C, "GetVariable", 1, 1), (0x1D, "SetVariable", 2, 0), (0x20, "SetTarget2", 1, 0), (0x21, "StringAdd", 2, 1), (0x22, "GetProperty", 2, 1),
    (0x23, "SetProperty", 3, 0), (0x24, "CloneSprite", 3, 0), (0x25, "RemoveSprite", 1, 0), (0x26, "Trace", 1, 0), (0x27, "StartDrag", 3, 0),
    (0x28, "EndDrag", 0, 0), (0x29, "StringLess", 2, 1), (0x2A, "Throw", 1, 0), (0x2B, "CastOp", 2, 1), (0x2C, "ImplementsOp", -1, 0),
    (0x2D, "FsCommand2", 0, 0), (0x30, "RandomNumber", 1, 1), (0x31, "MBStringLength", 1, 1), (0x32, "CharToAscii", 1, 1),
    (0x33, "AsciiToChar", 1, 1), (0x34, "GetTime", 0, 1), (0x35, "MBStringExtract", 3, 1), (0x36, "MBCharToAscii", 1, 1),
    (0x37, "MBAsciiToChar", 1, 1), (0x3A, "Delete", 2, 0), (0x3B, "Delete2", 1, 0), (0x3C, "DefineLocal", 2, 0), (0x3D, "CallFunction", -1, 1),
    (0x3E, "Return", 1, 0), (0x3F, "Modulo", 2, 1), (0x40, "NewObject", -1, 1), (0x41, "DefineLocal2", 1, 0), (0x42, "InitArray", -1, 1),
    (0x43, "InitObject", -1, 1), (0x44, "TypeOf", 1, 1), (0x45, "TargetPath", 1, 1), (0x46, "Enumerate", 1, -1), (0x47, "Add2", 2, 1),
    (0x48, "Less2", 2, 1), (0x49, "Equals2", 2, 1), (0x4A, "ToNumber", 1, 1), (0x4B, "ToString", 1, 1), (0x4C, "PushDuplicate", 1, 2),
    (0x4D, "StackSwap", 2, 2), (0x4E, "GetMember", 2, 1), (0x4F, "SetMember", 3, 0), (0x50, "Increment", 1, 1), (0x51, "Decrement", 1, 1),
    (0x52, "CallMethod", -1, 1), (0x53, "NewMethod", -1, 1), (0x54, "InstanceOf", 2, 1), (0x55, "Enumerate2", 1, -1), (0x60, "BitAnd", 2, 1),
    (0x61, "BitOr", 2, 1), (0x62, "BitXor", 2, 1), (0x63, "BitLShift", 2, 1), (0x64, "BitRShift", 2, 1), (0x65, "BitURShift", 2, 1),
    (0x66, "StrictEquals", 2, 1), (0x67, "Greater", 2, 1), (0x68, "StringGreater", 2, 1), (0x69, "Extends", 2, 0), (0x81, "GotoFrame", 0, 0),
    (0x83, "GetURL", 0, 0), (0x87, "StoreRegister", 1, 1), (0x88, "ConstantPool", 0, 0), (0x89, "StrictMode", 0, 0), (0x8A, "WaitForFrame", 0, 0),
    (0x8B, "SetTarget", 0, 0), (0x8C, "GotoLabel", 0, 0), (0x8D, "WaitForFrame2", 1, 0), (0x8E, "DefineFunction2", 0, 1), (0x8F, "Try", 0, 0),
    (0x94, "With", 1, 0), (0x96, "Push", 0, -1), (0x99, "Jump", 0, 0), (0x9A, "GetURL2", 2, 0), (0x9B, "DefineFunction", 0, 1), (0x9D, "If", 1, 0),
    (0x9E, "Call", 1, 0), (0x9F, "GotoFrame2", 1, 0),
)
NAME = {code: name for code, name, _, _ in OPCODES}
_JUMP, _IF, _RETURN, _THROW, _END = 0x99, 0x9D, 0x3E, 0x2A, 0x00


def scan(data: bytes, start: int = 0, stop: int | None = None) -> Iterator[dict]:
    """Records of a block: `offset`, `code`, `length` of operands, `next`, `complete`. Stops after End or at the bounds."""
    at, stop = start, len(data) if stop is None else stop
    while at < stop:
        code, head, size = data[at], 1, 0
        if code >= 0x80:
            if at + 3 > stop:
                yield {"offset": at, "code": code, "length": 0, "next": stop, "complete": False}
                return
            head, size = 3, data[at + 1] | data[at + 2] << 8
        complete = at + head + size <= stop
        end = min(stop, at + head + size)
        yield {"offset": at, "code": code, "length": end - at - head, "next": end, "complete": complete}
        if code == _END or not complete:
            return
        at = end


def _pushed(r: Reader) -> dict:
    kind = r.u8()
    readers = {
        0: ("string", r.string), 1: ("float", r.f32), 2: ("null", lambda: None), 3: ("undefined", lambda: None), 4: ("register", r.u8), 5: ("boolean", lambda: bool(r.u8())),
        6: ("double", r.f64_swapped), 7: ("integer", r.s32), 8: ("pool", r.u8), 9: ("pool", r.u16),
    }
    if kind not in readers:
        raise PastEnd
    name, read = readers[kind]
    return {"type": name, "value": read()}


def operands(code: int, raw: bytes, version: int = 6) -> tuple[dict, list[str]]:
    """Operands of a record and problems; never raises."""
    r, out = Reader(raw, version=version), {}
    try:
        if code == 0x81:
            out["frame"] = r.u16()
        elif code == 0x83:
            out |= {"url": r.string(), "target": r.string()}
        elif code == 0x87:
            out["register"] = r.u8()
        elif code == 0x88:
            out["pool"] = []
            for _ in range(r.u16()):
                if not r.left():
                    raise PastEnd
                out["pool"].append(r.string())
        elif code == 0x8A:
            out |= {"frame": r.u16(), "skip": r.u8()}
        elif code == 0x8B:
            out["target"] = r.string()
        elif code == 0x8C:
            out["label"] = r.string()
        elif code == 0x8D:
            out["skip"] = r.u8()
        elif code in (0x9B, 0x8E):
            out["name"] = r.string()
            n = r.u16()
            if code == 0x8E:
                out |= {"registers": r.u8(), "flags": r.u16()}
                out["parameters"] = [{"register": r.u8(), "name": r.string()} for _ in range(n)]
            else:
                out["parameters"] = [{"register": 0, "name": r.string()} for _ in range(n)]
            out["bodyLength"] = r.u16()
        elif code == 0x8F:
            flags = r.u8()
            out |= {"tryLength": r.u16(), "catchLength": r.u16(), "finallyLength": r.u16(), "hasCatch": bool(flags & 1), "hasFinally": bool(flags & 2), "inRegister": bool(flags & 4), "reserved": flags >> 3}
            if flags & 1:  # only a catch body names what it catches
                out |= {"register": r.u8()} if flags & 4 else {"variable": r.string()}
        elif code == 0x94:
            out["bodyLength"] = r.u16()
        elif code == 0x96:
            out["values"] = []
            while r.left():
                out["values"].append(_pushed(r))
        elif code in (_JUMP, _IF):
            out["branch"] = r.s16()
        elif code == 0x9A:
            flags = r.u8()
            out |= {"method": {0x40: "get", 0x80: "post"}.get(flags & 0xC0, "none"), "loadTarget": bool(flags & 2), "loadVariables": bool(flags & 1), "reserved": flags & 0x3C}
        elif code == 0x9F:
            flags = r.u8()
            out |= {"play": bool(flags & 1), "reserved": flags & 0xFC}
            if flags & 2:
                out["sceneBias"] = r.u16()
    except PastEnd:
        r.notes.append("cut off")
    return out, r.notes


def region(record: dict, fields: dict, stop: int) -> tuple[int, int] | None:
    """The bytes after a record that belong to it: a function's, With's or Try's body."""
    size = fields.get("bodyLength", 0) + fields.get("tryLength", 0) + (fields.get("catchLength", 0) if fields.get("hasCatch") else 0) + (fields.get("finallyLength", 0) if fields.get("hasFinally") else 0)
    return (record["next"], min(stop, record["next"] + size)) if size else None


def decode_records(data: bytes, version: int = 6) -> Iterator[dict]:
    """Records one by one with names, operands, the body they open, and the branch target if it hits a record."""
    starts: set[int] = set()
    for r in scan(data):
        starts |= {r["offset"], r["next"]}
    for r in scan(data):
        head = r["next"] - r["length"]
        fields, notes = operands(r["code"], data[head : r["next"]], version)
        body = region(r, fields, len(data))
        target = r["next"] + fields["branch"] if "branch" in fields else None
        if not r["complete"]:
            notes = [*notes, "cut off"]
        yield (
            r
            | {"name": NAME.get(r["code"]), "fields": fields, "problems": notes, "body_start": body and body[0], "body_end": body and body[1]}
            | {"target": target, "target_valid": None if target is None else target in starts}
        )


def decode_block(data: bytes, version: int = 6) -> list[dict]:
    """All records of a block."""
    return list(decode_records(data, version))


def basic_blocks(records: list[dict]) -> list[dict]:
    """Basic blocks: one starts at the first record, at a branch target, after a branch or an end, and after a region opens."""
    targets = {r["target"] for r in records if r["target_valid"]}
    blocks: list[dict] = []
    fresh = True
    for r in records:
        if fresh or r["offset"] in targets:
            blocks.append({"start": r["offset"], "end": r["next"], "successors": [], "last": r})
        blocks[-1] |= {"end": r["next"], "last": r}
        fresh = r["code"] in (_JUMP, _IF, _RETURN, _THROW, _END) or r["body_start"] is not None
    starts = {b["start"] for b in blocks}
    for b in blocks:
        last = b.pop("last")
        to = [last["target"]] if last["target_valid"] and last["code"] in (_JUMP, _IF) else []
        if last["code"] not in (_JUMP, _RETURN, _THROW, _END):
            to.append(b["end"])
        b["successors"] = sorted({t for t in to if t in starts})
    return blocks


_EFFECT = {code: (pops, pushes) for code, _, pops, pushes in OPCODES}


def stack_depths(records: list[dict]) -> dict[int, int | None]:
    """Values on the stack at the entry of each basic block that control flow reaches, from an empty stack on.

    Predecessors must agree; where they do not, or where a record's effect is not known, the depth is unknown (None),
    and so is everything that follows from it. A stack that runs empty stays at zero.
    """
    blocks = {b["start"]: b for b in basic_blocks(records)}
    own = {r["offset"]: r for r in records}

    def leave(start: int, depth: int | None) -> int | None:
        at = start
        while at < blocks[start]["end"] and at in own and depth is not None:
            r = own[at]
            pops, pushes = _EFFECT.get(r["code"], (-1, -1))
            if r["code"] == 0x96:
                pops, pushes = 0, len(r["fields"].get("values", ()))
            depth = None if pops < 0 or pushes < 0 else max(0, depth - pops) + pushes
            at = r["next"]
        return depth

    state: dict[int, int | None] = {}
    work = [(records[0]["offset"], 0)] if records else []
    while work:
        start, depth = work.pop()
        if start in state:
            if state[start] is None or state[start] == depth:
                continue
            depth = None
        state[start] = depth
        after = leave(start, depth)
        work += [(to, after) for to in blocks[start]["successors"]]
    return state


RECORDS = (
    "block_id string, seq int, offset int, code int, name string, length int, next int, complete boolean, fields string, problems array<string>, "
    "body_start int, body_end int, target int, target_valid boolean"
)
BLOCKS = "block_id string, start int, end int, successors array<int>"


#: Rows of an Arrow batch that is handed on: a batch of blocks can hold any number of records.
_ROWS = 2000


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, _ROWS)):
        yield pa.RecordBatch.from_pylist(part, schema=schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
    """Blocks one by one."""
    for batch in batches:
        for own, data, version in zip(*(batch.column(c) for c in ("block_id", "bytes", "version")), strict=True):
            yield own.as_py(), data.as_py() or b"", version.as_py() or 6


def record_table(blocks: DataFrame) -> DataFrame:
    """Record rows of action blocks (`block_id`, `bytes`, `version`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            {"block_id": own, "seq": seq} | r | {"fields": json.dumps(_plain(r["fields"]), separators=(",", ":"), ensure_ascii=False)}
            for own, data, version in _each(batches)
            for seq, r in enumerate(decode_records(data, version))
        )
        yield from _batched(rows, _RECORD_SCHEMA)

    return blocks.select("block_id", "bytes", "version").mapInArrow(run, RECORDS)


def block_table(blocks: DataFrame) -> DataFrame:
    """Basic blocks with their successors, by start offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({"block_id": own} | b for own, data, version in _each(batches) for b in basic_blocks(decode_block(data, version)))
        yield from _batched(rows, _BLOCK_SCHEMA)

    return blocks.select("block_id", "bytes", "version").mapInArrow(run, BLOCKS)


_RECORD_SCHEMA = pa.schema(
    [("block_id", pa.string()), ("seq", pa.int32()), ("offset", pa.int32()), ("code", pa.int32()), ("name", pa.string()), ("length", pa.int32()), ("next", pa.int32()),
     ("complete", pa.bool_()), ("fields", pa.string()), ("problems", pa.list_(pa.string())), ("body_start", pa.int32()), ("body_end", pa.int32()), ("target", pa.int32()), ("target_valid", pa.bool_())]
)
_BLOCK_SCHEMA = pa.schema([("block_id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("successors", pa.list_(pa.int32()))])


def opcode_dimension(spark: SparkSession) -> DataFrame:
    """The opcode table, as a small dimension."""
    return spark.createDataFrame(list(OPCODES), "code int, name string, pops int, pushes int")


# Writing blocks again


def _text(value: str, version: int) -> bytes:
    """A terminated string: UTF-8 from version 6 on, before it windows-1252 with a question mark for what it cannot hold."""
    if version >= 6:
        return value.encode() + b"\0"
    return bytes(_LEGACY.get(c, 0x3F) for c in value) + b"\0"


_LEGACY = {legacy_text(bytes([b])): b for b in range(256)}


def _push(value: dict, version: int) -> bytes:
    kind, v = value["type"], value["value"]
    if kind == "string":
        return b"\0" + _text(v, version)
    if kind == "float":
        return b"\x01" + struct.pack("<f", v)
    if kind in ("null", "undefined"):
        return b"\x02" if kind == "null" else b"\x03"
    if kind in ("register", "boolean"):
        return bytes([4 if kind == "register" else 5, int(v)])
    if kind == "double":
        raw = struct.pack("<d", v)
        return b"\x06" + raw[4:] + raw[:4]
    if kind == "integer":
        return b"\x07" + struct.pack("<i", v)
    return bytes([8, v]) if v < 256 else b"\x09" + struct.pack("<H", v)


def _body(code: int, f: dict, version: int) -> bytes:
    """Operands of one record as bytes."""
    if code == 0x81:
        return struct.pack("<H", f["frame"])
    if code == 0x83:
        return _text(f["url"], version) + _text(f["target"], version)
    if code == 0x87:
        return bytes([f["register"]])
    if code == 0x88:
        return struct.pack("<H", len(f["pool"])) + b"".join(_text(p, version) for p in f["pool"])
    if code == 0x8A:
        return struct.pack("<HB", f["frame"], f["skip"])
    if code in (0x8B, 0x8C):
        return _text(f["target"] if code == 0x8B else f["label"], version)
    if code == 0x8D:
        return bytes([f["skip"]])
    if code == 0x8F:
        flags = f["hasCatch"] | f["hasFinally"] << 1 | f.get("inRegister", "register" in f) << 2 | f.get("reserved", 0) << 3
        named = b"" if not f["hasCatch"] else bytes([f["register"]]) if "register" in f else _text(f["variable"], version)
        return struct.pack("<BHHH", flags, f["tryLength"], f["catchLength"], f["finallyLength"]) + named
    if code == 0x94:
        return struct.pack("<H", f["bodyLength"])
    if code == 0x96:
        return b"".join(_push(v, version) for v in f["values"])
    if code in (_JUMP, _IF):
        return struct.pack("<h", f["branch"])
    if code == 0x9A:
        return bytes([{"get": 0x40, "post": 0x80, "none": 0}[f["method"]] | f.get("reserved", 0) | f["loadTarget"] << 1 | f["loadVariables"]])
    if code == 0x9B:
        return _text(f["name"], version) + struct.pack("<H", len(f["parameters"])) + b"".join(_text(p["name"], version) for p in f["parameters"]) + struct.pack("<H", f["bodyLength"])
    if code == 0x8E:
        named = b"".join(bytes([p["register"]]) + _text(p["name"], version) for p in f["parameters"])
        return _text(f["name"], version) + struct.pack("<HBH", len(f["parameters"]), f["registers"], f["flags"]) + named + struct.pack("<H", f["bodyLength"])
    if code == 0x9F:
        biased = f.get("sceneBias") is not None
        return bytes([f.get("reserved", 0) | biased << 1 | f["play"]]) + (struct.pack("<H", f["sceneBias"]) if biased else b"")
    return b""


def serialise(records: list[tuple[int, dict]], version: int = 6) -> bytes:
    """Bytes of records given as (code, operands), in their canonical form; bodies follow as records of their own.

    A code that is not known has no canonical form: ValueError.
    """
    known, out = {code for code, *_ in OPCODES}, []
    for code, f in records:
        if code not in known:
            raise ValueError(f"no canonical form for code {code:#04x}")
        body = _body(code, f, version)
        out.append(bytes([code]) + (struct.pack("<H", len(body)) + body if code >= 0x80 else b""))
    return b"".join(out)
