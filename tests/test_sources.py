"""Scans and decoders: written movies read back, defects noted, and no bytes make them raise."""

import json
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from movie_writer import END, EXAMPLE, SHOW, matrix, movie, place, rect, remove, sprite, square, tag

from sparkloom.operators import movies
from sparkloom.sources import actions, audio, container, images, tagdata
from sparkloom.sources.bits import Reader, legacy_text


def codes(o):
    return [n["code"] for n in o.notes]


def test_the_printed_example():
    assert len(EXAMPLE) == 79
    o = container.open_bytes(EXAMPLE)
    assert (o.compression, o.version, o.declared) == ("none", 3, 79)
    assert (o.header["frame_rate"], o.header["frame_count"], o.header["width_px"], o.header["height_px"]) == (12.0, 1, 550.0, 400.0)
    assert [t["code"] for t in o.tags] == [9, 2, 26, 1, 0]
    shape = o.tags[1]
    assert (shape["defines"], shape["long_header"], shape["length"]) == (1, True, 35)
    body = [o.body[t["offset"] : t["offset"] + t["length"]] for t in o.tags]
    assert tagdata.decode(9, body[0])[0] == {"colour": [255, 255, 255, 255]}
    f, notes = tagdata.decode(2, body[1])
    assert not notes and f["bounds"] == {"xMin": 2010, "xMax": 4910, "yMin": 1670, "yMax": 4010}
    assert f["styles"] == {"fills": [], "lines": [{"width": 20, "colour": [0, 0, 0, 255]}]}
    r = f["records"]
    assert (r[0]["x"], r[0]["y"], r[0]["line"]) == (4900, 1680, 1)
    assert [(x["x"], x["y"]) for x in r[1:]] == [(4900, 4000), (2020, 4000), (2020, 1680), (4900, 1680)]
    assert codes(o) == ["SF0002", "SF0030"]


@pytest.mark.parametrize("kind", ["none", "zlib", "lzma"])
def test_compressions(kind):
    o = container.open_bytes(movie(square(1) + place(1, 1) + SHOW + END, kind=kind, version=13))
    assert o.compression == kind and [t["code"] for t in o.tags] == [2, 26, 1, 0] and not o.notes


def test_sprites_are_walked_in_place():
    inner = place(1, 1) + SHOW + remove(1) + SHOW + END
    o = container.open_bytes(movie(square(1) + sprite(2, 2, inner) + sprite(3, 1, sprite(4, 1, SHOW + END) + SHOW + END) + place(1, 2) + SHOW + END))
    assert [(t["code"], t["sprite"]) for t in o.tags] == [
        (2, None), (39, None), (26, 2), (1, 2), (28, 2), (1, 2), (0, 2), (39, None), (39, 3), (1, 4), (0, 4), (1, 3), (0, 3), (26, None), (1, None), (0, None),
    ]
    assert [t["index"] for t in o.tags] == list(range(16)) and codes(o) == ["SF0129", "SF0128"]


@pytest.mark.parametrize(
    "data,want",
    [
        (b"nothing of the kind", ["SF0001"]),
        (b"", ["SF0001"]),
        (movie(SHOW), ["SF0102"]),
        (movie(SHOW + END + b"tail"), ["SF0024"]),
        (movie(SHOW + END, length=7), ["SF0028", "SF0004"]),
        (movie(SHOW + END, frames=3), ["SF0023"]),
        (movie(tag(250) + SHOW + END), ["SF0104"]),
        (movie(tag(9, b"abc", long=True) + SHOW + END), ["SF0030"]),
        (movie(SHOW + struct.pack("<H", 9 << 6 | 40) + b"abc"), ["SF0101", "SF0102"]),
        (movie(square(1) + square(1) + square(0) + SHOW + END), ["SF0109", "SF0107"]),
        (movie(sprite(2, 1, SHOW) + SHOW + END), ["SF0174"]),
        (movie(sprite(2, 5, SHOW + END) + SHOW + END), ["SF0023"]),
        (movie(SHOW + END, rate=0), ["SF0022"]),
        (movie(SHOW + END, version=3), ["SF0002"]),
        (movie(SHOW + END, version=5, kind="zlib"), ["SF0033"]),
        (movie(SHOW + END, size=(0, 10)), ["SF0029"]),
    ],
)
def test_defects_are_noted(data, want):
    assert codes(container.open_bytes(data)) == want


def test_a_damaged_stream_keeps_its_beginning():
    whole = movie(b"".join(square(i, 100 + i * 7) for i in range(1, 300)) + SHOW + END, kind="zlib")
    o = container.open_bytes(whole[: len(whole) // 2])
    assert "SF0003" in codes(o) and len(o.tags) > 20
    with pytest.raises(container.Malformed):
        container.open_bytes(whole[:40], strict=True)
    assert "SF0007" in codes(container.open_bytes(whole, most=100))


def test_nesting_is_bounded():
    inner = SHOW + END
    for i in range(40):
        inner = sprite(100 + i, 1, inner + SHOW + END if i else inner)
    o = container.open_bytes(movie(inner + SHOW + END))
    assert "SF0103" in codes(o) and max(t["depth"] for t in o.tags) == 32


def test_readers():
    assert Reader(bytes([0xE5, 0x8E, 0x26])).encoded_u32() == 624485
    r = Reader(bytes([0x80, 0x00]))
    assert r.encoded_u32() == 0 and r.notes == ["overlong number"]
    assert [Reader(struct.pack("<H", x)).f16() for x in (0x3C00, 0x4000, 0xC400, 0x0001, 0x7BFF, 0x3555)] == [1.0, 2.0, -4.0, 2.0**-24, 65504.0, 0.333251953125]
    assert Reader(b"\xb0").sb(4) == -5 and Reader(b"\x48\x00").ub(5) == 9
    assert Reader(rect(-5, 70, 3, 900)).rect() == {"xMin": -5, "xMax": 70, "yMin": 3, "yMax": 900}
    assert Reader(matrix(-40, 7, 1.5)).matrix() == {"a": 1.5, "b": 0.0, "c": 0.0, "d": 1.5, "tx": -40, "ty": 7}
    assert legacy_text(b"a\x80\x81\xe9") == "a€\x81é" and Reader(b"h\xe9\0", version=5).string() == "hé"
    r = Reader(b"\xff\0", version=8)
    assert r.string() == "�" and r.notes == ["invalid utf-8"]


def test_decoders_never_raise():
    rnd = random.Random(1)
    bodies = [square(1)[2:], place(3, 4, "n", (5, 6), clip=9)[2:], bytes(60)]
    for _ in range(6000):
        body = bytearray(rnd.choice(bodies) + bytes(rnd.randrange(256) for _ in range(rnd.randrange(30))))
        for _ in range(rnd.randrange(6)):
            body[rnd.randrange(len(body))] = rnd.randrange(256)
        code = rnd.choice(list(tagdata.DECODERS))
        fields, _ = tagdata.decode(code, bytes(body), rnd.choice([3, 5, 6, 10]))
        json.dumps(tagdata._plain(fields), allow_nan=False)


def test_containers_never_raise():
    rnd = random.Random(2)
    whole = movie(square(1) + sprite(2, 1, place(1, 1) + SHOW + END) + place(1, 2) + SHOW + END)
    for _ in range(2000):
        data = bytearray(whole)
        for _ in range(rnd.randrange(1, 8)):
            data[rnd.randrange(len(data))] = rnd.randrange(256)
        container.open_bytes(bytes(data[: rnd.randrange(len(data) + 1)]))


def push(*values):
    return (0x96, {"values": [{"type": t, "value": v} for t, v in values]})


SCRIPT = [
    (0x88, {"pool": ["a", "é"]}), push(("pool", 1), ("integer", -3), ("double", 2.5), ("boolean", True), ("null", None), ("undefined", None), ("string", "x"), ("register", 2), ("float", 0.5)),
    (0x47, {}), (0x9D, {"branch": 1}), (0x06, {}), (0x9B, {"name": "f", "parameters": [{"register": 0, "name": "p"}], "bodyLength": 2}), (0x07, {}), (0x3E, {}), (0x99, {"branch": -1}), (0x00, {}),
]


def test_actions_round_trip():
    data = actions.serialise(SCRIPT)
    got = actions.decode_block(data)
    assert [r["code"] for r in got] == [c for c, _ in SCRIPT] and not any(r["problems"] for r in got)
    assert actions.serialise([(r["code"], r["fields"]) for r in got]) == data
    assert got[1]["fields"] == SCRIPT[1][1] and got[0]["fields"] == SCRIPT[0][1]
    assert got[5]["body_start"] == got[6]["offset"] and got[5]["body_end"] == got[8]["offset"]
    assert got[3]["target"] == got[5]["offset"] and got[3]["target_valid"] and not got[8]["target_valid"]


def test_every_operand_layout_round_trips():
    records = [
        (0x8A, {"frame": 700, "skip": 3}), (0x8D, {"skip": 9}), (0x9F, {"play": True, "reserved": 0}), (0x9F, {"play": False, "reserved": 0x14, "sceneBias": 515}),
        (0x9A, {"method": "get", "loadTarget": True, "loadVariables": False, "reserved": 0}), (0x9A, {"method": "post", "loadTarget": False, "loadVariables": True, "reserved": 0x3C}),
        (0x9A, {"method": "none", "loadTarget": False, "loadVariables": False, "reserved": 0}), (0x81, {"frame": 65535}), (0x87, {"register": 255}), (0x83, {"url": "a", "target": "é"}), (0x8B, {"target": "/x"}), (0x8C, {"label": "l"}),
        (0x8F, {"tryLength": 0, "catchLength": 0, "finallyLength": 0, "hasCatch": True, "hasFinally": False, "inRegister": False, "reserved": 0, "variable": "e"}),
        (0x8F, {"tryLength": 0, "catchLength": 0, "finallyLength": 0, "hasCatch": True, "hasFinally": True, "inRegister": True, "reserved": 21, "register": 4}),
        (0x8F, {"tryLength": 0, "catchLength": 0, "finallyLength": 0, "hasCatch": False, "hasFinally": True, "inRegister": False, "reserved": 0}), (0x20, {}), (0, {}),
    ]
    for version in (5, 6):
        data = actions.serialise(records, version)
        got = actions.decode_block(data, version)
        assert [(r["code"], r["fields"]) for r in got] == records and actions.serialise([(r["code"], r["fields"]) for r in got], version) == data
    assert actions.operands(0x9A, b"\x83")[0] == {"method": "post", "loadTarget": True, "loadVariables": True, "reserved": 0}
    assert actions.serialise([(0x8B, {"target": "€é漢"})], 5) == b"\x8b\x04\x00\x80\xe9?\0"
    with pytest.raises(ValueError):
        actions.serialise([(0x01, {})])


def test_basic_blocks():
    got = actions.decode_block(actions.serialise(SCRIPT))
    blocks = actions.basic_blocks(got)
    at = [r["offset"] for r in got]
    assert [b["start"] for b in blocks] == [at[0], at[4], at[5], at[6], at[8], at[9]]
    assert blocks[0]["successors"] == [at[4], at[5]] and blocks[3]["successors"] == [] and blocks[1]["successors"] == [at[5]]


def test_stack_depths():
    two = push(("integer", 1), ("integer", 2))
    got = actions.decode_block(actions.serialise([two, (0x9D, {"branch": 1}), (0x17, {}), (0x06, {}), (0x00, {})]))
    at = [r["offset"] for r in got]
    # The branch pops one of two values; the other way round pops the second.
    assert actions.stack_depths(got) == {at[0]: 0, at[2]: 1, at[3]: None}
    loop = actions.decode_block(actions.serialise([(0x06, {}), two, (0x17, {}), (0x17, {}), (0x99, {"branch": -22})]))
    assert set(actions.stack_depths(loop).values()) == {0}
    assert actions.stack_depths([]) == {}


def test_actions_never_raise():
    rnd = random.Random(3)
    whole = actions.serialise(SCRIPT)
    for _ in range(4000):
        data = bytearray(whole)
        for _ in range(rnd.randrange(1, 6)):
            data[rnd.randrange(len(data))] = rnd.randrange(256)
        records = actions.decode_block(bytes(data[: rnd.randrange(len(data) + 1)]), rnd.choice([4, 6]))
        actions.basic_blocks(records)
        actions.stack_depths(records)
        assert all(a["next"] == b["offset"] for a, b in zip(records, records[1:]))


def test_tables(spark, tmp_path):
    first = movie(square(1) + square(7) + square(1) + sprite(2, 2, place(1, 1) + SHOW + remove(1) + SHOW + END) + place(3, 2, "s") + tag(43, b"go\0") + SHOW + place(3, move=True, at=(40, 0)) + place(9, 55) + SHOW + remove(3) + SHOW + tag(12, b"\x06\x00") + END, frames=3)
    (tmp_path / "a.swf").write_bytes(first)
    (tmp_path / "b.swf").write_bytes(b"junk")
    files = container.read_files(spark, str(tmp_path))
    table = {r.path[-5:]: r for r in container.file_table(files).collect()}
    assert table["a.swf"].frame_count == 3 and table["b.swf"].compression is None
    assert {(r.path[-5:], r.code) for r in container.note_table(files).collect()} == {("a.swf", "SF0109"), ("b.swf", "SF0001")}
    decoded = tagdata.decoded(container.tag_table(files))
    assert [(r.id, r.shadowed) for r in movies.definitions(decoded).orderBy("index").collect()] == [(1, True), (7, False), (1, False), (2, False)]
    shown = {(r.timeline, r.frame, r.depth, r.character, r.since) for r in movies.display_list(decoded).collect()}
    assert shown == {(0, 0, 3, 2, 0), (0, 1, 3, 2, 0), (0, 1, 9, 55, 1), (0, 2, 9, 55, 1), (2, 0, 1, 1, 0)}
    assert [(r.character, r.depth) for r in movies.undefined_placements(decoded).collect()] == [(55, 9)]
    assert {r.frame: r.label for r in movies.frames(decoded).where("timeline = 0").collect()} == {0: "go", 1: "", 2: "", 3: ""}
    assert {r.id: r.live for r in movies.live_characters(decoded).collect()} == {1: True, 2: True, 7: False}
    blocks = movies.action_blocks(container.tag_table(files))
    assert [r.name for r in actions.record_table(blocks).orderBy("seq").collect()] == ["Play", "End"]
    assert actions.block_table(blocks).count() == 1


def test_records_are_handed_on_in_small_batches():
    """However many records a batch of blocks holds, and however many one block does."""

    class Table:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    data = [b"\x06" * n + b"\0" for n in (5, 9000, 0, 1200, 1200)]
    blocks = pa.RecordBatch.from_pydict({"block_id": list("abcde"), "bytes": data, "version": [6] * 5})
    for table in (actions.record_table, actions.block_table):
        assert list(table(Table())(iter([]))) == []
    got = list(actions.record_table(Table())(iter([blocks])))
    assert max(b.num_rows for b in got) <= 2000
    want = [(own, i) for own, d in zip("abcde", data, strict=True) for i in range(len(d))]
    assert [(r["block_id"], r["seq"]) for b in got for r in b.to_pylist()] == want


def test_mp3_frames_and_pcm():
    frame = bytes.fromhex("fffb9064") + bytes(413)
    got = audio.mp3_frames(frame * 3 + b"junk")
    assert [(f["offset"], f["length"], f["kbits"], f["rate"]) for f in got] == [(417 * i, 417, 128, 44100) for i in range(3)]
    assert audio.pcm(bytes([0, 128, 255]), 8, 1).tolist() == [[-32768, 0, 32512]]
    assert audio.pcm(struct.pack("<5h", 1, 2, 3, 4, 5), 16, 2).tolist() == [[1, 3], [2, 4]]
    assert audio.wav(np.zeros((2, 3), np.int16), 11025)[:4] == b"RIFF" and len(audio.wav(np.zeros((2, 3), np.int16), 11025)) == 56
    assert audio.resample(np.array([0, 10, 20, 30], np.int16), 2, 3).tolist() == [0, 7, 13, 20, 27, 30]
    assert audio.resample(np.array([0, 10, 20, 30], np.int16), 3, 2).tolist() == [0, 15, 30]  # 8 / 3 is nearer to 3
    assert audio.resample(np.array([5, -7], np.int16), 8, 8).tolist() == [5, -7] and audio.resample(np.zeros(0, np.int16), 1, 2).tolist() == []
    assert audio.levels(np.zeros(4, np.int16))["dbfs"] is None and audio.levels(np.full(4, 32, np.int16))["gated"] and not audio.levels(np.full(4, 33, np.int16))["gated"]


def test_code_deltas_add_cut_terms():
    """A step of 7 with codes of 4 bits: 7 >> 3, and 7 >> 2, 7 >> 1, 7 for the bits."""
    assert [audio.code_delta(7, k, 4) for k in range(8)] == [0, 1, 3, 4, 7, 8, 10, 11]
    assert [audio.code_delta(11, k, 3) for k in range(4)] == [2, 7, 13, 18] and [audio.code_delta(7, k, 2) for k in range(2)] == [3, 10]
    assert [audio.code_delta(9, k, 5) for k in (1, 2, 4, 8, 15)] == [1, 2, 4, 9, 16]
    off = [abs(audio.code_delta(s, k, bits) - (s * (2 * k + 1) >> (bits - 1))) for bits in (2, 3, 4, 5) for s in audio._STEPS for k in range(1 << (bits - 1))]
    assert (len(off), sum(d > 0 for d in off), max(off)) == (2670, 884, 3)  # the closed form is another function


def packed(text):
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def test_adpcm_by_hand():
    # 4 bits; sample 100, index 0 (step 7). Code 7: +11, index 8 (16). Code 12 (minus 4): -(2 + 16), index 10 (19). Code 1: 2 + 4, index 9.
    data = packed("10" + format(100, "016b") + format(0, "06b") + "0111" + "1100" + "0001")
    assert audio.adpcm(data, 1, 4).tolist() == [[100, 111, 93, 99]]
    # 2 bits, two channels, interleaved: steps of 7 (index 0) and 3024 (index 63), then 9 (index 2) and 3660 (index 65).
    data = packed("00" + format(0, "016b") + format(0, "06b") + format(-30000 & 0xFFFF, "016b") + format(63, "06b") + "01" + "11" + "10" + "00")
    assert audio.adpcm(data, 2, 3).tolist() == [[0, 10, 6], [-30000, -32768, -30938]]
    assert audio.adpcm(data[:6], 2, 3).shape[1] < 3


def encode_adpcm(samples, bits):
    """A plain encoder: the code whose decoded value comes closest."""
    text, value, index = format(bits - 2, "02b"), samples[0], 0
    text += format(value & 0xFFFF, "016b") + format(index, "06b")
    out, top = [value], 1 << (bits - 1)

    def decoded(c):
        step, change = audio._STEPS[index], 0
        for k in range(bits):  # the lowest bit stands for half a unit and is always set
            if (2 * (c & (top - 1)) + 1) >> k & 1:
                change += (step << k) >> (bits - 1)
        return max(-32768, min(32767, value - change if c & top else value + change))

    for s in samples[1:]:
        code = min(range(1 << bits), key=lambda c: abs(decoded(c) - s))
        value = decoded(code)
        index = max(0, min(88, index + audio._INDEX[bits][code & (top - 1)]))
        text += format(code, f"0{bits}b")
        out.append(value)
    return packed(text), out


@pytest.mark.parametrize("bits", [2, 3, 4, 5])
def test_adpcm(bits):
    wave = [int(9000 * np.sin(i / 15)) for i in range(700)]
    data, want = encode_adpcm(wave, bits)
    assert audio.adpcm(data, 1, 700).tolist() == [want]
    assert audio.adpcm(data[:30], 1, 700).shape[1] < 700


def test_lossless_pictures():
    import zlib

    table, index = bytes([1, 2, 3, 9, 8, 7]), bytes([0, 1, 1, 0] * 2)
    body = struct.pack("<HBHHB", 1, 3, 3, 2, 1) + zlib.compress(table + index)
    assert images.lossless(body, False)[0].tolist() == [[1, 2, 3, 255], [9, 8, 7, 255], [9, 8, 7, 255]]
    body = struct.pack("<HBHH", 1, 5, 1, 1) + zlib.compress(bytes([128, 64, 0, 128]))
    assert images.lossless(body, True).tolist() == [[[128, 0, 255, 128]]]
    assert images.png(np.zeros((2, 2, 4), np.uint8)).startswith(b"\x89PNG")


def test_blobs_dumps_scenes_and_hit_areas(spark, tmp_path):
    (tmp_path / "a.swf").write_bytes(movie(tag(12, b"\x06\x07\x00") + square(1) + SHOW + END))
    tags = container.tag_table(container.read_files(spark, str(tmp_path)))
    path = tags.first().path
    wants = [(path, 0, "s", 1, 2, 3), (path, 0, "s", 0, 1, 3), (path, 0, "t", 2, 5, 3), (path, 9, "u", 0, 1, 3), (path, 0, "v", 0, 1, 257)]
    good, bad = movies.residual_blobs(tags, spark.createDataFrame(wants, "path string, index int, subject string, start int, length int, registers int"))
    assert [(r.subject, bytes(r.bytes)) for r in good.collect()] == [("s", b"\x06")]
    assert {r.subject: r.why for r in bad.collect()} == {"t": "outside the body", "u": "no tag", "v": "registers"}
    dump = json.loads(movies.model_dump(tagdata.decoded(tags)).first().dump)
    assert [t["code"] for t in dump["tags"]] == [12, 2, 1, 0] and dump["tags"][1]["fields"]["character"] == 1
    scene = '{"schemaVersion":1,"width":5,"height":6,"frames":[{"items":[{"shape":1,"depth":2,"matrix":[1.0,0.0]}]}]}'
    texts = spark.createDataFrame([(scene,)], "scene string")
    assert movies.write_scenes(movies.read_scenes(texts)).first().scene == scene
    with pytest.raises(Exception):
        movies.read_scenes(spark.createDataFrame([("{broken",)], "scene string")).collect()


def test_hit_areas(spark):
    one = [1, 0, 0, 1, 0, 0]
    rows = [
        ("f", 1, 0, ["up"], 5, *one), ("f", 1, 1, ["hitTest", "down"], 5, 2, 0, 0, 2, 10, 0), ("f", 2, 2, ["up"], 5, 0, 0, 0, 0, 0, 0), ("f", 3, 3, ["up"], 5, 0, 1, -1, 0, 0, 0),
        ("f", 4, 4, ["hitTest"], 6, *one), ("f", 4, 5, ["up"], 5, *one),  # the hit test has no bounds, and the up state does not stand in
        ("f", 7, 6, ["up"], 1, 1, 0, 0, 1, 100, 0), ("f", 7, 7, ["up"], 5, *one),  # a button inside a button
        ("f", 8, 8, ["up"], 9, *one), ("f", 8, 9, ["up"], 5, *one), ("f", 9, 10, ["up"], 8, 1, 0, 0, 1, 50, 0), ("f", 9, 11, ["up"], 5, 1, 0, 0, 1, 20, 0), ("g", 1, 0, ["over"], 5, *one), ("g", 2, 1, ["up"], 2, *one),
    ]
    records = spark.createDataFrame(rows, "path string, button int, seq int, states array<string>, character int, a int, b int, c int, d int, tx int, ty int")
    bounds = spark.createDataFrame([("f", 5, 0, 0, 4, 6), ("f", 6, None, None, None, None), ("g", 5, 0, 0, 1, 1)], "path string, character int, x0 int, y0 int, x1 int, y1 int")
    got = {(r.path, r.button): (None if r.x0 is None else (r.x0, r.y0, r.x1, r.y1), r.source, r.problems) for r in movies.hit_areas(records, bounds).collect()}
    assert got == {
        ("f", 1): ((10, 0, 18, 12), "hitTest", []), ("f", 2): (None, "up", ["singular", "none"]), ("f", 3): ((-6, 0, 0, 4), "up", []), ("f", 4): (None, "hitTest", ["none"]),
        ("f", 7): ((0, 0, 118, 12), "up", []), ("f", 9): ((20, 0, 24, 6), "up", ["cycle"]), ("f", 8): ((0, 0, 24, 6), "up", []), ("g", 1): (None, None, []), ("g", 2): (None, "up", ["cycle", "none"]),
    }


def test_references_and_what_stops_their_closure(spark, tmp_path):
    font = tag(48, struct.pack("<H", 20) + b"\0\0\x01a\0\0\0\0")
    text = tag(11, struct.pack("<H", 21) + b"\0\0\0\0" + b"\x08" + struct.pack("<HH", 20, 9) + b"\0" + b"\0")
    (tmp_path / "a.swf").write_bytes(movie(square(1) + square(2) + tag(17, struct.pack("<HHHH", 30, 0, 40, 0)[:6] + b"\0" + struct.pack("<HH", 0, 0)) + place(1, 1) + SHOW + END))
    (tmp_path / "b.swf").write_bytes(movie(font + text + square(2) + place(1, 21) + SHOW + END))
    decoded = tagdata.decoded(container.tag_table(container.read_files(spark, str(tmp_path))))
    edges = {(r.path[-5], r.src, r.dst) for r in movies.references(decoded).collect()}
    assert {("a", 0, 1), ("a", 30, 40), ("b", 0, 21), ("b", 21, 20)} <= edges
    assert {(r.path[-5], r.character) for r in movies.reference_blockers(decoded).collect()} == {("b", 20)}
    live = {(r.path[-5], r.id): (r.live, r.prunable) for r in movies.live_characters(decoded).collect()}
    assert live["a", 2] == (False, True) and live["a", 1] == (True, False) and live["b", 2] == (False, False) and live["b", 20] == (True, False)


def test_command_line(spark, tmp_path, capsys):
    from sparkloom.__main__ import VERBS, main, table

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.swf").write_bytes(movie(square(1) + SHOW + END))
    assert all(table(spark, verb, str(tmp_path / "in")).columns for verb in VERBS)
    assert table(spark, "characters", str(tmp_path / "in")).count() == 1 and main(["frames", str(tmp_path / "in")], spark) == 0
    assert main(["tags", str(tmp_path / "in"), "--out", str(tmp_path / "out")], spark) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert main(["files", str(tmp_path / "nothing")], spark) == 2

    def alone(data, *more):
        (tmp_path / "in" / "a.swf").write_bytes(data)
        return main(["files", str(tmp_path / "in"), *more], spark)

    assert alone(b"junk") == 2
    assert alone(movie(tag(69, b"\x08\0\0\0") + SHOW + END, version=9)) == 3 and alone(movie(tag(82, b"\0" * 6) + SHOW + END, version=9)) == 3
    for data in (movie(square(1) + square(1) + SHOW + END), movie(square(1) + SHOW + END)[:14]):
        code = alone(data)
        levels = {r.severity for r in table(spark, "diagnostics", str(tmp_path / "in")).collect()}
        assert code == ("error" in levels) and ("error" in levels or alone(data, "--max-warnings", "0") == 4 * ("warning" in levels) == alone(data, "--fail-on", "warning"))


def test_trees_are_written_whole_or_not_at_all(spark, tmp_path):
    from sparkloom.sources.trees import write_tree

    kind = "path string, content binary"
    out = tmp_path / "tree"
    assert write_tree(spark.createDataFrame([("b/c.txt", b"1"), ("a.txt", b"2")], kind), str(out)) == ["a.txt", "b/c.txt"]
    assert (out / "b" / "c.txt").read_bytes() == b"1"
    for bad in ([("x", b"3"), ("../y", b"4")], [("x", b"3"), ("x", b"4")], [("/etc/x", b"")], [("a", b""), ("a/b", b"")]):
        with pytest.raises((ValueError, OSError)):
            write_tree(spark.createDataFrame(bad, kind), str(out))
        assert sorted(p.name for p in tmp_path.iterdir()) == ["tree"] and (out / "a.txt").read_bytes() == b"2"
    write_tree(spark.createDataFrame([("n", b"5")], kind), str(out))
    assert [p.name for p in out.iterdir()] == ["n"] and sorted(p.name for p in tmp_path.iterdir()) == ["tree"]


def test_decoders_of_ones_own_and_large_files(spark, tmp_path):
    import zlib

    def own(packed, most):
        if packed == b"bad":
            raise ValueError("no")
        return zlib.decompress(packed)[:most]

    body = rect(0, 100, 0, 100) + struct.pack("<HH", 256, 1) + b"\0\0"
    data = b"CWS\x06" + struct.pack("<I", 8 + len(body)) + zlib.compress(body)
    assert container.open_bytes(data, inflate={"zlib": own}).body == container.open_bytes(data).body == body
    assert [n["code"] for n in container.open_bytes(data[:8] + b"bad", inflate={"zlib": own}).notes][:1] == ["SF0003"]
    (tmp_path / "small").write_bytes(data)
    (tmp_path / "large").write_bytes(b"x" * 5000)
    files = container.read_files(spark, str(tmp_path), most=1000)
    assert {r.path.rpartition("/")[2]: r.content is None for r in files.collect()} == {"small": False, "large": True}
    assert container.tag_table(files, inflate={"zlib": own}).count() == 1
