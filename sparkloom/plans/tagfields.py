"""Tag bodies of every family, written from event numbers and decoded again.

A template is a tag code, the parts of its body (hex digits, or a number of so many bytes as SQL) and what must be read from
it (a JSON path and the value as SQL). SQL here means the same to both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.containers import _le
from sparkloom.plans.registry import Tables, query
from sparkloom.sources import tagdata

_A, _B, _C = "event_id % 60000", "event_id * 7 % 500", "event_id % 100"
_ID, _AT, _SMALL = (_A, 2), (_B, 2), (_C, 1)
_IS_ID = ("character", _A)

_TEMPLATES: tuple[tuple[int, tuple, tuple], ...] = (
    (4, (_ID, _AT, "00"), (_IS_ID, ("depth", _B), ("matrix.tx", "0"))),
    (5, (_ID, _AT), (_IS_ID, ("depth", _B))),
    (26, ("22", _AT, _ID, "616200"), (_IS_ID, ("depth", _B), ("name", "'ab'"))),
    (26, ("50", _AT, _ID, _AT), (("ratio", _A), ("depth", _B), ("clipDepth", _B))),
    (70, ("0200", _AT, _ID), (_IS_ID, ("depth", _B))),
    (14, (_ID, "1B", (_A, 4), "ABCD"), (_IS_ID, ("samples", _A), ("rate", "22050"))),
    (15, (_ID, "04", _AT), (("sound", _A), ("info.loops", _B), ("info.stop", "'false'"))),
    (18, ("0A1A", _AT), (("samples", _B), ("format", "'adpcm'"), ("playbackRate", "22050"))),
    (45, ("0F3B", _AT), (("samples", _B), ("channels", "2"), ("playbackRate", "44100"))),
    (60, (_ID, _AT, "0A001400", "0304"), (_IS_ID, ("frames", _B), ("deblocking", "1"))),
    (61, (_ID, _AT, "010203"), (("stream", _A), ("frame", _B), ("length", "3"))),
    (69, (("8 * (event_id % 2) + 16", 4),), (("actionScript3", "CASE event_id % 2 WHEN 1 THEN 'true' ELSE 'false' END"), ("useNetwork", "'false'"), ("hasMetadata", "'true'"))),
    (56, ("0100", _ID, "6100"), (("symbols[0].character", _A), ("symbols[0].name", "'a'"))),
    (76, ("0200", _ID, "6100", _AT, "6200"), (("symbols[0].character", _A), ("symbols[1].character", _B), ("symbols[1].name", "'b'"))),
    (57, ("7500", "0100", _ID, "6200"), (("symbols[0].character", _A), ("url", "'u'"))),
    (71, ("7500", "0100", "0100", _ID, "6200"), (("symbols[0].character", _A), ("url", "'u'"), ("symbols[0].name", "'b'"))),
    (65, (_ID, _AT), (("recursion", _A), ("timeout", _B))),
    (66, (_ID, _AT), (("depth", _A), ("tabIndex", _B))),
    (59, (_ID, "AABB"), (("sprite", _A), ("offset", "2"), ("length", "2"))),
    (58, ("7000",), (("password", "'p'"),)),
    (64, ("0000", "717200"), (("password", "'qr'"),)),
    (87, (_ID, "00000000", "01020304"), (_IS_ID, ("offset", "6"), ("length", "4"))),
    (77, ("E282AC00",), (("text", "'€'"),)),
    (86, ("01", _SMALL, "6100", "01", _SMALL, "6200"), (("scenes[0].offset", _C), ("labels[0].frame", _C), ("labels[0].name", "'b'"))),
    (88, (_ID, "6100", "6200"), (("font", _A), ("name", "'a'"), ("copyright", "'b'"))),
    (2, (_ID, "00" * 6), (_IS_ID, ("bounds.xMax", "0"))),
    (11, (_ID, "00" * 5), (_IS_ID, ("matrix.a", "'1.0'"))),
    (33, (_ID, "00" * 5), (_IS_ID, ("matrix.d", "'1.0'"))),
    (37, (_ID, "00" * 7), (_IS_ID, ("readOnly", "'false'"))),
    (48, (_ID, "0000", "026162", "0000", "0000"), (_IS_ID, ("name", "'ab'"), ("bold", "'false'"))),
    (75, (_ID, "0200", "026162", "0000", "0000"), (_IS_ID, ("name", "'ab'"), ("italic", "'true'"))),
    (7, (_ID, "0000"), (_IS_ID, ("actions.offset", "3"), ("actions.length", "1"))),
    (34, (_ID, "01", "0000", "00"), (_IS_ID, ("trackAsMenu", "'true'"))),
    (23, (_ID, "00"), (("button", _A), ("colourTransform.rMult", "256"), ("colourTransform.aAdd", "0"))),
    (17, (_ID, "0000", _AT, "00", "0000", "0000"), (("button", _A), ("sounds[1].sound", _B))),
    (13, (_ID, "0161", "00", "41"), (("font", _A), ("name", "'a'"), ("codes[0]", "65"))),
    (62, (_ID, "0161", "0001", "4100"), (("font", _A), ("language", "1"))),
    (74, (_ID, "48", "00000000", "0000803F", "00"), (_IS_ID, ("gridFit", "1"), ("sharpness", "'1.0'"))),
    (78, (_ID, "00"), (_IS_ID, ("grid.yMax", "0"))),
    (91, (_ID, "04", "6100"), (_IS_ID, ("flags", "4"), ("name", "'a'"))),
    (20, (_ID, "03", _AT, "0100", "02"), (_IS_ID, ("width", _B), ("colours", "3"))),
    (36, (_ID, "05", "0100", _AT, "00"), (_IS_ID, ("height", _B), ("format", "5"))),
    (21, (_ID, "FFD8FFD9"), (_IS_ID, ("offset", "2"), ("length", "4"))),
    (35, (_ID, "02000000", "0102"), (_IS_ID, ("alphaOffset", "2"), ("length", "2"))),
    (39, (_ID, _AT), (_IS_ID, ("frames", _B))),
    (89, ("6100", "00"), (("className", "'a'"), ("info.stop", "'false'"))),
    (46, (_ID, "00" * 14), (_IS_ID, ("bounds2.xMin", "0"))),
    (73, (_ID, "40"), (("font", _A), ("hint", "1"))),
    (19, ("AABB",), (("offset", "0"), ("length", "2"))),
    (93, ("0000", "11" * 32), (("passwordHash", f"'{'11' * 32}'"),)),
)


def _want(k: int) -> str:
    cases = " ".join(f"WHEN {n} THEN CAST({values[k][1]} AS VARCHAR)" for n, (_, _, values) in enumerate(_TEMPLATES) if k < len(values))
    return f"CASE event_id % {len(_TEMPLATES)} {cases} END"


@query(f"SELECT event_id, CASE event_id % {len(_TEMPLATES)} {' '.join(f'WHEN {n} THEN {c}' for n, (c, _, _) in enumerate(_TEMPLATES))} END AS code, {_want(0)} AS first, {_want(1)} AS second, {_want(2)} AS third FROM events")
def tag_fields(t: Tables) -> DataFrame:
    """Fields of tag bodies of every family, event by event."""
    which = F.col("event_id") % len(_TEMPLATES)
    code = body = None
    read = [None, None, None]
    for n, (own, parts, values) in enumerate(_TEMPLATES):
        hex_ = F.concat(*[F.lit(p) if isinstance(p, str) else _le(F.expr(p[0]), p[1]) for p in parts])
        code = F.lit(own) if code is None else F.when(which == n, own).otherwise(code)
        body = hex_ if body is None else F.when(which == n, hex_).otherwise(body)
        for k in range(3):
            got = F.get_json_object("fields", f"$.{values[k][0]}") if k < len(values) else F.lit(None).cast("string")
            read[k] = got if read[k] is None else F.when(which == n, got).otherwise(read[k])
    tags = t.events.select("event_id", code.alias("code"), F.unhex(body).alias("body"), F.lit(6).alias("version"))
    return tagdata.decoded(tags).select("event_id", "code", *[r.alias(name) for r, name in zip(read, ("first", "second", "third"), strict=True)])
