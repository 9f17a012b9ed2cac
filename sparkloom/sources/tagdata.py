"""Decoders for tag bodies: each gives a dictionary of fields in the format's own order.

A decoder reads what is there; a body that ends early gives the fields read so far and the problem "cut off".
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.sources import tagcodes
from sparkloom.sources.bits import PastEnd, Reader

Fields = dict
DECODERS: dict[int, Callable[[Reader, Fields, int], None]] = {}

#: Names of blend modes, filters and clip events by their number. Fixed values.
BLENDS = ("normal", "normal", "layer", "multiply", "screen", "lighten", "darken", "difference", "add", "subtract", "invert", "alpha", "erase", "overlay", "hardlight")
FILTERS = ("DropShadow", "Blur", "Glow", "Bevel", "GradientGlow", "Convolution", "ColorMatrix", "GradientBevel")
CLIP_EVENTS = (
    "load", "enterFrame", "unload", "mouseMove", "mouseDown", "mouseUp", "keyDown", "keyUp", "data", "initialize", "press", "release", "releaseOutside",
    "rollOver", "rollOut", "dragOver", "dragOut", "keyPress", "construct",
)
#: Sound formats and sample rates by their number. Fixed values.
SOUND_FORMATS = {0: "pcm", 1: "adpcm", 2: "mp3", 3: "pcm-le", 4: "nellymoser16", 5: "nellymoser8", 6: "nellymoser", 11: "speex"}
RATES = (5512, 11025, 22050, 44100)


def decodes(*codes: int) -> Callable:
    def register(function: Callable[[Reader, Fields, int], None]) -> Callable:
        for code in codes:
            DECODERS[code] = function
        return function

    return register


# Placement


@decodes(4)
def _place(r: Reader, f: Fields, code: int) -> None:
    f["character"], f["depth"], f["matrix"] = r.u16(), r.u16(), r.matrix()
    if r.left():
        f["colourTransform"] = r.colour_transform(False)


def _filter(r: Reader) -> dict:
    kind = r.u8()
    out: dict = {"kind": FILTERS[kind] if kind < len(FILTERS) else f"unknown {kind}"}
    if kind in (4, 7):
        n = r.u8()
        out["colours"], out["ratios"] = [r.rgba() for _ in range(n)], [r.u8() for _ in range(n)]
    elif kind in (0, 2):
        out["colour"] = r.rgba()
    elif kind == 3:
        out["highlight"], out["shadow"] = r.rgba(), r.rgba()
    if kind == 1:
        out["blurX"], out["blurY"], out["passes"] = r.fixed(), r.fixed(), r.u8() >> 3
    elif kind == 2:
        out |= {"blurX": r.fixed(), "blurY": r.fixed(), "strength": r.fixed8(), "flags": r.u8()}
    elif kind in (0, 3, 4, 7):
        out |= {"blurX": r.fixed(), "blurY": r.fixed(), "angle": r.fixed(), "distance": r.fixed(), "strength": r.fixed8(), "flags": r.u8()}
    elif kind == 5:
        x, y = r.u8(), r.u8()
        out |= {"columns": x, "rows": y, "divisor": r.f32(), "bias": r.f32(), "matrix": [r.f32() for _ in range(x * y)], "colour": r.rgba(), "flags": r.u8()}
    elif kind == 6:
        out["matrix"] = [r.f32() for _ in range(20)]
    elif kind > 7:
        raise PastEnd
    return out


def _events(r: Reader) -> list[str]:
    bits = r.u16() if r.version < 6 else r.u32()
    return [name for i, name in enumerate(CLIP_EVENTS) if bits >> i & 1]


def _clip_actions(r: Reader) -> dict:
    r.u16()
    out: dict = {"events": _events(r), "records": []}
    while r.left() >= (2 if r.version < 6 else 4):
        events = _events(r)
        if not events:
            break
        size = r.u32()
        start, stop = r.at, min(r.at + size, r.end)
        key = r.u8() if "keyPress" in events else None
        out["records"].append({"events": events, "key": key, "offset": r.at, "length": stop - r.at})
        r.at = stop
        if start + size > r.end:
            raise PastEnd
    return out


@decodes(26, 70)
def _place2(r: Reader, f: Fields, code: int) -> None:
    a = r.u8()
    b = r.u8() if code == 70 else 0
    f["depth"], f["move"] = r.u16(), bool(a & 1)
    if code == 70 and (b & 8 or (b & 16 and a & 2)):
        f["className"] = r.string()
    if a & 2:
        f["character"] = r.u16()
    if a & 4:
        f["matrix"] = r.matrix()
    if a & 8:
        f["colourTransform"] = r.colour_transform(True)
    if a & 16:
        f["ratio"] = r.u16()
    if a & 32:
        f["name"] = r.string()
    if a & 64:
        f["clipDepth"] = r.u16()
    if b & 1:
        f["filters"] = [_filter(r) for _ in range(r.u8())]
    if b & 2:
        mode = r.u8()
        f["blend"] = BLENDS[mode] if mode < len(BLENDS) else "normal"
    if b & 4:
        f["cacheAsBitmap"] = bool(r.u8()) if r.left() else True
    if b & 32:
        f["visible"] = bool(r.u8())
    if b & 64:
        f["background"] = r.rgba()
    if a & 128:
        f["clipActions"] = _clip_actions(r)


@decodes(5)
def _remove(r: Reader, f: Fields, code: int) -> None:
    f["character"], f["depth"] = r.u16(), r.u16()


@decodes(28)
def _remove2(r: Reader, f: Fields, code: int) -> None:
    f["depth"] = r.u16()


# Shapes


def _gradient(r: Reader, alpha: bool, focal: bool, morph: bool) -> dict:
    if morph:
        n = r.u8()
        return {"stops": [{"ratio": [r.u8()], "colour": r.rgba(), "ratio2": r.u8(), "colour2": r.rgba()} for _ in range(n)]}
    head = r.u8()
    stops = [{"ratio": r.u8(), "colour": r.rgba() if alpha else r.rgb()} for _ in range(head & 15)]
    out = {"spread": head >> 6, "interpolation": head >> 4 & 3, "stops": stops}
    if focal:
        out["focal"] = r.fixed8()
    return out


def _fill(r: Reader, alpha: bool, morph: bool = False) -> dict:
    kind = r.u8()
    out: dict = {"type": kind}
    if kind == 0:
        out["colour"] = r.rgba() if alpha or morph else r.rgb()
        if morph:
            out["colour2"] = r.rgba()
    elif kind in (16, 18, 19):
        out["matrix"] = r.matrix()
        if morph:
            out["matrix2"] = r.matrix()
        out["gradient"] = _gradient(r, alpha, kind == 19, morph)
    elif kind in (64, 65, 66, 67):
        out["bitmap"], out["matrix"] = r.u16(), r.matrix()
        if morph:
            out["matrix2"] = r.matrix()
    else:
        raise PastEnd
    return out


def _count(r: Reader, wide: bool) -> int:
    n = r.u8()
    return r.u16() if n == 255 and wide else n


def _line(r: Reader, shape: int, morph: bool) -> dict:
    out: dict = {"width": r.u16()}
    if morph:
        out["width2"] = r.u16()
    if shape < 4:
        out["colour"] = r.rgba() if shape == 3 or morph else r.rgb()
        if morph:
            out["colour2"] = r.rgba()
        return out
    out |= {"startCap": r.ub(2), "join": r.ub(2)}
    filled = r.flag()
    out |= {"noHScale": r.flag(), "noVScale": r.flag(), "pixelHinting": r.flag()}
    r.ub(5)
    out |= {"noClose": r.flag(), "endCap": r.ub(2)}
    if out["join"] == 2:
        out["miter"] = r.u16() / 256
    if filled:
        out["fill"] = _fill(r, True, morph)
    else:
        out["colour"] = r.rgba()
        if morph:
            out["colour2"] = r.rgba()
    return out


def _styles(r: Reader, shape: int, morph: bool = False) -> dict:
    wide = shape >= 2 or morph
    fills = [_fill(r, shape >= 3, morph) for _ in range(_count(r, wide))]
    return {"fills": fills, "lines": [_line(r, shape, morph) for _ in range(_count(r, wide))]}


def _records(r: Reader, shape: int, f: Fields, styled: bool = True) -> None:
    """Shape records with absolute positions: moves, lines and curves, and the styles that hold for them."""
    r.align()
    fill_bits, line_bits = r.ub(4), r.ub(4)
    x = y = 0
    base = {"fill": 0, "line": 0}
    out = f.setdefault("records", [])
    while True:
        if not r.flag():
            flags = r.ub(5)
            if not flags:
                break
            rec: dict = {"kind": "style"}
            if flags & 1:
                n = r.ub(5)
                x, y = r.sb(n), r.sb(n)
                rec |= {"kind": "move", "x": x, "y": y}
            for bit, name, width in ((2, "fill0", fill_bits), (4, "fill1", fill_bits), (8, "line", line_bits)):
                if flags & bit:
                    k = r.ub(width)
                    rec[name] = k + base["line" if name == "line" else "fill"] if k else 0
            if flags & 16 and styled:
                base = {"fill": len(f["styles"]["fills"]), "line": len(f["styles"]["lines"])}
                r.align()
                more = _styles(r, shape)
                f["styles"]["fills"] += more["fills"]
                f["styles"]["lines"] += more["lines"]
                fill_bits, line_bits = r.ub(4), r.ub(4)
            out.append(rec)
        elif r.flag():
            n = r.ub(4) + 2
            if r.flag():
                dx, dy = r.sb(n), r.sb(n)
            elif r.flag():
                dx, dy = 0, r.sb(n)
            else:
                dx, dy = r.sb(n), 0
            x, y = x + dx, y + dy
            out.append({"kind": "line", "x": x, "y": y})
        else:
            n = r.ub(4) + 2
            cx, cy = x + r.sb(n), y + r.sb(n)
            x, y = cx + r.sb(n), cy + r.sb(n)
            out.append({"kind": "curve", "cx": cx, "cy": cy, "x": x, "y": y})
    r.align()


@decodes(2, 22, 32, 83)
def _shape(r: Reader, f: Fields, code: int) -> None:
    shape = {2: 1, 22: 2, 32: 3, 83: 4}[code]
    f["character"], f["bounds"] = r.u16(), r.rect()
    if shape == 4:
        f["edgeBounds"] = r.rect()
        flags = r.u8()
        f |= {"winding": bool(flags & 4), "nonScaling": bool(flags & 2), "scaling": bool(flags & 1)}
    f["styles"] = _styles(r, shape)
    _records(r, shape, f)


@decodes(46, 84)
def _morph(r: Reader, f: Fields, code: int) -> None:
    f["character"], f["bounds"], f["bounds2"] = r.u16(), r.rect(), r.rect()
    if code == 84:
        f["edgeBounds"], f["edgeBounds2"], f["flags"] = r.rect(), r.rect(), r.u8()
    size = r.u32()
    second = r.at + size
    f["styles"] = _styles(r, 4 if code == 84 else 3, True)
    _records(r, 3, f, False)
    if size:
        r.at, r.bit = min(second, r.end), 0
    end: dict = {}
    _records(r, 3, end, False)
    f["endRecords"] = end["records"]


# Pictures, fonts, text


@decodes(6, 20, 21, 35, 36, 90)
def _bits(r: Reader, f: Fields, code: int) -> None:
    f["character"] = r.u16()
    if code in (20, 36):
        f["format"], f["width"], f["height"] = r.u8(), r.u16(), r.u16()
        if f["format"] == 3:
            f["colours"] = r.u8() + 1
    elif code in (35, 90):
        size = r.u32()
        if code == 90:
            f["deblock"] = r.u16() / 256
        f["alphaOffset"] = size
    f["offset"], f["length"] = r.at, r.left()


@decodes(10)
def _font1(r: Reader, f: Fields, code: int) -> None:
    f["character"] = r.u16()
    at = r.at
    first = r.u16()
    f["offsets"] = [first, *(r.u16() for _ in range(first // 2 - 1))]
    f["glyphs"] = []
    for o in f["offsets"]:
        r.at, r.bit = at + o, 0
        glyph: dict = {}
        _records(r, 1, glyph, False)
        f["glyphs"].append(glyph["records"])


@decodes(48, 75)
def _font2(r: Reader, f: Fields, code: int) -> None:
    f["character"] = r.u16()
    flags, f["language"] = r.u8(), r.u8()
    f |= {"bold": bool(flags & 1), "italic": bool(flags & 2), "smallText": bool(flags & 32)}
    f["name"] = r.text(r.take(r.u8()).rstrip(b"\0"))
    n = r.u16()
    wide = r.u32 if flags & 8 else r.u16
    at = r.at
    offsets = [wide() for _ in range(n)]
    table = wide() if n or r.left() else 0
    f["glyphs"] = []
    for o in offsets:
        r.at, r.bit = at + o, 0
        glyph: dict = {}
        _records(r, 1, glyph, False)
        f["glyphs"].append(glyph["records"])
    if n:
        r.at, r.bit = at + table, 0
    f["codes"] = [r.u16() if flags & 4 else r.u8() for _ in range(n)]
    if flags & 128:
        f |= {"ascent": r.s16(), "descent": r.s16(), "leading": r.s16()}
        f["advances"] = [r.s16() for _ in range(n)]
        f["glyphBounds"] = [r.rect() for _ in range(n)]
        f["kerning"] = [{"left": r.u16() if flags & 4 else r.u8(), "right": r.u16() if flags & 4 else r.u8(), "adjust": r.s16()} for _ in range(r.u16())]


@decodes(91)
def _font4(r: Reader, f: Fields, code: int) -> None:
    f["character"], f["flags"], f["name"] = r.u16(), r.u8(), r.string()
    f["length"] = r.left()


@decodes(88)
def _font_name(r: Reader, f: Fields, code: int) -> None:
    f["font"], f["name"], f["copyright"] = r.u16(), r.string(), r.string()


@decodes(13, 62)
def _font_info(r: Reader, f: Fields, code: int) -> None:
    f["font"] = r.u16()
    f["name"] = r.text(r.take(r.u8()).rstrip(b"\0"))
    flags = r.u8()
    f["flags"] = flags
    if code == 62:
        f["language"] = r.u8()
    size = 2 if flags & 1 else 1
    f["codes"] = [r.u16() if size == 2 else r.u8() for _ in range(r.left() // size)]


@decodes(73)
def _zones(r: Reader, f: Fields, code: int) -> None:
    f["font"], f["hint"] = r.u16(), r.ub(2)
    f["zones"] = []
    r.align()
    while r.left():
        data = [{"coordinate": r.f16(), "range": r.f16()} for _ in range(r.u8())]
        f["zones"].append({"data": data, "mask": r.u8()})


@decodes(74)
def _csm(r: Reader, f: Fields, code: int) -> None:
    f["character"], f["renderer"], f["gridFit"] = r.u16(), r.ub(2), r.ub(3)
    f["thickness"], f["sharpness"] = r.f32(), r.f32()


@decodes(11, 33)
def _text(r: Reader, f: Fields, code: int) -> None:
    f["character"], f["bounds"], f["matrix"] = r.u16(), r.rect(), r.matrix()
    glyph_bits, advance_bits = r.u8(), r.u8()
    f["runs"] = []
    while r.left() and (flags := r.u8()):
        run: dict = {}
        if flags & 8:
            run["font"] = r.u16()
        if flags & 4:
            run["colour"] = r.rgba() if code == 33 else r.rgb()
        if flags & 1:
            run["x"] = r.s16()
        if flags & 2:
            run["y"] = r.s16()
        if flags & 8:
            run["height"] = r.u16()
        run["glyphs"] = [{"index": r.ub(glyph_bits), "advance": r.sb(advance_bits)} for _ in range(r.u8())]
        r.align()
        f["runs"].append(run)


@decodes(37)
def _edit(r: Reader, f: Fields, code: int) -> None:
    f["character"], f["bounds"] = r.u16(), r.rect()
    a, b = r.u8(), r.u8()
    names = ("hasFont", "hasMaxLength", "hasColour", "readOnly", "password", "multiline", "wordWrap", "hasText")
    bits = {n: bool(a >> i & 1) for i, n in enumerate(names)}
    f |= {n: bits[n] for n in ("readOnly", "password", "multiline", "wordWrap")}
    f |= {"useOutlines": bool(b & 1), "html": bool(b & 2), "border": bool(b & 8), "noSelect": bool(b & 16), "autoSize": bool(b & 64)}
    if bits["hasFont"]:
        f["font"] = r.u16()
    if b & 128:
        f["fontClass"] = r.string()
    if bits["hasFont"] or b & 128:
        f["height"] = r.u16()
    if bits["hasColour"]:
        f["colour"] = r.rgba()
    if bits["hasMaxLength"]:
        f["maxLength"] = r.u16()
    if b & 32:
        f |= {"align": r.u8(), "leftMargin": r.u16(), "rightMargin": r.u16(), "indent": r.u16(), "leading": r.s16()}
    f["variable"] = r.string()
    if bits["hasText"]:
        f["text"] = r.string()


# Buttons, sounds, video


def _button_records(r: Reader, second: bool) -> list[dict]:
    out = []
    while flags := r.u8():
        states = [s for i, s in enumerate(("up", "over", "down", "hitTest")) if flags >> i & 1]
        rec: dict = {"states": states, "character": r.u16(), "depth": r.u16(), "matrix": r.matrix()}
        if second:
            rec["colourTransform"] = r.colour_transform(True)
            if flags & 16:
                rec["filters"] = [_filter(r) for _ in range(r.u8())]
            if flags & 32:
                mode = r.u8()
                rec["blend"] = BLENDS[mode] if mode < len(BLENDS) else "normal"
        out.append(rec)
    return out


@decodes(7)
def _button(r: Reader, f: Fields, code: int) -> None:
    f["character"], f["records"] = r.u16(), _button_records(r, False)
    f["actions"] = {"offset": r.at, "length": r.left()}


@decodes(34)
def _button2(r: Reader, f: Fields, code: int) -> None:
    f["character"], f["trackAsMenu"] = r.u16(), bool(r.u8() & 1)
    at = r.at
    offset = r.u16()
    f["records"] = _button_records(r, True)
    f["conditions"] = []
    if offset:
        r.at = at + offset
        while True:
            start, size, bits = r.at, r.u16(), r.u16()
            stop = start + size if size else r.end
            f["conditions"].append({"transitions": bits & 0x1FF, "key": bits >> 9, "offset": r.at, "length": max(0, min(stop, r.end) - r.at)})
            if not size or stop >= r.end:
                break
            r.at = stop


@decodes(23)
def _button_cxform(r: Reader, f: Fields, code: int) -> None:
    f["button"], f["colourTransform"] = r.u16(), r.colour_transform(False)


def _sound_info(r: Reader) -> dict:
    flags = r.u8()
    out: dict = {"stop": bool(flags & 32), "noMultiple": bool(flags & 16)}
    if flags & 1:
        out["in"] = r.u32()
    if flags & 2:
        out["out"] = r.u32()
    if flags & 4:
        out["loops"] = r.u16()
    if flags & 8:
        out["envelope"] = [{"at": r.u32(), "left": r.u16(), "right": r.u16()} for _ in range(r.u8())]
    return out


@decodes(17)
def _button_sound(r: Reader, f: Fields, code: int) -> None:
    f["button"], f["sounds"] = r.u16(), []
    for _ in range(4):
        own = r.u16()
        f["sounds"].append({"sound": own, "info": _sound_info(r)} if own else None)


@decodes(14)
def _sound(r: Reader, f: Fields, code: int) -> None:
    f["character"] = r.u16()
    flags = r.u8()
    f |= {"format": SOUND_FORMATS.get(flags >> 4, str(flags >> 4)), "rate": RATES[flags >> 2 & 3], "bits": 16 if flags & 2 else 8, "channels": 1 + (flags & 1), "samples": r.u32()}
    if flags >> 4 == 2:
        f["seek"] = r.s16()
    f["offset"], f["length"] = r.at, r.left()


@decodes(15, 89)
def _start_sound(r: Reader, f: Fields, code: int) -> None:
    if code == 15:
        f["sound"] = r.u16()
    else:
        f["className"] = r.string()
    f["info"] = _sound_info(r)


@decodes(18, 45)
def _stream_head(r: Reader, f: Fields, code: int) -> None:
    a, b = r.u8(), r.u8()
    f |= {"playbackRate": RATES[a >> 2 & 3], "format": SOUND_FORMATS.get(b >> 4, str(b >> 4)), "rate": RATES[b >> 2 & 3], "bits": 16 if b & 2 else 8, "channels": 1 + (b & 1), "samples": r.u16()}
    if b >> 4 == 2 and r.left() >= 2:
        f["latency"] = r.s16()


@decodes(19)
def _stream_block(r: Reader, f: Fields, code: int) -> None:
    f["offset"], f["length"] = r.at, r.left()


@decodes(60)
def _video(r: Reader, f: Fields, code: int) -> None:
    f["character"], f["frames"], f["width"], f["height"] = r.u16(), r.u16(), r.u16(), r.u16()
    flags = r.u8()
    f |= {"deblocking": flags >> 1 & 7, "smoothing": bool(flags & 1), "codec": r.u8()}


@decodes(61)
def _video_frame(r: Reader, f: Fields, code: int) -> None:
    f["stream"], f["frame"] = r.u16(), r.u16()
    f["length"] = r.left()


# Control


@decodes(9)
def _background(r: Reader, f: Fields, code: int) -> None:
    f["colour"] = r.rgb()


@decodes(43)
def _label(r: Reader, f: Fields, code: int) -> None:
    f["name"] = r.string()
    if r.left():
        f["anchor"] = bool(r.u8())


@decodes(69)
def _attributes(r: Reader, f: Fields, code: int) -> None:
    bits = r.u32()
    f |= {"useNetwork": bool(bits & 1), "actionScript3": bool(bits & 8), "hasMetadata": bool(bits & 16), "useGpu": bool(bits & 32), "useDirectBlit": bool(bits & 64)}


def _names(r: Reader) -> list[dict]:
    return [{"character": r.u16(), "name": r.string()} for _ in range(r.u16())]


@decodes(56, 76)
def _exports(r: Reader, f: Fields, code: int) -> None:
    f["symbols"] = _names(r)


@decodes(57, 71)
def _imports(r: Reader, f: Fields, code: int) -> None:
    f["url"] = r.string()
    if code == 71:
        r.u16()
    f["symbols"] = _names(r)


@decodes(77)
def _metadata(r: Reader, f: Fields, code: int) -> None:
    f["text"] = r.string()


@decodes(65)
def _limits(r: Reader, f: Fields, code: int) -> None:
    f["recursion"], f["timeout"] = r.u16(), r.u16()


@decodes(66)
def _tab(r: Reader, f: Fields, code: int) -> None:
    f["depth"], f["tabIndex"] = r.u16(), r.u16()


@decodes(78)
def _grid(r: Reader, f: Fields, code: int) -> None:
    f["character"], f["grid"] = r.u16(), r.rect()


@decodes(86)
def _scenes(r: Reader, f: Fields, code: int) -> None:
    f["scenes"] = [{"offset": r.encoded_u32(), "name": r.string()} for _ in range(r.encoded_u32())]
    f["labels"] = [{"frame": r.encoded_u32(), "name": r.string()} for _ in range(r.encoded_u32())]


@decodes(12)
def _action(r: Reader, f: Fields, code: int) -> None:
    f["offset"], f["length"] = r.at, r.left()


@decodes(59)
def _init_action(r: Reader, f: Fields, code: int) -> None:
    f["sprite"] = r.u16()
    f["offset"], f["length"] = r.at, r.left()


@decodes(24, 58, 64)
def _protect(r: Reader, f: Fields, code: int) -> None:
    if code == 64:
        r.u16()
    if r.left():
        f["password"] = r.string()


@decodes(93)
def _telemetry(r: Reader, f: Fields, code: int) -> None:
    r.u16()
    f["passwordHash"] = r.take(32).hex() if r.left() >= 32 else None


@decodes(87)
def _binary(r: Reader, f: Fields, code: int) -> None:
    f["character"] = r.u16()
    r.u32()
    f["offset"], f["length"] = r.at, r.left()


@decodes(39)
def _sprite(r: Reader, f: Fields, code: int) -> None:
    f["character"], f["frames"] = r.u16(), r.u16()


def decode(code: int, body: bytes, version: int = 6) -> tuple[Fields, list[str]]:
    """Fields of a tag body, and what was wrong. Never raises on any bytes."""
    fields: Fields = {}
    function = DECODERS.get(code)
    if function is None:
        return fields, []
    r = Reader(body, version=version or 6)
    try:
        function(r, fields, code)
    except (PastEnd, IndexError, ValueError, OverflowError, MemoryError):
        r.notes.append("cut off")
    return fields, r.notes


def _plain(value):
    """JSON has no NaN or infinity."""
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def decoded(tags: DataFrame) -> DataFrame:
    """Tag rows with `name`, `fields` (JSON) and `problems`, in place of the bytes."""
    names = [c for c in tags.columns if c != "body"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tags.schema if f.name != "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, text, problems = [], [], []
            for code, body, version in zip(batch.column("code").to_pylist(), batch.column("body").to_pylist(), batch.column("version").to_pylist(), strict=True):
                fields, notes = decode(code, body or b"", version)
                name.append(tagcodes.NAMES.get(code))
                text.append(json.dumps(_plain(fields), separators=(",", ":"), ensure_ascii=False))
                problems.append(notes)
            more = [pa.array(name, pa.string()), pa.array(text, pa.string()), pa.array(problems, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], names=[*names, "name", "fields", "problems"])

    return tags.mapInArrow(run, f"{schema}, name string, fields string, problems array<string>")
