"""Constant folding over dynamic literals, as expressions over a tagged struct.

A literal is a struct (type, num, str): type 'number', 'integer', 'string', 'boolean', 'null' or 'undefined'; a boolean
keeps its value in num. Any other type (a register, an object) is known by name only. A null struct means that nothing
can be proved, and stays null through every operation. Left operands come first; the right one is on top of the stack.

What folds: null counts as 0 and undefined as NaN; a text counts as the number it spells, blank text as 0 and any other
as NaN. A number's text is not provable, so no operation makes one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LITERAL = "struct<type:string,num:double,str:string>"
#: Characters that do not count at either end of a number's text.
_BLANK = "[\\x09-\\x0D\\x20\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def literal(kind: str, num: float | None = None, text: str | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(num).cast("double").alias("num"), F.lit(text).cast("string").alias("str"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _numbers(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """`body` of two literals' numbers; null if one is not known."""
    pair = F.struct(to_number(a).alias("x"), to_number(b).alias("y"))
    return bound(pair, lambda p: F.when(p["x"].isNotNull() & p["y"].isNotNull(), body(p["x"], p["y"])))


def number(x: Column) -> Column:
    return F.struct(F.lit("number").alias("type"), x.cast("double").alias("num"), F.lit(None).cast("string").alias("str"))


def string(x: Column) -> Column:
    return F.struct(F.lit("string").alias("type"), F.lit(None).cast("double").alias("num"), x.alias("str"))


def truth(x: Column, version: int = 7) -> Column:
    """A comparison's result: a boolean, or 1 and 0 before version 5."""
    return F.struct(F.lit("boolean" if version >= 5 else "number").alias("type"), F.when(x, 1.0).otherwise(0.0).alias("num"), F.lit(None).cast("string").alias("str"))


def spelled(text: Column) -> Column:
    """The number that a text spells: decimal with or without exponent, hexadecimal, octal, binary, infinity; else NaN."""

    def read(t: Column) -> Column:
        out = F.when(t == "", F.lit(0.0)).when(t.rlike(_DECIMAL), F.regexp_replace(t, r"^\+", "").try_cast("double"))
        out = out.when(t.isin("Infinity", "+Infinity"), F.lit(float("inf"))).when(t == "-Infinity", F.lit(float("-inf")))
        base = F.when(t.rlike("^0[xX][0-9a-fA-F]+$"), 16.0).when(t.rlike("^0[oO][0-7]+$"), 8.0).when(t.rlike("^0[bB][01]+$"), 2.0)
        digits = F.split(F.lower(F.substring(t, 3, 1 << 20)), "")
        value = bound(base, lambda k: F.aggregate(digits, F.lit(0.0), lambda s, d: s * k + F.instr(F.lit("0123456789abcdef"), d) - 1))
        return out.when(base.isNotNull(), value).otherwise(F.lit(float("nan")))

    return bound(F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", ""), read)


class Valued:
    """A literal whose number, text and truth are columns already (see `valued`); stands for it in any operation."""

    def __init__(self, column: Column):
        self.column = column

    def __getitem__(self, name: str) -> Column:
        return self.column[name]


def valued(v: Column) -> Column:
    """A literal with its `number`, `text` and `truth`, for use below a join or in a stored table: operations then share them."""
    return F.struct(v["type"].alias("type"), v["num"].alias("num"), v["str"].alias("str"), to_number(v).alias("number"), to_text(v).alias("text"), truthy(v).alias("truth"))


def to_number(v: Column | Valued) -> Column:
    """Numeric value; null where nothing can be said."""
    if isinstance(v, Valued):
        return v["number"]
    kind = v["type"]
    out = F.when(kind.isin("number", "integer", "boolean"), v["num"]).when(kind == "null", F.lit(0.0))
    return out.when(kind == "undefined", F.lit(float("nan"))).when(kind == "string", spelled(v["str"]))


def to_text(v: Column | Valued) -> Column:
    """Text of a literal; a number's is not provable."""
    if isinstance(v, Valued):
        return v["text"]
    kind = v["type"]
    out = F.when(kind == "string", v["str"]).when(kind == "boolean", F.when(v["num"] != 0, "true").otherwise("false"))
    return out.when(kind.isin("null", "undefined"), kind)


def truthy(v: Column | Valued) -> Column:
    """Truth of a literal: numbers other than 0 and NaN, texts that are not empty."""
    if isinstance(v, Valued):
        return v["truth"]
    kind = v["type"]
    out = F.when(kind.isin("number", "integer", "boolean"), (v["num"] != 0) & ~F.isnan(v["num"]))
    return out.when(kind == "string", v["str"] != "").when(kind.isin("null", "undefined"), F.lit(False))


def _is_text(a: Column, b: Column) -> Column:
    return (a["type"] == "string") & (b["type"] == "string")


def _nothing(v: Column) -> Column:
    return v["type"].isin("null", "undefined")


def add(a: Column, b: Column, *, either: bool) -> Column:
    """Addition: text if the left side (with `either`: either side) is a string, else numeric."""
    is_text = (a["type"] == "string") | (b["type"] == "string") if either else a["type"] == "string"
    return F.when(is_text, concat_text(a, b)).otherwise(_numbers(a, b, lambda x, y: number(x + y)))


def concat_text(a: Column, b: Column) -> Column:
    """Forced concatenation."""
    both = F.concat(to_text(a), to_text(b))
    return F.when(both.isNotNull(), string(both))


def _over(x: Column, y: Column) -> Column:
    """Division by IEEE rules, signed zeros included."""
    below = (x < 0) != y.cast("string").startswith("-")
    zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(below, -F.lit(float("inf"))).otherwise(F.lit(float("inf")))
    return F.when(y == 0, zero).otherwise(F.try_divide(x, y))


def arithmetic(op: str, a: Column, b: Column, version: int = 7) -> Column:
    """Subtraction, multiplication, division (a text before version 5 if by zero), and the remainder of the top by the other."""
    rules = {"-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": _over, "%": lambda x, y: F.when(x == 0, F.lit(float("nan"))).otherwise(F.try_mod(y, x))}
    rule = rules[op]
    if op == "/" and version < 5:
        return _numbers(a, b, lambda x, y: F.when(y == 0, string(F.lit("#ERROR#"))).otherwise(number(_over(x, y))))
    return _numbers(a, b, lambda x, y: number(rule(x, y)))


def int32(x: Column) -> Column:
    """Wraps a number to a signed 32-bit one; NaN and infinities give 0."""
    rest = F.try_mod(F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x), F.lit(4294967296.0)).cast("long")
    return bound(F.pmod(rest, F.lit(4294967296).cast("long")), lambda low: F.when(low >= 2147483648, low - 4294967296).otherwise(low).cast("int"))


def bits(op: str, a: Column, b: Column) -> Column:
    """Bitwise and, or, xor and shifts over 32-bit numbers; shift counts are taken modulo 32, '>>>' is unsigned."""
    rules = {
        "&": lambda x, y, n: x.bitwiseAND(y),
        "|": lambda x, y, n: x.bitwiseOR(y),
        "^": lambda x, y, n: x.bitwiseXOR(y),
        "<<": lambda x, y, n: F.call_function("shiftleft", x, n),
        ">>": lambda x, y, n: F.call_function("shiftright", x, n),
        ">>>": lambda x, y, n: F.call_function("shiftrightunsigned", x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), n),
    }
    rule = rules[op]
    return _numbers(a, b, lambda x, y: bound(F.struct(int32(x).alias("x"), int32(y).alias("y")), lambda p: number(rule(p["x"], p["y"], p["y"].bitwiseAND(31)))))


def _units(text: Column) -> Column:
    """The text's 16-bit units, as bytes that sort like them."""
    return F.encode(text, "UTF-16BE")


def less(a: Column, b: Column, version: int = 7, *, greater: bool = False) -> Column:
    """a < b (with `greater`: a > b): by 16-bit units if both are strings, else numeric; NaN is neither."""
    if greater:
        a, b = b, a
    numeric = _numbers(a, b, lambda x, y: truth((x < y) & ~F.isnan(x) & ~F.isnan(y), version))
    return F.when(_is_text(a, b), truth(_units(a["str"]) < _units(b["str"]), version)).otherwise(numeric)


def equals(a: Column, b: Column, version: int = 7) -> Column:
    """Numeric equality; NaN proves nothing."""
    return _numbers(a, b, lambda x, y: F.when(~F.isnan(x) & ~F.isnan(y), truth(x == y, version)))


def loose_equals(a: Column, b: Column, version: int = 7) -> Column:
    """Equality across types: texts by content, null and undefined equal each other, all else by number."""
    out = F.when(_is_text(a, b), truth(a["str"] == b["str"], version))
    return out.when(_nothing(a) & _nothing(b), truth(F.lit(True), version)).otherwise(equals(a, b, version))


def strict_equals(a: Column, b: Column, version: int = 7) -> Column:
    """Equality within a type; different types and NaN prove nothing."""
    numbers = a["type"].isin("number", "integer") & b["type"].isin("number", "integer")
    out = F.when(numbers, F.when(~F.isnan(a["num"]) & ~F.isnan(b["num"]), truth(a["num"] == b["num"], version)))
    out = out.when((a["type"] == "boolean") & (b["type"] == "boolean"), truth(a["num"] == b["num"], version))
    out = out.when(_is_text(a, b), truth(a["str"] == b["str"], version))
    return out.when(_nothing(a) & (a["type"] == b["type"]), truth(F.lit(True), version))


def logic(op: str, a: Column, b: Column, version: int = 7) -> Column:
    """And or or on truth; both sides must be known."""
    x, y = truthy(a), truthy(b)
    return F.when(x.isNotNull() & y.isNotNull(), truth((x & y) if op == "and" else (x | y), version))


def compare_text(op: str, a: Column, b: Column, version: int = 7) -> Column:
    """Comparison of two strings: 'eq', 'lt' or 'gt'; order is provable for printable ASCII only."""
    x, y = a["str"], b["str"]
    known = _is_text(a, b)
    if op != "eq":
        known = known & x.rlike("^[ -~]*$") & y.rlike("^[ -~]*$")
    return F.when(known, truth({"eq": x == y, "lt": x < y, "gt": x > y}[op], version))


def _code_units(text: Column) -> Column:
    """The text's first two 16-bit units as an array (fewer if it is shorter)."""
    pairs = F.split(F.substring(F.hex(_units(F.substring(text, 1, 2))), 1, 8), "(?<=\\G.{4})(?=.)")
    return F.transform(F.filter(pairs, lambda p: p != ""), lambda p: F.conv(p, 16, 10).cast("int"))


def _length(text: Column) -> Column:
    return (F.octet_length(_units(text)) / 2).cast("double")


def _char(code: Column) -> Column:
    """The character of a 16-bit unit; halves of surrogate pairs are no characters of their own, so null."""
    return F.when((code < 0xD800) | (code > 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE"))


def unary(op: str, v: Column, version: int = 7) -> Column:
    """Not, whole part, number, text, type name, lengths, first character's code, character of a code, one more, one less.

    'length' needs printable ASCII; lengths count 16-bit units. 'mbord' and 'mbchr' take two units as one code.
    """
    text, kind = v["str"], v["type"]
    is_text = kind == "string"
    numeric = {
        "number": lambda n: number(n),
        "int": lambda n: number(F.when(F.isnan(n) | (F.abs(n) >= 2.0**53), n).otherwise(n - F.try_mod(n, F.lit(1.0)))),
        "increment": lambda n: number(n + 1),
        "decrement": lambda n: number(n - 1),
    }
    if op in numeric:
        rule = numeric[op]
        return bound(to_number(v), lambda n: F.when(n.isNotNull(), rule(n)))
    if op in ("chr", "mbchr"):
        code = bound(to_number(v), lambda n: F.when((n == F.floor(n)) & (n >= 0) & (n < 0x1000000), n.cast("long")))
        if op == "chr":
            return bound(code, lambda c: F.when((c < 0x10000) & ((c < 0xD800) | (c > 0xDFFF)), string(_char(c))))
        high, low = (lambda c: F.shiftright(c, 8).bitwiseAND(0xFF)), (lambda c: c.bitwiseAND(0xFF))
        return bound(code, lambda c: F.when(c.isNotNull(), string(F.when(c >= 256, F.concat(_char(high(c)), _char(low(c)))).otherwise(_char(low(c))))))
    if op == "not":
        t = truthy(v)
        return F.when(t.isNotNull(), truth(~t, version))
    if op == "text":
        return F.when(to_text(v).isNotNull(), string(to_text(v)))
    if op == "typeof":
        name = F.when(kind == "integer", "number").when(kind.isin("number", "boolean", "string", "null", "undefined", "object"), kind)
        return F.when(name.isNotNull(), string(name))
    if op == "length":
        return F.when(is_text & text.rlike("^[ -~]*$"), number(_length(text)))
    if op == "mblength":
        return F.when(is_text, number(_length(text)))
    if op == "ord":
        return F.when(is_text & (text != ""), number(F.get(_code_units(text), 0)))
    if op == "mbord":
        return F.when(is_text & (_length(text) >= 2), bound(_code_units(text), lambda u: number(F.shiftleft(F.get(u, 0), 8).bitwiseOR(F.get(u, 1)))))
    raise ValueError(op)
