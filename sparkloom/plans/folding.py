"""Literal folding: every rule over every pair of literal kinds.

The oracle states what each literal is worth as a number, a text and a truth, and each rule over those; results are shown
as 'n:' and thousandths (or 'big'), 'b:' and truth, or 's:' and text, and are null where nothing folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import folding as fold
from sparkloom.plans.registry import Tables, query

#: Literals: name, type, number, text; then what each is worth as a number, as a text and as a truth.
_LITERALS = (
    ("empty", "string", None, "", 0.0, "", False),
    ("numeric", "string", None, "2.5", 2.5, "2.5", True),
    ("padded", "string", None, " 12 ", 12.0, " 12 ", True),
    ("words", "string", None, "nope", float("nan"), "nope", True),
    ("accent", "string", None, "é", float("nan"), "é", True),
    ("double", "number", 2.5, None, 2.5, None, True),
    ("negative", "number", -7.0, None, -7.0, None, True),
    ("zero", "number", 0.0, None, 0.0, None, False),
    ("large", "number", 4294967299.0, None, 4294967299.0, None, True),
    ("nan", "number", float("nan"), None, float("nan"), None, False),
    ("integer", "integer", 2.0, None, 2.0, None, True),
    ("true", "boolean", 1.0, None, 1.0, "true", True),
    ("false", "boolean", 0.0, None, 0.0, "false", False),
    ("null", "null", None, None, 0.0, "null", False),
    ("undefined", "undefined", None, None, float("nan"), "undefined", False),
    ("register", "register", 3.0, None, None, None, None),
)


def _sql(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    return f"'{x}'" if isinstance(x, str) else f"CAST('{x}' AS DOUBLE)"


_ROWS = ", ".join(f"({', '.join(_sql(v) for v in row)})" for row in _LITERALS)
_L = f"(SELECT n, k, CAST(v AS DOUBLE) AS v, CAST(x AS VARCHAR) AS x, CAST(num AS DOUBLE) AS num, CAST(txt AS VARCHAR) AS txt, CAST(t AS BOOLEAN) AS t FROM (VALUES {_ROWS}) AS l(n, k, v, x, num, txt, t))"


def _n(x: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL WHEN isnan({x}) THEN 'n:nan' WHEN isinf({x}) THEN CASE WHEN ({x}) > 0 THEN 'n:inf' ELSE 'n:-inf' END WHEN abs({x}) >= 1e12 THEN 'n:big' ELSE 'n:' || CAST(round(({x}) * 1000) AS BIGINT) END"


def _b(x: str) -> str:
    return f"CASE WHEN {x} THEN 'b:true' WHEN NOT ({x}) THEN 'b:false' END"


_TEXTS = "a.k = 'string' AND b.k = 'string'"
_NANS = "isnan(a.num) OR isnan(b.num)"
_W = "(CASE WHEN isnan({0}) THEN 0 ELSE ((CAST(trunc({0}) AS HUGEINT) % 4294967296 + 4294967296 + 2147483648) % 4294967296) - 2147483648 END)"
_A, _B = _W.format("a.num"), _W.format("b.num")
_SHIFT = f"(({_B} + 4294967296) % 32)"
_WRAP = "((({0}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"
_ASCII = "regexp_full_match(a.x, '[ -~]*') AND regexp_full_match(b.x, '[ -~]*')"


def _known(sql: str) -> str:
    return f"CASE WHEN a.num IS NOT NULL AND b.num IS NOT NULL THEN {sql} END"


def _whole(sql: str) -> str:
    return _known(f"'n:' || CAST(({sql}) * 1000 AS BIGINT)")


#: Rules by name, as SQL over the two literals.
_RULES = {
    "add": f"CASE WHEN a.k = 'string' THEN 's:' || a.x || b.txt ELSE {_n('a.num + b.num')} END",
    "add2": f"CASE WHEN a.k = 'string' OR b.k = 'string' THEN 's:' || a.txt || b.txt ELSE {_n('a.num + b.num')} END",
    "string_add": "'s:' || a.txt || b.txt",
    "subtract": _n("a.num - b.num"),
    "multiply": _n("a.num * b.num"),
    "divide": _known(f"CASE WHEN b.num = 0 THEN CASE WHEN isnan(a.num) OR a.num = 0 THEN 'n:nan' WHEN a.num > 0 THEN 'n:inf' ELSE 'n:-inf' END ELSE {_n('a.num / nullif(b.num, 0)')} END"),
    "divide4": _known(f"CASE WHEN b.num = 0 THEN 's:#ERROR#' ELSE {_n('a.num / nullif(b.num, 0)')} END"),
    "modulo": _known(f"CASE WHEN a.num = 0 OR {_NANS} THEN 'n:nan' ELSE {_n('b.num - a.num * trunc(b.num / a.num)')} END"),
    "equals": _known(f"CASE WHEN NOT ({_NANS}) THEN {_b('a.num = b.num')} END"),
    "less": f"CASE WHEN {_TEXTS} THEN {_b('a.x < b.x')} ELSE {_known(_b(f'a.num < b.num AND NOT ({_NANS})'))} END",
    "greater": f"CASE WHEN {_TEXTS} THEN {_b('a.x > b.x')} ELSE {_known(_b(f'a.num > b.num AND NOT ({_NANS})'))} END",
    "text_equals": f"CASE WHEN {_TEXTS} THEN {_b('a.x = b.x')} END",
    "text_less": f"CASE WHEN {_TEXTS} AND {_ASCII} THEN {_b('a.x < b.x')} END",
    "text_greater": f"CASE WHEN {_TEXTS} AND {_ASCII} THEN {_b('a.x > b.x')} END",
    "both": f"CASE WHEN a.t IS NOT NULL AND b.t IS NOT NULL THEN {_b('a.t AND b.t')} END",
    "one": f"CASE WHEN a.t IS NOT NULL AND b.t IS NOT NULL THEN {_b('a.t OR b.t')} END",
    "equals2": f"CASE WHEN {_TEXTS} THEN {_b('a.x = b.x')} WHEN a.k IN ('null', 'undefined') AND b.k IN ('null', 'undefined') THEN 'b:true' ELSE {_known(f'CASE WHEN NOT ({_NANS}) THEN {_b("a.num = b.num")} END')} END",
    "strict": f"CASE WHEN a.k IN ('number', 'integer') AND b.k IN ('number', 'integer') THEN CASE WHEN NOT ({_NANS}) THEN {_b('a.num = b.num')} END WHEN a.k <> b.k THEN NULL WHEN a.k = 'boolean' THEN {_b('a.num = b.num')} WHEN a.k = 'string' THEN {_b('a.x = b.x')} WHEN a.k IN ('null', 'undefined') THEN 'b:true' END",
    "bit_and": _whole(f"{_A} & {_B}"),
    "bit_or": _whole(f"{_A} | {_B}"),
    "bit_xor": _whole(f"xor({_A}, {_B})"),
    "shift_left": _whole(_WRAP.format(f"{_A} * CAST(pow(2, {_SHIFT}) AS BIGINT)")),
    "shift_right": _whole(f"CAST(floor({_A} / pow(2, {_SHIFT})) AS BIGINT)"),
    "shift_unsigned": _whole(f"CAST(floor((({_A} + 4294967296) % 4294967296) / pow(2, {_SHIFT})) AS BIGINT)"),
    "less4": f"CASE WHEN {_TEXTS} THEN CASE WHEN a.x < b.x THEN 'n:1000' ELSE 'n:0' END ELSE {_known(f"CASE WHEN a.num < b.num AND NOT ({_NANS}) THEN 'n:1000' ELSE 'n:0' END")} END",
}


def _literals(t: Tables) -> DataFrame:
    lits = t.spark.createDataFrame([row[:4] for row in _LITERALS], "n string, type string, num double, str string")
    return lits.select("n", F.struct("type", "num", "str").alias("v"))


def shown(v: Column) -> Column:
    num = v["num"]
    inf = float("inf")
    plain = F.when(F.isnan(num), "n:nan").when(num == inf, "n:inf").when(num == -inf, "n:-inf").when(F.abs(num) >= 1e12, "n:big").otherwise(F.concat(F.lit("n:"), F.round(num * 1000).cast("long")))
    return F.when(v["type"] == "string", F.concat(F.lit("s:"), v["str"])).when(v["type"] == "boolean", F.when(num != 0, "b:true").otherwise("b:false")).when(v["type"] == "number", plain)


@query(f"SELECT a.n AS a, b.n AS b, {', '.join(f'{sql} AS {name}' for name, sql in _RULES.items())} FROM {_L} a CROSS JOIN {_L} b")
def fold_matrix(t: Tables) -> DataFrame:
    """Binary rules on every pair of literals (a fixed few rows on either side)."""
    lits = _literals(t).withColumn("v", fold.valued(F.col("v")))
    a, b = lits.toDF("a", "l"), lits.toDF("b", "r")
    x, y = fold.Valued(F.col("l")), fold.Valued(F.col("r"))
    rules = {
        "add": fold.add(x, y, either=False), "add2": fold.add(x, y, either=True), "string_add": fold.concat_text(x, y),
        "subtract": fold.arithmetic("-", x, y), "multiply": fold.arithmetic("*", x, y), "divide": fold.arithmetic("/", x, y), "divide4": fold.arithmetic("/", x, y, 4),
        "modulo": fold.arithmetic("%", x, y), "equals": fold.equals(x, y), "less": fold.less(x, y), "greater": fold.less(x, y, greater=True),
        "text_equals": fold.compare_text("eq", x, y), "text_less": fold.compare_text("lt", x, y), "text_greater": fold.compare_text("gt", x, y),
        "both": fold.logic("and", x, y), "one": fold.logic("or", x, y), "equals2": fold.loose_equals(x, y), "strict": fold.strict_equals(x, y),
        "bit_and": fold.bits("&", x, y), "bit_or": fold.bits("|", x, y), "bit_xor": fold.bits("^", x, y),
        "shift_left": fold.bits("<<", x, y), "shift_right": fold.bits(">>", x, y), "shift_unsigned": fold.bits(">>>", x, y), "less4": fold.less(x, y, 4),
    }
    return a.crossJoin(F.broadcast(b)).select("a", "b", *[shown(v).alias(k) for k, v in rules.items()])


#: Unary results that do not follow from the values above: lengths, codes, and characters of codes.
_UNARY_ROWS = """(VALUES ('empty', 's:string', 'n:0', 'n:0', NULL, NULL, 'c:0'), ('numeric', 's:string', 'n:3000', 'n:3000', 'n:50000', 'n:12846000', NULL),
    ('padded', 's:string', 'n:4000', 'n:4000', 'n:32000', 'n:8241000', 'c:12'), ('words', 's:string', 'n:4000', 'n:4000', 'n:110000', 'n:28271000', NULL),
    ('accent', 's:string', NULL, 'n:1000', 'n:233000', NULL, NULL), ('double', 's:number', NULL, NULL, NULL, NULL, NULL), ('negative', 's:number', NULL, NULL, NULL, NULL, NULL),
    ('zero', 's:number', NULL, NULL, NULL, NULL, 'c:0'), ('large', 's:number', NULL, NULL, NULL, NULL, NULL), ('nan', 's:number', NULL, NULL, NULL, NULL, NULL),
    ('integer', 's:number', NULL, NULL, NULL, NULL, 'c:2'), ('true', 's:boolean', NULL, NULL, NULL, NULL, 'c:1'), ('false', 's:boolean', NULL, NULL, NULL, NULL, 'c:0'),
    ('null', 's:null', NULL, NULL, NULL, NULL, 'c:0'), ('undefined', 's:undefined', NULL, NULL, NULL, NULL, NULL), ('register', NULL, NULL, NULL, NULL, NULL, NULL))
    AS u(n, type, size, mbsize, code, mbcode, char)"""


@query(
    f"""SELECT l.n AS n, {_b('NOT l.t')} AS negated, {_n('trunc(l.num)')} AS whole, {_n('l.num')} AS value, 's:' || l.txt AS text, u.type, u.size, u.mbsize, u.code, u.mbcode,
    u.char, u.char AS mbchar, {_n('l.num + 1')} AS more, {_n('l.num - 1')} AS fewer FROM {_L} l JOIN {_UNARY_ROWS} ON u.n = l.n"""
)
def fold_unary(t: Tables) -> DataFrame:
    """Unary rules on every literal; characters are shown by their code."""
    v = F.col("v")
    names = {"negated": "not", "whole": "int", "value": "number", "text": "text", "type": "typeof", "size": "length", "mbsize": "mblength", "code": "ord", "mbcode": "mbord", "more": "increment", "fewer": "decrement"}
    chars = {"char": "chr", "mbchar": "mbchr"}
    return _literals(t).select(
        "n", *[shown(fold.unary(op, v)).alias(name) for name, op in names.items()], *[F.concat(F.lit("c:"), F.ascii(fold.unary(op, v)["str"])).alias(name) for name, op in chars.items()]
    )
