"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

Every rule is a SQL predicate that says when a document is rejected. On a bounded random sample each rule's cost (run time
beyond an empty scan, the least of several runs) and selectivity (share rejected) are estimated; rules then run in
descending order of rejection per cost inside one CASE, whose branches are evaluated only until one rejects. The order
never changes a verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 4_011
_SPACE = r"[\\x20\\x09-\\x0D]"
_WORD_CHAR = r"[^\\x20\\x09-\\x0D]"


def _let(value: str, name: str, body: str) -> str:
    """`body` with `name` bound to `value`, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeated_words() -> str:
    """SQL for the number of words in 5-word windows found twice or more, from the column `words`.

    Windows are compared by 64-bit hashes. Only a text with a repeated hash goes on to sort its windows; the words
    covered follow from the gaps between repeated windows.
    """
    grams = "slice(transform(hashes, (x, i) -> xxhash64(x, get(hashes, i + 1), get(hashes, i + 2), get(hashes, i + 3), get(hashes, i + 4))), 1, greatest(size(hashes) - 4, 0))"
    pairs = "array_sort(transform(grams, (x, i) -> struct(x AS h, i AS i)))"
    # A window is repeated if a neighbour in hash order has its hash.
    marked = (
        "zip_with(zip_with(pairs, slice(pairs, 2, size(pairs)), (a, b) -> struct(a.h AS h, a.i AS i, coalesce(a.h = b.h, false) AS up)), "
        "concat(array(CAST(NULL AS struct<h: bigint, i: int>)), slice(pairs, 1, size(pairs) - 1)), "
        "(a, b) -> IF(a.up OR coalesce(a.h = b.h, false), a.i, NULL))"
    )
    gaps = "aggregate(zip_with(at, slice(at, 2, size(at)), (a, b) -> coalesce(least(b - a, 5), 5)), 0L, (t, x) -> t + x)"
    places = _let(f"array_sort(filter({marked}, x -> x IS NOT NULL))", "at", gaps)
    count = f"IF(size(array_distinct(grams)) = size(grams), 0L, {_let(pairs, 'pairs', places)})"
    return _let("transform(words, w -> xxhash64(w))", "hashes", _let(grams, "grams", count))


_WORDS = f"filter(split(body, '{_SPACE}+'), w -> w <> '')"
_LINES = rf"filter(split(body, '\\n'), l -> l rlike '{_WORD_CHAR}')"

#: Features by name, as SQL over `body` (the text, empty for null), `words` and features listed above them.
FEATURES = {
    "n_words": "CAST(size(words) AS bigint)",
    "word_chars": "aggregate(words, 0L, (t, w) -> t + length(w))",
    "n_symbols": "CAST(regexp_count(body, '[#*$%&|<>]') AS bigint)",
    "n_lines": "CAST(size(lines) AS bigint)",
    "n_dup_lines": "CAST(size(lines) - size(array_distinct(lines)) AS bigint)",
    "n_repeat_words": _repeated_words(),
    "n_letters": r"CAST(length(body) - length(regexp_replace(body, '\\p{L}+', '')) AS bigint)",
}


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `reject` holds; `reject` is SQL over features, written as {name}."""

    name: str
    reject: str

    def sql(self) -> str:
        """The predicate over `body` and `words`; lines are cut only where the rule is reached and looks at them."""
        text = self.reject.format(**{k: f"({v})" for k, v in FEATURES.items()})
        return _let(_LINES, "lines", text) if "lines" in text else text


#: Base rules, which any order of the cascade includes.
BASE = (
    Rule("few_words", "{n_words} < 10"),
    Rule("repeated_words", "100 * {n_repeat_words} > 20 * {n_words}"),
)
#: Further rules. Their bounds lie far from ordinary prose in any language that puts blanks between words.
RULES = (
    *BASE,
    Rule("symbols", "100 * {n_symbols} > 25 * {n_words}"),
    Rule("repeated_lines", "100 * {n_dup_lines} > 30 * {n_lines}"),
    Rule("word_length", "{word_chars} < 2 * {n_words} OR {word_chars} > 20 * {n_words}"),
    Rule("letters", "100 * {n_letters} < 50 * {word_chars}"),
)


def prepared(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `body` (the text, empty for null), `words` and `lines` (those with a word), on which features are defined."""
    docs = docs.withColumn("body", F.coalesce(F.col(text_col), F.lit("")))
    return docs.withColumn("words", F.expr(_WORDS)).withColumn("lines", F.expr(_LINES))


def _sample(docs: DataFrame, text_col: str, rows: int, chars: int) -> list:
    """About `rows` random rows of the whole table, and `chars` characters of each at most."""
    total = docs.count()
    if total > 2 * rows:
        docs = docs.sample(fraction=1.2 * rows / total, seed=SEED)
    return docs.select(F.substring(F.col(text_col), 1, chars).alias("text")).limit(2 * rows).collect()


def rank_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", sample_rows: int = 300, sample_chars: int = 20_000, runs: int = 3) -> tuple[Rule, ...]:
    """Orders rules by estimated rejection per cost, on some `sample_rows` random rows and `sample_chars` characters of each.

    The sample decides on the order alone, never on a verdict. A rule's cost is the least time of `runs` runs, beyond that
    of a rule that does nothing. A rule that rejects nothing in the sample counts as rejecting one row in a thousand
    samples, so that cheap ones come before costly ones. An empty table keeps the given order.
    """
    spark = docs.sparkSession
    some = _sample(docs, text_col, sample_rows, sample_chars)
    n = len(some)
    if not n:
        return rules
    sample = spark.createDataFrame(some, "text string").coalesce(1)

    def timed(rule: Rule) -> tuple[float, int]:
        spent, hits = [], 0
        job = sample.agg(F.count(rejected_by((rule,), "text")))
        for _ in range(runs):
            began = time.perf_counter()
            hits = job.first()[0]
            spent.append(time.perf_counter() - began)
        return min(spent), hits

    empty, _ = timed(Rule("idle", "size(words) < 0"))
    score = {}
    for rule in rules:
        spent, hits = timed(rule)
        score[rule.name] = max(hits, 1e-3) / n / max(spent - empty, 1e-3)
    return tuple(sorted(rules, key=lambda r: -score[r.name]))


def rejected_by(rules: tuple[Rule, ...], text_col: str = "text") -> Column:
    """Name of the first rule, in the given order, that rejects the row; null if none does.

    One expression over the text, with its words bound inside: a filter on it can move freely without being evaluated
    more than once.
    """
    if not rules:
        return F.lit(None).cast("string")
    case = "CASE " + " ".join(f"WHEN {r.sql()} THEN '{r.name}' " for r in rules) + "END"
    body = "coalesce(`" + text_col.replace("`", "``") + "`, '')"
    return F.expr(_let(body, "body", _let(_WORDS, "words", case)))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that no rule rejects, with their columns.

    Defined results: a null or blank text has no words and is rejected as too short; repeated rows are judged alike;
    columns other than the text pass through, whatever their names; an empty table stays empty.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*inner)
    text = inner[[n.lower() for n in names].index(text_col.lower())]
    ranked = rank_rules(rows, rules, text_col=text)
    return rows.where(rejected_by(ranked, text).isNull()).toDF(*names)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `doc_id`, `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`, `base_failed`, `kept`,
    `rejected_by` (the cascade's first rule that rejects the row, or null) and `n_rules` (rules evaluated until then).

    The verdict is the cascade's, over the text, whose branches end at the first rule that rejects; `base_failed` is a
    column of the report, and as the cascade holds the base rules, whatever fails them is rejected by it, too. Features
    are counted over whole texts; a null text counts as empty (no words, so rejected).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ranked = rank_rules(rows, (*[r for r in BASE if r not in rules], *rules))
    known = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    body, made = "coalesce(text, '')", ", ".join(f"{FEATURES[k]} AS {k}" for k in known)
    out = rows.select("doc_id", F.expr(_let(body, "body", _let(_WORDS, "words", _let(_LINES, "lines", f"struct({made})")))).alias("f"), rejected_by(ranked, "text").alias("rejected_by"))
    failed = F.expr(" OR ".join(f"({r.reject.format(**{k: f'f.{k}' for k in known})})" for r in BASE))
    places = F.array(*[F.lit(r.name) for r in ranked])
    evaluated = F.coalesce(F.array_position(places, F.col("rejected_by")), F.lit(len(ranked))).cast("int")
    return out.select("doc_id", *[f"f.{k}" for k in known], failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by", evaluated.alias("n_rules"))
