"""Command line: `python -m sparkloom VERB FOLDER [--out FOLDER]` over all containers in a folder.

Verbs: files, tags, notes, frames, display, dump, actions, blocks (basic blocks), characters (with what is live), refusals,
diagnostics (folded notes), queries. Results are shown, or written as Parquet. Exit codes: 0 ok, 1 problems of severity
error, 2 no readable file, 3 content of the newer engine, 4 a limit on warnings exceeded, 5 a bug of this program.
"""

from __future__ import annotations

import argparse
import sys
import traceback

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERBS = ("files", "tags", "notes", "frames", "display", "dump", "actions", "blocks", "characters", "refusals", "diagnostics")


def folded_notes(notes: DataFrame) -> DataFrame:
    """Notes of a file folded by code, context and character: the first one's fields, and how many there are."""
    first = F.min_by(F.struct("message", "offset", "severity"), "seq").alias("first")
    folded = notes.groupBy("path", "code", "context", "character").agg(F.min("seq").alias("seq"), F.count("*").alias("n"), first)
    return folded.select("path", "seq", "code", "first.severity", "n", "first.message", "first.offset", "context", "character")


def table(spark: SparkSession, verb: str, folder: str) -> DataFrame:
    """What a verb shows."""
    from sparkloom.operators import movies
    from sparkloom.plans.reports import engine_verdicts
    from sparkloom.sources import actions, container, tagdata

    files = container.read_files(spark, folder)
    tags = container.tag_table(files)
    return {
        "files": lambda: container.file_table(files),
        "tags": lambda: tags.drop("body"),
        "notes": lambda: container.note_table(files),
        "frames": lambda: movies.frames(tagdata.decoded(tags)),
        "display": lambda: movies.display_list(tagdata.decoded(tags)),
        "dump": lambda: movies.model_dump(tagdata.decoded(tags)),
        "actions": lambda: actions.record_table(movies.action_blocks(tags)),
        "blocks": lambda: actions.block_table(movies.action_blocks(tags)),
        "characters": lambda: movies.live_characters(tagdata.decoded(tags)),
        "refusals": lambda: engine_verdicts(tags),
        "diagnostics": lambda: folded_notes(container.note_table(files)),
    }[verb]()


def exit_codes(spark: SparkSession, folder: str, fail_on: str, max_warnings: int) -> DataFrame:
    """The code that each file of the folder ends with, and the rule that gives it."""
    from sparkloom.plans.reports import exit_decision_of

    severity, n = F.col("severity"), F.col("n")
    notes = table(spark, "diagnostics", folder).groupBy("path").agg(F.count_if(severity == "error").alias("errors"), F.coalesce(F.sum(F.when(severity == "warning", n)), F.lit(0)).alias("warnings"), F.collect_set("code").alias("codes"))
    refused = table(spark, "refusals", folder).select("path", F.lit("refused").alias("status"))
    none = F.lit(None).cast("string")
    facts = table(spark, "files", folder).select("path").join(notes, "path", "left").join(refused, "path", "left").select(
        "path", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), none.alias("internal"), none.alias("unreadable"),
        F.coalesce("status", F.lit("complete")).alias("status"), F.lit(False).alias("read_failed"), F.lit(fail_on).alias("fail_on"), F.lit(max_warnings).alias("max_warnings"), F.lit(False).alias("over_budget"),
    )
    return exit_decision_of(facts).select("path", "exit_code", "rule")


#: Which file's code a run over several ends with, if they differ: what outranks what.
_OUTRANKS = (5, 2, 3, 1, 4)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    parser.add_argument("verb", choices=[*VERBS, "queries"])
    parser.add_argument("folder")
    parser.add_argument("--out")
    parser.add_argument("--fail-on", choices=["error", "warning"], default="error")
    parser.add_argument("--max-warnings", type=int, default=200)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparkloom").getOrCreate()
    try:
        if args.verb == "queries":
            from sparkloom.plans.catalog import QUERIES

            for name, query in QUERIES.items():
                query(spark, args.folder).write.mode("overwrite").parquet(f"{args.out or 'out'}/{name}")
            return 0
        result = table(spark, args.verb, args.folder)
        if args.out:
            result.write.mode("overwrite").parquet(args.out)
        else:
            result.show(50, truncate=80)
        codes = exit_codes(spark, args.folder, args.fail_on, args.max_warnings)
        tally = {r.exit_code: r["count"] for r in codes.groupBy("exit_code").count().collect()}  # six rows at most
    except Exception as e:  # whatever else it is, it is ours, and the caller must be able to tell it from bad input
        if isinstance(e, AnalysisException) and e.getCondition() == "PATH_NOT_FOUND":
            print(e, file=sys.stderr)
            return 2
        traceback.print_exc()
        return 5
    if not tally:
        return 2
    return next((code for code in _OUTRANKS if code in tally), 0)


if __name__ == "__main__":
    sys.exit(main())
