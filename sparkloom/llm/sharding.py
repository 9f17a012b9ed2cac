"""Random shards by a two-pass external shuffle, in DataFrame and SQL functions only.

Pass one scatters whole rows uniformly into buckets that fit in memory, by a seeded hash. Pass two gathers one bucket per
task, shuffles it with Fisher-Yates (Spark's `shuffle`), and lays the buckets end to end: a uniform order of all rows,
which is cut into shards whose row counts differ by one at most. `write_shards` writes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import stored

#: A bucket's bounds: bytes of the rows, and rows.
BUCKET_BYTES, BUCKET_ROWS = 64 << 20, 50_000
#: Copies of one row that a task makes at most.
COPIES = 10_000
SEED = 20_240_611

_KEY = ("doc_id", "size", "text_crc32", "digest")


def _size(text: str):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _crc32(text: str):
    return F.crc32(F.coalesce(F.col(text), F.lit("")))


def _numbered_copies(counted: DataFrame, most: int) -> DataFrame:
    """Each row `n` times, with `copy` from 1 to `n`. A row with very many copies is dealt to many tasks before they are made."""
    if most > COPIES:
        runs = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("int"))).alias("run")
        counted = counted.select("*", runs)
        counted = counted.repartition(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_KEY, "run")
    else:
        counted = counted.withColumn("run", F.lit(0))
    first = F.col("run").cast("long") * COPIES
    last = F.least(F.col("n"), first + COPIES)
    return counted.withColumn("copy", F.explode(F.sequence(first + 1, last))).drop("run", "n")


def _shuffled(rows: DataFrame, shards: int, id_: str, text: str, seed: int, bucket_bytes: int, bucket_rows: int) -> DataFrame:
    """The rows in shuffled order, with `shard` and `slot`; their own columns must have other names."""
    names = rows.columns
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in names), F.lit(16)).cast("long")
    rows = rows.select(F.col(id_).alias("doc_id"), _size(text).alias("size"), _crc32(text).alias("text_crc32"), F.xxhash64(*names).alias("digest"), width.alias("width"), F.struct(*names).alias("row"))
    counts = stored(rows.groupBy(*_KEY).agg(F.count("*").alias("n"), F.max("width").alias("width")), "records")
    rows = rows.drop("width")
    total, bytes_, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("width")), F.lit(0)), F.max("n")).first()
    buckets = max(1, -(-bytes_ // bucket_bytes), -(-total // bucket_rows))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *_KEY, "copy"), F.lit(buckets)).cast("int")
    first = _numbered_copies(counts.select(*_KEY, "n"), most or 0).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    first = stored(first.select("bucket", F.coalesce(before, F.lit(0)).alias("first")), "buckets")
    each = rows.withColumn("copy", F.lit(1).cast("long"))
    if (most or 0) > 1:
        many = stored(counts.where("n > 1").select("digest"), "repeated")
        alike = rows.join(many, "digest", "left_semi").groupBy(*_KEY, "row").agg(F.count("*").alias("n"))
        each = each.join(many, "digest", "left_anti").unionByName(_numbered_copies(alike, most))
    # Rows and all that is needed of them meet before they are scattered; what follows is done bucket by bucket.
    scattered = each.withColumn("bucket", bucket).join(first, "bucket").repartitionById(buckets, F.col("bucket"))
    # The sorted list makes the shuffle's input independent of the order of arrival; a bucket's partition fixes its seed.
    gathered = scattered.groupBy("bucket", "first").agg(F.sort_array(F.collect_list(F.struct(*_KEY, "copy", "row"))).alias("records"))
    placed = gathered.select("first", F.posexplode(F.shuffle("records", seed)).alias("at", "r"))
    placed = placed.select("r.row", (F.col("first") + F.col("at")).alias("rank"))
    n = max(total, 1)
    placed = placed.withColumn("shard", F.expr(f"int((rank * {shards}) div {n})"))
    slot = F.expr(f"rank - (shard * {n}L + {shards - 1}) div {shards}")
    return placed.select("row.*", "shard", slot.cast("long").alias("slot"))


def _inner(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """Rows under names of our own, and those of the given columns."""
    lower, names = [n.lower() for n in docs.columns], [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [names[lower.index(c.lower())] for c in columns]


def shuffled_documents(
    docs: DataFrame,
    shards: int = 40,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The shuffled rows themselves: those of `docs` with all their columns, `shuffle_shard` and `shuffle_slot`.

    Slots run from 0 without gaps in each shard; a partition holds one bucket in shuffled order. Rows that are alike are
    counted and told apart by a running number, so they scatter like any others and no bucket can grow hot.

    Defined results: repeated rows each get a place; a null id is an id like others; the same rows give the same places
    however they are stored; no rows give no rows. Columns must be of types that Spark can sort and hash.
    """
    rows, (id_, text) = _inner(docs, id_col, text_col)
    return _shuffled(rows, shards, id_, text, seed, bucket_bytes, bucket_rows).toDF(*docs.columns, "shuffle_shard", "shuffle_slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, **options) -> None:
    """Writes the shuffled rows as Parquet, one folder `shuffle_shard=N` for each shard.

    A bucket is one task, which writes its rows in shuffled order to the one or two shards that it lies in; a file's rows
    are in the order of their slots, and slots put the files of a shard in order. The write commits as a whole, and a task
    whose executor is lost is written again alike.
    """
    shuffled_documents(docs, shards, **options).write.partitionBy("shuffle_shard").mode("errorifexists").parquet(path)


def shuffled_shards(
    docs: DataFrame,
    shards: int = 40,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """What the shuffled rows hold: `doc_id`, `size`, `text_crc32`, `law` ('rows'), `shard`, `slot`, `grown_shard` (null).

    All is read from the rows of `shuffled_documents`. `size` is the text's UTF-8 bytes plus 16; a null text has no bytes
    and the checksum of an empty text.
    """
    rows, (id_, text) = _inner(docs, id_col, text_col)
    out = _shuffled(rows, shards, id_, text, seed, bucket_bytes, bucket_rows)
    return out.select(
        F.col(id_).alias("doc_id"), _size(text).alias("size"), _crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
