"""Decoders and planners: sounds, batches, caches, shelves, names and hashes, from events; oracles state results or closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import hashes
from sparkloom.operators import planning
from sparkloom.plans.registry import Tables, query
from sparkloom.plans.text import _given, _values
from sparkloom.plans.timeline import ROWS, rows
from sparkloom.sources import audio

#: Coded sounds: format, bits, channels, samples, bytes as hex, and the samples of each channel.
_SOUNDS = (
    ("adpcm", 16, 1, 4, "8019007C10", "100,111,93,99", ""),
    ("adpcm", 16, 2, 3, "0000008AD0FDE0", "0,10,6", "-30000,-32768,-30938"),
    ("pcm", 8, 1, 3, "0080FF", "-32768,0,32512", ""),
    ("pcm-le", 16, 2, 2, "0100FFFF02007F80", "1,2", "-1,-32641"),
    ("adpcm", 16, 1, 1, "8019007C10", "100", ""),
)


@query(
    f"""SELECT event_id AS id, unnest(CASE WHEN right_ = '' THEN [0] ELSE [0, 1] END) AS channel, unnest(CASE WHEN right_ = '' THEN [left_] ELSE [left_, right_] END) AS samples
    FROM events JOIN {_values(tuple((s[4], s[5], s[6]) for s in _SOUNDS), 'x', 'left_', 'right_')} ON given.i = event_id % {len(_SOUNDS)}"""
)
def sound_decode(t: Tables) -> DataFrame:
    """Sounds decoded to planes: codes of 2 and 4 bits, one and two channels, bytes and words."""
    given = t.spark.createDataFrame([(i, *s[:5]) for i, s in enumerate(_SOUNDS)], "i long, format string, bits int, channels int, samples int, hex string")
    e = t.events.select("event_id").join(F.broadcast(given), F.col("i") == F.col("event_id") % len(_SOUNDS))
    out = audio.sound_samples(e.select(F.col("event_id").cast("string").alias("id"), "format", "bits", "channels", "samples", F.unhex("hex").alias("data")))
    return out.select(F.col("id").cast("long").alias("id"), "channel", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@query(
    """SELECT event_id AS id, CAST(k AS INTEGER) AS seq, CASE WHEN k = 0 THEN 0 ELSE 417 * CAST(k AS INTEGER) END AS "offset", CASE WHEN k = event_id % 3 THEN CASE event_id % 2 WHEN 0 THEN 418 ELSE 104 END ELSE 417 END AS length,
    CASE WHEN k = event_id % 3 AND event_id % 2 = 1 THEN 32 ELSE 128 END AS kbits, k > 0 AND k = event_id % 3 AND event_id % 2 = 1 AS changed FROM (SELECT event_id, unnest(range(0, event_id % 3 + 1)) AS k FROM events WHERE event_id < 300)"""
)
def mp3_scan(t: Tables) -> DataFrame:
    """MPEG frames of 128 kbit/s, the last one padded or of 32 kbit/s, with junk behind them."""
    i = F.col("event_id")
    plain = F.expr("repeat(concat('FFFB9044', repeat('00', 413)), CAST(event_id % 3 AS INT))")
    last = F.when(i % 2 == 0, F.expr("concat('FFFB9244', repeat('00', 414))")).otherwise(F.expr("concat('FFFB1044', repeat('00', 100))"))
    data = F.unhex(F.concat(plain, last, F.lit("4A554E4B21")))
    return audio.frame_table(t.events.where("event_id < 300").select(i.alias("id"), data.alias("data"))).select("id", "seq", "offset", "length", "kbits", "changed")


@query(
    f"""WITH r AS (SELECT timeline AS scene, row_number() OVER (PARTITION BY timeline ORDER BY idx) AS n, depth AS material, idx % 10 <> 0 AS opaque FROM {ROWS}),
    s AS (SELECT *, CASE WHEN opaque THEN sum(CASE WHEN opaque THEN 0 ELSE 1 END) OVER (PARTITION BY scene ORDER BY n) END AS island FROM r),
    o AS (SELECT *, (row_number() OVER (PARTITION BY scene, island ORDER BY n) - 1) // 64 AS part FROM s WHERE opaque),
    b AS (SELECT scene, min(n) AS place, material, count(*) AS n, island, part FROM o GROUP BY scene, island, part, material
      UNION ALL SELECT scene, n, material, 1, -1, n FROM r WHERE NOT opaque),
    g AS (SELECT *, min(place) OVER (PARTITION BY scene, island, part) AS opens FROM b)
    SELECT scene, CAST(dense_rank() OVER (PARTITION BY scene ORDER BY opens) - 1 AS INTEGER) AS segment, CAST(row_number() OVER (PARTITION BY scene, opens ORDER BY place) - 1 AS INTEGER) AS batch, material, n FROM g"""
)
def batch_plan(t: Tables) -> DataFrame:
    """Draw batches of boxes side by side: segments end at translucent items and at 64 boxes."""
    i, n = F.col("idx"), F.col("idx")
    items = rows(t).select(F.col("timeline").alias("scene"), i.alias("idx"), F.col("depth").cast("long").alias("material"), (i % 10 != 0).alias("opaque"), F.lit(None).cast("int").alias("clip"),
                           (n * 10).cast("long").alias("x0"), F.lit(0).alias("y0"), (n * 10 + 10).cast("long").alias("x1"), F.lit(5).alias("y1"))
    return planning.plan_batches(items)


@query(
    f"""SELECT timeline AS run, CASE WHEN timeline % 2 = 0 THEN 0 ELSE count(*) - least(count(*), 5) END AS hits, CASE WHEN timeline % 2 = 0 THEN count(*) ELSE least(count(*), 5) END AS misses,
    CASE WHEN timeline % 2 = 0 THEN greatest(count(*) - 5, 0) ELSE 0 END AS evictions FROM {ROWS} GROUP BY timeline"""
)
def fifo_run(t: Tables) -> DataFrame:
    """A cache of five under seven keys in turn, which never hits, and under five, which always does once all are in."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("timeline").orderBy("idx"))
    uses = rows(t).select(F.col("timeline").alias("run"), "idx", F.when(F.col("timeline") % 2 == 0, n % 7).otherwise(n % 5).cast("long").alias("key"))
    return planning.fifo_cache(uses, 5)


@query(
    """WITH c AS (SELECT p_size AS font, count(*) AS n, CASE WHEN ceil(sqrt(count(*)) * 56) <= 512 THEN 512 WHEN ceil(sqrt(count(*)) * 56) <= 1024 THEN 1024 ELSE 2048 END AS side FROM part GROUP BY ALL),
    g AS (SELECT p_size AS font, p_partkey AS idx, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS k, side, p_size * 4 + 9 AS w, p_size * 3 + 20 AS h FROM part JOIN c ON font = p_size),
    r AS (SELECT *, (side - 4 - w) // (w + 4) + 1 AS across, (side - 4 - h) // (h + 4) + 1 AS down FROM g)
    SELECT font, idx, side, CAST(k // (across * down) AS INTEGER) AS page, CAST(2 + k % across * (w + 4) AS INTEGER) AS x, CAST(2 + k // across % down * (h + 4) AS INTEGER) AS y FROM r"""
)
def shelf_pack(t: Tables) -> DataFrame:
    """Glyphs of one size to a font on the shelves of its pages, whose side follows from their number."""
    z = F.col("p_size").cast("long")
    return planning.pack_shelves(t.part.select(z.alias("font"), F.col("p_partkey").cast("long").alias("idx"), (z * 4 + 9).alias("width"), (z * 3 + 20).alias("height")))


#: Names in order and what they must become where all of them meet in one scope.
_BASES = (("a", "a"), ("a_2", "a_2"), ("a", "a_3"), ("a", "a_4"), ("b", "b"), ("a_2", "a_2_2"), ("b_2_2", "b_2_2"), ("b", "b_2"), ("b_2", "b_2_3"), ("a_3", "a_3_2"))


@query(f"SELECT p_partkey AS scope, CAST(i AS BIGINT) AS idx, want AS name FROM part, {_values(_BASES, 'x', 'want')}")
def taken_suffix(t: Tables) -> DataFrame:
    """Repeated names with suffixes, past names that are taken already."""
    names = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("idx"), F.lit(b).alias("base")) for i, (b, _) in enumerate(_BASES)])).alias("n")
    return planning.taken_names(t.part.select(F.col("p_partkey").cast("long").alias("scope"), names).select("scope", "n.idx", "n.base"))


#: Texts with FNV-1a (64 bits), Adler-32 and CRC-32.
_HASHED = (("", "cbf29ce484222325", 1, 0), ("a", "af63dc4c8601ec8c", 6422626, 3904355907), ("foobar", "85944171f73967e8", 145425018, 2666930069))


@query(f"SELECT p_partkey, fnv, adler, crc FROM part JOIN {_values(_HASHED, 'x', 'fnv', 'adler', 'crc')} ON i = p_partkey % 3")
def byte_hashes(t: Tables) -> DataFrame:
    """Checksums of bytes."""
    p = t.part.select("p_partkey").join(F.broadcast(_given(t, _HASHED)), F.col("i") == F.col("p_partkey") % 3)
    b = F.col("x").cast("binary")
    return p.select("p_partkey", hashes.fnv1a64_hex(b).alias("fnv"), hashes.adler32(b).alias("adler"), F.crc32(b).alias("crc"))
