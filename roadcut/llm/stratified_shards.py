"""Sharding by proportional stratified interleaving, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadcut.llm import _io

#: Rows of a bucket in which a rank is counted.
BUCKET_ROWS = 20_000
_RANGE = 1 << 40


def interleave(docs: DataFrame, shards: int = 16, seed: int = 17, stratum: str = "source") -> DataFrame:
    """Puts every row into one of the shards, whose row counts differ by one at most and whose mixtures of the stratum
    match the corpus's.

    Rows of a stratum are shuffled by a seeded hash of doc_id and text, so that rows without an id don't fall together; row r of n gets the fractional rank (r + 1/2) / n. All
    rows are sorted by fractional rank and cut into equal shards. Neither rank needs a stratum in one task: rows fall
    into buckets by hash (or by fractional rank), bucket counts are summed up, and rows are ranked inside buckets.

    docs: doc_id, text and the stratum; other columns are not read. Returns doc_id, stratum, size (UTF-8 bytes and 1),
    text_crc32, shard, slot (from 0, without gaps in a shard). Null text: no bytes. A null stratum is one of its own.
    Rows with equal doc_id are ordered by size and crc; equal rows are interchangeable. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.crc32(text)), F.lit(_RANGE)).alias("draw"),
    )
    rows = _io.stored(rows, "sizes")
    total = rows.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.expr(f"draw div {-(-_RANGE // buckets)}"))
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    one = Window.partitionBy("stratum")
    counts = counts.select(F.col("stratum").alias("s"), F.col("bucket").alias("b"), (F.sum("n").over(one.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(one).alias("of"))
    inside = Window.partitionBy("stratum", "bucket").orderBy("draw", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("r", F.row_number().over(inside) - 1)
    ranked = ranked.join(counts, ranked["stratum"].eqNullSafe(counts["s"]) & (ranked["bucket"] == counts["b"]))
    ranked = ranked.select("doc_id", "stratum", "size", "text_crc32", ((F.col("before") + F.col("r") + 0.5) / F.col("of")).alias("share"))
    ranked = ranked.withColumn("part", F.floor(F.col("share") * buckets))
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    # a row for BUCKET_ROWS rows of the input
    parts = parts.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = ranked.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("share", "stratum", "doc_id")) - 1)
    place = place.join(parts, place["part"] == parts["p"]).withColumn("at", F.col("before") + F.col("r"))
    place = place.withColumn("shard", F.expr(f"at * {shards} div {max(total, 1)}"))
    return place.select("doc_id", "stratum", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.expr(f"at - (shard * {total} + {shards - 1}) div {shards}").alias("slot"))


def op4_stratified_shards(spark, sf_dir: str) -> DataFrame:
    out = interleave(_io.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("source"))
