"""Proportional stratified interleaving: every shard gets each source in the corpus's own mixture.

Rows are put in a seeded random order inside their source; a row at rank r
(from 0) of n gets the fractional rank (2r+1)/2n. Sorted by fractional rank,
any run of rows holds every source in proportion, so equal consecutive cuts
are shards that match the mixture.

No source and no shard is ever one task's work. Inside a source, the leading
bits of the shuffle key cut the order into buckets; a row's rank is the number
of rows in earlier buckets plus its place inside its own. The global order is
cut the same way by fractional rank, which is uniform by construction. Only
thin rows (id, source, size, checksum) are shuffled; the text is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, shuffle_parts, written

#: Bits of the seeded shuffle key (the leading 15 hex digits of an MD5).
KEY_BITS = 60


def shuffle_key(seed: str, row_id: Column, size: Column, text_crc32: Column) -> Column:
    """60 uniform bits that depend on the seed, the id, and the text's size and checksum: rows without ids are spread too."""
    parts = [F.coalesce(row_id.cast("string"), F.lit("")), size.cast("string"), text_crc32.cast("string")]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def _before(df: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """Rows of each bucket's group that lie in earlier buckets, from bucket counts."""
    counts = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*group).orderBy(bucket)
    return counts.select(
        *group, bucket,
        (F.sum("_n").over(order) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("_total"),
    )


def stratified_shards(
    docs: DataFrame, n_shards: int = 8, *, seed: str = "mixture-1",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Deal all rows of ``docs`` into ``n_shards`` shards (law ``rows``).

    Returns doc_id, source, size, text_crc32, law, shard, slot, grown_shard;
    counts of any two shards differ by at most one, and slots run from 0
    without gaps in each shard.

    Null text: size 1, checksum 0 (as for empty text). Null source: a stratum
    of its own. Null or repeated ids: every row is dealt; rows alike in id,
    source, size and checksum are interchangeable. Other columns are ignored.
    Empty input gives an empty result.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    cells = 4 * shuffle_parts(docs.sparkSession)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_s"),
    ).withColumn("_h", shuffle_key(seed, F.col("doc_id"), F.col("size"), F.col("text_crc32"))).withColumn("_b", F.expr(f"cast(shiftright(_h, {KEY_BITS - 30}) * {cells} div {1 << 30} as int)"))
    rows = written(rows, "shard-rows")

    tie = ["_h", "doc_id", "size", "text_crc32"]
    inside = F.row_number().over(Window.partitionBy("_s", "_b").orderBy(*tie)) - 1
    rank = F.col("_before") + inside
    ranked = rows.join(_before(rows, ["_s"], "_b"), ["_s", "_b"]).withColumn("_r", rank)
    ranked = ranked.withColumn("_f", (F.col("_r") + F.lit(0.5)) / F.col("_total")).drop("_before", "_total")
    ranked = written(ranked.withColumn("_g", F.floor(F.col("_f") * cells).cast("int")), "shard-ranks")

    # One row per cell of the global order: a bounded table, so one running sum over it is enough.
    cut = ranked.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    cut = cut.select("_g", (F.sum("_n").over(Window.orderBy("_g")) - F.col("_n")).alias("_before"),
                     F.sum("_n").over(Window.partitionBy()).alias("_total"))
    place = F.row_number().over(Window.partitionBy("_g").orderBy("_f", "_s", *tie)) - 1
    shard = F.expr(f"_pos * {n_shards} div _total").cast("int")
    # Shard s starts at the first position p with p * k div n = s (n rows, k shards): the ceiling of s * n / k.
    start = F.expr(f"(shard * _total + {n_shards - 1}) div {n_shards}")
    discard(rows)
    out = ranked.join(F.broadcast(cut), "_g").withColumn("_pos", (F.col("_before") + place).cast("long"))
    return out.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_pos") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
