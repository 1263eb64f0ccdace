"""Sharding by proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; the fractional rank
(rank - u) / n, with u from the source's own hash, lies evenly in (0, 1) for every source,
so sorting all rows by it interleaves the sources in proportion, and cutting the sorted rows
into equal runs gives every shard the mixture of the whole, to within about one row a source.
Many small sources do not meet at one point, as each has its own u.

Law: rows (counts at most one apart). Ranks come from counts by hash bucket plus a rank
within the bucket, so no task sorts a whole source, however large. Up to MAX_BUCKETS
buckets of ROWS_PER_BUCKET rows; beyond 4e9 rows the buckets grow.

Null source is a source of its own; null and empty texts have size 16; a text's length does
not matter, as texts are not moved. Rows with the same doc_id and text (ties of the shuffle)
are interchangeable and each gets its own slot. An empty table gives no rows. Columns besides
doc_id, text and source are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriata.llm.common import materialize, text_or_empty

SHARDS = 40
ROWS_PER_BUCKET = 2_000
MAX_BUCKETS = 2_000_000  # rows of the one running sum


def bucketed_rank(df: DataFrame, group: list[str], bucket: Column, order: list) -> DataFrame:
    """df with rank (from 1 within group) and of (the group's rows): bucket must not decrease along order. Tasks hold single buckets; the running sum holds a row per bucket."""
    df = df.withColumn("_bucket", bucket)
    key = [*group, "_bucket"]
    counts = df.groupBy(*key).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    ranked = df.withColumn("_own", own).join(counts.withColumn("_before", before).withColumn("of", F.sum("_n").over(whole)).drop("_n"), key)
    return ranked.withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_bucket")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source, fraction. The texts are read once and not shuffled."""
    text = text_or_empty()
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            "source",
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("stratum"),
            F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(text)).alias("h"),
        ),
        "sharding-rows",
    )
    n = rows.count()
    buckets = max(1, min(MAX_BUCKETS, -(-n // ROWS_PER_BUCKET)))
    part = lambda h: F.least(F.shiftrightunsigned(h, 1) / F.lit(2.0**63), F.lit(1 - 2.0**-53))  # noqa: E731  a hash as a number in [0, 1)
    h_bucket = F.floor(part("h") * buckets).cast("long")
    order = [F.shiftrightunsigned("h", 1), "h", "doc_id", "size", "text_crc32"]
    ranked = bucketed_rank(rows, ["stratum"], h_bucket, order)
    placed = ranked.withColumn("tie", F.xxhash64(F.lit(seed + 1), "stratum"))
    placed = materialize(placed.withColumn("fraction", (F.col("rank") - part("tie")) / F.col("of")).drop("rank", "of"), "sharding-fractions")
    total = bucketed_rank(placed, [], F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("long"), ["fraction", "tie", "stratum", *order])
    at = F.col("rank") - 1
    # the first n % shards shards hold one row more
    big, base = n % shards, n // shards
    edge = big * (base + 1)
    shard = F.when(at < edge, F.floor(at / F.lit(base + 1))).otherwise(big + F.floor((at - edge) / F.lit(max(base, 1))))
    slot = F.when(at < edge, at % F.lit(base + 1)).otherwise((at - edge) % F.lit(max(base, 1)))
    return total.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source", "fraction")
