"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the digest of the normalised text (A-Z
lower-cased). New data is digested, one survivor a digest is chosen (the largest doc_id),
survivors whose digest the index lacks are found by a sort-merge anti-join that reads the
index without shuffle, and appended. A text stays with the batch that brought it first, so
where the largest doc_id of several batches is to stay, the batches come in descending order.

Null text counts as empty; a text's length does not matter, as only digests move. Rows of the
same doc_id and text (ties): exactly one of them is kept. A null doc_id is smaller than any
other. An empty table adds nothing. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriata.llm.common import ascii_lower, fresh_path, join_hot, materialize, remove, text_or_empty


def digest(text: Column | None = None) -> Column:
    return F.sha2(ascii_lower(text_or_empty() if text is None else F.coalesce(text, F.lit(""))), 256)


class DigestIndex:
    """Table (digest binary, keep_id long, batch string), kept in `path` (a new folder of the shared one by default). Opened by name; a session with a persistent catalog finds it again, another reopens its folder with `path` and the bucket count it was made with (by default the shuffle partitions)."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.own_path = None
        if not spark.catalog.tableExists(name):
            if path is None:
                path = self.own_path = fresh_path(spark, name)
            spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, keys: DataFrame, batch: str | None = None) -> DataFrame:
        """keys (doc_id, digest binary, rid unique) -> a row a digest: digest, keep_id, group_size (rows of keys), keep_rid (null where an earlier batch keeps the text); unknown digests are appended.

        batch names the data: adding a batch again, after a driver's loss at any point, appends what is missing and gives the same result."""
        batch = batch or uuid.uuid4().hex
        groups = keys.groupBy("digest").agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("group_size"))
        groups = materialize(groups, "digest-groups")
        fresh = groups.hint("merge").join(self.rows(), "digest", "left_anti").select("digest", F.col("best.doc_id").alias("keep_id"), F.lit(batch).alias("batch"))
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return groups.hint("merge").join(self.rows(), "digest").select("digest", "keep_id", "group_size", F.when(F.col("batch") == batch, F.col("best.rid")).alias("keep_rid"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.own_path:
            remove(self.spark, self.own_path)


def resolve(keys: DataFrame, known: DataFrame) -> DataFrame:
    """keys with keep_id, group_size and kept; the rows of a digest with a third of all rows need not meet in one task."""
    rows = join_hot(keys, known.withColumn("_n", F.col("group_size")), ["digest"], "_n", keys.count())
    return rows.withColumn("kept", F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(False)))


def add_in_batches(index: DigestIndex, keys: DataFrame, batches: int = 2) -> DataFrame:
    """keys with keep_id, group_size, kept: ranges of doc_id are added one after another, the largest first, so each later one meets the digests stored before and the largest doc_id of a text stays."""
    cuts = keys.agg(F.percentile_approx("doc_id", [i / batches for i in range(batches - 1, 0, -1)])).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    parts, above = [], None
    for k, low in enumerate([*cuts, None]):
        own = F.lit(True) if low is None else F.col("doc_id") >= low
        if above is not None:
            own = own & (F.col("doc_id").isNull() | (F.col("doc_id") < above))
        part = keys.where(F.coalesce(own, F.lit(False)))
        parts.append(materialize(index.add(part, f"{k}"), "digest-known"))
        above = low
    known = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.max("keep_rid").alias("keep_rid"))
    return resolve(keys, known)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, digest, text_hash, rid of every row: texts are hashed here and not shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(digest()).alias("digest"), row_hash().alias("text_hash"), F.monotonically_increasing_id().alias("rid"))
    return materialize(rows, "digest-keys")


def row_hash() -> Column:
    """With doc_id, tells rows apart at a fraction of a digest's cost."""
    return F.xxhash64(text_or_empty())


def fresh_name(prefix: str = "digest_index") -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def drop_exact_copies(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of docs that the index keeps, with their columns. Only the keys of what goes are joined to the texts; of rows equal in doc_id and text, one is taken."""
    keys = keyed(docs)
    decided = resolve(keys, index.add(keys, batch))
    at = [F.coalesce("doc_id", F.lit(-1)).alias("_gone_id"), F.col("doc_id").isNull().alias("_gone_null"), F.col("text_hash").alias("_gone_hash")]
    found = decided.groupBy(*at).agg(F.max(F.col("kept").cast("int")).alias("_kept"), F.count("*").alias("_n")).where("_kept = 0 or _n > 1")
    found = materialize(found, "digest-gone")
    gone, again = found.drop("_kept", "_n"), found.where("_kept = 1").drop("_kept", "_n")
    same = lambda g: (F.coalesce(docs["doc_id"].cast("long"), F.lit(-1)) == g["_gone_id"]) & (docs["doc_id"].isNull() == g["_gone_null"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == g["_gone_hash"])
    kept = docs.join(gone, same(gone), "left_anti")
    if again.limit(1).count():
        marked = docs.join(again, same(again)).dropDuplicates(["_gone_id", "_gone_null", "_gone_hash"])
        kept = kept.unionByName(marked.select(*docs.columns))
    return kept.select(*docs.columns)
