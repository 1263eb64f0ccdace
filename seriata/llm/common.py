"""Shared pieces of the training-data operators: inputs, shared-folder tables, word and shingle hashes."""

from __future__ import annotations

import contextvars
import gc
import tempfile
import uuid
import weakref

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriata.ship import ship

SHINGLE = 5
HOT_SHARE = 1000
FEW_ROWS = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_local_dir: str | None = None
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_run: contextvars.ContextVar[Tables | None] = contextvars.ContextVar("run", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master that names none."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="seriata-")
    return _local_dir


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


class Tables:
    """The tables that one run writes: `with Tables(spark) as run:` owns those written inside the block.

    run.release() deletes them, once nothing that reads them is needed any more. What is
    never released goes when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        self._token = _run.set(self)
        return self

    def __exit__(self, *_) -> None:
        _run.reset(self._token)

    def release(self) -> int:
        n = len(self.paths)
        while self.paths:
            remove(self.spark, self.paths.pop())
        return n


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, owned by the current run and deleted with the application at the latest."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    if owner := _run.get():
        owner.paths.append(path)
    return path


def materialize(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, so lost executors cost nothing that was written.

    instead_of: an earlier result of this function that nothing reads any more once df is written; its files go."""
    spark = df.sparkSession
    ship(spark)
    path = fresh_path(spark, name)
    df.write.mode("append").parquet(path)
    if instead_of is not None and (old := _places.pop(instead_of, None)):
        remove(spark, old)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def tidy(spark: SparkSession) -> None:
    """Between the parts of a long job: the driver lets go of finished plans, and Spark's cleaner then removes the shuffle files and broadcasts that only they held."""
    gc.collect()
    spark._jvm.System.gc()


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], size: str, total: int, how: str = "inner", few: int = FEW_ROWS) -> DataFrame:
    """rows join table (a row a key, of which column `size` says how many of the `total` rows it meets), inner or left, without `size`.

    Keys with over a thousandth of the rows are a thousand at most: those are broadcast, so
    that their rows need not meet in one task; the rest is joined by shuffle. Of `few` rows
    or less no key needs that: a task that gets all of them is small."""
    if total <= few:
        return rows.join(table.drop(size), on, how)
    hot = F.col(size) * HOT_SHARE > F.lit(total)
    heavy, light = F.broadcast(table.where(hot).drop(size)), table.where(~hot).drop(size)
    rest = rows.join(F.broadcast(table.where(hot).select(*on)), on, "left_anti")
    return rows.join(heavy, on).unionByName(rest.join(light, on, how))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class _WordHashes(dict):
    """Word -> 64-bit hash; emptied at a fixed size, so memory stays bounded on any vocabulary."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased (bytes.split and bytes.lower know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(ws: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of five words, with repeats; fewer words count as one run; none give an empty array."""
    n = len(ws)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, ws), np.uint64, n)
    if n < size:
        acc = np.uint64(n)
        with np.errstate(over="ignore"):
            for x in h:
                acc = acc * _BASE + x
        return mix(np.array([acc], np.uint64))
    out = h[: n - size + 1].copy()
    for k in range(1, size):
        out *= _BASE
        out += h[k : n - size + 1 + k]
    return mix(out)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingles(words(text)))
