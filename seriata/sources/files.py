"""Readers and writers of runs, vectors, sidecars, reports, grids, logs and manifests."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriata import schema as S
from seriata.operators import contract


def read_runs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Run records (one JSON object a file, or a line) with block_id, sorted by cell_id; an empty folder is an error."""
    runs = spark.read.schema(S.RUNS).json(path, multiLine=not lines)
    if not runs.limit(1).count():
        raise FileNotFoundError(f"no run records in {path}")
    return runs.withColumn("block_id", block_id()).orderBy("cell_id")


def block_id() -> Column:
    return F.concat(F.col("dataset"), F.lit("_h"), F.col("pred_len").cast("string"), F.lit("_"), F.col("backbone"))


def write_series(values: DataFrame, sidecars: DataFrame, root: str) -> None:
    """Values and sidecars as Parquet, split by product; each write is all or nothing, and sidecars, which make a product readable, come last."""
    for df, name in ((values, "values"), (sidecars, "sidecars")):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell_id", "product").parquet(f"{root}/{name}")


def read_values(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(S.SAMPLE_VALUES).parquet(f"{root}/values")


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """S4."""
    return spark.read.schema(S.SIDECAR).parquet(f"{root}/sidecars")


def read_json_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """S4 for JSON sidecars, one object a file: cell_id and product come from the path .../<cell>/<product>.provenance.json."""
    fields = [f for f in S.SIDECAR if f.name not in ("cell_id", "product")]
    from pyspark.sql.types import StructType

    rows = spark.read.schema(StructType(fields)).json(path, multiLine=True).withColumn("_f", F.input_file_name())
    return rows.withColumn("cell_id", F.regexp_extract("_f", r"([^/]+)/[^/]+$", 1)).withColumn("product", F.regexp_extract("_f", r"([^/]+?)(\.provenance)?\.json$", 1)).select(*[f.name for f in S.SIDECAR])


def load_series(spark: SparkSession, root: str, cell_id: str, product: str, require_order: str | None = "index", expect_n: int | None = None, legacy_ok: bool = False, expect: Mapping[str, object] | None = None) -> DataFrame:
    """Pos, sample_id, window_origin, value of one product after validation; the first violation is raised. Filters on both keys reach the Parquet partitions."""
    mine = (F.col("cell_id") == cell_id) & (F.col("product") == product)
    values, sidecars = read_values(spark, root).where(mine), read_sidecars(spark, root).where(mine)
    wanted = spark.createDataFrame([(cell_id, product)], "cell_id string, product string")
    siblings = read_values(spark, root).where(F.col("cell_id") == cell_id)
    report = contract.validate(values, sidecars, expect, siblings, wanted, require_order, legacy_ok)
    contract.enforce(report)
    if expect_n is not None and (n := values.count()) != expect_n:
        raise contract.IdentityMismatch(f"{cell_id}/{product}: {n} values, {expect_n} expected")
    return values.select("pos", "sample_id", "window_origin", "value")


def write_json(path: str, obj: Any) -> None:
    """To a temporary file in the same folder, flushed, then renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(fd, "w") as f:
        json.dump(obj, f, indent=2, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, target)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S8."""
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_grid(path: str) -> dict[str, Any]:
    """A YAML grid as nested dicts."""
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


def horizons(available: Sequence[int], spec: str | Sequence[int | str]) -> list[int]:
    """The horizons that a grid entry names: all, places first to fourth, or numbers."""
    if spec == "all":
        return list(available)
    places = ("first", "second", "third", "fourth")
    return [available[places.index(s)] if isinstance(s, str) else int(s) for s in spec]


def feature_cache(spark: SparkSession, root: str, key: Mapping[str, object], build) -> DataFrame:
    """The table of this key if it was built before, else built and kept; a partition per key."""
    path = "/".join([root, *[f"{k}={v}" for k, v in key.items()]])
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    for k, v in key.items():
        out = out.withColumn(k, F.lit(v))
    return out


def manifest_check(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Manifest (name, sha256) against the files in path: name, expected, found, ok. Contents are hashed where they are read."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("found"))
    return manifest.select("name", F.col("sha256").alias("expected")).join(files, "name", "left").withColumn("ok", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)))


def fetch(manifest: Sequence[Mapping[str, str]], folder: str, timeout: float = 60.0) -> list[str]:
    """Files of the manifest (name, url, sha256) that the driver's folder lacks or holds with other contents, downloaded piece by piece; each becomes visible only with the pinned contents. Returns the names fetched."""
    import hashlib
    import urllib.request

    def digest(path: Path) -> str | None:
        if not path.exists():
            return None
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()

    got = []
    for row in manifest:
        target = Path(folder) / row["name"]
        if digest(target) == row["sha256"]:
            continue
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(target.name + ".part")
        with urllib.request.urlopen(row["url"], timeout=timeout) as source, open(part, "wb") as out:
            while piece := source.read(1 << 20):
                out.write(piece)
        if (found := digest(part)) != row["sha256"]:
            part.unlink()
            raise ValueError(f"{row['name']}: {found} instead of the pinned {row['sha256']}")
        os.replace(part, target)
        got.append(row["name"])
    return got


def append_log(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("append").json(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of .npy files in path: product (the file's name), pos, value. Read where the files are, one file a task."""
    import io

    import numpy as np
    import pandas as pd

    def rows(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False).reshape(-1).astype(float)
                yield pd.DataFrame({"product": os.path.basename(name).removesuffix(".npy"), "pos": np.arange(len(a)), "value": a})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInPandas(rows, "product string, pos bigint, value double")


def fixture_cell(spark: SparkSession, n: int = 64, seed: int = 0, cell_id: str = "cell", dataset: str = "ETTh1", seq_len: int = 96, pred_len: int = 336) -> DataFrame:
    """Three products of one cell from hashes: val_index_order, val_loader_order and val_perm."""
    from seriata.operators.order import full_permutation

    base = spark.range(n).select(F.lit(cell_id).alias("cell_id"), F.col("id").alias("pos"))
    u = lambda k: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}/{k}"), F.col("pos").cast("string"))), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    index = base.withColumn("value", -F.ln(u("a")) - F.ln(u("b"))).withColumn("window_origin", F.col("pos"))
    perm = full_permutation(base, ["cell_id"], seed)
    loader = perm.join(index.select("cell_id", F.col("pos").alias("src_pos"), "value"), ["cell_id", "src_pos"]).select("cell_id", "pos", "value", F.col("src_pos").alias("window_origin"))
    order = perm.select("cell_id", "pos", F.col("src_pos").cast("double").alias("value"), F.col("src_pos").alias("window_origin"))
    out = None
    for name, df in (("val_index_order", index), ("val_loader_order", loader), ("val_perm", order)):
        part = df.withColumn("product", F.lit(name)).withColumn("sample_id", contract.sample_id(F.lit(dataset), F.lit("val"), F.lit(seq_len), F.lit(pred_len), F.col("window_origin")))
        part = part.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.SAMPLE_VALUES])
        out = part if out is None else out.unionByName(part)
    return out


def fixture_identity(spark: SparkSession, cell_id: str = "cell", products: Sequence[str] = ("val_index_order",), dataset: str = "ETTh1", seq_len: int = 96, pred_len: int = 336, backbone: str = "DLinear", plugin: str = "none", seed: int = 2021) -> DataFrame:
    return spark.createDataFrame([(cell_id, p, p.split("_")[0], dataset, backbone, plugin, seq_len, pred_len, seed) for p in products], "cell_id string, product string, split string, dataset string, backbone string, plugin string, seq_len int, pred_len int, seed int")
