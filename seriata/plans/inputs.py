"""The driver's tables in the engine's data model, in DataFrames and in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from seriata.operators.features import forecaster_errors
from seriata.operators.order import with_pos
from seriata.ship import ship

L, H = 24, 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """series_id, pos, value: event values in time order."""
    e = table(spark, sf_dir, "events").where(F.col(key).isNotNull()).select(F.col(key).alias("series_id"), "ts", "event_id", "value")
    return with_pos(e, ["series_id"], "ts", "event_id").select("series_id", "pos", "value")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master that names none."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="seriata-")


def whole(*key: str, by: Sequence[str]) -> WindowSpec:
    """All rows of a key, taken in one order: sums of doubles are then equal however the rows are dealt over files and tasks."""
    return Window.partitionBy(*key).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


@contextmanager
def written(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """df as a table in the shared folder while the block lasts: plans on it are short."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    try:
        df.write.parquet(at)
        yield spark.read.parquet(at)
    finally:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


SERIES = "s as (select event_type as series_id, row_number() over (partition by event_type order by ts, event_id) - 1 as pos, value from events where event_type is not null)"
USER_SERIES = SERIES.replace("event_type", "user_id")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, value: hourly means; aggregated first, so the one numbering window holds a row per hour."""
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("value"))
    return e.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("hour")) - 1).cast("bigint").alias("t"), "value")


HOURLY = "h as (select row_number() over (order by hour) - 1 as t, value from (select date_trunc('hour', ts) as hour, avg(value) as value from events group by 1))"


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, channel, t, value: daily means per event type, the types as channels."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("value"))
    e = e.select(F.lit("events").alias("dataset"), F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("event_type")).alias("channel"), "event_type", "day", "value")
    return with_pos(e, ["event_type"], "day").select("dataset", "channel", F.col("pos").alias("t"), "value")


CHANNELS = "ch as (select 'events' as dataset, dense_rank() over (order by event_type) as channel, row_number() over (partition by event_type order by day) - 1 as t, value from (select event_type, date_trunc('day', ts) as day, avg(value) as value from events group by 1, 2))"


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, arm, pos, value: errors of the four closed-form forecasters on the hourly series."""
    h = hourly(spark, sf_dir).withColumn("g", F.lit("hourly"))
    return forecaster_errors(h, ["g"], L, H)


_WEIGHTS = [0.5 ** ((L - 1 - i) / (L / 2)) for i in range(L)]
_LEADS = ", ".join(f"lead(value, {i}) over o as v{i}" for i in range(L + H))
_ERROR = lambda f: "(" + " + ".join(f"pow(v{L + i} - ({f.replace('#', str(i))}), 2)" for i in range(H)) + f") / {H}.0"
_FORECASTS = {"last": f"v{L - 1}", "mean": "m", "ewma": "e", "seasonal": "v#"}
ARMS = f"""{HOURLY},
leads as (select t as pos, {_LEADS} from h window o as (order by t)),
looks as (select *, ({" + ".join(f"v{i}" for i in range(L))}) / {L}.0 as m, ({" + ".join(f"v{i} * {w!r}" for i, w in enumerate(_WEIGHTS))}) / {sum(_WEIGHTS)!r} as e from leads where v{L + H - 1} is not null),
a as ({" union all ".join(f"select 'hourly' as g, '{k}' as arm, pos, {_ERROR(f)} as value from looks" for k, f in _FORECASTS.items())})"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, product, pos, window_origin, sample_id, value and identity columns: documents as samples; dataset is the source, split the language, the origin a document's rank."""
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.col("n_chars").cast("double").alias("value"))
    return with_pos(d, ["source", "lang"], "doc_id").withColumn("window_origin", F.col("pos"))


VECTORS = "v as (select source, lang, doc_id, n_chars::double as value, row_number() over (partition by source, lang order by doc_id) - 1 as pos from documents)"
