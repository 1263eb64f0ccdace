"""Temporal URL lists, with DataFrame operations only.

Dated entries (list, pattern, action add or remove, at) become validity intervals: an add
holds until the next entry of the same list and pattern. A capture's host is tested
with all its parent domains; an as-of join finds, per list and pattern, the last interval
begun at or before the fetch time, and whether it still held then. The longest pattern
decides, of equal ones the allow list.

Captures of one host and time are decided once, and a pattern is asked once a time, however
many hosts lie below it. The as-of join runs by pattern and day: each day starts with the
intervals that were open the evening before, so a pattern with a third of all probes is as
many tasks as days. Captures, and hosts of one pattern and time, meet their verdicts by
`join_hot`.

Several entries of one list, pattern and time: remove prevails. Entries without list,
pattern or time never hold, nor do entries of lists other than LISTS. Captures without a
host or time, with a null, empty or malformed url (a host of more than 253 characters, as
no DNS name has, included) are allowed, without a rule; the rest of a url may have any length. Repeated captures are all kept. An empty table of captures gives no
rows, an empty one of entries no rules. Columns of the results' names are replaced, others kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriata.llm.common import join_hot, materialize

LISTS = ("block", "allow")
LONGEST_HOST = 253


def host_of(url: Column) -> Column:
    """Lower-case host; null where there is none or it is longer than a DNS name may be."""
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when((host != "") & (F.length(host) <= LONGEST_HOST), host)


def validity(entries: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_to (null: still valid) of the adds."""
    e = entries.where("pattern is not null and at is not null and list is not null").select("list", F.lower("pattern").alias("pattern"), "at", "action")
    e = e.groupBy("list", "pattern", "at").agg(F.max("action").alias("action"))  # add < remove
    ends = F.lead("at").over(Window.partitionBy("list", "pattern").orderBy("at"))
    return e.withColumn("valid_to", ends).where("action = 'add'").select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")


def day_of(at: Column) -> Column:
    return at.cast("date")


def as_of(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """asked (pattern, at; distinct) with span (list, valid_from, valid_to) of the interval that holds then, allow before block; only rows where one does."""
    span = F.struct("list", "valid_from", "valid_to")
    starts = spans.where(F.col("list").isin(*LISTS)).select("pattern", F.col("valid_from").alias("at"), day_of(F.col("valid_from")).alias("day"), span.alias("span"))
    none = F.lit(None).cast(starts.schema["span"].dataType)
    latest = lambda w, carried: {n: F.last(F.when(F.col("span.list") == n, F.col("span")) if carried is None else F.coalesce(F.when(F.col("span.list") == n, F.col("span")), F.col(f"{carried}.{n}")), ignorenulls=True).over(w) for n in LISTS}
    # what is open when each asked day begins: a row per interval and asked day
    days = asked.select("pattern", day_of(F.col("at")).alias("day")).distinct()
    ends = starts.select("pattern", "day", F.lit(1).alias("kind"), "at", "span").unionByName(days.select("pattern", "day", F.lit(0).alias("kind"), F.lit(None).cast(starts.schema["at"].dataType).alias("at"), none.alias("span")))
    evening = ends.withColumns(latest(Window.partitionBy("pattern").orderBy("day", "kind", "at"), None)).where("kind = 0").select("pattern", "day", F.struct(*LISTS).alias("carried"))
    # within the day: the carried intervals, then starts and questions in order of time
    empty = F.lit(None).cast(evening.schema["carried"].dataType)
    null_at = F.lit(None).cast(starts.schema["at"].dataType)
    rows = evening.select("pattern", "day", F.lit(0).alias("kind"), null_at.alias("at"), none.alias("span"), "carried")
    rows = rows.unionByName(starts.join(days, ["pattern", "day"], "left_semi").select("pattern", "day", F.lit(1).alias("kind"), "at", "span", empty.alias("carried")))
    rows = rows.unionByName(asked.select("pattern", day_of(F.col("at")).alias("day"), F.lit(2).alias("kind"), F.col("at").cast(starts.schema["at"].dataType).alias("at"), none.alias("span"), empty.alias("carried")))
    by = Window.partitionBy("pattern", "day").orderBy(F.col("at").asc_nulls_first(), "kind")
    rows = rows.withColumns(latest(by, "carried")).where("kind = 2")
    held = lambda c: F.when(F.col(c).isNotNull() & (F.col(f"{c}.valid_to").isNull() | (F.col("at") < F.col(f"{c}.valid_to"))), F.col(c))
    return rows.select("pattern", "at", F.coalesce(held("allow"), held("block")).alias("span")).where("span is not null")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched_at, ...) with host, verdict, rule_list, rule_pattern, valid_from, valid_to; these replace columns of the same names."""
    rows = captures.drop("host", "verdict", "rule_list", "rule_pattern", "valid_from", "valid_to").withColumn("host", host_of(F.col("url")))
    whole = F.col("host").isNotNull() & F.col("fetched_at").isNotNull()
    asked = materialize(rows.where(whole).groupBy("host", "fetched_at").agg(F.count("*").alias("_rows")), "urls-asked")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spans = materialize(validity(entries), "urls-spans")
    probes = asked.select("host", F.col("fetched_at").alias("at"), F.explode(parents).alias("pattern")).join(spans.select("pattern").distinct(), "pattern", "left_semi")
    probes = materialize(probes, "urls-probes")
    times = probes.groupBy("pattern", "at").agg(F.count("*").alias("_hosts"))
    hits = as_of(times.select("pattern", "at"), spans).join(times, ["pattern", "at"])
    hits = materialize(hits, "urls-hits")
    found = join_hot(probes, hits, ["pattern", "at"], "_hosts", probes.count())
    best = found.groupBy("host", F.col("at").alias("fetched_at")).agg(F.max_by(F.struct("pattern", "span"), F.length("pattern")).alias("rule"))
    best = best.select("host", "fetched_at", F.col("rule.span.list").alias("rule_list"), F.col("rule.pattern").alias("rule_pattern"), F.col("rule.span.valid_from").alias("valid_from"), F.col("rule.span.valid_to").alias("valid_to"))
    decided = materialize(asked.join(best, ["host", "fetched_at"], "left"), "urls-decided")
    out = join_hot(rows.where(whole), decided, ["host", "fetched_at"], "_rows", rows.count())
    out = out.unionByName(rows.where(~whole), allowMissingColumns=True)
    return out.withColumn("verdict", F.when(F.col("rule_list") == "block", "blocked").otherwise("allowed"))
