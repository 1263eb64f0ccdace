"""Registered queries of the order-audit operators, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriata.functions.columns import finite, is_close, token
from seriata.functions.stats import normal_isf
from seriata.operators import assoc, contract, diagnose, downstream, features, joins, order, reports, split
from seriata.plans import inputs, pipelines, sql
from seriata.plans.inputs import ARMS, CHANNELS, HOURLY, SERIES, USER_SERIES, VECTORS, H, L, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def aot_sql(ctes: str, source: str, key: str, p: str = "") -> str:
    """p: text for the p column, after z."""
    return f"""
with {ctes},
c1 as (select {key}, pos, value - avg(value) over (partition by {key}) as c from {source}),
c2 as (select {key}, c, coalesce(lead(c) over (partition by {key} order by pos), first_value(c) over (partition by {key} order by pos)) as nx from c1),
m as (select {key}, count(*) as n, sum(c * nx) as num, sum(c * c) as s2, sum(c * c * c * c) as s4 from c2 group by {key}),
k as (select *, case when n >= 4 and s2 > 1e-24 * n then num / s2 end as r, case when n >= 4 and s2 > 1e-24 * n then -1.0 / (n - 1) end as null_mean,
        case when n >= 4 and s2 > 1e-24 * n then ((s2 * s2 - s4) / (n - 1) + (s2 * s2 - 2 * s4) / ((n - 1.0) * (n - 2)) - s2 * s2 / ((n - 1.0) * (n - 1))) / (s2 * s2) end as var from m)
select {key}, n, round(r, 6) + 0.0::double as r, round(null_mean, 6) + 0.0::double as null_mean, case when var > 0 then round(sqrt(var), 6) end as null_sd,
       case when var > 0 then round((r - null_mean) / sqrt(var), 6) + 0.0::double end as z,{p}
       case when var > 0 and (r - null_mean) / sqrt(var) > 1.6448536269514722 then 1 else 0 end as reject
from k"""


def aot_table(df: DataFrame, key: list[str]) -> DataFrame:
    out = diagnose.aot_statistics(diagnose.aot_moments(df, key))
    out = out.withColumn("reject", diagnose.aot_certified(F.col("z")))
    return rounded(out, "r", "null_mean", "null_sd", "z").select(*key, "n", "r", "null_mean", "null_sd", "z", "reject")


#: In the aot_sql query: the p of z, undefined where z is.
P_COLUMN = f" case when var > 0 then round({sql.normal_sf('((r - null_mean) / sqrt(var))')}, 6) + 0.0::double end as p,"


def permuted_sql(source: str, key: str, seed: str, name: str = "p") -> str:
    parts = ", ".join(k.strip() for k in key.split(","))
    return f"{name} as (select {key}, row_number() over (partition by {key} order by md5(concat_ws('|', '{seed}', {parts}, pos)), pos) - 1 as pos, value from {source})"


@query(aot_sql(SERIES, "s", "series_id"))
def aot_by_event_type(spark, sf_dir):
    return aot_table(inputs.series(spark, sf_dir), ["series_id"])


@query(aot_sql(USER_SERIES, "s", "series_id"))
def aot_by_user(spark, sf_dir):
    return aot_table(inputs.series(spark, sf_dir, "user_id"), ["series_id"])


@query(aot_sql(ARMS, "a", "g, arm"))
def aot_forecaster_errors(spark, sf_dir):
    return aot_table(inputs.arms(spark, sf_dir), ["g", "arm"])


@query(aot_sql(f"{ARMS}, {permuted_sql('a', 'g, arm', 'shuffle')}", "p", "g, arm"))
def aot_shuffled(spark, sf_dir):
    a = inputs.arms(spark, sf_dir)
    key = ["g", "arm"]
    return aot_table(order.apply_permutation(a, order.full_permutation(a, key, "shuffle"), key), key)


def _blocks_sql(block: int) -> str:
    return f"p as (select g, arm, row_number() over (partition by g, arm order by md5(concat_ws('|', 'blocks', g, arm, pos // {block})), pos // {block}, pos) - 1 as pos, value from a)"


@query(aot_sql(f"{ARMS}, {_blocks_sql(32)}", "p", "g, arm"))
def aot_block_shuffled(spark, sf_dir):
    a = inputs.arms(spark, sf_dir)
    key = ["g", "arm"]
    return aot_table(order.apply_permutation(a, order.block_permutation(a, key, 32, "blocks"), key), key)


_PARTIAL = """
x1 as (select *, md5(concat_ws('|', 'part/pick', g, arm, pos)) as hp, md5(concat_ws('|', 'part/move', g, arm, pos)) as hm, count(*) over (partition by g, arm) as n from a),
x2 as (select *, row_number() over (partition by g, arm order by hp, pos) as rp from x1),
x3 as (select * from x2 where rp <= round_even(0.25 * n, 0) and round_even(0.25 * n, 0) >= 2),
mv as (select d.g, d.arm, d.pos, s.value from (select *, row_number() over (partition by g, arm order by pos) as k from x3) d
       join (select *, row_number() over (partition by g, arm order by hm, pos) as k from x3) s on d.g = s.g and d.arm = s.arm and d.k = s.k),
p as (select * from mv union all select g, arm, pos, value from a where not exists (select 1 from x3 where x3.g = a.g and x3.arm = a.arm and x3.pos = a.pos))"""


@query(aot_sql(f"{ARMS}, {_PARTIAL}", "p", "g, arm"))
def aot_partial_shuffled(spark, sf_dir):
    a = inputs.arms(spark, sf_dir)
    key = ["g", "arm"]
    return aot_table(order.apply_permutation(a, order.partial_permutation(a, key, 0.25, "part"), key), key)


STRIDES = (1, 4, 16, 64, 192, 512)


@query(aot_sql(f"{ARMS}, p as (select a.*, s.stride from a, (select unnest([1, 4, 16, 64, 192, 512]) as stride) s where a.pos % s.stride = 0)", "p", "g, arm, stride"))
def aot_strided_battery(spark, sf_dir):
    return aot_table(order.strided(inputs.arms(spark, sf_dir), STRIDES), ["g", "arm", "stride"])


@query(f"""with {ARMS}, {permuted_sql('a', 'g, arm', 'shuffle')}, i as (select g, arm, avg(value) as m, count(*) as n, list(value order by value) as l from a group by 1, 2), j as (select g, arm, avg(value) as m, count(*) as n, list(value order by value) as l from p group by 1, 2)
select g, arm, i.n as n_a, j.n as n_b, round(abs(j.m - i.m) / abs(i.m), 6) as mean_rel_diff, i.l = j.l as multiset_equal from i join j using (g, arm)""")
def order_masking_check(spark, sf_dir):
    a = inputs.arms(spark, sf_dir)
    p = order.apply_permutation(a, order.full_permutation(a, ["g", "arm"], "shuffle"), ["g", "arm"])
    return rounded(diagnose.masking_check(a, p, ["g", "arm"]), "mean_rel_diff")


_RANKED = "r as (select *, rank() over (partition by {k} order by value) + (count(*) over (partition by {k}, value) - 1) / 2.0 as rk from {t})"


def rho_bar_sql(ctes: str, source: str, key: str) -> str:
    return f"""with {ctes}, {_RANKED.format(k=key + ', arm', t=source)},
pr as (select x.{key}, x.arm as a1, y.arm as a2, corr(x.rk, y.rk) as rho, count(*) as n from r x join r y on x.{key} = y.{key} and x.pos = y.pos and x.arm < y.arm group by 1, 2, 3)
select {key}, 4 as n_arms, max(n) as n, round(avg(rho), 6) + 0.0::double as rho_bar, round(avg(rho) * sqrt(6.0 * (max(n) - 1)), 6) + 0.0::double as z_corrected, round(avg(rho) * sqrt(max(n) - 1), 6) + 0.0::double as z_naive from pr group by 1"""


def agreement_table(df: DataFrame) -> DataFrame:
    return rounded(diagnose.agreement(df, ["g"]), "rho_bar", "z_corrected", "z_naive").select("g", F.col("n_arms").cast("int").alias("n_arms"), "n", "rho_bar", "z_corrected", "z_naive")


@query(rho_bar_sql(ARMS, "a", "g"))
def cat_rho_bar(spark, sf_dir):
    return agreement_table(inputs.arms(spark, sf_dir))


@query(f"with {ARMS}, {_RANKED.format(k='g, arm', t='a')} select x.g, x.arm as arm_a, y.arm as arm_b, round(corr(x.rk, y.rk), 6) + 0.0::double as rho, count(*) as n from r x join r y on x.g = y.g and x.pos = y.pos and x.arm < y.arm group by 1, 2, 3")
def cat_pairwise_spearman(spark, sf_dir):
    return rounded(diagnose.pairwise_spearman(inputs.arms(spark, sf_dir), ["g"]), "rho")


def _shared_sql(label: str, condition: str) -> str:
    return f"""ai as (select *, dense_rank() over (partition by g order by arm) - 1 as i from a), al as (select *, {label} as label from ai),
o as (select distinct g, label, pos from al), op as (select g, label, pos as src, row_number() over (partition by g, label order by md5(concat_ws('|', 'share/{condition}', g, label, pos)), pos) - 1 as pos from o),
sh as (select al.g, al.arm, op.pos, al.value from al join op on al.g = op.g and al.label = op.label and al.pos = op.src)"""


@query(rho_bar_sql(f"{ARMS}, {_shared_sql('greatest(0, i - 1)', 'shared_k2')}", "sh", "g"))
def cat_shared_k2(spark, sf_dir):
    return agreement_table(order.inject_sharing(inputs.arms(spark, sf_dir), ["g"], "shared_k2", "share"))


@query(rho_bar_sql(f"{ARMS}, {_shared_sql('i', 'independent')}", "sh", "g"))
def cat_independent(spark, sf_dir):
    return agreement_table(order.inject_sharing(inputs.arms(spark, sf_dir), ["g"], "independent", "share"))


def _conditions_sql() -> str:
    labels = {"independent": "i", "all_shared": "0", "shared_k3": "greatest(0, i - 2)", "shared_k2": "greatest(0, i - 1)", "two_pairs": "i // 2"}
    parts = ["select 'intact' as condition, * from a"]
    ctes = []
    for name, label in labels.items():
        body = _shared_sql(label, name)
        for t in ("ai", "al", "o", "op", "sh"):
            body = body.replace(f"{t} as (", f"{t}_{name} as (").replace(f"from {t}", f"from {t}_{name}").replace(f"join {t} ", f"join {t}_{name} {t} ")
        body = body.replace(f"from al_{name} join", f"from al_{name} al join")
        ctes.append(body)
        parts.append(f"select '{name}', g, arm, pos, value from sh_{name}")
    return f"{ARMS}, {', '.join(ctes)}, cond as ({' union all '.join(parts)})"


@query(f"""with {_conditions_sql()}, r as (select *, rank() over (partition by condition, arm order by value) + (count(*) over (partition by condition, arm, value) - 1) / 2.0 as rk from cond),
pr as (select x.condition, corr(x.rk, y.rk) as rho from r x join r y on x.condition = y.condition and x.pos = y.pos and x.arm < y.arm group by x.condition, x.arm, y.arm)
select condition, round(avg(rho), 6) + 0.0::double as rho_bar from pr group by 1""")
def cat_conditions(spark, sf_dir):
    out = order.inject_conditions(inputs.arms(spark, sf_dir), ["g"], order.SHARING, "share")
    return rounded(diagnose.agreement(out, ["condition"]), "rho_bar").select("condition", "rho_bar")


@query("select doc_id, lang, n_chars, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as rank from documents")
def rank_average_ties(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "n_chars", diagnose.average_rank("n_chars", ["lang"]).alias("rank"))


@query("""with d as (select d.lang, d.n_chars, l.quality from documents d join labels l using (doc_id)),
r as (select lang, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as x, rank() over (partition by lang order by quality) + (count(*) over (partition by lang, quality) - 1) / 2.0 as y from d)
select lang, case when not isnan(corr(x, y)) then round(corr(x, y), 6) + 0.0::double end as rho, count(*) as n from r group by lang""")
def spearman_rank(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars")).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("quality", F.col("quality").cast("double"))
    return rounded(assoc.spearman(d, ["lang"], "n_chars", "quality"), "rho")


_W = "w as (select {k}o.t as window_origin, x.t - o.t as i, x.value as v, n.value as nv from {t} o join {t} x on x.t between o.t and o.t + {l1}{j} left join {t} n on n.t = x.t + 1{jn} where o.t <= (select max(t) from {t}) - {l} - {h} + 1)"


@query(f"""with {HOURLY}, {_W.format(k='', t='h', l1=L - 1, l=L, h=H, j='', jn='')},
m as (select window_origin, avg(v) as m, stddev_pop(v) as sd, var_pop(v) as var, max(v) - min(v) as rg, avg(abs(nv - v)) filter (i < {L - 1}) as ad, covar_pop(v, i) / (stddev_pop(i) + 1e-12) as sl, avg(v) filter (i >= {L // 2}) - avg(v) filter (i < {L // 2}) as dr, max(v) filter (i = {L - 1}) as lv from w group by 1),
c as (select window_origin, sum((v - m) * (nv - m)) filter (i < {L - 1}) as lag, sum(pow(v - m, 4)) / {L} as m4 from w join m using (window_origin) group by 1)
select 'hourly' as g, 0 as channel, window_origin, round(sd, 6) as f_std, round(rg, 6) as f_range, round(ad, 6) as f_absdiff, round(sl, 6) + 0.0::double as f_slope, round(lag / ({L} * var + 1e-12), 6) + 0.0::double as f_acf1, round(abs(dr) / (sd + 1e-12), 6) as f_drift, round(abs(lv - m) / (sd + 1e-12), 6) as f_last_dev, round(m4 / (var * var), 6) as f_kurtosis
from m join c using (window_origin)""")
def window_features_native(spark, sf_dir):
    h = inputs.hourly(spark, sf_dir).withColumn("g", F.lit("hourly")).withColumn("channel", F.lit(0))
    return rounded(features.channel_features(h, ["g"], L, H), *features.NATIVE)


@query(f"""with {CHANNELS}, p as (select a.t, a.channel as a, b.channel as b, a.value as x, b.value as y from ch a join ch b on a.t = b.t and a.channel < b.channel),
e as (select a, b, max(t) as last from p group by 1, 2), o as (select p.t as window_origin, p.a, p.b from p join e using (a, b) where p.t <= e.last - 7 - 2 + 1),
c as (select o.window_origin, o.a, o.b, abs(covar_pop(p.x, p.y)) / (stddev_pop(p.x) * stddev_pop(p.y) + 1e-12) as c from o join p on p.a = o.a and p.b = o.b and p.t between o.window_origin and o.window_origin + 6 group by 1, 2, 3)
select 'events' as dataset, window_origin, round(avg(c), 6) as f_cross_corr from c group by 2""")
def window_features_cross_corr(spark, sf_dir):
    return rounded(features.cross_correlation(inputs.channels(spark, sf_dir), ["dataset"], 7, 2), "f_cross_corr")


_DAYS, _AHEAD = 7, 2
_FREQUENCIES = _DAYS // 2


@query(f"""with {CHANNELS}, ends as (select channel, max(t) as last from ch group by 1),
w as (select o.channel, o.t as window_origin, x.t - o.t as i, x.value as v, n.value as nv from ch o join ends e on e.channel = o.channel and o.t <= e.last - {_DAYS + _AHEAD - 1} join ch x on x.channel = o.channel and x.t between o.t and o.t + {_DAYS - 1} left join ch n on n.channel = x.channel and n.t = x.t + 1),
m as (select channel, window_origin, avg(v) as m, stddev_pop(v) as sd, var_pop(v) as var, max(v) - min(v) as rg, avg(abs(nv - v)) filter (i < {_DAYS - 1}) as ad, covar_pop(v, i) / (stddev_pop(i) + 1e-12) as sl, avg(v) filter (i >= {_DAYS // 2}) - avg(v) filter (i < {_DAYS // 2}) as dr, max(v) filter (i = {_DAYS - 1}) as lv from w group by 1, 2),
c as (select channel, window_origin, sum((v - m) * (nv - m)) filter (i < {_DAYS - 1}) as lag, sum(pow(v - m, 4)) / {_DAYS} as m4 from w join m using (channel, window_origin) group by 1, 2),
own as (select window_origin, avg(sd) as f_std, avg(rg) as f_range, avg(ad) as f_absdiff, avg(sl) as f_slope, avg(lag / ({_DAYS} * var + 1e-12)) as f_acf1, avg(abs(dr) / (sd + 1e-12)) as f_drift, avg(abs(lv - m) / (sd + 1e-12)) as f_last_dev, avg(case when var > 0 then m4 / (var * var) else 0 end) as f_kurtosis from m join c using (channel, window_origin) group by 1),
mean as (select t, avg(value) as v from ch group by 1), mw as (select o.t as window_origin, x.t - o.t as i, x.v - avg(x.v) over (partition by o.t) as v from mean o join mean x on x.t between o.t and o.t + {_DAYS - 1} where o.t <= (select max(t) from mean) - {_DAYS + _AHEAD - 1}),
power as (select window_origin, f, pow(sum(v * cos(2 * pi() * f * i / {_DAYS})), 2) + pow(sum(v * sin(2 * pi() * f * i / {_DAYS})), 2) as p from mw, range(1, {_FREQUENCIES + 1}) r(f) group by 1, 2),
spec as (select window_origin, -sum(q * ln(q + 1e-12)) / ln({max(_FREQUENCIES, 2)}) as f_spec_ent from (select window_origin, p / (sum(p) over (partition by window_origin) + 1e-12) as q from power) group by 1),
pairs as (select a.window_origin, abs(covar_pop(a.v, b.v)) / (stddev_pop(a.v) * stddev_pop(b.v) + 1e-12) as c from w a join w b on a.window_origin = b.window_origin and a.i = b.i and a.channel < b.channel group by a.window_origin, a.channel, b.channel),
cross_c as (select window_origin, avg(c) as f_cross_corr from pairs group by 1)
select 'events' as dataset, window_origin, {", ".join(f"round({f}, 6) + 0.0::double as {f}" for f in features.FEATURES)} from own join spec using (window_origin) join cross_c using (window_origin)""")
def window_features_all(spark, sf_dir):
    return rounded(features.window_features(inputs.channels(spark, sf_dir), ["dataset"], _DAYS, _AHEAD), *features.FEATURES)


@query(f"with {ARMS} select g, arm, pos, round(value, 4) as value from a")
def forecaster_errors(spark, sf_dir):
    return rounded(inputs.arms(spark, sf_dir), "value", digits=4)


_CELLS = "cells as (select source as cell, count(*) as n, 6 + (min(doc_id) % 5)::int as seq_len, 2 as pred_len from documents group by 1)"


def cells(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("cell")).agg(F.count("*").alias("n"), (6 + F.min("doc_id") % 5).cast("int").alias("seq_len"), F.lit(2).alias("pred_len"))


def _audit_sql(mode: str) -> str:
    gap = "pred_len" if mode == "labels" else "seq_len + pred_len"
    shared = "tgt" if mode == "labels" else "shd"
    return f"""with {_CELLS}, p as (select *, ceil(({gap} - 1) / 2.0)::bigint as purge, floor(n * 0.5)::bigint as cut from cells),
b as (select *, greatest(cut - purge, 0) as n_train_windows, least(cut + purge, n) as start from p),
e as (select *, n - start as n_eval_windows, case when n_train_windows > 0 then n_train_windows - 1 end as last, case when n - start > 0 then start end as first from b),
s as (select *, greatest(0, last + seq_len + pred_len - first) as shd, greatest(0, last + seq_len + pred_len - first - seq_len) as tgt, last is not null and first is not null as live from e)
select cell, n, seq_len, pred_len, '{mode}' as purge_mode, purge as purge_origins, n_train_windows, n_eval_windows, ({gap})::bigint as required_origin_gap, last as last_train_origin, first as first_eval_origin,
 case when live then first - last end as min_origin_gap_actual, case when live then last + seq_len + pred_len end as last_train_target_end, case when live then first + seq_len end as first_eval_target_start,
 case when live then shd end as shared_timepoints_at_boundary, case when live then tgt end as shared_target_points_at_boundary, case when live and {shared} = 0 then 1 else 0 end as boundary_ok,
 case when n_train_windows >= 10 and n_eval_windows >= 10 and live and {shared} = 0 then 1 else 0 end as holdout_eligible from s"""


@query(_audit_sql("disjoint"))
def purge_audit_disjoint(spark, sf_dir):
    return split.audited_split(cells(spark, sf_dir), "disjoint", min_windows=10)


@query(_audit_sql("labels"))
def purge_audit_labels(spark, sf_dir):
    return split.audited_split(cells(spark, sf_dir), "labels", min_windows=10)


@query(f"with {VECTORS}, z as (select *, count(*) over (partition by source, lang) as n from v) select source, lang, doc_id, case when pos < greatest(floor(n * 0.5) - 3, 1) then 'train' when pos >= least(floor(n * 0.5) + 3, n - 1) then 'holdout' end as side from z")
def purged_split_sides(spark, sf_dir):
    v = inputs.vectors(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("source", "lang"))
    return split.purged_split(v.withColumn("n", n), F.col("n"), F.lit(3)).select("source", "lang", "doc_id", "side")


@query(f"""with {_CELLS}, f as (select *, (seq_len + pred_len)::bigint as cover, (select min(k) from range(1, 100000) t(k) where k * k * k >= cells.n) as fl from cells), u as (select *, greatest(cover, fl) as want, greatest(1, least(greatest(cover, fl), n // 2)) as used from f)
select cell, used as block_len, want as block_len_requested, cover as block_len_cover, fl as block_len_floor, case when used < want then 1 else 0 end as block_len_capped, ceil(n / used)::bigint as n_blocks from u""")
def block_length(spark, sf_dir):
    c = cells(spark, sf_dir)
    return c.select("cell", *[v.cast("bigint" if k != "block_len_capped" else "int").alias(k) for k, v in assoc.block_length(F.col("n"), F.col("seq_len"), F.col("pred_len")).items()])


@query("""with d as (select d.lang, d.n_chars::double as x, l.quality::double as y from documents d join labels l using (doc_id)), q as (select lang, quantile_cont(x, 0.1) as a, quantile_cont(x, 0.9) as b from d group by 1)
select lang, round(avg(y) filter (x >= b) / nullif(avg(y) filter (x <= a), 0), 6) as decile_ratio from d join q using (lang) group by lang""")
def decile_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("x")).join(table(spark, sf_dir, "labels"), "doc_id").withColumn("y", F.col("quality").cast("double"))
    return rounded(assoc.decile_ratio(d, ["lang"], "x", "y"), "decile_ratio")


def hourly_association(spark, sf_dir) -> DataFrame:
    h = inputs.hourly(spark, sf_dir).withColumn("g", F.lit("hourly")).withColumn("channel", F.lit(0))
    x = features.channel_features(h, ["g"], L, H).withColumnRenamed("window_origin", "pos").drop("channel")
    y = inputs.arms(spark, sf_dir).where("arm = 'mean'").select("g", "pos", "value")
    return rounded(x.join(y, ["g", "pos"]), *features.NATIVE, "value", digits=9)  # windows of equal values tie in every engine


#: The native features of the hourly series beside the errors of the mean forecaster: CTE x.
HOURLY_ASSOCIATION = f"""{ARMS}, {_W.format(k='', t='h', l1=L - 1, l=L, h=H, j='', jn='')},
m as (select window_origin, avg(v) as m, stddev_pop(v) as sd, var_pop(v) as var, max(v) - min(v) as rg, avg(abs(nv - v)) filter (i < {L - 1}) as ad, covar_pop(v, i) / (stddev_pop(i) + 1e-12) as sl, avg(v) filter (i >= {L // 2}) - avg(v) filter (i < {L // 2}) as dr, max(v) filter (i = {L - 1}) as lv from w group by 1),
c as (select window_origin, sum((v - m) * (nv - m)) filter (i < {L - 1}) as lag, sum(pow(v - m, 4)) / {L} as m4 from w join m using (window_origin) group by 1),
x as (select 'hourly' as g, window_origin as pos, {", ".join(f"round({e}, 9) + 0.0::double as {n}" for n, e in {"f_std": "sd", "f_range": "rg", "f_absdiff": "ad", "f_slope": "sl", "f_acf1": f"lag / ({L} * var + 1e-12)", "f_drift": "abs(dr) / (sd + 1e-12)", "f_last_dev": "abs(lv - m) / (sd + 1e-12)", "f_kurtosis": "m4 / (var * var)", "value": "a.value"}.items())}
      from m join c using (window_origin) join a on a.pos = m.window_origin and a.arm = 'mean')"""
_LONG = " union all ".join(f"select g, {i} as k, '{f}' as f, {f} as x, value from x" for i, f in enumerate(features.NATIVE))


@query(f"""with {HOURLY_ASSOCIATION}, l as ({_LONG}), {sql.ranked('r', 'l', 'g, f', rx='x', ry='value')}, p as (select g, k, f, corr(rx, ry) as rho, count(*) as n from r group by 1, 2, 3),
q as (select g, quantile_cont(f_std, 0.1) as a, quantile_cont(f_std, 0.9) as b from x group by 1), dr as (select x.g, avg(value) filter (f_std >= b) / avg(value) filter (f_std <= a) as d from x join q on x.g = q.g group by 1),
s as (select g, {", ".join(f"max(rho) filter (f = '{f}') as rho_{f}" for f in features.NATIVE)}, avg(abs(rho)) as mean_abs, max(n) as n, arg_max(rho, abs(rho) - k * 1e-13) as best, arg_max(f, abs(rho) - k * 1e-13) as best_f from p group by 1),
z as (select s.*, d, rho_f_std * sqrt(n - 1) as z from s join dr on dr.g = s.g)
select g, {", ".join(f"round(rho_{f}, 6) + 0.0::double as rho_{f}" for f in features.NATIVE)}, round(mean_abs, 6) as assoc_abs_rho_mean, n, round(best, 6) as assoc_rho_best, best_f as assoc_rho_best_feature, round(z, 6) as assoc_z_fstd, round(d, 6) as decile_ratio_fstd, round(2 * {sql.normal_sf('abs(z)')}, 6) + 0.0::double as assoc_p_iid_naive from z""")
def association_features(spark, sf_dir):
    df = hourly_association(spark, sf_dir)
    out = assoc.with_naive_p(assoc.association(df, ["g"], list(features.NATIVE), "value"))
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query(f"""with {ARMS}, b as (select pos, arg_min(arm, struct_pack(v := value, a := arm)) as label from a group by pos), f as (select label, count(*) / sum(count(*)) over () as f, count(*) as c from b group by label),
fx as (select arg_min(arm, struct_pack(v := m, a := arm)) as arm from (select arm, avg(value) as m from a group by arm))
select 'hourly' as g, arm as best_fixed_arm, (select label from f order by c desc, label limit 1) as modal_arm, round((select max(f) from f), 6) as modal_share, round((select sum(-f * log2(f)) from f), 6) as entropy_bits,
 round(coalesce((select f from f where label = fx.arm), 0.0), 6) as best_fixed_share, case when (select label from f order by c desc, label limit 1) = fx.arm then 1 else 0 end as modal_is_best_fixed from fx""")
def label_law(spark, sf_dir):
    return rounded(downstream.label_law(inputs.arms(spark, sf_dir), ["g"]), "modal_share", "entropy_bits", "best_fixed_share")


@query(f"with {ARMS} select g, pos, arg_min(arm, struct_pack(v := value, a := arm)) as label, round(min(value), 4) as best, round(avg(value), 4) as mean from a group by 1, 2")
def arm_argmin_labels(spark, sf_dir):
    return rounded(downstream.best_arms(inputs.arms(spark, sf_dir), ["g"]), "best", "mean", digits=4)


@query(f"""with {ARMS}, cut as (select max(pos) // 2 as c from a), f as (select arm, avg(value) as m from a, cut where pos < c group by 1), bf as (select arg_min(arm, struct_pack(v := m, a := arm)) as arm, count(*) as n_arms from f),
t as (select a.* from a, cut where pos >= c), o as (select avg(b) as oracle_mse, avg(m) as random_arm_mse from (select min(value) as b, avg(value) as m from t group by pos)), x as (select avg(value) as best_fixed_mse from t, bf where t.arm = bf.arm)
select 'hourly' as g, arm as best_fixed_arm, n_arms, round(best_fixed_mse, 6) as best_fixed_mse, round(oracle_mse, 6) as oracle_mse, round(random_arm_mse, 6) as random_arm_mse, round(100 * (best_fixed_mse - oracle_mse) / best_fixed_mse, 6) as oracle_headroom_pct from bf, o, x""")
def oracle_headroom(spark, sf_dir):
    a = inputs.arms(spark, sf_dir)
    c = a.agg(F.floor(F.max("pos") / 2).alias("c"))
    both = a.crossJoin(F.broadcast(c))
    out = downstream.headroom(both.where("pos < c").drop("c"), both.where("pos >= c").drop("c"), ["g"])
    return rounded(out, "best_fixed_mse", "oracle_mse", "random_arm_mse", "oracle_headroom_pct")


def paired_lines(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.concat_ws("-", "l_suppkey", (F.col("l_partkey") % 7).cast("string")).alias("block_id"), F.when(F.col("l_returnflag") == "N", "index").when(F.col("l_returnflag") == "A", "defect").otherwise("control").alias("condition"), F.col("l_discount").alias("value"))


_PAIRED = """p as (select concat_ws('-', l_suppkey, l_partkey % 7) as block_id, case l_returnflag when 'N' then 'index' when 'A' then 'defect' else 'control' end as condition, l_discount as value from lineitem),
m as (select block_id, condition, avg(value) as v from p group by 1, 2), d as (select c.condition, c.block_id, b.v as b, c.v as v, c.v - b.v as d from m c join m b on b.block_id = c.block_id and b.condition = 'index' where c.condition != 'index')"""


@query(f"with {_PAIRED} select condition, count(*) as n_blocks, round(avg(b), 6) as mean_index, round(avg(v), 6) as mean_condition, round(avg(d), 6) + 0.0::double as mean_diff, round(median(d), 6) + 0.0::double as median_diff from d group by 1 having count(*) >= 3")
def paired_diff_summary(spark, sf_dir):
    out = assoc.paired_summary(paired_lines(spark, sf_dir), "block_id", "condition", "value", ["defect", "control"])
    return rounded(out, "mean_index", "mean_condition", "mean_diff", "median_diff").select("condition", "n_blocks", "mean_index", "mean_condition", "mean_diff", "median_diff")


def order_pairs(spark, sf_dir) -> DataFrame:
    """Differences of order totals from the customer's mean, in whole units: ties are exact. The mean is summed in the order of the keys, as a whole mean's last digit moves its floor by one."""
    o = table(spark, sf_dir, "orders")
    m = F.floor(F.avg(F.col("o_totalprice")).over(inputs.whole("o_custkey", by=("o_orderkey", "o_totalprice"))))
    return o.select("o_orderpriority", "o_custkey", (F.floor("o_totalprice") - m).cast("double").alias("d"))


_PAIRS = "d as (select o_orderpriority, o_custkey, (floor(o_totalprice) - floor(avg(o_totalprice) over (partition by o_custkey)))::double as d from orders)"


@query(f"""with {_PAIRS}, x as (select *, abs(d) as a from d where d != 0), r as (select *, rank() over (partition by o_orderpriority order by a) + (count(*) over (partition by o_orderpriority, a) - 1) / 2.0 as r, count(*) over (partition by o_orderpriority, a) as t from x),
g as (select o_orderpriority, count(*) as n, least(sum(case when d > 0 then r else 0 end), sum(case when d < 0 then r else 0 end)) as w, sum(t * t - 1)::bigint as ties from r group by 1)
select o_orderpriority, n, round(w, 6) as w, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24.0 - ties / 48.0), 6) + 0.0::double as z, ties from g""")
def signed_rank(spark, sf_dir):
    return rounded(assoc.signed_rank(order_pairs(spark, sf_dir), ["o_orderpriority"], "d"), "w", "z")


@query(f"with {_PAIRS}, g as (select o_orderpriority, count(*) as n, avg(d) as m, stddev_samp(d) as sd from d group by 1) select o_orderpriority, n, round(m, 4) + 0.0::double as mean_diff, round(sd, 4) as sd_diff, 1000.0::double as margin, round((m + 1000) / (sd / sqrt(n)), 6) + 0.0::double as t_lower, round((m - 1000) / (sd / sqrt(n)), 6) + 0.0::double as t_upper from g")
def tost_moments(spark, sf_dir):
    out = assoc.equivalence_moments(order_pairs(spark, sf_dir), ["o_orderpriority"], "d", 1000.0).drop("se")
    return rounded(out.withColumn("mean_diff", F.round("mean_diff", 4) + 0.0).withColumn("sd_diff", F.round("sd_diff", 4)), "t_lower", "t_upper")


def _tost_sql(source: str, key: str, value: str, margin: float, more: str = "") -> str:
    """Figures of the equivalence test per key; source is a name."""
    return f"""tg as (select {key}, count(*) as n, avg({value}) as mean_diff, stddev_samp({value}) as sd_diff{more} from {source} group by {key}),
te as (select *, sd_diff / sqrt(n) as se, (mean_diff + {margin}) / (sd_diff / sqrt(n)) as t_lower, (mean_diff - {margin}) / (sd_diff / sqrt(n)) as t_upper, n - 1.0 as df from tg),
tt as (select *, greatest({sql.t_sf('t_lower', 'df')}, 1 - {sql.t_sf('t_upper', 'df')}) as p_tost, {sql.t_upper_025('df')} * se as half from te)"""


_TOST_COLUMNS = "round(mean_diff, 4) + 0.0::double as mean_diff, round(sd_diff, 4) as sd_diff, round(t_lower, 4) + 0.0::double as t_lower, round(t_upper, 4) + 0.0::double as t_upper, round(p_tost, 6) + 0.0::double as p_tost, case when p_tost < 0.05 then 1 else 0 end as equivalent_at_05, round(mean_diff - half, 4) + 0.0::double as ci95_low, round(mean_diff + half, 4) + 0.0::double as ci95_high"


def _tost_rounded(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "p_tost"), "mean_diff", "sd_diff", "t_lower", "t_upper", "ci95_low", "ci95_high", digits=4)


@query(f"with {_PAIRS}, {_tost_sql('d', 'o_orderpriority', 'd', 1000.0)} select o_orderpriority, n, 1000.0::double as margin, {_TOST_COLUMNS} from tt")
def tost_equivalence(spark, sf_dir):
    return _tost_rounded(assoc.equivalence_test(order_pairs(spark, sf_dir), ["o_orderpriority"], "d", 1000.0))


@query(f"""with {_PAIRS}, cm as (select o_orderpriority, o_custkey, avg(d) as v, count(*) as cells from d group by 1, 2), {_tost_sql('cm', 'o_orderpriority', 'v', 5000.0, ', sum(cells)::bigint as n_cells')}
select o_orderpriority, n, 5000.0::double as margin, {_TOST_COLUMNS}, n as n_clusters, n_cells from tt""")
def tost_clustered(spark, sf_dir):
    return _tost_rounded(assoc.equivalence_test_clustered(order_pairs(spark, sf_dir), ["o_orderpriority"], "o_custkey", "d", 5000.0))


@query(f"with {_PAIRS} select o_orderpriority, o_custkey, round(avg(d), 6) + 0.0::double as cluster_mean, count(*) as cells from d group by 1, 2")
def cluster_means(spark, sf_dir):
    return rounded(assoc.cluster_means(order_pairs(spark, sf_dir), ["o_orderpriority"], "o_custkey", "d"), "cluster_mean")


@query("""with r as (select l_suppkey, l_returnflag, l_linestatus, sum(l_quantity) as q from lineitem group by 1, 2, 3), j as (select a.l_suppkey, a.l_returnflag, a.q as a, b.q as b from r a join r b on a.l_suppkey = b.l_suppkey and a.l_returnflag = b.l_returnflag where a.l_linestatus = 'F' and b.l_linestatus = 'O')
select l_suppkey, l_returnflag, a, b, round(100 * (b - a) / nullif(a, 0), 6) + 0.0::double as rel_diff_pct, round(abs(100 * (b - a) / nullif(a, 0)), 6) as abs_rel_diff_pct from j""")
def rng_tax_pairs(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    return rounded(joins.paired_runs(r, ["l_suppkey", "l_returnflag"], "l_linestatus", "F", "O", "q"), "rel_diff_pct", "abs_rel_diff_pct")


@query(f"with {VECTORS}, i as (select *, concat_ws('|', 'window_origin/v1', source, lang, 'L96', 'H336', 'w' || pos) as sample_id from v) select sample_id, doc_id as pos, value as chars, quality::double as quality from i join labels using (doc_id)")
def join_by_sample_id(spark, sf_dir):
    """All documents against the labelled ones, by id."""
    v = inputs.vectors(spark, sf_dir)
    ids = v.select(contract.sample_id(F.col("source"), F.col("lang"), F.lit(96), F.lit(336), F.col("pos")).alias("sample_id"), "doc_id", "value")
    labelled = ids.join(table(spark, sf_dir, "labels"), "doc_id").select("sample_id", F.col("quality").cast("double").alias("value"))
    return joins.join_by_sample_id({"chars": ids.withColumnRenamed("doc_id", "pos"), "quality": labelled})


_IDS = "i as (select *, concat_ws('|', 'window_origin/v1', source, lang, 'L96', 'H336', 'w' || pos) as sample_id from v)"


def _digest_sql(source: str) -> str:
    return f"dg as (select source, lang, count(*) as n, 'sha256:' || sha256('order-audit/ordered-sample-ids/v1' || chr(10) || 'count=' || count(*) || chr(10) || string_agg(strlen(sample_id) || ':' || sample_id || chr(10), '' order by pos)) as digest from {source} group by 1, 2)"


@query(f"with {VECTORS}, {_IDS}, {_digest_sql('i')} select * from dg")
def ordered_id_digest(spark, sf_dir):
    v = inputs.vectors(spark, sf_dir)
    ids = v.withColumn("sample_id", contract.sample_id(F.col("source"), F.col("lang"), F.lit(96), F.lit(336), F.col("pos")))
    return contract.ordered_digest(ids, ["source", "lang"])


#: The little-endian bytes, in hexadecimal, of a whole number as a double.
_BITS = "(case when value = 0 then 0::bigint else ((floor(log2(value))::bigint + 1023) << 52) + ((value - pow(2, floor(log2(value)))) * pow(2, 52 - floor(log2(value))))::bigint end)"
_BYTES = "(" + " || ".join(f"substr(h, {15 - 2 * i}, 2)" for i in range(8)) + ")"


@query(f"""with {VECTORS}, b as (select source, lang, pos, printf('%016x', {_BITS}) as h from v),
g as (select source, lang, count(*) as n, string_agg({_BYTES}, '' order by pos) as body from b group by 1, 2)
select source, lang, n, 'sha256:' || sha256(unhex(hex('order-audit/value-digest/v1' || chr(10) || 'dtype=<f8|shape=(' || n || ',)' || chr(10)) || body)) as digest from g""")
def value_digest(spark, sf_dir):
    return contract.value_digest(inputs.vectors(spark, sf_dir), ["source", "lang"])


@query(f"""with {VECTORS}, {_IDS}, {_digest_sql('i')}, s as (select lang as grp, source as dataset, lang as split, 96 as seq_len, n, digest from dg)
select grp, count(*) as products, case when count(*) < 2 then null when count(distinct dataset) > 1 then 'dataset' end as violation, false as truncated from s group by 1""")
def positional_join_guard(spark, sf_dir):
    d = ordered_id_digest(spark, sf_dir)
    sc = d.select(F.col("lang").alias("grp"), F.lit("order-audit/provenance/2").alias("schema_version"), F.col("source").alias("dataset"), F.col("lang").alias("split"), F.lit(96).alias("seq_len"), F.lit(336).alias("pred_len"), F.lit("window_origin/v1").alias("sample_id_scheme"), F.lit("dataset_index").alias("order_semantics"), F.col("n").alias("n_samples"), F.col("digest").alias("ordered_sample_id_digest"))
    return joins.positional_join_check(sc, ["grp"])


@query(f"""with {ARMS}, {_shared_sql('greatest(0, i - 1)', 'shared_k2')}, per as (select distinct al.g, al.arm, op.pos, op.src from al join op on al.g = op.g and al.label = op.label and al.pos = op.src),
pd as (select g, arm, string_agg(src, ',' order by pos) as d, max((pos != src)::int) as moved from per group by 1, 2), po as (select g, d, count(*) as c, sum(moved) as moved from pd group by 1, 2), t as (select g, sum(c)::bigint as n_arms, count(*) as n_distinct, sum(c * (c - 1) // 2)::bigint as identical_pairs, sum(moved)::bigint as non_identity from po group by 1)
select *, case when n_distinct = 1 then 'all_identical' when n_distinct = n_arms then 'all_distinct' else 'partial_shared' end as sharing from t""")
def permutation_sharing(spark, sf_dir):
    a = inputs.arms(spark, sf_dir)
    index = F.dense_rank().over(Window.partitionBy("g").orderBy("arm")) - 1
    labelled = a.withColumn("label", order.sharing_label("shared_k2", index))
    perm = order.full_permutation(labelled.select("g", "label", "pos").distinct(), ["g", "label"], "share/shared_k2")
    per_arm = labelled.select("g", "arm", "label").distinct().join(perm, ["g", "label"]).drop("label")
    return diagnose.permutation_sharing(per_arm, ["g"])


@query(f"with {ARMS} select g, arm, pos, round(value, 4) as value from a")
def unpermute_roundtrip(spark, sf_dir):
    a = inputs.arms(spark, sf_dir)
    key = ["g", "arm"]
    perm = order.full_permutation(a, key, "trip")
    return rounded(order.unpermute(order.apply_permutation(a, perm, key), perm, key), "value", digits=4).select("g", "arm", "pos", "value")


@query(f"with {ARMS}, {permuted_sql('a', 'g, arm', 'defect')} select f.g, f.arm, f.pos, round(f.value, 4) as feature, round(p.value, 4) as value from a f join p on f.g = p.g and f.arm = p.arm and f.pos = p.pos")
def defect_join(spark, sf_dir):
    a = inputs.arms(spark, sf_dir)
    key = ["g", "arm"]
    x = a.withColumnRenamed("value", "feature")
    return rounded(joins.defect_join(x, a, order.full_permutation(a, key, "defect"), key), "feature", "value", digits=4)


@query(f"with {ARMS}, {permuted_sql('a', 'g, arm', 'control')} select f.g, f.arm, f.pos, round(p.value, 4) as feature, round(f.value, 4) as value from a f join p on f.g = p.g and f.arm = p.arm and f.pos = p.pos")
def control_join(spark, sf_dir):
    a = inputs.arms(spark, sf_dir)
    key = ["g", "arm"]
    x = a.withColumnRenamed("value", "feature")
    return rounded(joins.control_join(x, a, order.full_permutation(a, key, "control"), key), "feature", "value", digits=4)


@query("select l_shipmonth, round(avg(case when l_returnflag = 'A' then l_quantity end), 6) as \"A\", round(avg(case when l_returnflag = 'N' then l_quantity end), 6) as \"N\", round(avg(case when l_returnflag = 'R' then l_quantity end), 6) as \"R\" from (select *, strftime(l_shipdate, '%Y-%m') as l_shipmonth from lineitem) group by 1")
def pivot_condition(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("l_shipmonth", F.date_format("l_shipdate", "yyyy-MM"))
    return rounded(reports.pivot_mean(l, ["l_shipmonth"], "l_returnflag", "l_quantity", ["A", "N", "R"]), "A", "N", "R")


@query("select case when grouping(l_returnflag) = 1 then 'all' else l_returnflag end as l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean_quantity from lineitem group by rollup (l_returnflag)")
def rollup_report(spark, sf_dir):
    return rounded(reports.with_total(table(spark, sf_dir, "lineitem"), "l_returnflag", n=F.count("*"), mean_quantity=F.avg("l_quantity")), "mean_quantity")


@query("select event_type, count(value) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, min(value) as min, max(value) as max, round(stddev_samp(value), 6) as sd, round(stddev_pop(value), 6) as sd_pop, round(quantile_cont(value, 0.1), 6) as q10, round(quantile_cont(value, 0.9), 6) as q90 from events group by 1")
def exact_quantiles(spark, sf_dir):
    return rounded(reports.summary(table(spark, sf_dir, "events"), ["event_type"], "value", [0.1, 0.9]), "mean", "median", "sd", "sd_pop", "q10", "q90")


@query("""with g as (select d.i * 6 + h.i * 3 + p.i as ordinal, d.v as dataset, h.v as pred_len, p.v as plugin from (values (0, 'a'), (1, 'b')) d(i, v), (values (0, 96), (1, 192)) h(i, v), (values (0, 'none'), (1, 'revin'), (2, 'none')) p(i, v)),
c as (select *, concat_ws('_', dataset, pred_len, plugin) as cell_id from g) select min(ordinal)::bigint as ordinal, dataset, pred_len::bigint as pred_len, plugin, cell_id from c group by dataset, pred_len, plugin, cell_id""")
def grid_cross_join(spark, sf_dir):
    return joins.grid(spark, {"dataset": ["a", "b"], "pred_len": [96, 192], "plugin": ["none", "revin", "none"]}, ["dataset", "pred_len", "plugin"]).select("ordinal", "dataset", "pred_len", "plugin", "cell_id")


@query("select c_custkey, c_nationkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')")
def pending_anti_join(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.pending(table(spark, sf_dir, "customer"), done, ["c_custkey"]).select("c_custkey", "c_nationkey")


@query("select c_custkey, c_nationkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def existence_semi_join(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.exists(table(spark, sf_dir, "customer"), done, ["c_custkey"]).select("c_custkey", "c_nationkey")


@query("""with c as (select source, lang, count(*) as n from documents group by 1, 2), q as (select unnest(quantile_cont(n, [0.0, 0.25, 0.5, 0.75, 1.0])) as target, unnest(range(5)) as k from c),
r as (select q.k, q.target, c.*, row_number() over (partition by q.k order by abs(c.n - q.target), c.source, c.lang) as i from c, q) select k::int as k, round(target, 6) as target, source, lang, n from r where i = 1""")
def nearest_length_pick(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return rounded(joins.nearest_pick(c, "n", [0.0, 0.25, 0.5, 0.75, 1.0], "source", "lang"), "target")


@query("with c as (select source, lang, count(*) as c from documents group by 1, 2), f as (select source, c / sum(c) over (partition by source) as f from c) select source, round(sum(-f * log2(f)), 6) + 0.0::double as entropy_bits, round(max(f), 6) as modal_share from f group by 1")
def entropy_bits(spark, sf_dir):
    return rounded(reports.entropy_bits(table(spark, sf_dir, "documents"), ["source"], "lang"), "entropy_bits", "modal_share")


@query("select event_type, round(kurtosis_pop(value) + 3, 6) as kurtosis from events group by 1")
def kurtosis_moments(spark, sf_dir):
    return rounded(reports.named(table(spark, sf_dir, "events"), ["event_type"], kurtosis=reports.kurtosis("value")), "kurtosis")


@query("with m as (select event_type, avg(value) as m from events group by 1) select event_type, count(value) as n, round(sum(pow(value - m, 2)), 3) as s2, round(sum(pow((value - m) / 10, 4)), 3) as s4 from events join m using (event_type) group by 1")
def central_sums(spark, sf_dir):
    out = reports.central_sums(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", F.round("s2", 3).alias("s2"), F.round(F.col("s4") / 10000, 3).alias("s4"))


@query("select case when value < 0 then 0 when value >= 100 then 41 else floor(value / 2.5)::int + 1 end as bin, count(*) as n from events where value is not null group by 1")
def fixed_bin_histogram(spark, sf_dir):
    return reports.histogram(table(spark, sf_dir, "events"), "value", 0, 100, 40)


@query("select source, lang, count(*) as n from documents group by 1, 2")
def value_counts(spark, sf_dir):
    return reports.value_counts(table(spark, sf_dir, "documents"), "source", "lang")


@query("select source, count(distinct lang) as langs, round(100.0 * avg(case when n_chars > 1000 then 1.0 else 0.0 end), 6) as long_pct from documents group by 1 having count(*) >= 2")
def distinct_and_rates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return rounded(d.groupBy("source").agg(F.countDistinct("lang").alias("langs"), reports.rate(F.col("n_chars") > 1000).alias("long_pct"), F.count("*").alias("c")).where("c >= 2").drop("c"), "long_pct")


@query("select count(*) as n from lineitem where abs(l_discount - 0.05) <= 1e-8 + 1e-5 * 0.05 and l_returnflag in ('A', 'N') and l_linestatus not in ('X') and l_quantity is not null and starts_with(l_returnflag, 'A')")
def report_filters(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.where(is_close(F.col("l_discount"), F.lit(0.05)) & F.col("l_returnflag").isin("A", "N") & ~F.col("l_linestatus").isin("X") & finite(F.col("l_quantity")) & F.col("l_returnflag").startswith("A")).agg(F.count("*").alias("n"))


_EPOCHS = "e as (select o_custkey as run, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as epoch, o_totalprice as loss from orders)"


@query(f"""with {_EPOCHS}, b as (select *, min(loss) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as before from e), u as (select *, coalesce(loss < before - 1e-8, true) as up from b),
l as (select *, max(case when up then epoch end) over (partition by run order by epoch) as lu from u), s as (select *, min(case when epoch - lu >= 3 then epoch end) over (partition by run) as stop from l), k as (select * from s where stop is null or epoch <= stop)
select run, max(case when up then epoch end)::int as best_epoch, arg_max(loss, epoch) filter (up) as best_loss, count(*) as epochs_run from k group by 1""")
def early_stopping(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("loss"))
    e = o.withColumn("epoch", F.row_number().over(Window.partitionBy("run").orderBy("o_orderdate", "o_orderkey")))
    return reports.early_stop(e, ["run"], "epoch", "loss", 3)


@query(f"with {SERIES} select series_id, pos, round((value - avg(value) over w) / sqrt(var_pop(value) over w + 1e-5), 6) + 0.0::double as normalised from s window w as (partition by series_id)")
def revin_normalise(spark, sf_dir):
    return rounded(features.revin(inputs.series(spark, sf_dir), ["series_id"]), "normalised").select("series_id", "pos", "normalised")


@query(f"""with {SERIES}, k as (select series_id, pos // 50 as w, pos % 50 as k, value from s), z as (select *, sqrt(var_pop(value) over (partition by series_id, w) + 1e-5) as wsd from k),
g as (select series_id, w, ((k - 2) // 16)::int as slice, avg(value) as mean, greatest(sqrt(var_pop(value) + 1e-5), 0.1 * max(wsd)) as sd from z where k >= 2 group by 1, 2, 3),
f as (select *, pow(0.5, (n - 1 - slice) / (n / 2.0)) as wt from (select *, max(slice) over (partition by series_id, w) + 1 as n from g))
select series_id, w, round(sum(mean * wt) / sum(wt), 6) as mean, round(exp(sum(ln(sd) * wt) / sum(wt)), 6) as sd from f group by 1, 2""")
def slice_forecast(spark, sf_dir):
    k = inputs.series(spark, sf_dir).select("series_id", F.floor(F.col("pos") / 50).alias("w"), (F.col("pos") % 50).alias("k"), "value")
    return rounded(features.slice_forecast(features.slice_statistics(k, ["series_id", "w"], 50), ["series_id", "w"]), "mean", "sd")


@query("select o_orderpriority, round(covar_pop(o_custkey, o_totalprice) * count(*) / (var_pop(o_custkey) * count(*) + 10), 6) + 0.0::double as slope from orders group by 1")
def ridge_slopes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return rounded(features.ridge_slope(o, ["o_orderpriority"], "o_custkey", "o_totalprice", 10.0), "slope").select("o_orderpriority", "slope")


@query("""with v as (select value as v, count(*) filter (event_id % 2 = 0) as a, count(*) filter (event_id % 2 = 1) as b from events group by 1), c as (select abs(sum(a) over (order by v) / sum(a) over () - sum(b) over (order by v) / sum(b) over ()) as gap, a, b from v)
select round(max(gap), 6) as d, sum(a)::bigint as n_a, sum(b)::bigint as n_b from c""")
def ks_two_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(diagnose.ks_two_sample(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")), "d")


_H60 = "('0x' || substr(md5({0}), 1, 15))::bigint"


@query(f"""with {_CELLS}, r as (select cell, n, 8 as b, unnest(range(3)) as replicate from cells), k as (select *, unnest(range(ceil(n / b)::bigint)) as j from r),
s as (select *, {_H60.format("concat_ws('|', 'mbb', cell, replicate, j)")} % n as start, unnest(range(8)) as i from k)
select cell, replicate::int as replicate, j * 8 + i as pos, (start + i) % n as src_pos from s where j * 8 + i < n""")
def moving_block_indices(spark, sf_dir):
    c = cells(spark, sf_dir).select("cell", "n", F.lit(8).alias("block_len"))
    return order.moving_block_indices(c, ["cell"], order.replicates(spark, 3), "mbb")


@query(f"""with {VECTORS}, k as (select source, pos0 as src, n, {_H60.format("concat_ws('|', 'cbp/shift', source)")} % n as sh from (select source, row_number() over (partition by source order by doc_id) - 1 as pos0, count(*) over (partition by source) as n from v)),
m as (select source, src, (src + sh) % n as mid from k) select source, row_number() over (partition by source order by md5(concat_ws('|', 'cbp', source, mid // 8)), mid // 8, mid) - 1 as pos, src as src_pos from m""")
def circular_block_permutation(spark, sf_dir):
    d = order.with_pos(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id")
    return order.circular_block_permutation(d, ["source"], 8, "cbp")


@query("""with o as (select o_custkey, o_orderkey, o_orderdate from orders), a as (select o_custkey, o_orderdate, min(o_totalprice) as price from orders where o_orderpriority like '1%' group by 1, 2)
select o.o_orderkey, x.price as value from o left join lateral (select a.price from a where a.o_custkey = o.o_custkey and a.o_orderdate <= o.o_orderdate order by a.o_orderdate desc limit 1) x on true""")
def asof_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    right = o.where("o_orderpriority like '1%'").groupBy("o_custkey", "o_orderdate").agg(F.min("o_totalprice").alias("value"))
    return joins.asof_join(o.select("o_custkey", "o_orderkey", "o_orderdate"), right, ["o_custkey"], "o_orderdate", "value").select("o_orderkey", "value")


@query("select n_nationkey, n_name, r_name from nation left join region on n_regionkey = r_regionkey and r_regionkey < 3")
def reindex_left_join(spark, sf_dir):
    r = table(spark, sf_dir, "region").where("r_regionkey < 3").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.reindex(table(spark, sf_dir, "nation"), r, ["n_regionkey"]).select("n_nationkey", "n_name", "r_name")


@query(f"with {ARMS}, {permuted_sql('a', 'g, arm', 'shuffle')} select g, arm, round(max(abs(a.value - p.value) - (1e-8 + 1e-5 * abs(p.value))), 6) as worst from a join p using (g, arm, pos) group by 1, 2")
def allclose_check(spark, sf_dir):
    a = inputs.arms(spark, sf_dir)
    p = order.apply_permutation(a, order.full_permutation(a, ["g", "arm"], "shuffle"), ["g", "arm"])
    return rounded(joins.allclose_violations(a, p, ["g", "arm"]), "worst")


_VERIFIED = """c as (select count(*)::double as rows, avg(l_quantity) as quantity, sum(l_discount) as discount, max(l_tax) as tax from lineitem), computed as (unpivot c on rows, quantity, discount, tax into name name value value),
f as (select l_returnflag, count(*) as n, sum(l_quantity) as q, sum(l_discount) as d from lineitem group by 1),
declared as (select 'rows' as name, sum(n)::double as value, 0 as decimals from f union all select 'quantity', round(sum(q) / sum(n), 1), 1 from f union all select 'discount', round(sum(d) * 1.01, 2), 2 from f union all select 'flags', count(*)::double, 0 from f)"""


@query(f"""with {_VERIFIED}, b as (select name, a.value as computed, d.value as declared, decimals from computed a full join declared d using (name)),
o as (select *, coalesce(case when decimals = 0 then round(computed) = declared else abs(computed - declared) <= greatest(1e-9, 0.51 * pow(10.0, -decimals), 1e-3 * abs(declared)) end, false) as ok from b)
select name, round(computed, 3) as computed, declared, decimals, ok, case when ok then null when declared is null then 'not declared' when computed is null then 'not computed' else 'differs' end as problem from o""")
def verify_numbers(spark, sf_dir):
    """Figures of the whole table against a table declared from its groups, in which one figure is wrong, one missing and one too many."""
    lines = table(spark, sf_dir, "lineitem")
    computed = reports.scalars(lines, rows=F.count("*"), quantity=F.avg("l_quantity"), discount=F.sum("l_discount"), tax=F.max("l_tax"))
    f = lines.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("d"))
    declared = reports.scalars(f, rows=F.sum("n"), quantity=F.round(F.sum("q") / F.sum("n"), 1), discount=F.round(F.sum("d") * 1.01, 2), flags=F.count("*"))
    declared = declared.withColumn("decimals", F.when(F.col("name").isin("rows", "flags"), 0).when(F.col("name") == "quantity", 1).otherwise(2))
    return pipelines.verify(computed, declared).withColumn("computed", F.round("computed", 3))


@query("select r_name as n from region intersect select r_name from region where r_regionkey > 1 union all (select r_name from region except select r_name from region where r_regionkey > 2)")
def set_operations(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    names = lambda d: d.select(F.col("r_name").alias("n"))
    return names(r).intersect(names(r.where("r_regionkey > 1"))).unionByName(names(r).subtract(names(r.where("r_regionkey > 2"))))


@query("select source, coalesce(lang, 'unknown') as lang, doc_id % 4 as k, sum(n_chars)::bigint as total from documents group by 1, 2, 3")
def derived_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source", token(F.col("lang")).alias("lang"), (F.col("doc_id") % 4).alias("k")).agg(F.sum("n_chars").alias("total"))


_LENGTHS = (50, 100, 200, 500, 1000, 2000, 5000, 11425)
_Z05, _Z10 = normal_isf(0.05), normal_isf(0.1)


@query(f"""with n as (select unnest({list(_LENGTHS)})::bigint as n) select n, round({_Z05 + _Z10!r} / sqrt(n), 6) as rho_min_detectable, round({sql.normal_sf(f'({_Z05!r} - 0.5 * sqrt(n))')}, 6) + 0.0::double as power_at_rho_0_5, round({sql.normal_sf(f'({_Z05!r} - 0.1 * sqrt(n))')}, 6) + 0.0::double as power_at_rho_0_1 from n""")
def aot_theory(spark, sf_dir):
    inputs.ship(spark)
    return rounded(diagnose.theory(spark, _LENGTHS), "rho_min_detectable", "power_at_rho_0_5", "power_at_rho_0_1")


@query(f"with {ARMS}, {sql.aot_monte_carlo('a', 'g, arm', 2000, 1)} select g, arm, n, round(r, 6) as r, round(p_perm, 6) as p_perm from mc")
def aot_mc_pvalue(spark, sf_dir):
    return rounded(diagnose.aot_monte_carlo(inputs.arms(spark, sf_dir), ["g", "arm"], seed=1), "r", "p_perm")


@query(f"with {ARMS}, {sql.agreement_monte_carlo('a', 'g', 2000, 1)} select g, round(rho_bar, 6) as rho_bar, round(p, 6) as p, round(null_mean, 6) + 0.0::double as null_mean, round(null_sd, 6) as null_sd from cm")
def cat_mc_pvalue(spark, sf_dir):
    return rounded(diagnose.agreement_monte_carlo(inputs.arms(spark, sf_dir), ["g"], seed=1), "rho_bar", "p", "null_mean", "null_sd")


@query()
def aot_tail(spark, sf_dir):
    return diagnose.tail_calibration(inputs.arms(spark, sf_dir), ["g", "arm"], 1_000_000, seed=1)


_DA_COLUMNS = "n, round(rho, 6) + 0.0::double as assoc_rho, round(lo, 6) + 0.0::double as ci_lo, round(hi, 6) + 0.0::double as ci_hi, excl as ci_excludes_zero, round(p, 6) as p_block, round(two, 6) as p_boot_2sided, round(mean, 6) + 0.0::double as boot_rho_mean, b as block_len, blocks as n_blocks, n_boot, n_perm"


def _da_rounded(df: DataFrame) -> DataFrame:
    return rounded(df, "assoc_rho", "ci_lo", "ci_hi", "p_block", "p_boot_2sided", "boot_rho_mean")


@query(f"with {HOURLY_ASSOCIATION}, {sql.dependence_aware('x', 'g', 'f_std', 'value', L + H, 2000, 2000)} select g, {_DA_COLUMNS} from da")
def assoc_dep_aware(spark, sf_dir):
    df = hourly_association(spark, sf_dir).select("g", "pos", "f_std", "value")
    return _da_rounded(assoc.dependence_aware(df, ["g"], "f_std", "value", L, H))


_CLUSTER = """cb_v as (select {key}, {cluster} as c, {value} as v from {source} where {value} is not null), cb_c as (select {key}, c, row_number() over (partition by {key} order by c) - 1 as i, count(*) over (partition by {key}) as k from (select distinct {key}, c from cb_v)),
cb_d as (select {key}, r, ('0x' || substr(md5(concat_ws('|', '{seed}', {key}, r, i)), 1, 15))::bigint % k as i from (select *, unnest(range({draws})) as r from cb_c)),
cb_p as (select {of_d}, d.r, c.c from cb_d d join cb_c c on {on_c} and d.i = c.i), cb_s as (select {of_p}, p.r, {stat}(v.v) as s from cb_p p join cb_v v on {on_v} and p.c = v.c group by {of_p}, p.r),
cb_i as (select {key}, quantile_cont(s, 0.025) as lo, quantile_cont(s, 0.975) as hi, median(s) as mid, count(*) as n_boot from cb_s group by {key}), cb_0 as (select {key}, {stat}(v) as point, count(distinct c) as n_clusters, count(*) as n_cells from cb_v group by {key})
select {key}, {more}round(point, 6) as point, round(lo, 6) as ci_lo, round(hi, 6) as ci_hi, round(mid, 6) as boot_median, n_clusters, n_cells, n_boot from cb_0 join cb_i using ({key})"""


def cluster_sql(source: str, key: str, cluster: str, value: str, seed: object, stat: str = "median", draws: int = 2000, more: str = "") -> str:
    """CTEs and the select of assoc.cluster_bootstrap."""
    return _CLUSTER.format(source=source, key=key, cluster=cluster, value=value, seed=seed, stat=stat, draws=draws, more=more, of_d=f"d.{key}", of_p=f"p.{key}", on_c=f"d.{key} = c.{key}", on_v=f"p.{key} = v.{key}")


@query(f"with {cluster_sql('documents', 'lang', 'source', 'n_chars', 1)}")
def cluster_bootstrap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", F.col("n_chars").cast("double").alias("value"))
    return rounded(assoc.cluster_bootstrap(d, ["lang"], "source", "value", seed=1), "point", "ci_lo", "ci_hi", "boot_median")


@query()
def difficulty_regression(spark, sf_dir):
    """The first half of the hourly windows is the validation split, the second the test split."""
    with inputs.written(hourly_association(spark, sf_dir), "hourly") as df:
        half = df.crossJoin(F.broadcast(df.agg(F.floor(F.max("pos") / 2).alias("_half"))))  # one row
        val, test = half.where("pos < _half").drop("_half"), half.where("pos >= _half").drop("_half")
        cols = list(features.NATIVE)
        x, y = val.select("g", "pos", *cols), val.select("g", "pos", "value")
        perm, control = order.full_permutation(y, ["g"], "t1"), order.full_permutation(y, ["g"], "t1c")
        joined = downstream.three_conditions(x, y, perm, control, ["g"])
        return downstream.difficulty_regression(joined.drop("g"), test.select(*cols, "value"), cols, L, H)


@query()
def arm_selection(spark, sf_dir):
    """As difficulty_regression: labels and fit on the first half, figures on the second."""
    df = hourly_association(spark, sf_dir)
    cols = list(features.NATIVE)
    a = inputs.arms(spark, sf_dir).select("arm", "pos", "value")
    x = df.select("pos", *cols)
    cut = F.broadcast(a.agg(F.floor(F.max("pos") / 2).alias("_half")))  # one row
    early, late = (lambda d: d.crossJoin(cut).where("pos < _half").drop("_half")), (lambda d: d.crossJoin(cut).where("pos >= _half").drop("_half"))
    perms = order.full_permutation(early(a), ["arm"], "t2")
    control = order.full_permutation(early(x).withColumn("k", F.lit(0)), ["k"], "t2c").drop("k")
    return downstream.arm_selection(early(x), early(a), late(x), late(a), cols, perms, control)


def draws_sql(features_: str, values: str, x: str, draws: int, seed: object = 0) -> str:
    """CTEs that end in rd (g, draw, condition, rho), of downstream.replicated_associations; both tables (g, pos, ...) hold the same positions."""
    moved = lambda name, t, col: f"rd_{name} as (select g, draw, row_number() over (partition by g, draw order by md5(concat_ws('|', '{seed}/{name}', g, draw, pos)), pos) - 1 as pos, {col} as v from {t}, (select unnest(range({draws})) as draw))"
    return f"""{moved('defect', values, 'value')}, {moved('control', features_, x)},
rd_j as (select d.g, d.draw, 'defect' as condition, f.{x} as x, d.v as y from rd_defect d join {features_} f on f.g = d.g and f.pos = d.pos union all select d.g, d.draw, 'control', d.v, f.value from rd_control d join {values} f on f.g = d.g and f.pos = d.pos),
{sql.ranked('rd_r', 'rd_j', 'g, draw, condition', rx='x', ry='y')}, rd as (select g, draw::int as draw, condition, corr(rx, ry) as rho, count(*) as n from rd_r group by 1, 2, 3)"""


@query(f"with {HOURLY_ASSOCIATION}, {draws_sql('x', 'x', 'f_std', 8)} select g, draw, condition, round(rho, 6) + 0.0::double as rho, n from rd")
def replicated_draws(spark, sf_dir):
    df = hourly_association(spark, sf_dir)
    return rounded(downstream.replicated_associations(df.select("g", "pos", "f_std"), df.select("g", "pos", "value"), ["g"], "f_std", 8), "rho")


@query(f"""with {SERIES}, d as (select series_id, pos // 32 as w, pos % 32 as k, -value as d, count(*) over (partition by series_id, pos // 32) as n from s),
f as (select series_id, w, max(n) as n, q, sqrt(pow(sum(d * cos(2 * pi() * q * k / n)), 2) + pow(sum(d * sin(2 * pi() * q * k / n)), 2)) as f from d, range(17) r(q) where q <= n // 2 group by series_id, w, q),
e as (select series_id, w, avg(d * d) as mse from d group by 1, 2) select e.series_id, e.w, round(0.5 * max(mse) + 0.5 * avg(f), 4) as loss from e join f on e.series_id = f.series_id and e.w = f.w group by 1, 2""")
def frequency_loss(spark, sf_dir):
    s = inputs.series(spark, sf_dir)
    w = s.select("series_id", F.floor(F.col("pos") / 32).alias("w"), (F.col("pos") % 32).alias("step"), F.lit(0.0).alias("pred"), F.col("value").alias("true"))
    return rounded(features.frequency_loss(w, ["series_id", "w"], 0.5), "loss", digits=4)


#: What the contract must say to each injected fault (fault, error, field; none where nothing recorded contradicts it).
FAULTS = (
    ("array_replaced_by_another_cell_same_length", "DigestMismatch", "value_digest"),
    ("array_truncated_by_one_sample", "IdentityMismatch", "n_samples"),
    ("cyclic_rotation_of_the_whole_array", "DigestMismatch", "value_digest"),
    ("duplicate_sample_ids_in_one_product", "IdentityMismatch", "sample_id"),
    ("float_perturbation_1e-12", "DigestMismatch", "value_digest"),
    ("join_of_a_product_with_no_sample_ids", "MissingField", "sample_id"),
    ("legacy_sidecar_without_schema_version", "SchemaVersion", "schema_version"),
    ("loader_order_relabelled_as_index_order", "IdentityMismatch", "window_origin"),
    ("no_sidecar_but_consumer_passes_require_order_None", None, None),
    ("order_semantics_outside_the_enumeration", "OrderSemantics", "order_semantics"),
    ("per_sample_value_computed_wrongly_but_consistently", None, None),
    ("positional_join_across_different_sample_sets", "IdentityMismatch", "pred_len"),
    ("positional_join_truncated_to_n_min", None, None),
    ("random_permutation_of_the_array", "DigestMismatch", "value_digest"),
    ("required_field_removed_from_sidecar", "MissingField", "value_digest"),
    ("same_length_different_dataset_joined", "IdentityMismatch", "sample_id"),
    ("same_length_different_horizon_joined", "IdentityMismatch", "sample_id"),
    ("sample_id_source_replaced_val_perm", "IdentityMismatch", "ordered_sample_id_digest"),
    ("sidecar_file_deleted", "MissingField", "sidecar"),
    ("single_element_edited", "DigestMismatch", "value_digest"),
    ("stale_sidecar_array_rerun_in_place", "DigestMismatch", "value_digest"),
    ("two_producers_share_one_wrong_loader_order", None, None),
    ("unknown_future_schema_version", "SchemaVersion", "schema_version"),
    ("upstream_data_or_preprocessing_changed", None, None),
    ("val_product_consumed_as_test", "IdentityMismatch", "split"),
)
_FAULT_ROWS = ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" for x in f) + ")" for f in FAULTS)


@query(f"select fault, (exception is not null)::int as detected, exception, detected_by_field from (values {_FAULT_ROWS}) t(fault, exception, detected_by_field)")
def contract_coverage(spark, sf_dir):
    from seriata.plans.coverage import contract_coverage as run

    inputs.ship(spark)
    return run(spark).drop("note")


@query(f"with {HOURLY} select (t // 7)::bigint as batch_id, t % 7 as pos_in_batch, t as window_origin, round(pow((50::float - value::float)::double, 2), 4) as value from h")
def recorder_stream(spark, sf_dir):
    """Forecaster errors recorded from a file stream of single predictions, one micro-batch a trigger, into the shared folder."""
    import uuid

    from seriata.streaming import recorder

    h = inputs.hourly(spark, sf_dir)
    pairs = h.select((F.col("t") % 7).alias("pos_in_batch"), F.floor(F.col("t") / 7).alias("batch_id"), F.col("t").alias("window_origin"), F.lit(0).alias("step"), F.lit(0).alias("channel"), F.lit(50.0).alias("pred"), F.col("value").alias("true"))
    root = f"{inputs.shared_dir(spark)}/recorder-{uuid.uuid4().hex}"
    pairs.write.parquet(f"{root}/in")
    recorder.record(spark.readStream.schema(pairs.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/ck").awaitTermination()
    return rounded(spark.read.parquet(f"{root}/out").select("batch_id", "pos_in_batch", "window_origin", "value"), "value", digits=4)


def _cells(spark, sf_dir) -> DataFrame:
    return inputs.arms(spark, sf_dir).select(F.col("arm").alias("cell_id"), F.col("g").alias("split"), "pos", "value")


_VARIANTS = f"""{ARMS}, cv as (select arm as cell_id, g as split, pos, value from a),
fp as (select cell_id, split, row_number() over (partition by cell_id, split order by md5(concat_ws('|', 'q3', cell_id, split, pos)), pos) - 1 as pos, value from cv),
lo as (select cell_id, split, row_number() over (partition by cell_id, split order by md5(concat_ws('|', 'loader', cell_id, split, pos)), pos) - 1 as pos, value from cv),
q3 as (select *, 'index_order' as variant from cv union all select *, 'full_permutation' from fp union all select *, 'observed_loader_order' from lo)"""


@query(aot_sql(_VARIANTS, "q3", "cell_id, split, variant", P_COLUMN))
def aot_sequences(spark, sf_dir):
    v = _cells(spark, sf_dir)
    out = pipelines.aot_sequences(v, order.full_permutation(v, ["cell_id", "split"], "loader"), "q3")
    return rounded(out, "r", "null_mean", "null_sd", "z", "p").select("cell_id", "split", "variant", "n", "r", "null_mean", "null_sd", "z", "p", "reject")


_SEQ = aot_sql(_VARIANTS, "q3", "cell_id, split, variant")


@query(f"""with sq as ({_SEQ}), l as (select * from (values {", ".join(f"({a!r}::double, {normal_isf(a)!r}::double)" for a in pipelines.ALPHAS)}) t(alpha, lim))
select alpha, count(*) filter (variant = 'index_order') as n_clean, count(*) filter (variant = 'full_permutation') as n_corrupted, round(100 * avg(case when z > lim then 1.0 else 0.0 end) filter (variant = 'index_order'), 6) as clean_certified_pct,
 round(100 * avg(case when z > lim then 1.0 else 0.0 end) filter (variant = 'full_permutation'), 6) as corrupted_certified_pct from sq, l where variant in ('index_order', 'full_permutation') group by 1""")
def certification(spark, sf_dir):
    v = _cells(spark, sf_dir)
    return rounded(pipelines.certification(pipelines.aot_sequences(v, None, "q3")), "clean_certified_pct", "corrupted_certified_pct")


def _exact(text: str) -> str:
    """The text with the last select's figures unrounded."""
    head, mark, last = text.rpartition("\nselect ")
    return head + mark + last.replace("round(", "(").replace(", 6)", ")")


@query(f"""with sq as ({_exact(_SEQ)}) select variant, {", ".join(f"round({f}({c}), 6) + 0.0::double as {n}_{c}" for c in ("z", "r") for n, f in (("min", "min"), ("median", "median"), ("max", "max")))} from sq where variant != 'observed_loader_order' group by 1""")
def certification_margin(spark, sf_dir):
    out = pipelines.margin(pipelines.aot_sequences(_cells(spark, sf_dir), None, "q3"))
    return rounded(out, *[c for c in out.columns if c != "variant"])


@query(f"""with {ARMS}, cv as (select arm as cell_id, g as split, pos, value from a), {sql.aot_monte_carlo('cv', 'cell_id, split', 2000, 0)}, z as ({aot_sql('one as (select 1)', 'cv', 'cell_id, split', P_COLUMN)})
select z.cell_id, z.split, z.n, z.p as p_normal, round(mc.p_perm, 6) as p_perm from z join mc on z.cell_id = mc.cell_id and z.split = mc.split""")
def aot_calibration(spark, sf_dir):
    return rounded(pipelines.aot_calibration(_cells(spark, sf_dir)), "p_normal", "p_perm")


def _sensitivity_sql() -> str:
    parts = []
    for b in (8, 32, 128, 512):
        parts.append(f"select cell_id, split, 'block' as kind, {b}.0::double as param, row_number() over (partition by cell_id, split order by md5(concat_ws('|', '0/{b}', cell_id, split, pos // {b})), pos // {b}, pos) - 1 as pos, value from cv")
    ctes = []
    for i, f in enumerate((0.05, 0.1, 0.25, 0.5, 1.0)):
        ctes.append(f"""f{i}a as (select *, md5(concat_ws('|', '0/{f}/pick', cell_id, split, pos)) as hp, md5(concat_ws('|', '0/{f}/move', cell_id, split, pos)) as hm, round_even({f} * count(*) over (partition by cell_id, split), 0) as m from cv),
f{i}b as (select *, row_number() over (partition by cell_id, split order by hp, pos) as rp from f{i}a), f{i}c as (select *, row_number() over (partition by cell_id, split order by pos) as k, row_number() over (partition by cell_id, split order by hm, pos) as kk from f{i}b where rp <= m and m >= 2)""")
        parts.append(f"select d.cell_id, d.split, 'partial', {f}::double, d.pos, s.value from f{i}c d join f{i}c s on d.cell_id = s.cell_id and d.split = s.split and d.k = s.kk")
        parts.append(f"select cell_id, split, 'partial', {f}::double, pos, value from f{i}b where not (rp <= m and m >= 2)")
    return f"{ARMS}, cv as (select arm as cell_id, g as split, pos, value from a), {', '.join(ctes)}, q5 as ({' union all '.join(parts)})"


@query(f"select cell_id, split, kind, param, n, z, p, reject from ({aot_sql(_sensitivity_sql(), 'q5', 'cell_id, split, kind, param', P_COLUMN)})")
def aot_sensitivity(spark, sf_dir):
    return rounded(pipelines.aot_sensitivity(_cells(spark, sf_dir)), "z", "p")


BLOCK = ["block_id", "seed", "val_order"]


def blocks(spark, sf_dir) -> DataFrame:
    """The arms as one block of the published reports."""
    return inputs.arms(spark, sf_dir).select(F.col("g").alias("block_id"), F.lit(2021).alias("seed"), F.lit("det").alias("val_order"), "arm", "pos", "value")


_BLOCKS = f"{ARMS}, bl as (select g as block_id, 2021 as seed, 'det' as val_order, arm, pos, value from a), ar as (select block_id, seed, val_order, string_agg(distinct arm, '|' order by arm) as arms from bl group by all)"


def _variants_sql(source: str, key: str) -> str:
    """CTE vr: source (key, arm, pos, value) as index_order and with each arm shuffled, as order.inject_sharing(..., independent, 0)."""
    return f"""vr_i as (select *, dense_rank() over (partition by {key} order by arm) - 1 as label from {source}),
vr as (select {key}, arm, pos, value, 'index_order' as variant from {source} union all select {key}, arm, row_number() over (partition by {key}, arm order by md5(concat_ws('|', '0/independent', {key}, label, pos)), pos) - 1, value, 'full_permutation' from vr_i)"""


def _agreement_sql(source: str, key: str) -> str:
    """CTE ag: key, n_arms, n, rho_bar, z_corrected, z_naive of all pairs of arms."""
    on = " and ".join(f"x.{k.strip()} = y.{k.strip()}" for k in key.split(","))
    of = ", ".join(f"x.{k.strip()}" for k in key.split(","))
    return f"""{sql.ranked('ag_r', source, key + ', arm', rk='value')}, ag_p as (select {of}, x.arm as a, y.arm as b, corr(x.rk, y.rk) as rho, count(*) as n from ag_r x join ag_r y on {on} and x.pos = y.pos and x.arm < y.arm group by all),
ag_n as (select {key}, count(distinct arm) as n_arms from {source} group by all),
ag as (select {key}, n_arms, max(n) as n, avg(rho) as rho_bar, avg(rho) * sqrt(n_arms * (n_arms - 1) / 2.0 * (max(n) - 1)) as z_corrected, avg(rho) * sqrt(max(n) - 1) as z_naive from ag_p join ag_n using ({key}) group by {key}, n_arms)"""


_BK = "block_id, seed, val_order"


@query(f"""with {_BLOCKS}, {_variants_sql('bl', _BK)}, {_agreement_sql('vr', _BK + ', variant')}, {sql.agreement_monte_carlo('vr', _BK + ', variant', 2000, 0)},
pa as (select {_BK}, 'pair:' || a || '~' || b as variant, 2::bigint as n_arms, n, rho as rho_bar, 2 * {sql.t_sf('(abs(rho) * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)')} as p, rho * sqrt(n - 1) as z_corrected, rho * sqrt(n - 1) as z_naive from ag_p where variant = 'index_order'),
al as (select {_BK}, variant, n_arms, n, ag.rho_bar, cm.p, z_corrected, z_naive from ag join cm using ({_BK}, variant) union all select * from pa)
select {_BK}, variant, n_arms, arms, n, round(rho_bar, 6) + 0.0::double as rho_bar, round(p, 6) + 0.0::double as p, round(z_corrected, 6) + 0.0::double as z_corrected, round(z_naive, 6) + 0.0::double as z_naive from al join ar using ({_BK})""")
def cat_blocks(spark, sf_dir):
    return rounded(pipelines.cat_blocks(blocks(spark, sf_dir), BLOCK), "rho_bar", "p", "z_corrected", "z_naive")


_GRID = f"gr as (select {_BK}, stride::int as stride, arm, pos // stride as pos, value from (select *, unnest({list(STRIDES)}) as stride from bl) where pos % stride = 0 qualify count(*) over (partition by {_BK}, stride, arm) >= 40)"


@query(f"""with {_BLOCKS}, {_GRID}, {_variants_sql('gr', _BK + ', stride')}, {_agreement_sql('vr', _BK + ', variant, stride')}, {sql.agreement_monte_carlo('vr', _BK + ', variant, stride', 2000, 0)},
on_ as ({aot_sql('one as (select 1)', 'vr', _BK + ', variant, stride, arm', _exact(P_COLUMN))}), oa as (select {_BK}, variant, stride, median(p) as aot_median_p, avg(reject) as aot_certify_rate from on_ group by all)
select {_BK}, variant, stride, round(greatest(0, 1 - stride / {L + H}.0), 6) as overlap_ratio, n, n_arms, round(aot_median_p, 6) + 0.0::double as aot_median_p, round(aot_certify_rate, 6) as aot_certify_rate, round(ag.rho_bar, 6) + 0.0::double as cat_rho_bar, round(cm.p, 6) as cat_p, case when cm.p < 0.05 then 1 else 0 end as cat_certify
from ag join cm using ({_BK}, variant, stride) join oa using ({_BK}, variant, stride)""")
def battery(spark, sf_dir):
    return rounded(pipelines.battery(blocks(spark, sf_dir), BLOCK, L, H, STRIDES), "overlap_ratio", "aot_median_p", "aot_certify_rate", "cat_rho_bar", "cat_p")


@query(f"""with {_BLOCKS}, pm as (select block_id, seed, arm, pos as src, row_number() over (partition by block_id, seed, arm order by md5(concat_ws('|', 'scan', block_id, seed, arm, pos)), pos) - 1 as pos, value from bl),
it as (select block_id, seed, arm, pos, value, 'intact' as kind from bl union all select block_id, seed, arm, pos, value, 'loader' from pm union all select block_id, seed, arm, pos, src::double, 'order' from pm),
{_agreement_sql('it', 'block_id, seed, kind')}, mi as (select block_id, seed, kind, arm, pos, value from it where kind != 'order'),
{sql.agreement_monte_carlo("(select block_id, seed, arm, pos, value from mi where kind = 'loader')", 'block_id, seed', 2000, 0)}, {sql.agreement_monte_carlo("(select block_id, seed, arm, pos, value from mi where kind = 'intact')", 'block_id, seed', 2000, 0).replace('cm_', 'ci_').replace('cm as', 'ci as')},
ao as ({aot_sql('one as (select 1)', "(select * from mi where kind = 'loader')", 'block_id, seed, arm', _exact(P_COLUMN))}), aa as (select block_id, seed, min(p) as lo, max(p) as hi, median(p) as mid, sum(reject)::bigint as rejects, count(*) as k from ao group by all),
dg as (select block_id, seed, arm, string_agg(src, ',' order by pos) as d, max((src != pos)::int) as moved from pm group by all), do_ as (select block_id, seed, d, count(*) as c, sum(moved) as moved from dg group by all),
sh as (select block_id, seed, sum(c)::bigint as n_arms, count(*) as n_distinct_perms, sum(c * (c - 1) // 2)::bigint as n_pairs_identical, sum(moved)::bigint as n_arms_misordered from do_ group by all),
pr as (select block_id, seed, count(*) as n_pairs, avg(rho) as me, max(rho) as ma, min(rho) as mi, max(rho) filter (rho < 1 - 1e-12) as mn from ag_p where kind = 'order' group by all)
select block_id, seed, (select arms from ar) as arms, n_pairs, round(me, 6) + 0.0::double as spearman_perm_mean, round(ma, 6) + 0.0::double as spearman_perm_max, round(mi, 6) + 0.0::double as spearman_perm_min, round(mn, 6) + 0.0::double as spearman_perm_max_nonidentical, sh.n_arms, n_distinct_perms, n_pairs_identical, n_arms_misordered,
 case when n_distinct_perms = 1 then 'all_identical' when n_distinct_perms = sh.n_arms then 'all_distinct' else 'partial_shared' end as perm_sharing, 1 as perm_consistent, lo_.n as n_windows, round(lo_.rho_bar, 6) + 0.0::double as cat_rho_bar, round(cm.p, 6) as cat_p_mc, case when cm.p < 0.05 then 1 else 0 end as cat_certified, round({sql.normal_sf('lo_.z_corrected')}, 6) + 0.0::double as cat_p_analytic,
 round(in_.rho_bar, 6) + 0.0::double as cat_rho_bar_intact, round(ci.p, 6) as cat_p_mc_intact, case when ci.p < 0.05 then 1 else 0 end as cat_certified_intact, round(lo, 6) + 0.0::double as aot_p_min, round(hi, 6) + 0.0::double as aot_p_max, round(mid, 6) + 0.0::double as aot_p_median, rejects as n_arms_aot_rejects, k as n_arms_aot
from sh join pr using (block_id, seed) join cm using (block_id, seed) join ci using (block_id, seed) join aa using (block_id, seed) join (select * from ag where kind = 'loader') lo_ using (block_id, seed) join (select * from ag where kind = 'intact') in_ using (block_id, seed)""")
def observed_perm_scan(spark, sf_dir):
    a = blocks(spark, sf_dir).drop("val_order")
    out = pipelines.observed_scan(a, order.full_permutation(a, ["block_id", "seed", "arm"], "scan"), ["block_id", "seed"])
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query(f"""with {HOURLY}, b as (select (t // 120)::varchar as g, t % 120 as pos, value as x, abs(value - 50) as value from h), {draws_sql('b', 'b', 'x', 8)},
dw as (select g, draw, max(rho) filter (condition = 'defect') - max(rho) filter (condition = 'control') as d from rd group by 1, 2), al as (select draw, d from dw union all select null, avg(d) from dw group by g), {_tost_sql('al', 'draw', 'd', 0.5)}
select round(min(p_tost) filter (draw is not null), 6) + 0.0::double as p_min, round(median(p_tost) filter (draw is not null), 6) + 0.0::double as p_median, round(max(p_tost) filter (draw is not null), 6) + 0.0::double as p_max, round(avg((p_tost < 0.05)::int) filter (draw is not null), 6) as certify_fraction, round(max(p_tost) filter (draw is null), 6) + 0.0::double as p_of_means from tt""")
def equivalence_draws(spark, sf_dir):
    d = inputs.hourly(spark, sf_dir).withColumn("g", F.floor(F.col("t") / 120).cast("string"))
    f = order.with_pos(d, ["g"], "t").select("g", "pos", F.col("value").alias("x"))
    v = order.with_pos(d.withColumn("value", F.abs(F.col("value") - 50)), ["g"], "t").select("g", "pos", "value")
    draws = downstream.replicated_associations(f, v, ["g"], "x", 8)
    out = pipelines.draws_summary(pipelines.equivalence_draws(draws, "g", 0.5))
    return rounded(out, *out.columns)


def _legacy_sql(purge: int) -> str:
    return _audit_sql("labels").replace(f"ceil((pred_len - 1) / 2.0)::bigint as purge", f"{purge}::bigint as purge").replace("'labels' as purge_mode", "'legacy' as purge_mode")


@query(f"{_audit_sql('labels')} union all ({_audit_sql('disjoint')}) union all ({_legacy_sql(4)})")
def purge_audit_rules(spark, sf_dir):
    return pipelines.purge_audit(cells(spark, sf_dir), 4, 10)


def runs(spark, sf_dir) -> DataFrame:
    """Orders as run records: the customer is the cell, the priority the order."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 50).alias("cell"), F.when(F.col("o_orderpriority") < "3", "det").otherwise("shuf").alias("val_order")).agg(F.floor(F.avg("o_totalprice")).cast("double").alias("mse"), F.floor(F.max("o_totalprice")).cast("double").alias("val_mse"), F.count("*").cast("int").alias("best_epoch"))


@query("""with r as (select o_custkey % 50 as cell, case when o_orderpriority < '3' then 'det' else 'shuf' end as val_order, floor(avg(o_totalprice)) as mse, floor(max(o_totalprice)) as val_mse, count(*)::int as best_epoch from orders group by 1, 2)
select a.cell, a.mse as mse_det, a.val_mse as val_mse_det, a.best_epoch as best_epoch_det, b.mse as mse_shuf, b.val_mse as val_mse_shuf, b.best_epoch as best_epoch_shuf, round(100 * (b.mse - a.mse) / nullif(a.mse, 0), 6) + 0.0::double as rel_diff_pct,
 round(abs(100 * (b.mse - a.mse) / nullif(a.mse, 0)), 6) as abs_rel_diff_pct, case when a.best_epoch = b.best_epoch then 1 else 0 end as same_best_epoch from r a join r b using (cell) where a.val_order = 'det' and b.val_order = 'shuf'""")
def rng_tax(spark, sf_dir):
    return rounded(pipelines.rng_tax(runs(spark, sf_dir), ["cell"]), "rel_diff_pct", "abs_rel_diff_pct")


@query(f"""with {SERIES}, k as (select series_id, pos // 50 as w, pos % 50 as k, value from s), z as (select *, sqrt(var_pop(value) over (partition by series_id, w) + 1e-5) as wsd, greatest(k - 2, 0) // 16 as slice from k),
g as (select series_id, w, slice, avg(value) filter (k >= 2) as m, greatest(sqrt(var_pop(value) filter (k >= 2) + 1e-5), 0.1 * max(wsd)) as sd from z group by 1, 2, 3)
select z.series_id, z.w, z.k, round((z.value - g.m) / g.sd, 6) + 0.0::double as normalised from z join g using (series_id, w, slice) where g.m is not null""")
def slice_normalise(spark, sf_dir):
    k = inputs.series(spark, sf_dir).select("series_id", F.floor(F.col("pos") / 50).alias("w"), (F.col("pos") % 50).alias("k"), "value")
    return rounded(features.slice_normalise(k, ["series_id", "w"], 50), "normalised").select("series_id", "w", "k", "normalised")


@query(f"with {SERIES}, l as (select series_id, pos, value, lead(value) over (partition by series_id order by pos) as following from s) select * from l where following is not null")
def lag_pairs(spark, sf_dir):
    return features.lag_pairs(inputs.series(spark, sf_dir), ["series_id"])


@query(f"""with {ARMS}, {permuted_sql('a', 'g, arm', 'law')}, c as (select 'index' as condition, * from a union all select 'defect', * from p),
b as (select condition, pos, arg_min(arm, struct_pack(v := value, a := arm)) as label from c group by 1, 2), n as (select condition, label, count(*) as c from b group by 1, 2), f as (select *, c / sum(c) over (partition by condition) as f from n)
select condition, round(max(f), 6) as modal_share, round(sum(-f * log2(f)), 6) as entropy_bits from f group by 1""")
def label_law_conditions(spark, sf_dir):
    a = inputs.arms(spark, sf_dir)
    moved = order.apply_permutation(a, order.full_permutation(a, ["g", "arm"], "law"), ["g", "arm"])
    both = a.withColumn("condition", F.lit("index")).unionByName(moved.withColumn("condition", F.lit("defect")))
    return rounded(downstream.label_law(both, ["condition"]), "modal_share", "entropy_bits").select("condition", "modal_share", "entropy_bits")


_THREE = f"""{HOURLY_ASSOCIATION}, q19d as (select g, row_number() over (partition by g order by md5(concat_ws('|', 'q19', g, pos)), pos) - 1 as pos, value from x), q19c as (select g, row_number() over (partition by g order by md5(concat_ws('|', 'q19c', g, pos)), pos) - 1 as pos, f_std from x),
th as (select 'index' as condition, g, pos, f_std, value from x union all select 'defect', x.g, x.pos, x.f_std, q.value from x join q19d q on q.g = x.g and q.pos = x.pos union all select 'control', x.g, x.pos, q.f_std, x.value from x join q19c q on q.g = x.g and q.pos = x.pos)"""


@query(f"with {_THREE}, {sql.dependence_aware('th', 'condition, g', 'f_std', 'value', L + H, 2000, 2000)} select condition, g, {_DA_COLUMNS} from da")
def difficulty_dep_aware(spark, sf_dir):
    """The dependence-aware association of all three joins; conditions are keys of one plan."""
    df = hourly_association(spark, sf_dir)
    x, y = df.select("g", "pos", "f_std"), df.select("g", "pos", "value")
    joined = downstream.three_conditions(x, y, order.full_permutation(y, ["g"], "q19"), order.full_permutation(y, ["g"], "q19c"), ["g"])
    return _da_rounded(assoc.dependence_aware(joined.select("condition", "g", "pos", "f_std", "value"), ["condition", "g"], "f_std", "value", L, H))


@query("select 'cell' as cell_id, product, 'ok' as status, null::varchar as reason, 64::bigint as n from (values ('val_index_order'), ('val_loader_order')) t(product)")
def backfill_report(spark, sf_dir):
    from seriata.sources.files import fixture_cell, fixture_identity

    inputs.ship(spark)
    names = ["val_index_order", "val_loader_order"]
    legacy = fixture_identity(spark, products=names).select("cell_id", "product", F.lit(None).cast("string").alias("schema_version"), F.split("product", "_")[1].alias("order"), F.lit(64).cast("bigint").alias("n_windows"))
    return contract.backfill_plan(legacy, fixture_cell(spark))

from seriata.plans import report_queries  # noqa: E402,F401  registers its queries here
