"""Composite reports: each one plan over all cells, with no loop over cells.

values: (cell_id, split, pos, value) in index order; arms: (group..., arm, pos, value);
perms: (cell_id, split, pos, src_pos), the observed loader order. Variants become a column
and a key, so all of them go through one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriata.functions.columns import indicator
from seriata.functions.stats import normal_sf_col, t_sf_col
from seriata.operators import assoc, diagnose, joins, order, reports, split

Key = Sequence[str]
ALPHAS = (0.05, 0.01, 1e-3, 1e-6, 1e-12)
CELL = ("cell_id", "split")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def with_p(df: DataFrame, z: str = "z", alpha: float = diagnose.ALPHA) -> DataFrame:
    return df.withColumn("p", normal_sf_col(F.col(z))).withColumn("reject", indicator(F.col("p") < alpha))


def sequence_variants(values: DataFrame, perms: DataFrame | None, seed: object) -> DataFrame:
    """values with variant: index_order, full_permutation and, where perms has the cell, observed_loader_order."""
    key = list(CELL)
    parts = [values.withColumn("variant", F.lit("index_order")), order.shuffled(values, key, seed).withColumn("variant", F.lit("full_permutation"))]
    if perms is not None:
        parts.append(order.apply_permutation(values, perms, key).withColumn("variant", F.lit("observed_loader_order")))
    return union(*parts)


def loader_orders(values: DataFrame, observed: DataFrame, key: Key, seed: object) -> DataFrame:
    """Q9: key..., pos, src_pos, perm_source: the observed order of each key that has one, a simulated order for the others."""
    rest = values.select(*key, "pos").join(observed.select(*key).distinct(), list(key), "left_anti")
    made = order.full_permutation(rest, key, seed).withColumn("perm_source", F.lit("simulated"))
    return observed.select(*key, "pos", "src_pos", F.lit("observed").alias("perm_source")).unionByName(made)


def difficulty_associations(features: DataFrame, values: DataFrame, orders: DataFrame, key: Key, columns: Sequence[str], seed: object) -> DataFrame:
    """Q9's description: key..., condition, perm_source and the association columns of all keys in one plan; orders as loader_orders gives them."""
    from seriata.operators import downstream

    joined = downstream.three_conditions(features, values, orders.drop("perm_source"), order.full_permutation(values, key, f"{seed}/control"), key)
    out = assoc.with_naive_p(assoc.association(joined, ["condition", *key], columns, "value"))
    return out.join(orders.select(*key, "perm_source").distinct(), list(key))


def aot_sequences(values: DataFrame, perms: DataFrame | None = None, seed: object = 0) -> DataFrame:
    """Q3: cell_id, split, variant, n, r, null_mean, null_sd, z, p, reject; ids of the cells join on cell_id."""
    return with_p(diagnose.aot_statistics(diagnose.aot_moments(sequence_variants(values, perms, seed), [*CELL, "variant"])))


def aot_calibration(values: DataFrame, draws: int = 2000, cells: int | None = None, seed: int = 0) -> DataFrame:
    """Q4: cell_id, split, n, p_normal, p_perm over `cells` vectors (all by default), chosen by a hash."""
    key = list(CELL)
    if cells is not None:
        values = values.join(order.subsample(values.select(*key).distinct(), cells, seed, *key), key, "left_semi")
    z = with_p(diagnose.aot_statistics(diagnose.aot_moments(values, key))).select(*key, "n", F.col("p").alias("p_normal"))
    return z.join(diagnose.aot_monte_carlo(values, key, draws, seed).select(*key, "p_perm"), key)


def aot_sensitivity(values: DataFrame, blocks: Sequence[int] = (8, 32, 128, 512), fractions: Sequence[float] = (0.05, 0.1, 0.25, 0.5, 1.0), seed: object = 0) -> DataFrame:
    """Q5: cell_id, split, kind, param, n, z, p, reject under block and partial shuffles."""
    key = list(CELL)
    made = [(order.block_permutation(values, key, b, f"{seed}/{b}"), "block", float(b)) for b in blocks] + [(order.partial_permutation(values, key, f, f"{seed}/{f}"), "partial", float(f)) for f in fractions]
    rows = union(*[order.apply_permutation(values, p, key).withColumn("kind", F.lit(k)).withColumn("param", F.lit(x)) for p, k, x in made])
    return with_p(diagnose.aot_statistics(diagnose.aot_moments(rows, [*key, "kind", "param"]))).select(*key, "kind", "param", "n", "z", "p", "reject")


def _agreement(arms: DataFrame, key: Key, draws: int, seed: int = 0) -> DataFrame:
    """agreement with p_analytic and p: by `draws` Monte-Carlo draws, or the analytic one where draws is 0."""
    out = diagnose.agreement(arms, key).withColumn("p_analytic", normal_sf_col(F.col("z_corrected")))
    if not draws:
        return out.withColumn("p", F.col("p_analytic"))
    return out.join(diagnose.agreement_monte_carlo(arms, key, draws, seed).select(*key, "p"), list(key), "left")


def spearman_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation by Student's distribution; 0 at +-1."""
    df = (n - 2).cast("double")
    room = F.greatest(1 - rho * rho, F.lit(0.0))
    return F.when(room > 0, 2 * t_sf_col(F.abs(rho) * F.sqrt(df / F.when(room > 0, room)), df)).otherwise(0.0)


def cat_blocks(arms: DataFrame, group: Key, draws: int = 2000, seed: object = 0) -> DataFrame:
    """Q8: group..., variant (index_order, full_permutation, pair:a~b), n_arms, arms, n, rho_bar, p, z_corrected, z_naive over the windows that all arms have; group is (block_id, seed, val_order) in the published report."""
    arms = joins.stack_arms(arms, group)
    names = arms.groupBy(*group).agg(F.array_join(F.sort_array(F.collect_set("arm")), "|").alias("arms"))
    both = union(arms.withColumn("variant", F.lit("index_order")), order.inject_sharing(arms, group, "independent", seed).withColumn("variant", F.lit("full_permutation")))
    whole = _agreement(both, [*group, "variant"], draws)
    pairs = diagnose.pairwise_spearman(arms, group)
    z = F.col("rho") * F.sqrt((F.col("n") - 1).cast("double"))
    pairs = pairs.select(*group, F.concat(F.lit("pair:"), "arm_a", F.lit("~"), "arm_b").alias("variant"), F.lit(2).cast("bigint").alias("n_arms"), "n", F.col("rho").alias("rho_bar"), z.alias("z_corrected"), z.alias("z_naive"))
    pairs = pairs.withColumn("p", spearman_p(F.col("rho_bar"), F.col("n")))
    cols = [*group, "variant", "n_arms", "n", "rho_bar", "p", "z_corrected", "z_naive"]
    out = whole.withColumn("n_arms", F.col("n_arms").cast("bigint")).select(*cols).unionByName(pairs.select(*cols))
    return out.join(names, list(group)).select(*group, "variant", "n_arms", "arms", "n", "rho_bar", "p", "z_corrected", "z_naive")


def battery(arms: DataFrame, group: Key, seq_len: int, pred_len: int, strides: Sequence[int] = (1, 4, 16, 64, 192, 512), minimum: int = 40, draws: int = 2000, seed: object = 0) -> DataFrame:
    """Q15: group..., variant, stride, overlap_ratio, n, n_arms, aot_median_p, aot_certify_rate, cat_rho_bar, cat_p, cat_certify on stride grids of `minimum` windows at least; the shuffled variant permutes each grid by itself."""
    at = [*group, "stride"]
    grid = order.strided(joins.stack_arms(arms, group), strides).withColumn("pos", F.expr("pos div stride"))
    large = grid.groupBy(*at).agg(F.countDistinct("pos").alias("_n")).where(F.col("_n") >= minimum).select(*at)
    grid = grid.join(large, at, "left_semi")
    rows = union(grid.withColumn("variant", F.lit("index_order")), order.inject_sharing(grid, at, "independent", seed).withColumn("variant", F.lit("full_permutation")))
    key = [*group, "variant", "stride"]
    one = with_p(diagnose.aot_statistics(diagnose.aot_moments(rows, [*key, "arm"])))
    one = one.groupBy(*key).agg(F.median("p").alias("aot_median_p"), F.avg(F.col("reject").cast("double")).alias("aot_certify_rate"))
    cat = _agreement(rows, key, draws)
    out = cat.join(one, key).withColumn("overlap_ratio", order.overlap_ratio(F.col("stride"), seq_len, pred_len))
    return out.select(*key, "overlap_ratio", "n", F.col("n_arms").cast("bigint").alias("n_arms"), "aot_median_p", "aot_certify_rate", F.col("rho_bar").alias("cat_rho_bar"), F.col("p").alias("cat_p"), indicator(F.col("p") < diagnose.ALPHA).alias("cat_certify"))


def certification(sequences: DataFrame, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """Q16: sequences (variant, z): alpha, n_clean, n_corrupted, clean_certified_pct, corrupted_certified_pct."""
    from seriata.functions.stats import normal_isf

    rows = sequences.where(F.col("variant").isin("index_order", "full_permutation"))
    limits = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(normal_isf(a)).alias("limit")) for a in alphas])
    rows = rows.select("variant", "z", F.explode(limits).alias("l")).select("variant", "z", "l.alpha", "l.limit")
    clean = F.col("variant") == "index_order"
    rate = lambda c: 100 * F.avg(F.when(c, indicator(F.col("z") > F.col("limit")).cast("double")))
    return rows.groupBy("alpha").agg(F.count(F.when(clean, 1)).alias("n_clean"), F.count(F.when(~clean, 1)).alias("n_corrupted"), rate(clean).alias("clean_certified_pct"), rate(~clean).alias("corrupted_certified_pct"))


def margin(sequences: DataFrame) -> DataFrame:
    """Least, median and greatest z and r per variant."""
    return sequences.groupBy("variant").agg(*[f(c).alias(f"{n}_{c}") for c in ("z", "r") for n, f in (("min", F.min), ("median", F.median), ("max", F.max))])


def observed_scan(intact: DataFrame, perms: DataFrame, group: Key, draws: int = 2000, loader: DataFrame | None = None) -> DataFrame:
    """Q17: perms (group..., arm, pos, src_pos) on intact arms: sharing of the orders, correlation of the orders, agreement and AOT of the loader vectors, and whether recorded loader vectors (loader; made from the orders by default) are what the orders make of the intact ones. group is (block_id, seed) in the published report."""
    key = [*group, "arm"]
    made = order.apply_permutation(intact, perms, key)
    loader = made if loader is None else loader
    consistent = joins.allclose_violations(made, loader, key).groupBy(*group).agg((F.max("worst") <= 0).cast("int").alias("perm_consistent"))
    sharing = diagnose.permutation_sharing(perms, group)
    pairs = diagnose.pairwise_spearman(perms.select(*key, "pos", F.col("src_pos").cast("double").alias("value")), group)
    rho = F.col("rho")
    rhos = pairs.groupBy(*group).agg(F.count("*").alias("n_pairs"), F.avg(rho).alias("spearman_perm_mean"), F.max(rho).alias("spearman_perm_max"), F.min(rho).alias("spearman_perm_min"), F.max(F.when(rho < 1 - 1e-12, rho)).alias("spearman_perm_max_nonidentical"))
    names = intact.groupBy(*group).agg(F.array_join(F.sort_array(F.collect_set("arm")), "|").alias("arms"))
    cat = lambda d, tail: _agreement(d, group, draws).select(*group, *([F.col("n").alias("n_windows")] if not tail else []), F.col("rho_bar").alias(f"cat_rho_bar{tail}"), F.col("p").alias(f"cat_p_mc{tail}"), indicator(F.col("p") < diagnose.ALPHA).alias(f"cat_certified{tail}"), *([F.col("p_analytic").alias("cat_p_analytic")] if not tail else []))
    one = with_p(diagnose.aot_statistics(diagnose.aot_moments(loader, key))).groupBy(*group).agg(F.min("p").alias("aot_p_min"), F.max("p").alias("aot_p_max"), F.median("p").alias("aot_p_median"), F.sum("reject").alias("n_arms_aot_rejects"), F.count("*").alias("n_arms_aot"))
    out = reduce(lambda a, b: a.join(b, list(group)), [names, rhos, sharing, consistent, cat(loader, ""), cat(intact, "_intact"), one])
    renamed = {"identical_pairs": "n_pairs_identical", "n_distinct": "n_distinct_perms", "sharing": "perm_sharing", "non_identity": "n_arms_misordered"}
    return out.withColumnsRenamed(renamed)


def analytic_check(mc: DataFrame) -> DataFrame:
    """Rows (z_corrected, p, null_sd, n_arms, n): |p analytic - p Monte-Carlo| and the ratio of the deviations."""
    m = F.col("n_arms") * (F.col("n_arms") - 1) / 2
    out = mc.withColumn("p_analytic", normal_sf_col(F.col("z_corrected"))).withColumn("sd_ratio", F.col("null_sd") * F.sqrt(m * (F.col("n") - 1)))
    return out.withColumn("p_error", F.abs(F.col("p_analytic") - F.col("p")))


def equivalence_draws(draws: DataFrame, block: str, margin_: float) -> DataFrame:
    """Q12: draws (block, draw, condition, rho): per draw a TOST of defect against control over blocks, and one over the draws' means: draw (NULL for the mean), n, mean_diff, p_tost, ..."""
    wide = draws.groupBy(block, "draw").pivot("condition", ["defect", "control"]).agg(F.avg("rho")).withColumn("d", F.col("defect") - F.col("control"))
    single = assoc.equivalence_test(wide, ["draw"], "d", margin_)
    mean = wide.groupBy(block).agg(F.avg("d").alias("d")).withColumn("draw", F.lit(None).cast(wide.schema["draw"].dataType))
    return single.unionByName(assoc.equivalence_test(mean, ["draw"], "d", margin_))


def draws_summary(tests: DataFrame) -> DataFrame:
    """Least, median and greatest p of single draws, the share that certifies, and the test of the means."""
    one = F.col("draw").isNotNull()
    return tests.agg(F.min(F.when(one, F.col("p_tost"))).alias("p_min"), F.median(F.when(one, F.col("p_tost"))).alias("p_median"), F.max(F.when(one, F.col("p_tost"))).alias("p_max"), F.avg(F.when(one, F.col("equivalent_at_05").cast("double"))).alias("certify_fraction"), F.max(F.when(~one, F.col("p_tost"))).alias("p_of_means"))


def purge_audit(cells: DataFrame, legacy: int = 200, min_windows: int = split.MIN_WINDOWS) -> DataFrame:
    """Q20: the split audit under both rules and under a constant purge."""
    return union(split.audited_split(cells, "labels", min_windows=min_windows), split.audited_split(cells, "disjoint", min_windows=min_windows), split.audited_split(cells, "labels", min_windows=min_windows, purge=F.lit(legacy)).withColumn("purge_mode", F.lit("legacy")))


STATISTICS = ("index_median_rho", "defect_minus_index_median", "control_minus_index_median", "defect_minus_control_median", "index_frac_p_block_lt_05", "index_frac_ci_excludes_zero", "index_frac_p_iid_lt_05")


def cluster_inputs(cells: DataFrame) -> DataFrame:
    """cells (dataset, seq_len, pred_len, rho_index, rho_defect, rho_control, p_block, ci_excludes_zero, p_iid): the seven statistics' values and the two cluster definitions."""
    c = F.col
    low = lambda p: F.when(c(p).isNotNull(), (c(p) < 0.05).cast("double"))
    values = [c("rho_index"), c("rho_defect") - c("rho_index"), c("rho_control") - c("rho_index"), c("rho_defect") - c("rho_control"), low("p_block"), c("ci_excludes_zero").cast("double"), low("p_iid")]
    sample_set = F.concat_ws("|", "dataset", F.concat(F.lit("L"), "seq_len"), F.concat(F.lit("H"), "pred_len"), F.lit("val"))
    return cells.withColumn("sample_set", sample_set).withColumns(dict(zip(STATISTICS, values)))


def cluster_summary(cells: DataFrame, clusters: Sequence[str], statistics: Sequence[str] = STATISTICS, n_boot: int = 2000, seed: object = 0) -> DataFrame:
    """Q21: statistic, cluster, point, ci_lo, ci_hi, ...: statistics are unpivoted, so one bootstrap plan per cluster definition serves all; medians, and means for fractions (names with _frac_)."""
    long = cells.select(*clusters, F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value")) for s in statistics])).alias("s")).select(*clusters, "s.*")
    parts = []
    for stat in ("median", "mean"):
        own = [s for s in statistics if ("_frac_" in s) == (stat == "mean")]
        if own:
            rows = long.where(F.col("statistic").isin(own))
            parts += [assoc.cluster_bootstrap(rows, ["statistic"], c, "value", n_boot, seed, stat).withColumn("cluster", F.lit(c)) for c in clusters]
    return union(*parts)


def headline(cells: DataFrame, audit: DataFrame) -> DataFrame:
    """Q21's headline: name, value over cells (cluster_inputs') and audit rows (purge_mode, holdout_eligible, block_len, block_len_capped), each from one pass."""
    r = F.col("rho_index")
    quartile = lambda q: F.percentile(r, q)
    first = reports.scalars(
        cells,
        n_cells=F.count("*"), n_sequences_val_plus_test=2 * F.count("*"), n_distinct_sample_sets_val=F.countDistinct("sample_set"), n_distinct_sample_sets=2 * F.countDistinct("sample_set"), n_datasets=F.countDistinct("dataset"),
        rho_median=F.median(r), rho_q1=quartile(0.25), rho_q3=quartile(0.75), rho_iqr=quartile(0.75) - quartile(0.25), rho_min=F.min(r), rho_max=F.max(r),
        frac_p_block_lt_05=F.avg("index_frac_p_block_lt_05"), frac_ci_excludes_zero=F.avg("index_frac_ci_excludes_zero"), frac_p_iid_naive_lt_05=F.avg("index_frac_p_iid_lt_05"),
    )
    mode = lambda m, e: F.count(F.when((F.col("purge_mode") == m) & (F.col("holdout_eligible") == e), 1))
    own = F.col("purge_mode") == "disjoint"
    second = reports.scalars(audit, block_len_median=F.median(F.when(own, F.col("block_len"))), block_len_capped_cells=F.sum(F.when(own, F.col("block_len_capped"))), **{f"{m}_{n}": mode(m, e) for m in split.MODES for n, e in (("eligible", 1), ("ineligible", 0))})
    return first.unionByName(second)


def task_equivalence(rows: DataFrame, task: str, block: str, value: str, cluster: str, margin_: float) -> DataFrame:
    """Q11: one row per task: the paired test of defect against control over blocks, and the same over clusters' means (clustered_...). rows: (block, condition, cluster, value)."""
    wide = rows.groupBy(block).pivot("condition", ["defect", "control"]).agg(F.avg(value)).join(rows.groupBy(block).agg(F.min(cluster).alias(cluster)), block)
    wide = wide.withColumn("d", F.col("defect") - F.col("control")).withColumn("task", F.lit(task))
    one = assoc.equivalence_test(wide, ["task"], "d", margin_)
    many = assoc.equivalence_test_clustered(wide, ["task"], cluster, "d", margin_)
    return one.join(many.select("task", *[F.col(c).alias(f"clustered_{c}") for c in many.columns if c != "task"]), "task")


def downstream_paired(rows: Sequence[tuple[str, str, str, DataFrame]]) -> DataFrame:
    """Q11: (task, block, value, rows) -> task, condition, ...: every task's paired differences from the right join, with p."""
    parts = [assoc.with_paired_p(assoc.paired_summary(df, block, "condition", value, ["defect", "control"])).withColumn("task", F.lit(task)) for task, block, value, df in rows]
    return union(*parts)


def rng_tax(runs: DataFrame, key: Key) -> DataFrame:
    """Q14: runs that differ in val_order only: key..., mse and val_mse of both, relative differences in percent, best epochs."""
    cols = ["mse", "val_mse", "best_epoch"]
    a = runs.where("val_order = 'det'").select(*key, *[F.col(c).alias(f"{c}_det") for c in cols])
    b = runs.where("val_order = 'shuf'").select(*key, *[F.col(c).alias(f"{c}_shuf") for c in cols])
    rel = 100 * (F.col("mse_shuf") - F.col("mse_det")) / F.nullif(F.col("mse_det"), F.lit(0.0))
    return a.join(b, list(key)).withColumn("rel_diff_pct", rel).withColumn("abs_rel_diff_pct", F.abs("rel_diff_pct")).withColumn("same_best_epoch", indicator(F.col("best_epoch_det") == F.col("best_epoch_shuf")))


def run_numbers(runs: DataFrame) -> DataFrame:
    """Q24 over run records: name, value: counts, budgets and per-axis totals, from one pass and one grouping set."""
    whole = reports.scalars(
        runs, runs=F.count("*"), hours=F.sum("train_seconds") / 3600, epochs=F.sum("epochs_run"), datasets=F.countDistinct("dataset"), backbones=F.countDistinct("backbone"), plugins=F.countDistinct("plugin"), horizons=F.countDistinct("pred_len"), seeds=F.countDistinct("seed"),
        median_mse=F.median("mse"), slowest=F.max("train_seconds"), shortest_val=F.min("n_val_windows"), longest_val=F.max("n_val_windows"), windows_val=F.sum("n_val_windows"), windows_test=F.sum("n_test_windows"), evaluations=F.sum(F.col("n_val_windows") + F.col("n_test_windows")), truncated=F.sum(F.col("truncated").cast("int")),
    )
    axes = ["dataset", "backbone", "plugin", "val_order"]
    sets = union(*[runs.groupBy(F.col(a).alias("k")).agg(F.count("*").cast("double").alias("runs"), (F.sum("train_seconds") / 3600).alias("hours")).withColumn("axis", F.lit(a)) for a in axes])
    per = sets.select(F.explode(F.array(*[F.struct(F.concat_ws("_", F.lit(m), "axis", "k").alias("name"), F.col(m).alias("value")) for m in ("runs", "hours")])).alias("s")).select("s.name", "s.value")
    return whole.unionByName(per)


def report_numbers(certified: DataFrame, taxes: DataFrame, cats: DataFrame, paired: DataFrame, batteries: DataFrame) -> DataFrame:
    """Q24 over reports: name, value: the figures a text quotes from certification (Q16), rng_tax (Q14), cat_blocks (Q8), downstream_paired (Q11) and battery (Q15)."""
    label = lambda *c: F.concat_ws("_", *c)
    unpivot = lambda df, ident, cols: df.select(F.explode(F.array(*[F.struct(label(F.lit(c), *ident).alias("name"), F.col(c).cast("double").alias("value")) for c in cols])).alias("s")).select("s.name", "s.value")
    tax = reports.scalars(taxes, rng_pairs=F.count("*"), rng_median_abs_pct=F.median("abs_rel_diff_pct"), rng_max_abs_pct=F.max("abs_rel_diff_pct"), rng_same_epoch_pct=100 * F.avg("same_best_epoch"))
    blocks = cats.where(F.col("variant").isin("index_order", "full_permutation")).groupBy("variant").agg(F.count("*").alias("cat_blocks"), F.median("rho_bar").alias("cat_median_rho"), (100 * F.avg((F.col("p") < 0.05).cast("double"))).alias("cat_certified_pct"))
    pairs = reports.scalars(cats.where(F.col("variant").startswith("pair:")), cat_pairs=F.count("*"), cat_pair_median_rho=F.median("rho_bar"), cat_pair_min_rho=F.min("rho_bar"))
    grid = batteries.groupBy("variant", "stride").agg(F.avg("aot_certify_rate").alias("aot_rate"), F.avg(F.col("cat_certify").cast("double")).alias("cat_rate"), F.min("n").alias("grid_n"))
    return union(unpivot(certified, [F.col("alpha").cast("string")], ["clean_certified_pct", "corrupted_certified_pct"]), tax, unpivot(blocks, [F.col("variant")], ["cat_blocks", "cat_median_rho", "cat_certified_pct"]), pairs, unpivot(paired, [F.col("task"), F.col("condition")], ["mean_diff", "median_diff", "wilcoxon_p"]), unpivot(grid, [F.col("variant"), F.col("stride").cast("string")], ["aot_rate", "cat_rate", "grid_n"]), order_zero_overlap(batteries))


def order_zero_overlap(batteries: DataFrame) -> DataFrame:
    """name, value: the smallest stride of the grids at which neighbouring windows share nothing."""
    return reports.scalars(batteries.where(F.col("overlap_ratio") == 0), min_stride_no_overlap=F.min("stride"))


def grid_table(runs: DataFrame) -> DataFrame:
    """Q25: runs and hours by backbone, with a total."""
    return reports.with_total(runs, "backbone", runs=F.count("*"), hours=F.sum("train_seconds") / 3600)


def budget_table(runs: DataFrame) -> DataFrame:
    """Q25: dataset, backbone, runs, hours, epochs, median_mse, with subtotals ("all") along both."""
    g = runs.cube("dataset", "backbone").agg(F.grouping("dataset").alias("_d"), F.grouping("backbone").alias("_b"), F.count("*").alias("runs"), (F.sum("train_seconds") / 3600).alias("hours"), F.sum("epochs_run").alias("epochs"), F.median("mse").alias("median_mse"))
    named = lambda c, flag: F.when(F.col(flag) == 1, "all").otherwise(F.col(c)).alias(c)
    return g.select(named("dataset", "_d"), named("backbone", "_b"), "runs", "hours", "epochs", "median_mse")


def certification_table(sequences: DataFrame, alphas: Sequence[float] = (0.05, 0.01, 1e-3)) -> DataFrame:
    """Q25: variant, one certified_pct column per alpha, n."""
    from seriata.functions.stats import normal_isf

    return sequences.groupBy("variant").agg(F.count("*").alias("n"), *[(100 * F.avg(indicator(F.col("z") > normal_isf(a)).cast("double"))).alias(f"certified_pct_{i}") for i, a in enumerate(alphas)])


def sharing_table(conditions: DataFrame) -> DataFrame:
    """Q25: cat_conditions (condition, rho_bar) as one row, a column per condition in the published order."""
    return conditions.groupBy().pivot("condition", list(order.SHARING)).agg(F.first("rho_bar"))


def rng_tax_table(taxes: DataFrame, by: Key) -> DataFrame:
    """Q25: by..., pairs, median and greatest |difference| in percent, share with the same best epoch."""
    return taxes.groupBy(*by).agg(F.count("*").alias("pairs"), F.median("abs_rel_diff_pct").alias("median_abs_pct"), F.max("abs_rel_diff_pct").alias("max_abs_pct"), (100 * F.avg("same_best_epoch")).alias("same_epoch_pct"))


def scatter_points(features: DataFrame, values: DataFrame, x: str, y: str, key: Key) -> DataFrame:
    """Q26: the rows that a scatter of x against the log of y shows; figures are drawn elsewhere."""
    from seriata.functions.columns import clamped_log

    return features.join(values, [*key, "pos"]).select(*key, "pos", F.col(x).alias("x"), clamped_log(F.col(y)).alias("y"))


def violin_quantiles(df: DataFrame, key: Key, value: str, steps: int = 20) -> DataFrame:
    """Q26: key..., k, q, value: the quantiles that outline a violin."""
    qs = [i / steps for i in range(steps + 1)]
    return df.groupBy(*key).agg(F.percentile(value, qs).alias("v")).select(*key, F.posexplode("v").alias("k", "value")).withColumn("q", F.col("k") / steps)


def verify(computed: DataFrame, declared: DataFrame) -> DataFrame:
    """Q27: figures recomputed against an independent table of declared ones: name, computed, declared, decimals, ok, and why not."""
    out = reports.verify_numbers(computed, declared)
    why = F.when(F.col("ok"), None).when(F.col("declared").isNull(), "not declared").when(F.col("computed").isNull(), "not computed").otherwise("differs")
    return out.withColumn("problem", why)


def rate_of(flag: Column) -> Column:
    return reports.rate(flag)
