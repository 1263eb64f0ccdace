"""Analyses of joined tables under three conditions, arm selection, label laws.

Conditions: index (the right join), defect (values in loader order joined by position),
control (shuffled features). The regression's trees are functions/boost.py's, a fit per task; the
classifier is pyspark.ml's and runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriata.functions.boost import Boosting
from seriata.functions.columns import clamped_log
from seriata.operators import assoc, joins, order, split

Key = Sequence[str]
CONDITIONS = ("index", "defect", "control")


def three_conditions(features: DataFrame, values: DataFrame, perm: DataFrame, control: DataFrame, key: Key) -> DataFrame:
    """condition, key..., pos, features..., value: the three joins of one feature table and one value vector."""
    right = features.join(values.select(*key, "pos", "value"), [*key, "pos"])
    made = {"index": right, "defect": joins.defect_join(features, values, perm, key), "control": joins.control_join(features, values, control, key)}
    cols = right.columns
    out = None
    for name, df in made.items():
        part = df.select(F.lit(name).alias("condition"), *cols)
        out = part if out is None else out.unionByName(part)
    return out


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(df)


def regressor(seed: int = 0, iterations: int = 200) -> Boosting:
    """M3: the reference's settings; nothing is drawn, so every seed gives the same trees."""
    return Boosting(iterations=iterations, rate=0.08, depth=3, least=40, l2=1.0)


def classifier(seed: int = 0) -> RandomForestClassifier:
    """Several classes: Spark's boosted trees know two only."""
    return RandomForestClassifier(featuresCol="_x", labelCol="_y", predictionCol="pick", numTrees=60, maxDepth=6, minInstancesPerNode=20, seed=seed)


def difficulty_regression(joined: DataFrame, test: DataFrame, columns: Sequence[str], seq_len: int, pred_len: int, purge: int | None = None, mode: str = "disjoint", seed: int = 0, iterations: int = 200) -> DataFrame:
    """M1: joined (condition, pos, columns, value) and test (columns, value): condition, spearman_test, r2_test, spearman_holdout, holdout_eligible and association. The target is the log of the value.

    All fits are groups of one plan; a fit's rows are in one task's memory. Rows with an undefined feature are left out. Runs at once and returns the rows, so that the joins are made once."""
    learner = regressor(seed, iterations)
    columns = list(columns)
    joined = joined.cache()
    cols = [*[F.col(c).cast("double").alias(c) for c in columns], clamped_log(F.col("value")).alias("_y")]
    rows = joined.where(F.col("condition").isin(*CONDITIONS)).dropna(subset=columns).select("condition", F.col("pos").cast("bigint").alias("pos"), *cols)
    cells = rows.groupBy("condition").agg(F.count("*").alias("n")).withColumn("seq_len", F.lit(seq_len)).withColumn("pred_len", F.lit(pred_len))
    audit = split.audited_split(cells, mode) if purge is None else cells.withColumn("holdout_eligible", F.lit(1)).withColumn("purge_origins", F.lit(purge))
    audit = audit.select("condition", "holdout_eligible", F.col("purge_origins").cast("int").alias("purge_origins"), F.col("n").alias("n_val"))
    sides = split.purged_split(rows.join(F.broadcast(audit.where("holdout_eligible = 1")), "condition"), F.col("n_val"), F.col("purge_origins"), origin="pos").where("side is not null")  # a row per condition
    given = test.dropna(subset=columns).select(F.explode(F.array(*[F.lit(c) for c in CONDITIONS])).alias("condition"), F.lit(None).cast("bigint").alias("pos"), *cols)
    part = lambda df, fit, side: df.select(F.lit(fit).alias("fit"), side.alias("side"), "condition", "pos", *columns, "_y")
    parts = part(rows, "test", F.lit("train")).unionByName(part(given, "test", F.lit("test"))).unionByName(part(sides, "holdout", F.col("side")))

    def one(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        train, rest = df[df.side == "train"].sort_values("pos"), df[df.side != "train"]
        if train.empty:
            raise ValueError(f"no rows to fit for {key}")
        fitted = learner.fit_predict(train[columns].to_numpy(), train["_y"].to_numpy(), rest[columns].to_numpy())
        return pd.DataFrame({"condition": key[0], "fit": key[1], "_y": rest["_y"], "fitted": fitted})

    fitted = parts.groupBy("condition", "fit").applyInPandas(one, "condition string, fit string, _y double, fitted double").cache()
    rho = assoc.spearman(fitted, ["condition", "fit"], "fitted", "_y").groupBy("condition").agg(*[F.max(F.when(F.col("fit") == fit, F.col("rho"))).alias(f"spearman_{fit}") for fit in ("test", "holdout")])
    r2 = assoc.r_squared(fitted.where("fit = 'test'"), ["condition"], "_y", "fitted")
    out = rho.join(r2, "condition").join(audit, "condition").select("condition", "spearman_test", F.col("r2").alias("r2_test"), "spearman_holdout", "holdout_eligible", "purge_origins", "n_val")
    out = out.join(assoc.association(joined, ["condition"], columns, "value", main=columns[0]), "condition")
    try:
        return joined.sparkSession.createDataFrame(out.collect(), out.schema)  # a row per condition
    finally:
        fitted.unpersist()
        joined.unpersist()


def best_arms(arms: DataFrame, group: Key) -> DataFrame:
    """Group..., pos, label (arm of least value, first arm by name at ties), best."""
    return arms.groupBy(*group, "pos").agg(F.min_by("arm", F.struct("value", "arm")).alias("label"), F.min("value").alias("best"), F.avg("value").alias("mean"))


def headroom(val: DataFrame, test: DataFrame, group: Key) -> DataFrame:
    """A.6: group..., best_fixed_arm (least mean on val), best_fixed_mse, oracle_mse, random_arm_mse (on test), oracle_headroom_pct, n_arms."""
    fixed = val.groupBy(*group, "arm").agg(F.avg("value").alias("m")).groupBy(*group).agg(F.min_by("arm", F.struct("m", "arm")).alias("best_fixed_arm"), F.count("*").alias("n_arms"))
    per = test.groupBy(*group, "arm").agg(F.avg("value").alias("best_fixed_mse"))
    at = best_arms(test, group).groupBy(*group).agg(F.avg("best").alias("oracle_mse"), F.avg("mean").alias("random_arm_mse"))
    out = fixed.join(per.withColumnRenamed("arm", "best_fixed_arm"), [*group, "best_fixed_arm"]).join(at, list(group)) if group else fixed.join(per.withColumnRenamed("arm", "best_fixed_arm"), "best_fixed_arm").crossJoin(at)
    return out.withColumn("oracle_headroom_pct", 100 * (F.col("best_fixed_mse") - F.col("oracle_mse")) / F.col("best_fixed_mse"))


def arm_selection(features_val: DataFrame, val: DataFrame, features_test: DataFrame, test: DataFrame, columns: Sequence[str], perms: DataFrame, control: DataFrame, seed: int = 0) -> DataFrame:
    """M2 for one group: features (pos, columns), arms (arm, pos, value), perms (arm, pos, src_pos), control (pos, src_pos): condition, realised_mse, gain and headroom in percent, accuracy. With one label only the best fixed arm is used and the accuracy is undefined."""
    base = headroom(val, test, [])
    defect = order.apply_permutation(val.withColumn("g", F.lit(0)), perms.withColumn("g", F.lit(0)), ["g", "arm"]).select("arm", "pos", "value")
    moved = features_val.withColumnRenamed("pos", "src_pos").join(control, "src_pos").select("pos", *columns)
    made = {"index": (features_val, val), "defect": (features_val, defect), "control": (moved, val)}
    names = [r["arm"] for r in val.select("arm").distinct().orderBy("arm").collect()]  # a name per arm
    code = F.array_position(F.array(*[F.lit(a) for a in names]), F.col("label")) - 1
    target = _vectors(features_test, columns)
    truth = best_arms(test, []).select("pos", F.col("label").alias("truth"))
    out = None
    for name, (x, a) in made.items():
        labels = best_arms(a, []).withColumn("_y", code.cast("double")).select("pos", "_y")
        rows = _vectors(x.join(labels, "pos"), columns)
        if labels.select("_y").distinct().limit(2).count() < 2:
            result = base.select(F.col("best_fixed_mse").alias("realised_mse"), F.lit(None).cast("double").alias("oracle_match_acc"))
        else:
            picks = classifier(seed).fit(rows).transform(target).select("pos", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pick").cast("int") + 1).alias("arm"))
            result = picks.join(test, ["arm", "pos"]).join(truth, "pos").agg(F.avg("value").alias("realised_mse"), F.avg((F.col("arm") == F.col("truth")).cast("double")).alias("oracle_match_acc"))
        part = base.crossJoin(result).withColumn("condition", F.lit(name)).withColumn("rel_gain_vs_best_fixed", 100 * (F.col("best_fixed_mse") - F.col("realised_mse")) / F.col("best_fixed_mse"))
        out = part if out is None else out.unionByName(part)
    return out


def label_law(arms: DataFrame, group: Key) -> DataFrame:
    """Group..., modal_arm, modal_share, best_fixed_arm, best_fixed_share, modal_is_best_fixed, entropy_bits of the best-arm labels."""
    labels = best_arms(arms, group)
    shares = labels.groupBy(*group, "label").agg(F.count("*").alias("c")).withColumn("f", F.col("c") / F.sum("c").over(Window.partitionBy(*(group or [F.lit(0)]))))
    fixed = arms.groupBy(*group, "arm").agg(F.avg("value").alias("m")).groupBy(*group).agg(F.min_by("arm", F.struct("m", "arm")).alias("best_fixed_arm"))
    law = shares.groupBy(*group).agg(F.min_by("label", F.struct(-F.col("c"), "label")).alias("modal_arm"), F.max("f").alias("modal_share"), F.sum(-F.col("f") * F.log2("f")).alias("entropy_bits"))
    both = law.join(fixed, list(group)) if group else law.crossJoin(fixed)
    own = shares.select(*group, F.col("label").alias("best_fixed_arm"), F.col("f").alias("_f"))
    both = both.join(own, [*group, "best_fixed_arm"], "left").withColumn("best_fixed_share", F.coalesce("_f", F.lit(0.0))).drop("_f")
    return both.withColumn("modal_is_best_fixed", (F.col("modal_arm") == F.col("best_fixed_arm")).cast("int"))


def replicated_associations(features: DataFrame, values: DataFrame, key: Key, x: str, draws: int, seed: object = 0) -> DataFrame:
    """M4: key..., draw, condition, rho for repeated draws of the defect and control orders; the draw is one more key, so all draws run in one plan."""
    many = features.select(*key, "pos", F.col(x).alias("x")).crossJoin(F.broadcast(features.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))))
    k = [*key, "draw"]
    v = values.select(*key, "pos", "value").crossJoin(F.broadcast(features.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))))
    out = None
    for name in ("defect", "control"):
        perm = order.full_permutation(many, k, f"{seed}/{name}")
        rows = (joins.defect_join if name == "defect" else joins.control_join)(many, v, perm, k)
        part = assoc.spearman(rows, k, "x", "value").withColumn("condition", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
