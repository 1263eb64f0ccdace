"""Leakage-free chronological splits of overlapping windows, as expressions over n, L and H."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriata.functions.columns import overlap

MODES = ("labels", "disjoint")
MIN_WINDOWS = 200


def required_gap(seq_len: Column, pred_len: Column, mode: str) -> Column:
    """Origins apart so that no target point (labels) or no point at all (disjoint) is shared."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    return pred_len if mode == "labels" else seq_len + pred_len


def purge_for(seq_len: Column, pred_len: Column, mode: str) -> Column:
    """A split with purge p leaves 2 p + 1 origins between its sides."""
    return F.ceil((required_gap(seq_len, pred_len, mode) - 1) / 2.0)


def purged_split(rows: DataFrame, n: Column, purge: Column, fraction: float = 0.5, origin: str = "window_origin") -> DataFrame:
    """Rows with side train, holdout or NULL (purged); each side keeps one origin at least."""
    cut = F.floor(n * fraction)
    train = F.col(origin) < F.greatest(cut - purge, F.lit(1))
    hold = F.col(origin) >= F.least(cut + purge, n - 1)
    return rows.withColumn("side", F.when(train, "train").when(hold, "holdout"))


def span(origin: Column, seq_len: Column, pred_len: Column) -> Column:
    """Half-open endpoints of one window in raw time points."""
    mid, end = origin + seq_len, origin + seq_len + pred_len
    return F.struct(origin.alias("input_start"), mid.alias("input_end"), mid.alias("target_start"), end.alias("target_end"), origin.alias("cover_start"), end.alias("cover_end"))


def boundary_audit(last_train: Column, first_eval: Column, seq_len: Column, pred_len: Column, mode: str) -> dict[str, Column]:
    """What the realised ends share; NULL with boundary_ok 0 where a side is empty. Nothing reads the purge back."""
    a, b = span(last_train, seq_len, pred_len), span(first_eval, seq_len, pred_len)
    shared, targets = overlap(a["cover_end"], b["cover_start"]), overlap(a["target_end"], b["target_start"])
    live = last_train.isNotNull() & first_eval.isNotNull()
    ok = F.coalesce((targets if mode == "labels" else shared) == 0, F.lit(False)) & live
    when = lambda c: F.when(live, c)
    return {
        "required_origin_gap": required_gap(seq_len, pred_len, mode),
        "last_train_origin": last_train,
        "first_eval_origin": first_eval,
        "min_origin_gap_actual": when(first_eval - last_train),
        "last_train_target_end": when(a["target_end"]),
        "first_eval_target_start": when(b["target_start"]),
        "shared_timepoints_at_boundary": when(shared),
        "shared_target_points_at_boundary": when(targets),
        "boundary_ok": ok.cast("int"),
    }


def audited_split(cells: DataFrame, mode: str = "disjoint", fraction: float = 0.5, min_windows: int = MIN_WINDOWS, purge: Column | None = None) -> DataFrame:
    """Cells (..., n, seq_len, pred_len) with bounds, audit and holdout_eligible. The purge is never shrunk to make a cell eligible; sides may be empty."""
    n, length, horizon = (F.col(c).cast("bigint") for c in ("n", "seq_len", "pred_len"))
    p = (purge_for(length, horizon, mode) if purge is None else purge).cast("bigint")
    cut = F.floor(n * fraction)
    n_train, start = F.greatest(cut - p, F.lit(0)), F.least(cut + p, n)
    n_eval = n - start
    last = F.when(n_train > 0, n_train - 1)
    first = F.when(n_eval > 0, start)
    out = cells.withColumn("purge_mode", F.lit(mode)).withColumn("purge_origins", p).withColumn("n_train_windows", n_train).withColumn("n_eval_windows", n_eval)
    for name, c in boundary_audit(last, first, length, horizon, mode).items():
        out = out.withColumn(name, c)
    eligible = (F.col("n_train_windows") >= min_windows) & (F.col("n_eval_windows") >= min_windows) & (F.col("boundary_ok") == 1)
    return out.withColumn("holdout_eligible", eligible.cast("int"))


def strict(audit: DataFrame) -> DataFrame:
    """The audit, failing where a boundary is violated."""
    message = F.concat(F.lit("purge violated: shared points "), F.coalesce(F.col("shared_timepoints_at_boundary").cast("string"), F.lit("unknown")))
    return audit.withColumn("boundary_ok", F.when(F.col("boundary_ok") == 1, 1).otherwise(F.raise_error(message).cast("int")))
