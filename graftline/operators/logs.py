"""Ordered logs: smoothing, carrying forward, segments, retention and log lines.

Order that spans a whole log is kept within a key (file, user or series), which is how logs are split; windows never
run over all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.functions.metrics import failed_as_minus_one
from graftline.functions.records import is_parse_fail, quoted_list
from graftline.functions.text import strip_ansi


def retained(rows: DataFrame, user: str, time: str, days: int) -> DataFrame:
    """Rows within ``days`` of the user's latest; rows without time or user stay.

    The latest times come from an aggregation with map-side combine and a join that AQE may split, so a user with a
    third of all rows is not one task's work, as a window over the user would be.
    """
    latest = rows.where(F.col(user).isNotNull()).groupBy(F.col(user).alias("_u")).agg(F.max(time).alias("_latest"))
    near = F.col(time) >= F.col("_latest") - F.make_dt_interval(F.lit(days))
    return rows.join(latest, F.col(user) == F.col("_u"), "left").where(F.coalesce(near, F.lit(True))).drop("_u", "_latest")


def smoothed(value: str, by: list[str], order: list[str], width: int) -> Column:
    """Mean of the last ``width`` values, fewer at the start."""
    return F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width - 1), 0))


def carried(value: Column, by: list[str], order: list[str]) -> Column:
    """The last non-null value so far."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def segments(rows: DataFrame, by: list[str], order: list[str], marker: Column, value: Column, keep_incomplete: bool = False) -> DataFrame:
    """One row per stretch that begins at a marker: idx, n values, their mean; rows before the first marker are left out.

    The last stretch is incomplete and dropped, unless asked for or the only one.
    """
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.withColumn("idx", F.sum(F.when(marker, 1).otherwise(0)).over(run)).where("idx > 0")
    each = cut.groupBy(*by, "idx").agg(F.count(F.when(~marker, value)).alias("n"), F.round(F.avg(F.when(~marker, value)), 6).alias("mean"))
    if keep_incomplete:
        return each
    last = Window.partitionBy(*by)
    return each.withColumn("_last", F.max("idx").over(last)).where((F.col("idx") < F.col("_last")) | (F.col("_last") == 1)).drop("_last")


BLOCK = 100_000
#: Marks of a kept-step line and of a micro-batch line, and a number as logs write it; fixed values.
KEPT, MICRO = ("[kept-step]", "[keep]"), "[micro]"
NUMBER = r"([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"


def carried_lines(lines: DataFrame, by: list[str], pos: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """lines with the last non-null of each value so far, in the order of ``pos`` within ``by``.

    A window over a whole log would be one task's work. Each block of lines gives its last values, these are carried
    from block to block, and only a block is sorted by a task.
    """
    rows = lines.withColumns({k: v for k, v in values.items()}).withColumn("_block", F.floor(F.col(pos) / block))
    ends = rows.groupBy(*by, "_block").agg(*[F.max(F.when(F.col(k).isNotNull(), F.struct(pos, k))).getField(k).alias(f"_{k}") for k in values])
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(*by, "_block", *[F.last(f"_{k}", ignorenulls=True).over(before).alias(f"_{k}") for k in values])
    inside = Window.partitionBy(*by, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select(*[c for c in rows.columns if c not in values], *[F.last(k, ignorenulls=True).over(inside).alias(k) for k in values])
    return own.join(heads, [*by, "_block"]).withColumns({k: F.coalesce(k, f"_{k}") for k in values}).drop("_block", *[f"_{k}" for k in values])


def _part(line: Column, pattern: str) -> Column:
    """The pattern's first group, null where it does not occur."""
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def is_kept_step(line: Column) -> Column:
    return F.contains(line, F.lit(KEPT[0])) | F.contains(line, F.lit(KEPT[1]))


def kept_step(line: Column) -> dict[str, Column]:
    """Fields of a kept-step line, each found by its own name, so that the order and the spelling of keys may differ."""
    plain = strip_ansi(line)
    return {
        "depth": _part(plain, r"\bdepth=(\d+)").try_cast("int"), "status": F.lower(_part(plain, r"\bstatus=([A-Za-z_]+)")), "f1": _part(plain, r"(?:\bf1|step_F1\(raw\))=" + NUMBER).try_cast("double"),
        "key": _part(plain, r'cond_keys?=\[?"?([^\]\s",]*)'), "gold": quoted_list(_part(plain, r"\bgold=(\[[^\]]*\])")), "pred": quoted_list(_part(plain, r"\bpred=(\[[^\]]*\])"))}


def kept_means(steps: DataFrame) -> DataFrame:
    """One row over steps(depth, status, f1, gold, pred): means at the root and below, with and without failed parses and
    with truth only, and the shares of one-sided steps. A mean over nothing is null."""
    root, ok, true, said = F.col("depth") == 0, ~is_parse_fail(F.col("status")), F.size("gold") > 0, F.size("pred") > 0
    mean = lambda where: F.round(F.avg(F.when(where, F.col("f1"))), 6)
    share = lambda part, of: F.round(F.try_divide(F.count_if(part & of), F.count_if(of)), 6)
    return steps.agg(
        F.count("*").alias("n"), F.count_if(root).alias("n_root"), mean(root).alias("root_all"), mean(~root).alias("below_all"), mean(root & ok).alias("root_ok"), mean(~root & ok).alias("below_ok"),
        mean(~root & true).alias("below_true_all"), mean(~root & true & ok).alias("below_true_ok"), share(said, ~true).alias("said_of_untrue"), share(true, ~said).alias("true_of_unsaid"))


def reward_means(steps: DataFrame) -> DataFrame:
    """One row: means of F1 without truth, with truth and over all that parsed, and of rewards with -1 for failed parses;
    a mean over nothing is 0."""
    ok, true = ~is_parse_fail(F.col("status")), F.size("gold") > 0
    mean = lambda c, where: F.round(F.coalesce(F.avg(F.when(where, c)), F.lit(0.0)), 6)
    return steps.agg(
        mean(F.col("f1"), ok & ~true).alias("f1_untrue"), mean(F.col("f1"), ok & true).alias("f1_true"), mean(F.col("f1"), ok).alias("f1_all"),
        mean(failed_as_minus_one(F.col("status"), F.col("f1")), F.lit(True)).alias("reward"), F.count_if(ok).alias("n_ok"), F.count("*").alias("n"))


def statuses(steps: DataFrame) -> DataFrame:
    """(status, n, pct, fail_rate): the histogram of outcomes and, on each row, the share of failed parses."""
    n = steps.groupBy("status").agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # over the few outcomes only
    fails = F.sum(F.when(is_parse_fail(F.col("status")), F.col("n")).otherwise(0)).over(every)
    return n.select("status", "n", F.round(100.0 * F.col("n") / F.sum("n").over(every), 6).alias("pct"), F.round(fails / F.sum("n").over(every), 6).alias("fail_rate"))


def sides_by_depth(steps: DataFrame) -> DataFrame:
    """Steps of each depth with and without truth and predictions."""
    true, said = F.size("gold") > 0, F.size("pred") > 0
    return steps.groupBy("depth").agg(F.count_if(true).alias("has_gold"), F.count_if(~true).alias("no_gold"), F.count_if(said).alias("has_pred"), F.count_if(~said).alias("no_pred"))


def train_step(line: Column) -> dict[str, Column]:
    """Step and measures of a trainer line."""
    plain = strip_ansi(line)
    return {
        "step": _part(plain, r"step:(\d+)").try_cast("bigint"), "pg_loss": _part(plain, "actor/pg_loss:" + NUMBER).try_cast("double"),
        "score": _part(plain, "critic/score/mean:" + NUMBER).try_cast("double")}


def micro_frame(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """Micro-batch lines of lines(file, line_no, line) with their losses and counts, and the epoch, step and total loss of
    the last lines before that told them; before the first such line these are null."""
    plain = strip_ansi(F.col("line"))
    whole = lambda p: _part(plain, p).try_cast("int")
    loss = _part(plain, "train/loss:" + NUMBER).try_cast("double")
    told = {
        "epoch": whole(r"Epoch\s+(\d+)\s*/\s*\d+"), "epoch_total": whole(r"Epoch\s+\d+\s*/\s*(\d+)"),
        "step_in_epoch": F.when(loss.isNotNull(), whole(r"step:(\d+)")), "total_loss": loss}
    number = lambda k: _part(plain, rf"\b{k}=" + NUMBER)
    rows = carried_lines(lines, ["file"], "line_no", told, block).where(F.contains(F.col("line"), F.lit(MICRO)))
    return rows.select(
        "file", "line_no", whole(r"\[micro\]\s+(\d+)/").alias("micro"), whole(r"\[micro\]\s+\d+/(\d+)").alias("micro_total"), "epoch", "epoch_total", "step_in_epoch", "total_loss",
        *[number(k).try_cast("double").alias(f"{k}_loss") for k in ("cls0", "cls1", "content")], *[number(k).try_cast("int").alias(k) for k in ("depth0", "depth1", "pairs")])
