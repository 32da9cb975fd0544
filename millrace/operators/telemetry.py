"""Metric logs: steps, trailing windows, rates, and the comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.order import positioned
from millrace.runtime import small

#: Peak dense TFLOP/s of devices, by a part of their name; the first that fits counts.
PEAKS = [
    ("h200", 989.0), ("h100", 989.0), ("gh200", 989.0), ("b200", 2250.0), ("a100", 312.0), ("a800", 312.0), ("l40s", 362.0), ("l40", 181.0),
    ("a6000", 155.0), ("4090", 165.2), ("5090", 209.5), ("3090", 71.0), ("a10g", 125.0), ("v100", 125.0), ("t4", 65.0), ("mi300x", 1307.0),
]
#: Trailing windows are worked out in blocks of so many steps.
BLOCK = 4096


def stepped(log: DataFrame, run: str, order_by: list[str]) -> DataFrame:
    """log with part and step: each row's place in its run, from 0, in the given order. Rows are ranked over all runs at once, so a hot run isn't one task."""
    at = positioned(log, [run, *order_by])
    first = at.groupBy(run).agg(F.min("ord").alias("__first"))
    return at.join(small(first), run).withColumn("step", (F.col("ord") - F.col("__first")).cast("bigint")).drop("ord", "__first")


def trailing(rows: DataFrame, run: str, width: int, result: str, agg) -> DataFrame:
    """rows with result = agg over the last `width` steps of the run (this one included); rows have a step each, without gaps.

    Blocks of BLOCK steps are windows of their own; a block is lent the width - 1 steps before it.
    """
    block = F.expr(f"step div {BLOCK}")
    lent = F.when(F.col("step") % BLOCK >= BLOCK - width + 1, F.array(block, block + 1)).otherwise(F.array(block))
    both = rows.withColumn("__block", F.explode(lent))
    w = W.partitionBy(run, "__block").orderBy("step").rowsBetween(1 - width, 0)
    return both.withColumn(result, agg(w)).where(F.col("__block") == block).drop("__block")


def running_min(rows: DataFrame, run: str, value: str, result: str) -> DataFrame:
    """stepped() rows with the smallest value so far in the run; nulls don't count."""
    low = rows.groupBy(run, "part").agg(F.min(value).alias("__m"))
    before = W.partitionBy(run).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition of the log
    low = low.withColumn("__low", F.min("__m").over(before)).drop("__m")
    here = F.min(value).over(W.partitionBy(run, "part").orderBy("step"))
    return rows.join(small(low), [run, "part"]).withColumn(result, F.least(here, "__low")).drop("__low")


def number(c: Column) -> Column:
    """A metric as a number; what is none is NaN."""
    return F.coalesce(c.try_cast("double"), F.lit(float("nan")))


def record(step: Column, seconds: Column, metrics: dict[str, Column], prefix: str = "train") -> Column:
    """A line of the log."""
    return F.to_json(F.struct(step.alias("step"), seconds.alias("time"), *[number(c).alias(f"{prefix}/{k}") for k, c in metrics.items()]))


def peak_tflops(device: Column) -> Column:
    """Peak of the first known part of the device's name, without case and blanks; else null."""
    name = F.replace(F.lower(device), F.lit(" "), F.lit(""))
    out = F.lit(None).cast("double")
    for key, peak in reversed(PEAKS):
        out = F.when(F.contains(name, F.lit(key)), F.lit(peak)).otherwise(out)
    return out


def utilisation(tokens: Column, flops_per_token: float, seconds: Column, peak: Column) -> Column:
    """Share of the peak that was used; null if the peak is unknown or no time passed."""
    return F.when(peak.isNotNull() & (seconds > 0), tokens * flops_per_token / seconds / (peak * 1e12))


def short_number(n: Column) -> Column:
    """1.2B, 3.4M, 5.6K, with one decimal; smaller numbers as they are."""
    out = n.cast("string")
    for unit, size in (("K", 1e3), ("M", 1e6), ("B", 1e9)):
        out = F.when(n >= size, F.concat(F.format_string("%.1f", F.round(n / size, 1)), F.lit(unit))).otherwise(out)
    return out


def console_line(step: Column, max_steps: int, loss: Column, lr: Column, step_time: Column) -> Column:
    """A progress line; a part that isn't known is left out."""
    return F.concat_ws(
        " | ",
        F.format_string("step %7d/%d", step, F.lit(max_steps)),
        F.format_string("loss %7.4f", loss),
        F.format_string("ppl %8.2f", F.round(F.exp(F.least(loss, F.lit(20.0))), 2)),
        F.format_string("lr %.2e", lr),
        F.when(step_time.isNotNull(), F.format_string("%6.0f ms", F.round(1000 * step_time, 0))),
    )


def last_losses(log: DataFrame, run: str, order_by: Column) -> DataFrame:
    """(<run>, final_train, final_val): the last train and validation loss there is of each run."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order_by))
    return log.groupBy(run).agg(last("train_loss").alias("final_train"), last("val_loss").alias("final_val"))


def against_baseline(finals: DataFrame, run: str, baseline: str) -> DataFrame:
    """finals with delta: the signed difference of final_val to the baseline's, or - where either is missing."""
    base = finals.where(F.col(run) == baseline).agg(F.max("final_val")).scalar()
    d = F.col("final_val") - F.col("__base")
    return finals.withColumn("__base", base).withColumn("delta", F.when(d.isNull(), "-").otherwise(F.format_string("%+.4f", F.round(d, 4)))).drop("__base")
