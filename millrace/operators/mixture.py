"""Interleaving domains at fixed ratios, in stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.order import positioned

#: Fixed value: the step of the low-discrepancy sequence.
PHI = 0.6180339887498949


def edges(weights: dict[str, float]) -> list[tuple[str, float, float]]:
    """(name, share, upper edge) over names in order; weights must sum to something positive."""
    total = sum(weights.values())
    if not total > 0:
        raise ValueError("mixture weights must sum to something positive")
    out, upto = [], 0.0
    for name in sorted(weights):
        share = weights[name] / total
        upto += share
        out.append((name, share, upto))
    return out


def domain_of(k: Column, weights: dict[str, float]) -> Column:
    """The domain of draw k: the first whose edge lies above the fractional part of k * PHI."""
    u = (k * F.lit(PHI)) % 1.0
    choice = F.lit(None).cast("string")
    for name, _, edge in reversed(edges(weights)):
        choice = F.when(u < edge, name).otherwise(choice)
    return choice


def draws(spark: SparkSession, n: int, weights: dict[str, float]) -> DataFrame:
    """(k, domain) of the first n draws."""
    return spark.range(n).select(F.col("id").alias("k"), domain_of(F.col("id"), weights).alias("domain"))


def local_steps(drawn: DataFrame) -> DataFrame:
    """(k, domain, local_step): the how-manieth draw of its domain each one is, from 0; all draws are ranked at once, so a large domain isn't one task."""
    at = positioned(drawn, ["domain", "k"])
    first = at.groupBy("domain").agg(F.min("ord").alias("first"))
    return at.join(F.broadcast(first), "domain").select("k", "domain", (F.col("ord") - F.col("first")).cast("bigint").alias("local_step"))  # a row per domain


def reweighted(spark: SparkSession, n: int, stages: list[tuple[int, dict[str, float]]], start: int = 0) -> DataFrame:
    """(k, domain) of draws start to n - 1, with weights that change at draws of the given numbers; the draws are counted on through."""
    k, choice = F.col("id"), F.lit(None).cast("string")
    for since, weights in sorted(stages, key=lambda x: x[0]):
        choice = F.when(k >= since, domain_of(k, weights)).otherwise(choice)
    return spark.range(start, n).select(k.alias("k"), choice.alias("domain"))


def state(drawn: DataFrame, tokens_per_batch: int) -> DataFrame:
    """(domain, batches, tokens_seen, last_draw) after the draws (k, domain): what each domain's loader has given, and the last draw that was its."""
    by = drawn.groupBy("domain").agg(F.count("*").alias("batches"), F.max("k").alias("last_draw"))
    return by.select("domain", "batches", (F.col("batches") * tokens_per_batch).alias("tokens_seen"), "last_draw")


def resumed(spark: SparkSession, saved: DataFrame, n: int, weights: dict[str, float]) -> DataFrame:
    """(k, domain, local_step) of the draws up to n - 1 that come after a saved state(); domains go on where their loaders stopped, new ones begin."""
    k = saved.agg(F.coalesce(F.max("last_draw") + 1, F.lit(0)).alias("k")).head()[0]  # a row per domain
    rows = local_steps(reweighted(spark, n, [(0, weights)], k))
    rows = rows.join(F.broadcast(saved.select("domain", "batches")), "domain", "left")
    return rows.select("k", "domain", (F.col("local_step") + F.coalesce("batches", F.lit(0))).alias("local_step"))


def realised(drawn: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(domain, share) of the draws, 0 where a domain had none."""
    names = drawn.sparkSession.createDataFrame([(n,) for n in weights], "domain string")
    total = drawn.agg(F.count("*").alias("n")).scalar()
    got = drawn.groupBy("domain").agg(F.count("*").alias("c"))
    return names.join(F.broadcast(got), "domain", "left").select("domain", F.round(F.coalesce("c", F.lit(0)) / total, 6).alias("share"))


def stage_of(progress: Column, until: list[float]) -> Column:
    """The first stage whose end lies above the progress, else the last; from 0."""
    stage = F.lit(len(until) - 1)
    for k in range(len(until) - 1, -1, -1):
        stage = F.when(progress < until[k], k).otherwise(stage)
    return stage
