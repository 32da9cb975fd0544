"""Ordinals, prefix sums and restarting scans over a whole table in a given order, without a task that sees all rows.

The table is range-partitioned once and written with its partition numbers; totals of the partitions (a row each) then give every
partition its start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.runtime import cut

#: Summaries of partitions that are put together in one task; more take another level.
FAN = 32


def positioned(df: DataFrame, order_by: list[str], sums: list[str] = ()) -> DataFrame:
    """df with part, ord (1-based, in the given order) and, for each column c of sums, before_c: its sum over the rows before.

    Nulls count as 0 in sums and come first in the order; order_by should be unique, else equal rows get their ordinals in any order.
    Give it narrow rows: they are written once.
    """
    parts = cut(df.repartitionByRange(*order_by).withColumn("part", F.spark_partition_id()))
    totals = parts.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(f"t_{c}") for c in sums])
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    start = totals.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"s_{c}") for c in ["n", *[f"t_{c}" for c in sums]]])
    w = W.partitionBy("part").orderBy(*order_by)
    upto = w.rowsBetween(W.unboundedPreceding, -1)
    out = parts.join(F.broadcast(start), "part").withColumn("ord", F.row_number().over(w) + F.col("s_n"))
    for c in sums:
        inside = F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(upto), F.lit(0))
        out = out.withColumn(f"before_{c}", inside + F.col(f"s_t_{c}"))
    return out.drop("s_n", *[f"s_t_{c}" for c in sums])


def _successors(p: np.ndarray, c: np.ndarray, size: int, after: bool) -> tuple[np.ndarray, np.ndarray]:
    """For a group starting at each row: the row that starts the next group (n if none here), and what the rest must reach."""
    n = len(p)
    if after:
        last = np.searchsorted(c, p + size, "left")
        carry = np.where(last < n, -1, p + size)
        return np.minimum(last + 1, n), carry
    nxt = np.maximum(np.searchsorted(c, p + size, "right"), np.arange(n) + 1)
    return np.minimum(nxt, n), p + size


def _entry(p: np.ndarray, c: np.ndarray, carry: np.ndarray | int, after: bool) -> np.ndarray:
    """The first row that starts a group, when the group open at the start must reach `carry` (-1: none is open)."""
    k = np.searchsorted(c, carry, "left") + 1 if after else np.searchsorted(c, carry, "right")
    return np.where(np.asarray(carry) < 0, 0, np.minimum(k, len(p)))


def _passed(c: np.ndarray, carries: np.ndarray, groups: np.ndarray, full: bool, carry: np.ndarray, after: bool) -> tuple[np.ndarray, np.ndarray]:
    """What is open after rows whose summary this is, for each value that may be open before them, and how many groups begin there."""
    at = _entry(c, c, carry, after)
    inside = at < len(c)
    place = np.minimum(at, max(len(c) - 1, 0))
    ended = after and full and len(c) > 0
    out = np.where(inside, carries[place], np.where(ended & (c[-1] >= carry), -1, carry) if ended else carry)
    return out, np.where(inside, groups[place], 0)


def _columns(t: pa.Table) -> list[tuple]:
    """(part, rows, first_p, c, carry, groups) of summaries in order."""
    t = t.sort_by("part").combine_chunks()
    lists = [[x.values.to_numpy() for x in t.column(n)] for n in ("c", "carry", "groups")]
    return list(zip(*(t.column(n).to_pylist() for n in ("part", "rows", "first_p")), *lists))


def _joined(t: pa.Table, size: int, after: bool) -> pa.Table:
    """One summary of partitions in a row: the entries of the first ones as far as `size` goes, each followed through the others."""
    rows = _columns(t)
    part, n, first_p, c, carry, groups = rows[0]
    for _, m, _, c2, carry2, groups2 in rows[1:]:
        full = len(c) == n
        out, begun = _passed(c2, carry2, groups2, len(c2) == m, carry, after)
        carry, groups = out, groups + begun
        if full:  # what is open at the start may also reach beyond the first ones
            c, carry, groups = np.concatenate([c, c2]), np.concatenate([carry, carry2]), np.concatenate([groups, groups2])
            most = int(np.searchsorted(c, first_p + size, "right") + 2)
            c, carry, groups = c[:most], carry[:most], groups[:most]
        n += m
    lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (c, carry, groups)]
    up = t.column("up")[0].as_py()
    return pa.table([t.column("k").slice(0, 1), pa.array([up], pa.int32()), pa.array([n], pa.int64()), pa.array([first_p], pa.int64()), *lists], ["k", "part", "rows", "first_p", "c", "carry", "groups"])


def _handed_down(t: pa.Table, after: bool) -> pa.Table:
    """(k, part, carry, done): what is open before each of the partitions in a row, and how many groups have begun."""
    carry, done = (t.column(n)[0].as_py() if n in t.column_names else x for n, x in (("carry_in", -1), ("done_in", 0)))
    out = []
    for part, n, _, c, carries, groups in _columns(t):
        out.append((part, carry, done))
        new, begun = _passed(c, carries, groups, len(c) == n, np.array([carry]), after)
        carry, done = int(new[0]), done + int(begun[0])
    cols = list(zip(*out))
    keys = pa.concat_arrays([t.column("k").combine_chunks().slice(0, 1)] * len(out)) if len(out) else t.column("k")
    return pa.table([keys, pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["k", "part", "carry", "done"])


def restarting_groups(rows: DataFrame, size: int, rule: str, key: str | None = None, fan: int = FAN) -> DataFrame:
    """(<key>, ord, grp): groups of consecutive rows by total length, grp from 0.

    rows: positioned() rows with ord, part, len and before_len, lengths of 0 or more; if key is given, groups begin anew with each
    of its values, and it comes first in the order. rule "roll": a group ends after the row with which it reaches `size`. rule "pack": a group ends before the row with which it
    would exceed `size`; a longer row is a group of its own. Each partition works out what it does with any group that may
    be open at its start (at most the rows within `size` of it). Summaries of FAN partitions in a row make one of their own, level by level, until FAN
    are left; what really is open is then handed down the levels, and each partition numbers its rows.
    """
    after = rule == "roll"
    keyed = rows.withColumn("k", F.col(key) if key else F.lit(0))
    kind = dict(keyed.dtypes)["k"]
    src = keyed.select("k", "part", "ord", F.col("len").cast("bigint").alias("len"), F.col("before_len").cast("bigint").alias("p"))

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        p, c = pdf["p"].to_numpy(), (pdf["p"] + pdf["len"]).to_numpy()
        n = len(p)
        nxt, carry = _successors(p, c, size, after)
        root, count = np.where(nxt < n, nxt, np.arange(n)), np.where(nxt < n, 1, 0)
        while True:  # pointer jumping to the last group that starts here
            far = root[root]
            if (far == root).all():
                break
            count, root = count + count[root], far
        m = int(min(n, np.searchsorted(c, p[0] + size, "right") + 2))
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "part": [pdf["part"].iloc[0]], "rows": [n], "first_p": [int(p[0])],
                             "c": [c[:m].tolist()], "carry": [carry[root][:m].tolist()], "groups": [(count + 1)[:m].tolist()]})

    schema = f"k {kind}, part int, rows bigint, first_p bigint, c array<bigint>, carry array<bigint>, groups array<bigint>"
    levels = [cut(src.groupBy("k", "part").applyInPandas(summary, schema))]
    while levels[-1].count() > fan:
        joined = levels[-1].withColumn("up", F.expr(f"part div {fan}")).groupBy("k", "up").applyInArrow(lambda t: _joined(t, size, after), schema)
        higher = cut(joined)
        if higher.count() == levels[-1].count():  # a key has no two summaries left
            break
        levels.append(higher)
    found = f"k {kind}, part int, carry bigint, done bigint"
    opened = cut(levels[-1].groupBy("k").applyInArrow(lambda t: _handed_down(t, after), found))
    for lower in reversed(levels[:-1]):
        above = opened.select("k", F.col("part").alias("up"), F.col("carry").alias("carry_in"), F.col("done").alias("done_in"))
        rows_in = lower.withColumn("up", F.expr(f"part div {fan}")).join(above, ["k", "up"])
        opened = cut(rows_in.groupBy("k", "up").applyInArrow(lambda t: _handed_down(t, after), found))

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        p, c = pdf["p"].to_numpy(), (pdf["p"] + pdf["len"]).to_numpy()
        carry, done = int(pdf["carry"].iloc[0]), int(pdf["done"].iloc[0])
        nxt, _ = _successors(p, c, size, after)
        starts = np.zeros(len(p), np.int64)
        at = int(_entry(p, c, carry, after)) if carry >= 0 else 0
        while at < len(p):
            starts[at] = 1
            at = int(nxt[at])
        return pd.DataFrame({"k": pdf["k"], "ord": pdf["ord"], "grp": done - 1 + np.cumsum(starts)})

    numbered = src.join(opened, ["k", "part"]).groupBy("k", "part").applyInPandas(number, f"k {kind}, ord bigint, grp bigint")
    return numbered.withColumnRenamed("k", key) if key else numbered.drop("k")
