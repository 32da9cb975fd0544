"""Filling containers of a fixed capacity with whole documents (problem 5).

The plan is made over the histogram of lengths, which has at most `capacity` rows however many documents there are.
Best fit in decreasing length puts *counts* of items into *ranges* of containers; each step becomes one block
(length, first rank, last rank, first container, items per container). Documents then take the planned slots by a
join on length and rank within length. Ranks come from two levels (a salted window, then offsets of the salts; a length has as many salts as
its count asks for), so that a length shared by a third of all documents isn't ranked in one task. Pieces that fill a container need no slot: their
containers are numbered by prefix sums over their documents.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.order import positioned
from millrace.runtime import small

#: Rows of one length that are ranked in one window, on average.
RANKED = 500_000

PLAN_SCHEMA = "profile string, len bigint, rank_lo bigint, rank_hi bigint, container bigint, per bigint"


def plan_blocks(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over counts: blocks (len, rank_lo, rank_hi exclusive, first container, items per container).

    An item of the block with rank k goes to container first + (k - rank_lo) div per. Open containers are kept as
    ranges of equal free space, so the work depends on the number of lengths and not on the number of items.
    """
    blocks, free, groups, opened = [], [], {}, 0  # free: sorted spaces; groups: space -> list of (container, count)

    def put(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in groups:
                groups[space] = []
                bisect.insort(free, space)
            groups[space].append((first, count))

    for size in sorted((s for s, c in histogram.items() if 0 < s <= capacity and c > 0), reverse=True):
        left, rank = histogram[size], 0
        while left:
            at = bisect.bisect_left(free, size)
            if at < len(free):  # the tightest open containers that hold the item
                space = free[at]
                first, count = groups[space].pop()
                if not groups[space]:
                    del groups[space], free[at]
                per = space // size
                used = min(count, -(-left // per))
                if used * per > left and used > 1:  # the last container would stay partly planned; leave it for a step of its own
                    used = left // per
                elif used * per > left:
                    per = left
                put(space, first + used, count - used)
            else:
                per = min(capacity // size, left)
                used, first, space = left // per, opened, capacity
                opened += used
            take = used * per
            blocks.append((size, rank, rank + take, first, per))
            put(space - per * size, first, used)
            rank, left = rank + take, left - take
    return blocks


def capacities(profiles: DataFrame) -> DataFrame:
    """(profile, capacity) of the profiles that are packed for."""
    return profiles.where("profile is not null and capacity > 0").groupBy("profile").agg(F.max("capacity").alias("capacity"))


def pack(sizes: DataFrame, profiles: DataFrame, id_col: str = "doc_id", ranked: int = RANKED) -> DataFrame:
    """(profile, capacity, container_id, <id>, piece, token_start, n_tokens): every document of `sizes` in every profile.

    sizes: (<id>, n_tokens), one row per item, materialised. profiles: (profile, capacity), a small configuration table,
    read by the driver. Items of 0 or null tokens take no space and are spread over the containers by hash; an item above the capacity is cut
    into pieces of the capacity and one rest, numbered from 0; all other items are whole, as piece 0. Repeated ids are
    items of their own. Profiles with a null name or a null or non-positive capacity are left out, a repeated
    name counts once, with its largest capacity. Containers are numbered from 0 in each profile.
    """
    spark: SparkSession = sizes.sparkSession
    caps = {r[0]: r[1] for r in capacities(profiles).collect()}
    each = [F.struct(F.lit(k).alias("profile"), F.lit(int(v)).cast("bigint").alias("capacity")) for k, v in sorted(caps.items())]
    profile = F.array(*each) if each else F.array().cast("array<struct<profile:string,capacity:bigint>>")
    item = F.col(f"`{id_col}`")
    sized = sizes.where("n_tokens > 0").select(item.alias("id"), "n_tokens", F.explode(profile).alias("c")).select("id", "n_tokens", "c.profile", "c.capacity")
    # Whole containers of items above the capacity.
    large = sized.where("n_tokens > capacity").withColumn("full", F.expr("n_tokens div capacity"))
    rows = positioned(large.select("profile", "capacity", "id", "full"), ["profile", "id"], ["full"])
    first = rows.groupBy("profile").agg(F.min("before_full").alias("first"), F.sum("full").alias("whole"))
    whole = {r.profile: r.whole for r in first.collect()}  # a row per profile
    own = rows.join(F.broadcast(first), "profile").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)))
    filled = own.select("profile", "capacity", F.expr("before_full - first + piece").cast("bigint").alias("container_id"), F.col("id").alias(id_col), "piece", F.expr("piece * capacity").alias("token_start"), F.col("capacity").alias("n_tokens"))
    # All else is at most as long as the capacity.
    rests = sized.withColumn("piece", F.expr("if(n_tokens > capacity, n_tokens div capacity, 0L)")).withColumn("token_start", F.expr("piece * capacity")).withColumn("len", F.expr("n_tokens - token_start")).where("len > 0")
    histogram: dict[str, dict[int, int]] = {}
    for p, size, n in rests.groupBy("profile", "len").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows a profile
        histogram.setdefault(p, {})[size] = n
    hot = [(p, size, -(-n // ranked)) for p, h in histogram.items() for size, n in h.items() if n > ranked]
    salts = small(spark.createDataFrame(hot, "profile string, len bigint, salts bigint"))
    pieces = rests.join(salts, ["profile", "len"], "left").withColumn("salt", F.expr("pmod(xxhash64(id, piece), coalesce(salts, 1L))"))
    pieces = pieces.select("profile", "capacity", "id", "piece", "token_start", "len", "salt")
    counts = pieces.groupBy("profile", "len", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("profile", "len").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")))
    plan = [(p, *b) for p, h in histogram.items() for b in plan_blocks(h, caps[p])]
    plan = [(p, size, lo, hi, first + whole.get(p, 0), per) for p, size, lo, hi, first, per in plan]
    opened = {p: max([1, whole.get(p, 0), *(b[4] + -(-(b[3] - b[2]) // b[5]) for b in plan if b[0] == p)]) for p in caps}
    blocks = spark.createDataFrame(plan, PLAN_SCHEMA)
    within = W.partitionBy("profile", "len", "salt").orderBy("id", "piece")
    ranked_rows = (
        pieces.withColumn("rn", F.row_number().over(within) - 1)
        .join(offsets.drop("n"), ["profile", "len", "salt"])  # the window already has this partitioning
        .withColumn("rank", F.col("rn") + F.col("offset"))
    )
    hit = (ranked_rows.profile == blocks.profile) & (ranked_rows.len == blocks.len) & (ranked_rows["rank"] >= blocks.rank_lo) & (ranked_rows["rank"] < blocks.rank_hi)
    placed = ranked_rows.join(small(blocks), hit).select(
        ranked_rows.profile,
        "capacity",
        F.expr("container + (rank - rank_lo) div per").alias("container_id"),
        F.col("id").alias(id_col),
        "piece",
        "token_start",
        ranked_rows.len.alias("n_tokens"),
    ).unionByName(filled)
    nothing = F.lit(0).cast("bigint")
    count = F.create_map(*[F.lit(x) for p, n in opened.items() for x in (p, n)]) if opened else F.lit(None).cast("map<string,int>")
    empty = sizes.where("coalesce(n_tokens, 0) <= 0").select(item.alias("id"), F.explode(profile).alias("c"))
    anywhere = F.pmod(F.xxhash64("id"), F.element_at(count, F.col("c.profile")).cast("bigint"))
    rest = empty.select("c.profile", "c.capacity", anywhere.alias("container_id"), F.col("id").alias(id_col), nothing.alias("piece"), nothing.alias("token_start"), nothing.alias("n_tokens"))
    return placed.unionByName(rest)


def fill_report(packed: DataFrame) -> DataFrame:
    """(profile, capacity, containers, items, tokens, unused, fill) of a result of pack()."""
    by = packed.groupBy("profile", "capacity", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("i"))
    return (
        by.groupBy("profile", "capacity")
        .agg(F.count("*").alias("containers"), F.sum("i").alias("items"), F.sum("t").alias("tokens"))
        .withColumn("unused", F.expr("containers * capacity - tokens"))
        .withColumn("fill", F.expr("round(tokens / (containers * capacity), 6)"))
    )


def verify(packed: DataFrame, sizes: DataFrame, profiles: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(profile, documents, overfull, incomplete), a row per row of profiles: items that have a first piece, containers above the
    capacity, and ids whose pieces aren't, as often as they should be, those that pack() has to make of the tokens.

    packed: a result of pack(sizes, profiles), materialised, as sizes is. Every piece is held against the tokens in sizes, so that a lost rest, a
    piece that stands twice or a wrong length is told; nothing is taken from packed that sizes and profiles give.
    """
    caps = F.broadcast(capacities(profiles))
    item, one, none = F.col(f"`{id_col}`").alias("id"), F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    due = sizes.select(item, F.expr("greatest(coalesce(n_tokens, 0L), 0L)").alias("n")).crossJoin(caps)
    due = due.withColumn("piece", F.explode(F.expr("sequence(0L, greatest((n - 1) div capacity, 0L))"))).withColumn("token_start", F.expr("piece * capacity"))
    due = due.select("profile", "id", "piece", "token_start", F.expr("least(n - token_start, bigint(capacity))").alias("n_tokens"), one.alias("due"), none.alias("got"))
    got = packed.select("profile", item, "piece", "token_start", "n_tokens", none.alias("due"), one.alias("got"))
    pieces = due.unionByName(got).groupBy("profile", "id", "piece", "token_start", "n_tokens").agg(F.sum("due").alias("due"), F.sum("got").alias("got"))
    wrong = F.when(F.col("due") != F.col("got"), F.struct("id"))  # null ids count, too
    items = pieces.groupBy("profile").agg(F.sum(F.expr("if(piece = 0, got, 0L)")).alias("documents"), F.count_distinct(wrong).cast("int").alias("incomplete"))
    loads = packed.groupBy("profile", "container_id").agg(F.sum("n_tokens").alias("t")).join(caps, "profile")
    full = loads.groupBy("profile").agg(F.sum((F.col("t") > F.col("capacity")).cast("int")).cast("int").alias("overfull"))
    rows = profiles.select("profile").join(F.broadcast(items), "profile", "left").join(F.broadcast(full), "profile", "left")  # a row per profile
    return rows.na.fill(0).select("profile", "documents", "overfull", "incomplete")
