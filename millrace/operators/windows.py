"""Token windows over documents laid end to end, and the plan of batches over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.shuffle import permute_epochs


def sequence_count(n_tokens: int, length: int) -> int:
    """Windows of a stream; fewer than one is an error."""
    n = max(0, (n_tokens - 1) // length)
    if not n:
        raise ValueError(f"{n_tokens} tokens are too few for a sequence of {length}")
    return n


def windows(docs: DataFrame, length: int, vocab_size: int | None = None) -> DataFrame:
    """(seq_idx, tokens): windows of length + 1 tokens, each beginning with the last token of the one before.

    docs: (ids array<int>, before_len), ids laid end to end from before_len on. A document gives one slice to each window it lies in,
    so no token is a row of its own and what is gathered for a window are its slices. The incomplete last window is dropped.
    Given a vocab_size that allows it, slices are shuffled as 16-bit numbers.
    """
    first = F.expr(f"cast(greatest(0, floor((before_len - 1) / {length})) as bigint)")
    last = F.expr(f"cast(floor((before_len + size(ids) - 1) / {length}) as bigint)")
    cuts = docs.where("size(ids) > 0").select("ids", "before_len", F.explode(F.sequence(first, last)).alias("seq_idx"))
    lo = F.expr(f"greatest(before_len, seq_idx * {length})")
    hi = F.expr(f"least(before_len + size(ids), seq_idx * {length} + {length} + 1)")
    part = cuts.withColumn("lo", lo).withColumn("hi", hi).where("hi > lo")
    taken = F.expr("slice(ids, int(lo - before_len) + 1, int(hi - lo))")
    narrow = vocab_size is not None and vocab_size <= 1 << 15
    part = part.select("seq_idx", F.struct("lo", (taken.cast("array<smallint>") if narrow else taken).alias("t")).alias("s"))
    joined = part.groupBy("seq_idx").agg(F.array_sort(F.collect_list("s")).alias("s"))  # at most length + 1 tokens
    return joined.select("seq_idx", F.flatten(F.col("s.t")).cast("array<int>").alias("tokens")).where(F.size("tokens") == length + 1)


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """(chunk, tokens): the stream of documents (ids, before_len) in chunks of `size` tokens, the last one shorter."""
    lo = F.expr(f"greatest(before_len, chunk * {size})")
    hi = F.expr(f"least(before_len + size(ids), chunk * {size} + {size})")
    first, last = F.expr(f"before_len div {size}"), F.expr(f"(before_len + size(ids) - 1) div {size}")
    part = docs.where("size(ids) > 0").select("ids", "before_len", F.explode(F.sequence(first, last)).alias("chunk")).withColumn("lo", lo).withColumn("hi", hi)
    part = part.select("chunk", F.struct("lo", F.expr("slice(ids, int(lo - before_len) + 1, int(hi - lo))").alias("t")).alias("s"))
    return part.groupBy("chunk").agg(F.array_sort(F.collect_list("s")).alias("s")).select("chunk", F.flatten(F.col("s.t")).alias("tokens"))


def gather(plan: DataFrame, seqs: DataFrame) -> DataFrame:
    """A batch plan with its windows' tokens."""
    return plan.join(seqs, "seq_idx")


def inputs_and_targets(tokens: Column, length: int) -> tuple[Column, Column]:
    return F.slice(tokens, 1, length), F.slice(tokens, 2, length)


def batch_plan(spark: SparkSession, n_sequences: int, steps: range, batch: int, world: int, seed: int) -> DataFrame:
    """(step, epoch, cursor, rank, slot, seq_idx) of the given steps: which window each rank reads where.

    A pure function of the step: an epoch has n_sequences div (world * batch) steps, its order is the bijection of its seed, and what is
    left of it is dropped.
    """
    per = world * batch
    if per > n_sequences:
        raise ValueError(f"a step of {per} exceeds {n_sequences} sequences")
    spe = n_sequences // per
    k = spark.range(steps.start * per, steps.stop * per).withColumnRenamed("id", "k")
    k = k.withColumn("step", F.expr(f"k div {per}")).withColumn("epoch", F.expr(f"step div {spe}"))
    k = k.withColumn("cursor", F.expr(f"(step % {spe}) * {per}")).withColumn("at", F.expr(f"k % {per}"))
    place = F.col("cursor") + F.col("at")
    return k.select("step", "epoch", "cursor", F.expr(f"at div {batch}").alias("rank"), F.expr(f"at % {batch}").alias("slot"),
                    permute_epochs(place, F.col("epoch"), n_sequences, seed).alias("seq_idx"))


def tokens_seen(step: Column, per_step: int, length: int) -> Column:
    """Tokens that all ranks have been given when a 0-based step is done."""
    return (step + 1) * per_step * length


def states(plan: DataFrame, per_step: int, length: int, n_sequences: int, seed: int, workers: int = 1) -> DataFrame:
    """(step, epoch, cursor, tokens_seen, seed, per_step, seq_len, n_sequences, exact) after each step of a batch_plan().

    With more than one worker in flight the cursor is only as far as has been asked for, which is what exact says.
    """
    done = plan.select("step", "epoch", (F.col("cursor") + per_step).alias("cursor")).distinct()
    fixed = {"seed": seed, "per_step": per_step, "seq_len": length, "n_sequences": n_sequences, "exact": workers <= 1}
    return done.select("step", "epoch", "cursor", tokens_seen(F.col("step"), per_step, length).alias("tokens_seen"), *[F.lit(v).alias(k) for k, v in fixed.items()])


def restored(saved: DataFrame, seed: int, n_sequences: int, per_step: int, strict: bool = False) -> DataFrame:
    """saved states with the cursor taken down to the start of a step of this job.

    Another seed is an error, as the order would be another; so is, if strict, another number of sequences. A null seed or number agrees with any.
    """
    wrong = F.when(F.col("seed") != seed, F.raise_error(F.concat(F.lit(f"the state has another seed than {seed}: "), F.col("seed").cast("string"))).cast("bigint"))
    if strict:
        wrong = wrong.when(F.col("n_sequences") != n_sequences, F.raise_error(F.concat(F.lit(f"the data have {n_sequences} sequences, the state "), F.col("n_sequences").cast("string"))).cast("bigint"))
    return saved.withColumn("cursor", wrong.otherwise(aligned_cursor(F.col("cursor"), per_step)))


def aligned_cursor(cursor: Column, per_step: int) -> Column:
    """A restored cursor goes down to the start of a step."""
    return cursor - cursor % per_step


def skipped(cursor: int, n: int, per_step: int, n_sequences: int) -> tuple[int, int]:
    """(epochs passed, cursor) after skipping n steps; wraps at n_sequences and not at the last full step."""
    at = cursor + n * per_step
    return at // n_sequences, at % n_sequences
