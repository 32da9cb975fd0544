"""Schedules, sizes and costs as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.settings import deep_merge, load_layers, overrides  # noqa: F401  configuration lives there


#: What is left of a rate, by how much of its way down it has gone.
SHAPES = {
    "1-sqrt": lambda gone: 1 - F.sqrt(gone),
    "linear": lambda gone: 1 - gone,
    "cosine": lambda gone: (1 + F.cos(math.pi * gone)) / 2,
}


def learning_rate(step: Column, base: float, max_steps: int, warmup: int = 0, min_ratio: float = 0.1, schedule: str = "wsd", decay_steps: int = 0, shape: str = "1-sqrt") -> Column:
    """Learning rate at a 0-based step: linear warmup, then down from base to base * min_ratio; an unknown schedule is an error.

    cosine and linear go down from the warmup on, wsd over the last decay_steps (a fifth of max_steps) in the given shape (an unknown one
    is 1-sqrt), constant never.
    """
    fall = decay_steps or max(1, int(0.2 * max_steps))
    spans = {"constant": None, "cosine": (warmup, max(1, max_steps - warmup)), "linear": (warmup, max(1, max_steps - warmup)), "wsd": (max_steps - fall, fall)}
    if schedule not in spans:
        raise ValueError(f"unknown schedule {schedule!r}")
    left = F.lit(1.0)
    if spans[schedule]:
        begin, length = spans[schedule]
        gone = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (step - begin) / length))
        left = SHAPES.get(shape if schedule == "wsd" else schedule, SHAPES["1-sqrt"])(gone)
    rate = base * (min_ratio + (1 - min_ratio) * left)
    return F.when(step < warmup, base * (step + 1) / warmup).otherwise(rate) if warmup else rate


def group_rate(rate: Column, base: float, own_base: float) -> Column:
    """The rate of a parameter group with a base of its own, which keeps the ratio to the first group's."""
    return rate * (own_base / base)


def budget_steps(tokens: Column, per_step: int) -> Column:
    """Whole steps in a budget of tokens, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(tokens / per_step).cast("bigint"))


def early_finish(step: Column, max_steps: int, decay_share: float = 0.2, decay_steps: int = 0) -> Column:
    """The number of steps with which the decay begins at `step`."""
    return step + (decay_steps or max(1, int(decay_share * max_steps)))


def batch_scaled(lr: Column, batch: Column, reference_batch: Column) -> Column:
    """Square-root scaling of a learning rate with the batch."""
    return lr * F.sqrt(batch / reference_batch)


#: What a configuration may leave out, with the value that stands for it: of types and depths, and of what switches something off.
OPTIONAL = {"attn_type": "'gqa'", "q_lora_rank": "0", "kv_lora_rank": "0", "qk_rope_head_dim": "0", "qk_nope_head_dim": "0", "v_head_dim": "0", "mtp_depth": "0"}


def derived(configs: DataFrame) -> DataFrame:
    """configs with what they leave out: head and feed-forward widths, the ranks and head sizes of latent attention, active experts and their width."""
    have = set(configs.columns)
    full = configs.select("*", *[F.expr(v).cast("string" if c == "attn_type" else "int").alias(c) for c, v in OPTIONAL.items() if c not in have])
    multiple = "coalesce(ffn_multiple_of, 128)" if "ffn_multiple_of" in have else "128"
    steps = [
        ("d_head", "coalesce(d_head, d_model div n_head)"),
        ("ffn_hidden", f"coalesce(ffn_hidden, {multiple} * ceil(floor(8 * d_model / 3) / {multiple}))"),
        *[(c, f"if(attn_type = 'mla', if(coalesce({c}, 0) > 0, {c}, {v}), coalesce({c}, 0))") for c, v in [
            ("kv_lora_rank", "greatest(64, d_model div 4)"), ("qk_rope_head_dim", "greatest(16, d_head div 2)"), ("qk_nope_head_dim", "d_head"), ("v_head_dim", "d_head")]],
        ("n_experts_active", "if(moe, if(coalesce(n_experts_active, 0) > 0, n_experts_active, greatest(1, n_experts div 8)), n_experts_active)"),
        ("expert_hidden", f"if(moe, coalesce(expert_hidden, greatest({multiple}, {multiple} * bround(ffn_hidden / {multiple} / 2))), expert_hidden)"),
    ]
    for name, rule in steps:
        full = full.withColumn(name, F.expr(f"int({rule})"))
    return full


def layers(configs: DataFrame) -> DataFrame:
    """A row per layer of each configuration: layer, and whether it has experts, no rotary embedding, and sees the whole context."""
    i = F.col("layer")
    every = lambda c: (F.col(c) > 0) & ((i + 1) % F.greatest(F.col(c), F.lit(1)) == 0)
    return configs.where("n_layer > 0").withColumn("layer", F.explode(F.expr("sequence(0, n_layer - 1)"))).select(
        *[F.col(c) for c in configs.columns], "layer", _has_experts(i).alias("is_expert"), every("nope_every").alias("is_nope"),
        ((F.col("sliding_window") <= 0) | every("global_attn_every")).alias("is_global"),
    )


def _has_experts(layer: Column) -> Column:
    behind = layer - F.col("moe_first_dense")
    return F.col("moe") & (behind >= 0) & (behind % F.greatest(F.col("moe_layer_freq"), F.lit(1)) == 0)


def parameter_counts(configs: DataFrame) -> DataFrame:
    """(name, attention, blocks, mtp, total, active, flops): parameters of grouped-query and latent-attention models, and training FLOPs per token.

    A multi-token head is a block after the last layer with two more gains and a projection of both its inputs; it isn't active. FLOPs are six per
    weight a token meets, the output head (again for each multi-token head) and the routers included, and those of the attention scores.
    """
    c = derived(configs).withColumn("layer", F.explode(F.expr("sequence(0, n_layer + mtp_depth - 1)"))).withColumn("head", F.expr("layer >= n_layer"))
    c = c.withColumn("ex", _has_experts(F.col("layer")))
    for name, rule in [
        ("query", "if(q_lora_rank > 0, q_lora_rank * (d + heads * qk), d * heads * qk)"),
        ("gains", "if(attn_type = 'mla', kv_lora_rank + q_lora_rank, if(qk_norm, 2 * d_head, 0))"),
        ("weights", "if(attn_type = 'mla', query + d * (kv_lora_rank + qk_rope_head_dim) + kv_lora_rank * heads * (qk_nope_head_dim + v_head_dim) + heads * v_head_dim * d, 2 * d * d_head * (heads + n_kv_head))"),
        ("expert", "3 * d * expert_hidden"), ("router", "if(ex, d * n_experts, 0)"),
        ("held", "if(ex, expert * (n_experts + n_shared), 3 * d * ffn_hidden) + router"),
        ("used", "if(ex, expert * (n_experts_active + n_shared), 3 * d * ffn_hidden)"),
        ("emb", "vocab_size * d"), ("scores", "12 * heads * d_head * max_seq_len"),
    ]:
        if name == "query":
            c = c.select("*", F.col("d_model").cast("bigint").alias("d"), F.col("n_head").cast("bigint").alias("heads"), F.expr("qk_nope_head_dim + qk_rope_head_dim").alias("qk"))
        c = c.withColumn(name, F.expr(f"bigint({rule})"))
    block = "weights + gains + 2 * d"
    by = c.groupBy("name").agg(
        F.expr("max(weights + gains)").alias("attention"),
        F.expr(f"sum(if(head, 0, {block} + held))").alias("blocks"),
        F.expr(f"sum(if(head, {block} + held + 2 * d + 2 * d * d, 0))").alias("mtp"),
        F.expr(f"sum(if(head, 0, {block} + used))").alias("touched"),
        F.expr("max(emb * if(tied, 1, 2) + d)").alias("outside"),
        F.expr("sum(6 * (weights + used + router + if(head, 2 * d * d + emb, 0)) + scores) + max(6 * emb)").alias("flops"),
    )
    return by.select("name", "attention", "blocks", "mtp", F.expr("blocks + mtp + outside").alias("total"), F.expr("touched + outside").alias("active"), "flops")


def fitted_steps(spark, next_step: int, elapsed: float, budget: float, margin: float, per_step: float, decay_share: float = 0.2, decay_steps: int = 0) -> DataFrame:
    """(max_steps): the first number of steps, from as many as the time left allows, whose decay doesn't begin before next_step."""
    left = max(0, int((budget - elapsed - margin) // max(per_step, 1e-9)))
    first = next_step + left
    n = F.col("id")
    decay = F.lit(decay_steps) if decay_steps else F.greatest(F.lit(1), F.floor(n * decay_share))
    return spark.range(first, first + 4 * (next_step + decay_steps + 4)).where(n - decay >= next_step).agg(F.min("id").alias("max_steps"))


def accumulation(global_tokens: Column, per_micro: Column) -> Column:
    """Micro-steps per step: rounded half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(global_tokens / per_micro).cast("bigint"))
