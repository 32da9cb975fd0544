"""Conversations as training examples: records, rendering, loss masks and packed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import bpe
from millrace.operators.order import positioned, restarting_groups
from millrace.sources.text import strict_json

#: The token of each role.
ROLES = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"}
RECORD = "messages array<struct<role string, content string>>, instruction string, input string, output string, prompt string, question string, response string, completion string, answer string"


def _filled(*names: str) -> Column:
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names])


def _pair(user: Column, reply: Column) -> Column:
    turn = lambda who, c: F.struct(F.lit(who).alias("role"), c.alias("content"))
    return F.when(user.isNotNull() & reply.isNotNull(), F.array(turn("user", user), turn("assistant", reply)))


def parse_records(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """lines with messages array<struct<role, content>>, or null where a line is no usable record.

    A record with messages gives those of known role and non-empty content, and null if none is left, without a look at the rest; then
    come instruction (with input after a blank line) and output or response; then prompt or question and
    response, completion or answer. Blank and malformed lines give null.
    """
    keep = lines.columns
    raw = F.col(f"`{line_col}`")
    r = lines.withColumn("__r", F.from_json(raw, RECORD)).withColumn("__v", strict_json(raw))
    has = lambda k: F.schema_of_variant(F.try_variant_get("__v", f"$.{k}", "variant")).isNotNull()
    r = r.select(*keep, "__r.*", has("messages").alias("__m"), has("instruction").alias("__i"), F.col("__v").isNull().alias("__bad"))
    turns = F.filter("messages", lambda m: m.role.isin(*ROLES) & (m.content != ""))
    user = F.when(F.coalesce("input", F.lit("")) != "", F.concat("instruction", F.lit("\n\n"), "input")).otherwise(F.col("instruction"))
    found = (
        F.when(F.col("__bad"), None)
        .when(F.col("__m"), F.when(F.size(turns) > 0, turns))
        .when(F.col("__i"), _pair(user, _filled("output", "response")))
        .otherwise(_pair(_filled("prompt", "question"), _filled("response", "completion", "answer")))
    )
    return r.select(*keep, found.alias("messages"))


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<turn, role, content>>) in order of turn.

    messages: (conv_id, turn, role, content); roles in any case and with blanks, others than the three are dropped with their rows, so are null and
    empty contents; rows delivered again count once. A conversation is gathered as one value, as it is one example.
    """
    role = F.lower(F.trim("role"))
    rows = messages.where(role.isin(*ROLES) & (F.col("content") != "")).select("conv_id", F.struct("turn", role.alias("role"), "content").alias("m"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_set("m")).alias("messages"))


def render(messages: Column) -> Column:
    """The prompt form: role token and content of each message, then the assistant's token."""
    tokens = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.concat(F.array_join(F.transform(messages, lambda m: F.concat(F.element_at(tokens, m.role), m.content)), ""), F.lit(ROLES["assistant"]))


def encode_examples(convs: DataFrame, v: bpe.Vocabulary) -> DataFrame:
    """(conv_id, ids, mask): role id and content of each message, an end id after an assistant's; mask 1 on the assistant's content and end."""
    missing = [t for t in ROLES.values() if t not in v.specials]
    if missing:
        raise ValueError(f"the vocabulary lacks {missing}")
    turns = convs.select("conv_id", F.posexplode("messages").alias("pos", "m")).select(F.struct("conv_id", "pos", "m.role").alias("key"), "m.content")
    got = bpe.encode(turns, v, "key", "content").select("key.*", "ids")
    head = F.create_map(*[F.lit(x) for r, t in ROLES.items() for x in (r, v.specials[t])])
    reply = F.col("role") == "assistant"
    ids = F.concat(F.array(F.element_at(head, F.col("role"))), "ids", F.when(reply, F.array(F.lit(v.end_id()))).otherwise(F.array().cast("array<int>")))
    mask = F.concat(F.array(F.lit(0)), F.array_repeat(reply.cast("int"), F.size("ids") + reply.cast("int")))
    parts = got.select("conv_id", F.struct("pos", ids.alias("ids"), mask.alias("mask")).alias("p"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select("conv_id", F.flatten(F.col("p.ids")).alias("ids"), F.flatten(F.col("p.mask")).cast("array<tinyint>").alias("mask"))


def pack(examples: DataFrame, seq_len: int, pad_id: int, order_col: str, drop_long: bool = False) -> DataFrame:
    """(window_id, ids, mask): examples packed in order into windows of seq_len + 1, padded with mask 0.

    A window ends before the example that would overflow it. Longer examples are cut at the end, or dropped. Null or empty ids take no place;
    a null mask, or one shorter than its ids, counts as 0 there. Only (order, length) is sorted; an example meets its window by a join.
    """
    width = seq_len + 1
    rows = examples.where("size(ids) > 0").select(F.col(f"`{order_col}`").alias("o"), "ids", F.coalesce("mask", F.array().cast("array<tinyint>")).alias("mask"))
    rows = rows.where(F.size("ids") <= width) if drop_long else rows.withColumn("mask", F.slice("mask", 1, F.least(F.size("ids"), F.lit(width)))).withColumn("ids", F.slice("ids", 1, width))
    n = F.size("ids")
    rows = rows.withColumn("mask", F.concat(F.slice("mask", 1, n), F.array_repeat(F.lit(0).cast("tinyint"), F.greatest(n - F.size("mask"), F.lit(0)))))
    at = positioned(rows.select("o", n.cast("bigint").alias("len")), ["o"], ["len"])
    window = at.select("o", "ord").join(restarting_groups(at, width, "pack"), "ord")
    parts = rows.join(window, "o").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("ord", "ids", "mask"))).alias("p"))
    flat = parts.select(F.col("grp").alias("window_id"), F.flatten(F.col("p.ids")).alias("ids"), F.flatten(F.col("p.mask")).alias("mask"))
    gap = F.lit(width) - F.size("ids")
    return flat.select("window_id", F.concat("ids", F.array_repeat(F.lit(pad_id), gap)).alias("ids"), F.concat("mask", F.array_repeat(F.lit(0).cast("tinyint"), gap)).alias("mask"))


def pad_id(v: bpe.Vocabulary) -> int:
    return v.specials.get("<|pad|>", v.end_id())


def missing_roles(specials: DataFrame, roles: dict[str, str] = ROLES) -> DataFrame:
    """(role): the role tokens that a vocabulary's specials (name) lack; encode_examples() refuses such a vocabulary."""
    need = specials.sparkSession.createDataFrame([(t,) for t in roles.values()], "role string")
    return need.join(specials.select(F.col("name").alias("role")), "role", "left_anti")


def batches(windows_: DataFrame, plan: DataFrame) -> DataFrame:
    """plan (.., seq_idx) with x, y and mask of its windows (window_id, ids, mask): inputs, targets, and whether a target is trained on."""
    n = F.size("ids") - 1
    rows = windows_.select(F.col("window_id").alias("seq_idx"), F.slice("ids", F.lit(1), n).alias("x"), F.slice("ids", F.lit(2), n).alias("y"), F.slice("mask", F.lit(2), n).alias("mask"))
    return plan.join(rows, "seq_idx")
