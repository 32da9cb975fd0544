"""Queries on conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import bpe
from millrace.operators import chat, windows
from millrace.plans.registry import query
from millrace.runtime import cut, new_path, table

SPECIALS = ["<|endoftext|>", "<|pad|>", "<|system|>", "<|user|>", "<|assistant|>"]
VOCAB = bpe.Vocabulary([], SPECIALS)
_KNOWN = "k AS (SELECT DISTINCT conv_id, turn, lower(trim(role, ' ')) AS role, content FROM messages WHERE lower(trim(role, ' ')) IN ('system', 'user', 'assistant') AND content <> '')"
_HEAD = "CASE role WHEN 'system' THEN 258 WHEN 'user' THEN 259 ELSE 260 END"


def convs(spark, d):
    return chat.conversations(table(spark, d, "messages"))


# Records of all shapes are made of messages, by their id.
_LINES = "lines AS (SELECT DISTINCT message_id, content, role, dataset FROM messages WHERE content <> '' AND role IS NOT NULL)"


@query("sft_1", f"""WITH {_LINES} SELECT message_id, CASE message_id % 5 WHEN 0 THEN 1 ELSE 2 END::INT AS n, CASE message_id % 5
WHEN 1 THEN md5(content || (CASE WHEN role = '' THEN '' ELSE chr(10) || chr(10) || role END) || '|' || dataset) WHEN 0 THEN md5(content) ELSE md5(content || '|' || dataset) END AS digest
FROM lines WHERE message_id % 5 = 0 OR (message_id % 5 IN (1, 2) AND dataset <> '')""")
def sft_1(spark, d):
    m = table(spark, d, "messages").where("content <> '' and role is not null").select("message_id", "content", "role", "dataset").distinct()
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    k = F.col("message_id") % 5
    line = (
        F.when(k == 0, F.to_json(F.struct(F.array(turn("user", F.col("content")), turn("robot", F.lit("x")), turn("assistant", F.lit(""))).alias("messages"))))
        .when(k == 1, F.to_json(F.struct(F.col("content").alias("instruction"), F.col("role").alias("input"), F.col("dataset").alias("output"))))
        .when(k == 2, F.to_json(F.struct(F.col("content").alias("question"), F.coalesce("dataset", F.lit("")).alias("answer"))))
        .when(k == 3, F.to_json(F.struct(F.array().cast("array<struct<role:string,content:string>>").alias("messages"), F.col("content").alias("prompt"), F.lit("r").alias("response"))))
        .otherwise("not json")
    )
    got = chat.parse_records(m.select("message_id", line.alias("line"))).where("messages is not null")
    return got.select("message_id", F.size("messages").alias("n"), F.md5(F.array_join(F.col("messages.content"), "|")).alias("digest"))


@query("sft_2", f"WITH {_KNOWN} SELECT conv_id, md5(string_agg('<|' || role || '|>' || content, '' ORDER BY turn) || '<|assistant|>') AS digest FROM k GROUP BY conv_id")
def sft_2(spark, d):
    return convs(spark, d).select("conv_id", F.md5(chat.render(F.col("messages"))).alias("digest"))


@query("sft_3", f"""WITH {_KNOWN}, t AS (SELECT conv_id, role, strlen(content) AS n, {_HEAD} AS head, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS a,
list_sum(list_transform(regexp_extract_all(hex(encode(content)), '..'), lambda h: ('0x' || h)::INT)) AS s FROM k)
SELECT conv_id, sum(1 + n + a)::BIGINT AS n_ids, sum(a * (n + 1))::BIGINT AS n_trainable, sum(head + s + a * 256)::BIGINT AS id_sum FROM t GROUP BY conv_id""")
def sft_3(spark, d):
    ex = chat.encode_examples(convs(spark, d), VOCAB)
    return ex.select("conv_id", F.size("ids").cast("bigint").alias("n_ids"), F.expr("aggregate(mask, 0L, (x, y) -> x + y)").alias("n_trainable"), F.expr("aggregate(ids, 0L, (x, y) -> x + y)").alias("id_sum"))


@query("sft_4", "SELECT r AS role FROM (VALUES ('<|tool|>'), ('<|user|>')) AS v(r) WHERE r NOT IN (SELECT decode(token_bytes) FROM vocab WHERE is_special)")
def sft_4(spark, d):
    """Role tokens that the vocabulary lacks."""
    have = table(spark, d, "vocab").where("is_special").select(F.decode("token_bytes", "UTF-8").alias("name"))
    return chat.missing_roles(have, {"tool": "<|tool|>", "user": "<|user|>"})


SEQ = 512
_PACK = f"""WITH RECURSIVE x AS (SELECT DISTINCT example_id, ids, mask FROM examples WHERE len(ids) > 0),
s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY example_id) AS k, least(len(ids), {SEQ + 1})::BIGINT AS n,
coalesce(list_sum(list_transform(mask[1:least(len(ids), {SEQ + 1})], lambda m: m::BIGINT)), 0)::BIGINT AS t FROM x),
r AS (SELECT k, n, t, 0::BIGINT AS w, n AS run FROM s WHERE k = 1 UNION ALL
SELECT s.k, s.n, s.t, r.w + (r.run + s.n > {SEQ + 1})::BIGINT, CASE WHEN r.run + s.n > {SEQ + 1} THEN s.n ELSE r.run + s.n END FROM r JOIN s ON s.k = r.k + 1),
g AS (SELECT w AS window_id, {SEQ + 1} - sum(n)::BIGINT AS n_pad, sum(t)::BIGINT AS n_trainable, count(*) AS n FROM r GROUP BY w)"""


def packed(spark, d):
    ex = table(spark, d, "examples").select("example_id", "ids", "mask").distinct()
    return chat.pack(ex, SEQ, -1, "example_id")


@query("sft_5", _PACK + f" SELECT window_id, {SEQ + 1}::BIGINT AS n_ids, n_pad, n_trainable FROM g")
def sft_5(spark, d):
    ones = F.expr("aggregate(mask, 0L, (x, y) -> x + y)")
    return packed(spark, d).select("window_id", F.size("ids").cast("bigint").alias("n_ids"), F.expr("bigint(size(filter(ids, x -> x = -1)))").alias("n_pad"), ones.alias("n_trainable"))


@query("sft_6", _PACK + f" SELECT round(sum(n_trainable) / (count(*) * {SEQ + 1}), 6) AS fraction FROM g")
def sft_6(spark, d):
    ones = F.expr("aggregate(mask, 0L, (x, y) -> x + y)")
    return packed(spark, d).agg(F.round(F.sum(ones) / (F.count("*") * (SEQ + 1)), 6).alias("fraction"))


@query("sft_7", _PACK + " SELECT window_id, n_trainable AS y_trainable FROM g")
def sft_7(spark, d):
    """Trainable targets: the mask is shifted with them, and a window's first token, a role, is never trained."""
    shifted = F.slice("mask", 2, SEQ)
    return packed(spark, d).select("window_id", F.aggregate(shifted, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("y_trainable"))


@query("sft_7_batches")
def sft_7_batches(spark, d):
    """Two epochs of batches of 4 on 2 ranks over all packed windows: (step, rank, slot, seq_idx, x_sum, y_trained)."""
    packed_rows = cut(packed(spark, d))
    n = packed_rows.count()
    plan = windows.batch_plan(spark, n, range(2 * (n // 8)), 4, 2, 1337)
    got = chat.batches(packed_rows, plan)
    total = F.expr("aggregate(x, 0L, (a, t) -> a + t)")
    trained = F.expr("aggregate(zip_with(y, mask, (t, m) -> bigint(t) * m), 0L, (a, t) -> a + t)")
    return got.select("step", "rank", "slot", "seq_idx", total.alias("x_sum"), trained.alias("y_trained"))


@query("sft_8", "SELECT coalesce(max(CASE WHEN decode(token_bytes) = '<|pad|>' THEN token_id END), max(CASE WHEN decode(token_bytes) = '<|endoftext|>' THEN token_id END))::INT AS pad_id FROM vocab WHERE is_special")
def sft_8(spark, d):
    s = table(spark, d, "vocab").where("is_special").select("token_id", F.decode("token_bytes", "UTF-8").alias("name"))
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("token_id")))
    return s.agg(F.coalesce(pick("<|pad|>"), pick("<|endoftext|>")).alias("pad_id"))


@query("src_13", f"WITH {_KNOWN} SELECT md5(string_agg('<|' || role || '|>' || content, '' ORDER BY turn) || '<|assistant|>') AS digest FROM k GROUP BY conv_id")
def src_13(spark, d):
    """Conversations written as JSON lines, with lines that are none among them, and read back."""
    path = new_path(spark, "chats", ".jsonl")
    good = convs(spark, d).select(F.to_json(F.struct(F.expr("transform(messages, m -> struct(m.role as role, m.content as content))").alias("messages"))).alias("value"))
    bad = spark.createDataFrame([("",), ("{broken",), ("[1]",), ('{"text": "x"}',)], "value string")
    good.union(bad).write.text(path)
    got = chat.parse_records(spark.read.text(path), "value").where("messages is not null")
    return got.select(F.md5(chat.render(F.col("messages"))).alias("digest"))
