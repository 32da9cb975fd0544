"""Queries on evaluation items and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import bpe
from millrace.operators import corpus
from millrace.operators import evaluation as ev
from millrace.operators import tasks
from millrace.plans.registry import query
from millrace.runtime import table

_WS = r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\p{Z}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _rstrip(c: str) -> str:
    return f"regexp_replace({c}, '{_WS}+$', '')"


ITEMS = "it AS (SELECT DISTINCT item_id, coalesce(context, '') AS context, choices, gold, task FROM eval_items WHERE len(choices) > 0)"


def items(spark, d):
    """Items with choices; a null context is empty."""
    rows = table(spark, d, "eval_items").where("size(choices) > 0")
    return rows.select("item_id", F.coalesce("context", F.lit("")).alias("context"), "choices", "gold", "task").distinct()


@query("eval_2", f"WITH {ITEMS} SELECT item_id, task, coalesce(task, '') || ': ' || context || ' ' || upper(substr(choices[-1], 1, 1)) || lower(substr(choices[-1], 2)) AS context, array_to_string(list_transform(choices, lambda c: ' ' || {_strip('c')}), '|') AS choices FROM it")
def eval_2(spark, d):
    last = F.element_at("choices", -1)
    ctx = ev.completion(F.col("task"), F.col("context"), last, F.col("context"))
    return items(spark, d).select("item_id", "task", ctx.alias("context"), F.array_join(ev.spaced(F.col("choices")), "|").alias("choices"))


@query("eval_3", f"""WITH t AS (SELECT doc_id, {_rstrip('text')} AS t FROM documents WHERE text IS NOT NULL AND text <> ''), w AS (SELECT doc_id, t, string_split(t, ' ')[-1] AS w FROM t)
SELECT doc_id, md5(CASE WHEN contains(t, ' ') THEN substr(t, 1, length(t) - length(w) - 1) ELSE '' END) AS context, ' ' || w AS choice FROM w""")
def eval_3(spark, d):
    context, choice = ev.last_word(F.col("text"))
    return corpus.usable(table(spark, d, "documents")).select("doc_id", F.md5(context).alias("context"), choice.alias("choice"))


@query("eval_4", f"WITH {ITEMS} SELECT item_id, task, gold, CASE WHEN gold < len(choices) THEN gold ELSE 0 END::INT AS found FROM it")
def eval_4(spark, d):
    labels = F.transform(F.sequence(F.lit(1), F.size("choices")), lambda i: F.substr(F.lit("ABCDEFGHIJ"), i, F.lit(1)))
    key = F.substr(F.lit("ABCDEFGHIJ"), F.col("gold") + 1, F.lit(1))
    return items(spark, d).select("item_id", "task", "gold", ev.gold_of(labels, key).alias("found"))


@query("eval_7", f"""WITH {ITEMS}, s AS (SELECT item_id, task, choices, context || ' _ end_' AS s FROM it), p AS (SELECT *, position('_' IN s) AS p FROM s)
SELECT item_id, task, {_rstrip('left(s, p - 1)')} AS context, ' ' || choices[1] || substr(s, p + 1) || '| ' || choices[-1] || substr(s, p + 1) AS choices FROM p""")
def eval_7(spark, d):
    raw = items(spark, d).select("item_id", "task", F.concat("context", F.lit(" _ end_")).alias("sentence"), F.element_at("choices", 1).alias("option1"), F.element_at("choices", -1).alias("option2"), F.lit("1").alias("answer"))
    return tasks.load("winogrande", raw).select("item_id", "task", "context", F.array_join("choices", "|").alias("choices"))


@query("eval_6", f"WITH {ITEMS} SELECT item_id, task, context, ' ' || choices[1] || '| ' || choices[-1] AS choices, coalesce(gold, 0)::INT AS gold FROM it")
def eval_6(spark, d):
    raw = items(spark, d).select("item_id", "task", F.col("context").alias("goal"), F.element_at("choices", 1).alias("sol1"), F.element_at("choices", -1).alias("sol2"), F.coalesce("gold", F.lit(0)).cast("string").alias("label"))
    return tasks.load("piqa", raw).select("item_id", "task", "context", F.array_join("choices", "|").alias("choices"), "gold")


_REQ = "rq AS (SELECT item_id, context, unnest(choices) AS continuation, unnest(range(len(choices)))::INT AS choice_index FROM (SELECT DISTINCT item_id, coalesce(context, '') AS context, choices FROM eval_items))"


@query("eval_9", f"WITH {_REQ} SELECT item_id, choice_index, context, continuation FROM rq")
def eval_9(spark, d):
    return ev.requests(table(spark, d, "eval_items"))


_LEN = f"{_REQ}, ln AS (SELECT item_id, choice_index, least(greatest(strlen(context), 1) + greatest(strlen(continuation), 1), 256)::INT AS n_ids, greatest(strlen(continuation), 1) AS c FROM rq)"


def lengths(spark, d):
    rows = ev.requests(table(spark, d, "eval_items"))
    n, c = ev.encoded_lengths(F.octet_length("context"), F.octet_length("continuation"), 256)
    return rows.select("item_id", "choice_index", n.alias("n_ids"), c.alias("n_cont"))


@query("eval_10", f"WITH {_LEN} SELECT item_id, choice_index, n_ids, least(c, n_ids - 1)::INT AS n_cont FROM ln")
def eval_10(spark, d):
    return lengths(spark, d)


@query("eval_11", f"WITH {_LEN} SELECT item_id, choice_index, ((row_number() OVER (ORDER BY n_ids DESC, item_id, choice_index) - 1) // 8)::BIGINT AS batch FROM ln")
def eval_11(spark, d):
    return ev.length_batches(lengths(spark, d), "n_ids", ["item_id", "choice_index"], 8).select("item_id", "choice_index", "batch")


_VALID = "v AS (SELECT DISTINCT run, item_id, choice_index, logprob, n_tokens, n_chars, is_greedy FROM eval_scores WHERE run IS NOT NULL AND logprob IS NOT NULL AND NOT isnan(logprob))"


def scores(spark, d):
    return ev.valid_scores(table(spark, d, "eval_scores"))


@query("eval_12", f"WITH {_VALID} SELECT run, item_id, round(sum(logprob), 6) AS logprob, bool_and(is_greedy) AS all_greedy, count(*) AS n FROM v GROUP BY run, item_id")
def eval_12(spark, d):
    return ev.span_scores(scores(spark, d), ["run", "item_id"]).withColumn("logprob", F.round("logprob", 6))


@query("eval_13", f"WITH {_VALID} SELECT run, item_id, choice_index, logprob / greatest(n_chars, 1) AS per_char, logprob / greatest(n_tokens, 1) AS per_token FROM v")
def eval_13(spark, d):
    unit = lambda c: ev.per_unit(F.col("logprob"), F.col(c))
    return scores(spark, d).select("run", "item_id", "choice_index", unit("n_chars").alias("per_char"), unit("n_tokens").alias("per_token"))


_JUDGED = f"""{_VALID}, i AS (SELECT DISTINCT ON (item_id) item_id, lower(task) AS task, len(choices) AS k, gold FROM eval_items WHERE len(choices) > 0),
b AS (SELECT run, item_id, k, gold, task, count(*) AS n, bool_and(is_greedy) AS g, (array_agg(choice_index ORDER BY logprob DESC, choice_index))[1] AS a,
(array_agg(choice_index ORDER BY logprob / greatest(n_chars, 1) DESC, choice_index))[1] AS c, (array_agg(choice_index ORDER BY logprob / greatest(n_tokens, 1) DESC, choice_index))[1] AS t
FROM v JOIN i USING (item_id) GROUP BY ALL HAVING count(*) = k),
j AS (SELECT run, task, CASE WHEN k = 1 THEN g ELSE coalesce(a = gold, false) END::INT AS acc, CASE WHEN k = 1 THEN g ELSE coalesce(c = gold, false) END::INT AS acc_norm,
CASE WHEN k = 1 THEN g ELSE coalesce(t = gold, false) END::INT AS acc_token, CASE WHEN k > 1 THEN 1.0::DOUBLE / k ELSE 0 END AS base FROM b),
acc AS (SELECT run, task, count(*) AS n, round(avg(acc), 6) AS acc, round(avg(acc_norm), 6) AS acc_norm, round(avg(acc_token), 6) AS acc_token, round(avg(base), 6) AS random_baseline FROM j GROUP BY run, task)"""


def accuracy(spark, d):
    return ev.accuracy(ev.judged(table(spark, d, "eval_items"), table(spark, d, "eval_scores")))


@query("eval_14", f"WITH {_JUDGED} SELECT run, task, n, acc, acc_norm, acc_token, random_baseline FROM acc")
def eval_14(spark, d):
    return accuracy(spark, d)


@query("eval_15", f"WITH {_VALID}, p AS (SELECT run, -sum(logprob) / sum(n_tokens) AS nll, sum(n_tokens)::BIGINT AS n_tokens FROM v GROUP BY run) SELECT run, round(nll, 6) AS loss, round(exp(least(nll, 20)), 4) AS ppl, n_tokens, round(nll / ln(2) / 3.0, 6) AS bpb FROM p")
def eval_15(spark, d):
    return ev.perplexity(scores(spark, d), 3.0)


@query("eval_16", f"""WITH {_JUDGED} SELECT run, 1::INT AS ord, task, '| ' || task || ' | ' || n || ' | ' || printf('%.2f', round(100 * acc_norm, 2)) || ' | ' || printf('%.2f', round(100 * random_baseline, 2)) || ' |' AS line FROM acc
UNION ALL SELECT run, 2::INT, '', '| **average** | | **' || printf('%.2f', round(100 * avg(acc_norm), 2)) || '** | |' FROM acc GROUP BY run""")
def eval_16(spark, d):
    return ev.report(accuracy(spark, d), "acc_norm")


@query("eval_17", f"WITH {_VALID}, r AS (SELECT run, item_id % 4 AS rank, avg(-logprob / greatest(n_tokens, 1)) AS l FROM v GROUP BY run, item_id % 4) SELECT run, round(avg(l), 6) AS loss, round(exp(least(avg(l), 20)), 4) AS ppl, round(avg(l) / ln(2), 6) AS bpb FROM r GROUP BY run")
def eval_17(spark, d):
    """Validation in training: batches of equal weight on each of four ranks."""
    rows = scores(spark, d).select("run", (F.col("item_id") % 4).alias("rank"), (-ev.per_unit(F.col("logprob"), F.col("n_tokens"))).alias("ce"))
    return ev.validation(rows)


@query("eval_10_ids", f"""WITH {_REQ}, bt AS (SELECT item_id, choice_index, CASE WHEN context = '' THEN [256] ELSE list_transform(regexp_extract_all(hex(encode(context)), '..'), lambda h: ('0x' || h)::INT) END AS a,
CASE WHEN continuation = '' THEN [256] ELSE list_transform(regexp_extract_all(hex(encode(continuation)), '..'), lambda h: ('0x' || h)::INT) END AS b FROM rq), k AS (SELECT item_id, choice_index, len(b) AS nb, list_concat(a, b)[-64:] AS ids FROM bt)
SELECT item_id, choice_index, len(ids)::INT AS n_ids, least(nb, len(ids) - 1)::INT AS n_cont, list_sum(ids)::BIGINT AS id_sum, ids[1] AS first FROM k""")
def eval_10_ids(spark, d):
    """Requests as ids, the last 64 kept."""
    got = ev.encoded_requests(ev.requests(table(spark, d, "eval_items")), bpe.Vocabulary([], ["<|endoftext|>"]), 64)
    return got.select("item_id", "choice_index", F.size("ids").alias("n_ids"), "n_cont", F.expr("aggregate(ids, 0L, (x, y) -> x + y)").alias("id_sum"), F.element_at("ids", 1).alias("first"))


@query("eval_8", "SELECT * FROM (VALUES " + ", ".join("({}::INT, '{}', '{}', {}::INT)".format(k, c, ch[g], g) for k, (c, ch, g) in enumerate(tasks.PLAIN)) + ") AS v(n, context, best, gold)")
def eval_8(spark, d):
    """The task of three items that any working scorer gets right."""
    return tasks.load("sanity", limit=3, order_by=["n"]).select("n", "context", F.expr("choices[gold]").alias("best"), "gold")


@query("eval_1", "SELECT * FROM (VALUES ('arc_challenge'), ('arc_easy'), ('hellaswag'), ('lambada'), ('openbookqa'), ('piqa'), ('sanity'), ('winogrande')) AS v(task)")
def eval_1(spark, d):
    """The tasks there are."""
    return spark.createDataFrame([(n,) for n in tasks.TASKS], "task string")


_TASKS = [("arc_easy", "question"), ("arc_challenge", "question"), ("openbookqa", "question_stem")]


@query("eval_5", f"WITH {ITEMS} SELECT name, item_id, task, context, array_to_string(list_transform(choices, lambda c: ' ' || {_strip('c')}), '|') AS choices, CASE WHEN gold < len(choices) THEN gold ELSE 0 END::INT AS gold FROM it, (VALUES ('arc_easy'), ('arc_challenge'), ('openbookqa')) AS v(name)")
def eval_5(spark, d):
    """The tasks of lettered choices, built from rows of their shape."""
    letters = F.transform(F.sequence(F.lit(1), F.size("choices")), lambda i: F.substr(F.lit("ABCDEFGHIJ"), i, F.lit(1)))
    key = F.substr(F.lit("ABCDEFGHIJ"), F.col("gold") + 1, F.lit(1))
    out = None
    for name, question in _TASKS:
        raw = items(spark, d).select("item_id", "task", F.col("context").alias(question), F.struct(letters.alias("label"), F.col("choices").alias("text")).alias("choices"), key.alias("answerKey"))
        part = tasks.load(name, raw).select(F.lit(name).alias("name"), "item_id", "task", "context", F.array_join("choices", "|").alias("choices"), "gold")
        out = part if out is None else out.unionByName(part)
    return out
