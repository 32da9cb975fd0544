"""Multiple-choice items, requests, and the aggregation of their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import bpe
from millrace.operators.order import positioned


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def spaced(choices: Column) -> Column:
    """Choices without blanks around, each with one before."""
    return F.transform(choices, lambda c: F.concat(F.lit(" "), _strip(c)))


def completion(activity: Column, ctx_a: Column, ctx_b: Column, ctx: Column) -> Column:
    """activity: ctx_a ctx_b, the latter with a capital and else small letters; ctx alone where there is no ctx_b."""
    second = F.concat(F.upper(F.substring(ctx_b, 1, 1)), F.lower(F.substring(ctx_b, 2, 1 << 30)))
    return F.concat(F.coalesce(activity, F.lit("")), F.lit(": "), F.when(F.coalesce(ctx_b, F.lit("")) != "", F.concat(ctx_a, F.lit(" "), second)).otherwise(ctx))


def last_word(text: Column) -> tuple[Column, Column]:
    """(context, choice): all before the last blank of the text without blanks at its end, and what follows with a blank before; no blank, no context."""
    t = _rstrip(text)
    last = F.substring_index(t, " ", -1)
    return F.when(F.contains(t, F.lit(" ")), F.left(t, F.length(t) - F.length(last) - 1)).otherwise(""), F.concat(F.lit(" "), last)


def gold_of(labels: Column, key: Column) -> Column:
    """Place of the key among the labels, 0 if it isn't there."""
    return F.greatest(F.coalesce(F.array_position(labels, key), F.lit(0)).cast("int") - 1, F.lit(0))


def fill_blank(sentence: Column, options: list[Column]) -> tuple[Column, Column]:
    """(context, choices): the sentence up to the first _ without blanks at its end, and each option with what follows the _."""
    at = F.instr(sentence, "_")
    prefix = F.when(at > 0, F.left(sentence, at - 1)).otherwise(sentence)
    suffix = F.when(at > 0, F.substr(sentence, at + 1)).otherwise("")
    return _rstrip(prefix), F.array(*[F.concat(F.lit(" "), o, suffix) for o in options])


def requests(items: DataFrame) -> DataFrame:
    """(item_id, choice_index, context, continuation): a row per choice; repeated items count once, null contexts are empty."""
    one = items.select("item_id", F.coalesce("context", F.lit("")).alias("context"), "choices").distinct()
    return one.select("item_id", "context", F.posexplode("choices").alias("choice_index", "continuation"))


def encoded_lengths(n_context: Column, n_continuation: Column, max_len: int) -> tuple[Column, Column]:
    """(n_ids, n_cont): an empty side is one end token; the last max_len ids are kept, of which at least one is context."""
    n = F.least(F.greatest(n_context, F.lit(1)) + F.greatest(n_continuation, F.lit(1)), F.lit(max_len))
    return n, F.least(F.greatest(n_continuation, F.lit(1)), n - 1)


def encoded_requests(rows: DataFrame, v: bpe.Vocabulary, max_len: int, keys: tuple[str, ...] = ("item_id", "choice_index")) -> DataFrame:
    """(*keys, ids, n_cont) of requests: context and continuation encoded, an empty one being an end token, of which the last max_len ids are kept."""
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("text")) for k, c in enumerate(("context", "continuation"))])
    both = rows.select(F.struct(*keys).alias("key"), F.explode(sides).alias("s")).select(F.struct("key", "s.side").alias("at"), F.coalesce("s.text", F.lit("")).alias("text"))
    got = bpe.encode(both, v, "at").withColumn("ids", F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.array(F.lit(v.end_id()))))
    side = lambda k: F.max(F.when(F.col("at.side") == k, F.col("ids")))  # noqa: E731  one row a side
    whole = got.groupBy(F.col("at.key").alias("key")).agg(side(0).alias("a"), side(1).alias("b"))
    ids = F.concat("a", "b")
    kept = whole.select("key.*", F.slice(ids, F.greatest(F.lit(1), F.size(ids) - max_len + 1), F.lit(max_len)).alias("ids"), F.size("b").alias("__n"))
    return kept.select(*keys, "ids", F.least("__n", F.size("ids") - 1).alias("n_cont"))


def length_batches(rows: DataFrame, n_col: str, keys: list[str], size: int) -> DataFrame:
    """rows with batch: the longest first, of equal length by keys, size rows to a batch."""
    at = positioned(rows.select(*keys, (-F.col(n_col)).alias("neg")), ["neg", *keys])
    return rows.join(at.select(*keys, F.expr(f"(ord - 1) div {size}").alias("batch")), keys)


def valid_scores(scores: DataFrame) -> DataFrame:
    """Scores once each; null and NaN log-probabilities are dropped."""
    rows = scores.select("run", "item_id", "choice_index", "logprob", "n_tokens", "n_chars", "is_greedy")
    return rows.where("run is not null and logprob is not null and not isnan(logprob)").dropDuplicates(["run", "item_id", "choice_index"])


def span_scores(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, logprob, all_greedy, n) of rows (logprob, is_greedy) per token."""
    return tokens.groupBy(*keys).agg(F.sum("logprob").alias("logprob"), F.bool_and("is_greedy").alias("all_greedy"), F.count("*").alias("n"))


def per_unit(logprob: Column, n: Column) -> Column:
    return logprob / F.greatest(n, F.lit(1))


def judged(items: DataFrame, scores: DataFrame) -> DataFrame:
    """(run, task, item_id, acc, acc_norm, acc_token, baseline) of items all of whose choices are scored.

    The choice of the highest score is held against gold, of equal ones the first; norm is per character, token per token. An item with one choice is
    right if that is greedy, and has baseline 0. A null gold is never right. Task names count without case.
    """
    one = items.where("size(choices) > 0").select("item_id", F.lower("task").alias("task"), F.size("choices").alias("k"), "gold").dropDuplicates(["item_id"])
    s = valid_scores(scores)
    best = lambda v: F.max_by("choice_index", F.struct(v, -F.col("choice_index")))
    by = s.groupBy("run", "item_id").agg(
        F.count("*").alias("scored"),
        best(F.col("logprob")).alias("raw"),
        best(per_unit(F.col("logprob"), F.col("n_chars"))).alias("norm"),
        best(per_unit(F.col("logprob"), F.col("n_tokens"))).alias("token"),
        F.bool_and("is_greedy").alias("greedy"),
    )
    rows = by.join(one, "item_id").where("scored = k")
    hit = lambda c: F.when(F.col("k") == 1, F.col("greedy")).otherwise(F.coalesce(F.col(c) == F.col("gold"), F.lit(False))).cast("int")
    return rows.select("run", "task", "item_id", hit("raw").alias("acc"), hit("norm").alias("acc_norm"), hit("token").alias("acc_token"),
                       F.when(F.col("k") > 1, 1 / F.col("k")).otherwise(0.0).alias("baseline"))


def accuracy(rows: DataFrame) -> DataFrame:
    """(run, task, n, acc, acc_norm, acc_token, random_baseline) of judged() rows."""
    return rows.groupBy("run", "task").agg(
        F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("acc", "acc_norm", "acc_token")], F.round(F.avg("baseline"), 6).alias("random_baseline")
    )


def perplexity(scores: DataFrame, bytes_per_token: float = 0.0) -> DataFrame:
    """(run, loss, ppl, n_tokens[, bpb]): negative log-likelihood per token, its exponential up to e^20, and bits per byte."""
    by = scores.groupBy("run").agg((-F.sum("logprob") / F.sum("n_tokens")).alias("nll"), F.sum("n_tokens").alias("n_tokens"))
    out = by.select("run", F.round("nll", 6).alias("loss"), F.round(F.exp(F.least("nll", F.lit(20.0))), 4).alias("ppl"), "n_tokens", "nll")
    return (out.withColumn("bpb", F.round(F.col("nll") / F.log(F.lit(2.0)) / bytes_per_token, 6)) if bytes_per_token > 0 else out).drop("nll")


def validation(batches: DataFrame, bytes_per_token: float | None = None) -> DataFrame:
    """(run, loss, ppl, bpb) of (run, rank, ce): the plain mean over each rank's batches, averaged over ranks; without bytes per token they count as 1."""
    loss = batches.groupBy("run", "rank").agg(F.avg("ce").alias("ce")).groupBy("run").agg(F.avg("ce").alias("l"))
    bits = F.col("l") / F.log(F.lit(2.0)) / (bytes_per_token or 1.0)
    return loss.select("run", F.round("l", 6).alias("loss"), F.round(F.exp(F.least("l", F.lit(20.0))), 4).alias("ppl"), F.round(bits, 6).alias("bpb"))


def report(acc: DataFrame, metric: str) -> DataFrame:
    """(run, ord, line): a table in markdown, tasks by name and their plain average at the end."""
    pct = lambda c: F.format_string("%.2f", F.round(100 * c, 2))
    lines = acc.select("run", F.lit(1).alias("ord"), "task", F.concat(F.lit("| "), "task", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), pct(F.col(metric)), F.lit(" | "), pct(F.col("random_baseline")), F.lit(" |")).alias("line"))
    foot = acc.groupBy("run").agg(F.avg(metric).alias("a")).select("run", F.lit(2).alias("ord"), F.lit("").alias("task"), F.concat(F.lit("| **average** | | **"), pct(F.col("a")), F.lit("** | |")).alias("line"))
    return lines.unionByName(foot)
