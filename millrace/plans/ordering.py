"""Queries on the stateless shuffle, the batch plan and mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import shuffle
from millrace.operators import mixture, windows
from millrace.plans import corpus
from millrace.plans.registry import query
from millrace.runtime import cut, table

_M64 = "18446744073709551616::UHUGEINT"
_MUL = f"((({{a}})::UHUGEINT * ({{b}})::UHUGEINT) % {_M64})::UBIGINT"


def _mix(x: str) -> str:
    """The finaliser as nested scalar subqueries, so that each step is worked out once."""
    return (
        f"(SELECT xor(z, z >> 31) FROM (SELECT {_MUL.format(a='xor(y, y >> 27)', b='10723151780598845931')} AS z FROM "
        f"(SELECT {_MUL.format(a='xor(x, x >> 30)', b='13787848793156543929')} AS y FROM (SELECT ({x})::UBIGINT AS x))))"
    )


def _add(a: str, b: str) -> str:
    return f"((({a})::UHUGEINT + ({b})::UHUGEINT) % {_M64})::UBIGINT"


_STEP = "11400714819323198485"
_SEED = f"(SELECT {_mix(_add(_MUL.format(a='1337', b=_STEP), _MUL.format(a='e + 1', b='13787848793156543929')))} & 9223372036854775807::UBIGINT)"


def _perm(n: int, source: str) -> str:
    """CTEs from `source` (idx, seed ubigint): perm (idx, seed, out); rounds are rows of a recursive table."""
    half = shuffle.half_width(n)
    low = (1 << half) - 1
    key = _mix(_add(_MUL.format(a="seed", b=_STEP), _MUL.format(a="round + 1", b=_STEP)))
    f = f"({_mix(_add('r', key))} & {low}::UBIGINT)"
    return (
        f"walk AS (SELECT idx, seed, 0 AS round, idx::UBIGINT >> {half} AS l, idx::UBIGINT & {low}::UBIGINT AS r FROM {source} "
        f"UNION ALL SELECT idx, seed, CASE WHEN round = 4 THEN 0 ELSE round + 1 END, CASE WHEN round = 4 THEN l ELSE r END, CASE WHEN round = 4 THEN r ELSE xor(l, {f}) END "
        f"FROM walk WHERE round < 4 OR (l << {half}) | r >= {n}), "
        f"perm AS (SELECT idx, seed, ((l << {half}) | r)::BIGINT AS out FROM walk WHERE round = 4 AND (l << {half}) | r < {n})"
    )


N = 1000


@query("perm_7", f"SELECT e AS epoch, {_SEED}::BIGINT AS seed FROM range(200) AS t(e)")
def perm_7(spark, d):
    return spark.createDataFrame([(e, shuffle.epoch_seed(1337, e)) for e in range(200)], "epoch bigint, seed bigint")


@query("perm_5", f"WITH RECURSIVE s AS (SELECT i AS idx, {_SEED.replace('e + 1', '1')} AS seed FROM range({N}) AS t(i)), {_perm(N, 's')} SELECT idx, out FROM perm")
def perm_5(spark, d):
    return spark.range(N).select(F.col("id").alias("idx"), shuffle.permute(F.col("id"), N, shuffle.epoch_seed(1337, 0)).alias("out"))


@query("perm_6", f"WITH RECURSIVE s AS (SELECT i AS idx, 5::UBIGINT AS seed FROM range(300, 400) AS t(i)), {_perm(N, 's')} SELECT idx, out FROM perm")
def perm_6(spark, d):
    return spark.range(300, 400).select(F.col("id").alias("idx"), shuffle.permute(F.col("id"), N, 5).alias("out"))


# 127 sequences, 2 ranks of 4: 15 steps an epoch, 7 sequences of each are left out.
_PLAN = f"""WITH RECURSIVE k AS (SELECT k, k // 8 AS step, (k // 8) // 15 AS e, ((k // 8) % 15) * 8 AS cursor, k % 8 AS spot FROM range(400) AS t(k)),
s AS (SELECT cursor + spot AS idx, {_SEED} AS seed, k FROM k), {_perm(127, '(SELECT DISTINCT idx, seed FROM s)')}
SELECT step, e AS epoch, cursor, spot // 4 AS rank, spot % 4 AS slot, out AS seq_idx FROM k JOIN s USING (k) JOIN perm ON perm.idx = s.idx AND perm.seed = s.seed"""


@query("load_4", _PLAN)
def load_4(spark, d):
    return windows.batch_plan(spark, 127, range(50), 4, 2, 1337)


@query("load_2", "SELECT s AS step, s // 15 AS epoch, (s % 15) * 8 AS cursor FROM range(50) AS t(s)")
def load_2(spark, d):
    return windows.batch_plan(spark, 127, range(50), 4, 2, 1337).select("step", "epoch", "cursor").distinct()


@query("load_5", "SELECT s AS step, (s + 1) * 8 * 512 AS tokens_seen FROM range(50) AS t(s)")
def load_5(spark, d):
    return spark.range(50).select(F.col("id").alias("step"), windows.tokens_seen(F.col("id"), 8, 512).alias("tokens_seen"))


@query("load_7", "SELECT message_id, (message_id // 8) * 8 AS cursor FROM messages WHERE message_id >= 0")
def load_7(spark, d):
    """States of loaders with other cursors, restored in a job of 8 a step."""
    saved = table(spark, d, "messages").where("message_id >= 0").select("message_id", F.col("message_id").alias("cursor"), F.when(F.col("message_id") % 2 == 0, 1337).alias("seed"), F.lit(127).alias("n_sequences"))
    return windows.restored(saved, 1337, 127, 8, strict=True).select("message_id", "cursor")


@query("load_8", "SELECT n, (n * 8) // 127 AS epochs, (n * 8) % 127 AS cursor FROM range(60) AS t(n)")
def load_8(spark, d):
    return spark.createDataFrame([(n, *windows.skipped(0, n, 8, 127)) for n in range(60)], "n bigint, epochs bigint, cursor bigint")


WEIGHTS = {"code_repos": 0.2, "forum_threads": 0.35, "web_crawl": 0.35, "zero_source": 0.0, "wiki_mirror": 0.1}
_W = "w AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in sorted(WEIGHTS.items())) + ") AS v(domain, weight))"
_E = f"{_W}, e AS (SELECT domain, weight / sum(weight) OVER () AS share, sum(weight / (SELECT sum(weight) FROM w)) OVER (ORDER BY domain) AS edge FROM w)"
_DRAW = f"{_E}, u AS (SELECT k, fmod(k * 0.6180339887498949::DOUBLE, 1.0::DOUBLE) AS u FROM range(20000) AS t(k)), dr AS (SELECT k, (SELECT domain FROM e WHERE edge > u ORDER BY edge, domain LIMIT 1) AS domain FROM u)"


@query("mix_1", f"WITH {_E} SELECT domain, round(share, 6) AS share, round(edge, 6) AS edge FROM e")
def mix_1(spark, d):
    return spark.createDataFrame([(n, round(s, 6), round(e, 6)) for n, s, e in mixture.edges(WEIGHTS)], "domain string, share double, edge double")


@query("mix_3", f"WITH {_DRAW} SELECT k, domain FROM dr")
def mix_3(spark, d):
    return mixture.draws(spark, 20_000, WEIGHTS)


@query("mix_4", f"WITH {_DRAW} SELECT k, domain, row_number() OVER (PARTITION BY domain ORDER BY k) - 1 AS local_step FROM dr")
def mix_4(spark, d):
    return mixture.local_steps(mixture.draws(spark, 20_000, WEIGHTS))


@query("mix_5", f"WITH {_DRAW} SELECT w.domain, round(count(k) / 20000, 6) AS share FROM w LEFT JOIN dr ON w.domain = dr.domain GROUP BY w.domain")
def mix_5(spark, d):
    return mixture.realised(mixture.draws(spark, 20_000, WEIGHTS), WEIGHTS)


@query("mix_7", "SELECT s AS step, CASE WHEN s / 200 < 0.7 THEN 0 WHEN s / 200 < 0.9 THEN 1 ELSE 2 END::INT AS stage FROM range(260) AS t(s)")
def mix_7(spark, d):
    return spark.range(260).select(F.col("id").alias("step"), mixture.stage_of(F.col("id") / 200, [0.7, 0.9, 1.0]).cast("int").alias("stage"))


@query("perm_1", f"SELECT message_id, ({_mix('message_id')} & 9223372036854775807::UBIGINT)::BIGINT AS x FROM messages")
def perm_1(spark, d):
    """The finaliser of each id, its lower 63 bits."""

    @F.pandas_udf("bigint")
    def run(x):
        import numpy as np
        import pandas as pd

        return pd.Series((shuffle._mix_all(x.to_numpy().astype(np.uint64)) & np.uint64((1 << 63) - 1)).astype(np.int64))

    return table(spark, d, "messages").select("message_id", run("message_id").alias("x"))


@query("perm_2", "SELECT n, greatest(1, ceil(ceil(log2(n)) / 2))::INT AS half FROM range(2, 3000) AS t(n)")
def perm_2(spark, d):
    return spark.createDataFrame([(n, shuffle.half_width(n)) for n in range(2, 3000)], "n bigint, half int")


@query("load_1", f"WITH RECURSIVE s AS (SELECT i AS idx, {_SEED.replace('e + 1', '4')} AS seed FROM range(127) AS t(i)), {_perm(127, 's')} SELECT idx AS k, out AS seq_idx FROM perm")
def load_1(spark, d):
    """The whole order of epoch 3."""
    return spark.range(127).select(F.col("id").alias("k"), shuffle.permute_epochs(F.col("id"), F.lit(3), 127, 1337).alias("seq_idx"))


@query("load_3", "SELECT s AS step, r AS rank, (s % 15) * 8 + r * 4 AS first_place FROM range(50) AS t(s), range(2) AS u(r)")
def load_3(spark, d):
    plan = windows.batch_plan(spark, 127, range(50), 4, 2, 1337).where("slot = 0")
    return plan.select("step", "rank", (F.col("cursor") + F.col("rank") * 4).alias("first_place"))


@query("load_6", "SELECT s AS step, s // 15 AS epoch, ((s % 15) + 1) * 8 AS cursor, (s + 1) * 4096 AS tokens_seen, 1337::INT AS seed, true AS exact FROM range(50) AS t(s)")
def load_6(spark, d):
    """The state after each step, with one worker."""
    after = windows.states(windows.batch_plan(spark, 127, range(50), 4, 2, 1337), 8, 512, 127, 1337)
    return after.select("step", "epoch", "cursor", "tokens_seen", "seed", "exact")


LATER = {"code_repos": 0.8, "web_crawl": 0.2}


@query("mix_6", f"WITH {_DRAW}, dl AS (SELECT k, CASE WHEN u < 0.8 THEN 'code_repos' ELSE 'web_crawl' END AS domain FROM u) SELECT k, CASE WHEN k < 14000 THEN dr.domain ELSE dl.domain END AS domain FROM dr JOIN dl USING (k)")
def mix_6(spark, d):
    """Other weights from draw 14,000 on."""
    return mixture.reweighted(spark, 20_000, [(0, WEIGHTS), (14_000, LATER)])


@query("mix_8", f"WITH {_DRAW} SELECT domain, count(*) AS batches, (count(*) * 4096)::BIGINT AS tokens_seen, max(k) AS last_draw FROM dr GROUP BY domain")
def mix_8(spark, d):
    """The state of each domain's loader after all draws."""
    return mixture.state(mixture.draws(spark, 20_000, WEIGHTS), 4096)


@query("mix_8_resumed", f"WITH {_DRAW}, l AS (SELECT k, domain, row_number() OVER (PARTITION BY domain ORDER BY k) - 1 AS local_step FROM dr) SELECT k, domain, local_step FROM l WHERE k > (SELECT max(k) FROM dr WHERE k < 9000 AND domain IS NOT NULL)")
def mix_8_resumed(spark, d):
    """The draws after a state saved at draw 9,000, as if there had been no stop."""
    saved = cut(mixture.state(mixture.draws(spark, 9_000, WEIGHTS), 4096))
    return mixture.resumed(spark, saved, 20_000, WEIGHTS)


_W3 = corpus._STREAM + f", w AS (SELECT pos // {corpus.L} AS seq_idx, pos, tok FROM toks UNION ALL SELECT pos // {corpus.L} - 1, pos, tok FROM toks WHERE pos % {corpus.L} = 0 AND pos > 0), w3 AS (SELECT seq_idx, arg_min(tok, pos) AS first, sum(tok)::BIGINT AS id_sum FROM w GROUP BY seq_idx HAVING count(*) = {corpus.L + 1})"


@query("win_5", _PLAN.replace("WITH RECURSIVE ", f"WITH RECURSIVE {_W3}, pl AS (WITH RECURSIVE ", 1) + ") SELECT step, rank, slot, pl.seq_idx, first, id_sum FROM pl JOIN w3 ON w3.seq_idx = pl.seq_idx")
def win_5(spark, d):
    """The windows of a plan over the first 127, gathered."""
    plan = windows.batch_plan(spark, 127, range(50), 4, 2, 1337)
    near = corpus.byte_stream(spark, d).where(F.col("before_len") <= 127 * corpus.L)  # what lies beyond the plan's windows needn't be cut up
    got = windows.gather(plan, windows.windows(near, corpus.L, 257))
    return got.select("step", "rank", "slot", "seq_idx", F.element_at("tokens", 1).alias("first"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t).alias("id_sum"))


# The same over every window of the corpus. The recursive SQL of the permutation is too slow for these; tests hold them against a loop.
EPOCHS, BATCH, WORLD, BASE_SEED = 2, 4, 2, 1337


def corpus_windows(spark, d) -> int:
    """How many windows the documents' tokens make (win_2)."""
    return corpus.win_2(spark, d).head()[0]


def whole_plan(spark, d):
    """The plan of whole epochs over all windows; an epoch drops only what is less than a step."""
    n = corpus_windows(spark, d)
    return windows.batch_plan(spark, n, range(EPOCHS * (n // (BATCH * WORLD))), BATCH, WORLD, BASE_SEED)


@query("perm_5_all")
def perm_5_all(spark, d):
    n = corpus_windows(spark, d)
    return spark.range(n).select(F.col("id").alias("idx"), shuffle.permute(F.col("id"), n, shuffle.epoch_seed(BASE_SEED, 0)).alias("out"))


@query("perm_6_all")
def perm_6_all(spark, d):
    """A slice from the middle of the order, worked out without the rest; the domain is all windows."""
    n = corpus_windows(spark, d)
    return spark.range(n * 3 // 10, n * 4 // 10).select(F.col("id").alias("idx"), shuffle.permute(F.col("id"), n, 5).alias("out"))


@query("load_1_all")
def load_1_all(spark, d):
    n = corpus_windows(spark, d)
    return spark.range(n).select(F.col("id").alias("k"), shuffle.permute_epochs(F.col("id"), F.lit(3), n, BASE_SEED).alias("seq_idx"))


@query("load_2_all")
def load_2_all(spark, d):
    return whole_plan(spark, d).select("step", "epoch", "cursor").distinct()


@query("load_3_all")
def load_3_all(spark, d):
    plan = whole_plan(spark, d).where("slot = 0")
    return plan.select("step", "rank", (F.col("cursor") + F.col("rank") * BATCH).alias("first_place"))


@query("load_4_all")
def load_4_all(spark, d):
    return whole_plan(spark, d)


@query("load_6_all")
def load_6_all(spark, d):
    after = windows.states(whole_plan(spark, d), BATCH * WORLD, corpus.L, corpus_windows(spark, d), BASE_SEED)
    return after.select("step", "epoch", "cursor", "tokens_seen", "seed", "exact")


@query("win_5_all")
def win_5_all(spark, d):
    """All windows of the corpus, gathered in the order of whole epochs; texts meet their places before they become four bytes a token."""
    got = windows.gather(whole_plan(spark, d), windows.windows(corpus.byte_stream(spark, d), corpus.L, 257))
    return got.select("step", "rank", "slot", "seq_idx", F.element_at("tokens", 1).alias("first"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t).alias("id_sum"))
