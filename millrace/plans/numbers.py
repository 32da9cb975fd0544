"""Queries on logits, losses and routing; embeddings play the logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import evaluation, tensors
from millrace.plans.registry import query
from millrace.runtime import table

_X = "x AS (SELECT vec_id AS row, unnest(range(len(embedding)))::INT AS class, unnest(embedding)::DOUBLE AS logit FROM embeddings)"
_OUT = "SELECT row, class, round(logit, 6) AS logit FROM {}"
END = 8187


def logits(spark, d):
    return tensors.long_logits(table(spark, d, "embeddings"), "vec_id", "embedding")


def shown(rows):
    return rows.select("row", "class", F.round("logit", 6).alias("logit"))


_SEG = f"""e AS (SELECT DISTINCT example_id, ids FROM examples WHERE len(ids) > 0), t AS (SELECT example_id AS seq, unnest(ids) AS tok, unnest(range(len(ids))) AS pos FROM e),
sg AS (SELECT seq, pos, tok, (sum((tok = {END})::INT) OVER (PARTITION BY seq ORDER BY pos) - (tok = {END})::INT)::INT AS doc FROM t)"""


def segmented(spark, d):
    rows = table(spark, d, "examples").where("size(ids) > 0").select("example_id", "ids").distinct()
    return tensors.segments(rows.select(F.col("example_id").alias("seq"), F.posexplode("ids").alias("pos", "tok")), END)


@query("seg_1", f"WITH {_SEG} SELECT seq, doc, count(*) AS n, min(pos)::INT AS first, max(pos)::INT AS last FROM sg GROUP BY seq, doc")
def seg_1(spark, d):
    return segmented(spark, d).groupBy("seq", "doc").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("seg_2", f"WITH {_SEG} SELECT seq, sum(v)::BIGINT AS visible FROM (SELECT seq, least(64, pos - (min(pos) OVER (PARTITION BY seq, doc)) + 1) AS v FROM sg) GROUP BY seq")
def seg_2(spark, d):
    rows = tensors.visible_from(segmented(spark, d), 64)
    return rows.groupBy("seq").agg(F.sum(F.col("pos") - F.col("first") + 1).cast("bigint").alias("visible"))


_SEEN = "sn AS (SELECT vec_id AS row, ((vec_id * 7 + i * i) % 64)::INT AS class, count(*) AS n FROM embeddings, (VALUES (0), (1), (2), (8), (64)) AS v(i) GROUP BY ALL)"


@query("log_1", f"WITH {_X}, {_SEEN} SELECT x.row, x.class, round(CASE WHEN n IS NULL THEN logit WHEN logit > 0 THEN logit / 1.3 - 0.1 * n ELSE logit * 1.3 - 0.1 * n END, 6) AS logit FROM x LEFT JOIN sn ON x.row = sn.row AND x.class = sn.class")
def log_1(spark, d):
    i = F.explode(F.array(*[F.lit(k) for k in (0, 1, 2, 8, 64)]))
    seen = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), i.alias("i")).select("row", ((F.col("row") * 7 + F.col("i") * F.col("i")) % 64).cast("int").alias("class"))
    return shown(tensors.penalised(logits(spark, d), seen, 1.3, 0.1))


@query("log_2", f"WITH {_X} " + "SELECT row, class, round(logit / 0.7, 6) AS logit FROM x")
def log_2(spark, d):
    return shown(tensors.tempered(logits(spark, d), 0.7))


_K = "k AS (SELECT * FROM x QUALIFY rank() OVER (PARTITION BY row ORDER BY logit DESC) <= 7)"


@query("log_3", f"WITH {_X}, {_K} " + _OUT.format("k"))
def log_3(spark, d):
    return shown(tensors.top_k(logits(spark, d), 7))


def _prob(name: str, source: str) -> str:
    return f"{name} AS (SELECT row, class, logit, exp(logit) / sum(exp(logit)) OVER (PARTITION BY row) AS p FROM {source})"


_MIN = "m AS (SELECT * FROM pm QUALIFY p >= 0.7 * max(p) OVER (PARTITION BY row))"


@query("log_4", f"WITH {_X}, {_prob('pm', 'x')}, {_MIN} " + _OUT.format("m"))
def log_4(spark, d):
    return shown(tensors.min_p(logits(spark, d), 0.7))


_TOP = "tp AS (SELECT * FROM pt QUALIFY coalesce(sum(p) OVER (PARTITION BY row ORDER BY logit DESC, class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 0.613)"


@query("log_5", f"WITH {_X}, {_prob('pt', 'x')}, {_TOP} " + _OUT.format("tp"))
def log_5(spark, d):
    return shown(tensors.top_p(logits(spark, d), 0.613))


@query("log_6", f"WITH x0 AS (SELECT vec_id AS row, unnest(range(len(embedding)))::INT AS class, unnest(embedding)::DOUBLE AS l FROM embeddings), x AS (SELECT row, class, l / 0.2 AS logit FROM x0), k AS (SELECT * FROM x QUALIFY rank() OVER (PARTITION BY row ORDER BY logit DESC) <= 20), {_prob('pm', 'k')}, {_MIN.replace('0.7', '0.3')}, {_prob('pt', 'm')}, {_TOP} " + _OUT.format("tp"))
def log_6(spark, d):
    return shown(tensors.filtered(logits(spark, d), 0.2, 20, 0.3, 0.613))


@query("log_7", f"WITH {_X} SELECT row, class FROM x QUALIFY row_number() OVER (PARTITION BY row ORDER BY logit DESC, class) = 1")
def log_7(spark, d):
    return tensors.greedy(logits(spark, d))


@query("loss_1", f"WITH {_X}, c AS (SELECT row, class, tanh(logit / 0.5) * 0.5 AS logit FROM x), l AS (SELECT row, ln(sum(exp(logit))) AS lse FROM c GROUP BY row), h AS (SELECT lse - logit AS ce, lse FROM c JOIN embeddings ON vec_id = row AND class = label AND label <> 3 JOIN l USING (row)) SELECT round(avg(ce), 6) AS ce, round(avg(lse * lse), 6) AS zloss, count(*) AS n_tokens FROM h")
def loss_1(spark, d):
    targets = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.when(F.col("label") == 3, -100).otherwise(F.col("label")).alias("target"))
    out = tensors.cross_entropy(logits(spark, d), targets, 0.5)
    return out.select(F.round("ce", 6).alias("ce"), F.round("zloss", 6).alias("zloss"), F.col("n_tokens").cast("bigint").alias("n_tokens"))


@query("loss_2", f"""WITH {_X}, s0 AS (SELECT row, class, logit / 2 AS z FROM x), s AS (SELECT row, class, z - ln(sum(exp(z)) OVER (PARTITION BY row)) AS ls FROM s0),
q0 AS (SELECT row - 1 AS row, class, logit / 2 AS z FROM x QUALIFY row_number() OVER (PARTITION BY row ORDER BY logit DESC, class) <= 8), q AS (SELECT row, class, z - ln(sum(exp(z)) OVER (PARTITION BY row)) AS lq FROM q0),
k AS (SELECT row, sum(exp(lq) * (lq - ls)) AS kl FROM q JOIN s USING (row, class) GROUP BY row) SELECT round(avg(kl) * 4, 6) AS loss FROM k""")
def loss_2(spark, d):
    x = logits(spark, d)
    return tensors.distillation(x, x.withColumn("row", F.col("row") - 1), 2.0, 8).select(F.round("loss", 6).alias("loss"))


@query("loss_2_masked", f"""WITH {_X}, s0 AS (SELECT row, class, logit / 3 AS z FROM x), s AS (SELECT row, class, z - ln(sum(exp(z)) OVER (PARTITION BY row)) AS ls FROM s0),
q AS (SELECT row - 1 AS row, class, ls AS lq FROM s), k AS (SELECT row, sum(exp(lq) * (lq - ls)) AS kl FROM q JOIN s USING (row, class) GROUP BY row) SELECT round(sum(kl * (row % 2)) / greatest(sum(row % 2), 1) * 9, 6) AS loss FROM k""")
def loss_2_masked(spark, d):
    """Distillation over whole distributions, in which every other row is masked out."""
    x = logits(spark, d)
    mask = x.select("row").distinct().withColumn("mask", F.col("row") % 2)
    return tensors.distillation(x, x.withColumn("row", F.col("row") - 1), 3.0, 0, mask).select(F.round("loss", 6).alias("loss"))


_RT = f"{_X}, sc AS (SELECT row, class, logit, 1 / (1 + exp(-logit)) AS s FROM x), rt0 AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY row ORDER BY s + class * 0.001 DESC, class) <= 4), rt AS (SELECT row, class, s / greatest(sum(s) OVER (PARTITION BY row), 1e-9) AS weight FROM rt0)"


def routes(spark, d):
    bias = spark.range(64).select(F.col("id").cast("int").alias("class"), (F.col("id") * 0.001).alias("bias"))
    return tensors.routed(logits(spark, d), 4, bias)


@query("moe_1", f"WITH {_RT} SELECT row, class, round(weight, 6) AS weight FROM rt")
def moe_1(spark, d):
    return routes(spark, d).select("row", "class", F.round("weight", 6).alias("weight"))


_LD = f"{_RT}, ld AS (SELECT i::INT AS class, count(rt.row) AS load FROM range(70) AS t(i) LEFT JOIN rt ON rt.class = i GROUP BY i)"


@query("moe_2", f"WITH {_LD} SELECT class, load FROM ld")
def moe_2(spark, d):
    return tensors.expert_load(routes(spark, d), 70)


@query("moe_2_cv", f"WITH {_LD} SELECT round(stddev_samp(load) / avg(load), 6) AS cv FROM ld")
def moe_2_cv(spark, d):
    return tensors.load_variation(tensors.expert_load(routes(spark, d), 70)).select(F.round("cv", 6).alias("cv"))


@query("moe_3", f"WITH {_LD} SELECT class, 0.001 * sign((SELECT avg(load) FROM ld) - load) AS delta FROM ld".replace("0.001 * sign", "0.001::DOUBLE * sign"))
def moe_3(spark, d):
    return tensors.bias_update(tensors.expert_load(routes(spark, d), 70), 0.001)


@query("moe_4", f"WITH {_RT} SELECT rt.row, round(sum(weight * logit * 2), 6) AS value FROM rt JOIN x ON rt.row = x.row AND rt.class = x.class GROUP BY rt.row")
def moe_4(spark, d):
    outputs = logits(spark, d).select("row", "class", (F.col("logit") * 2).alias("value"))
    return tensors.combined(routes(spark, d), outputs).select("row", F.round("value", 6).alias("value"))


@query("moe_5", f"WITH {_RT}, z AS (SELECT avg(power(l, 2)) AS z FROM (SELECT ln(sum(exp(logit))) AS l FROM x GROUP BY row)), pb AS (SELECT class, avg(s) AS prob FROM sc GROUP BY class), c AS (SELECT class, count(*) AS n FROM rt GROUP BY class) SELECT round(any_value(z), 6) AS zloss, round(64 * sum(n / (SELECT count(*) FROM rt) * prob), 6) AS aux FROM c JOIN pb USING (class), z")
def moe_5(spark, d):
    out = tensors.router_losses(logits(spark, d), routes(spark, d), 64)
    return out.select(F.round("zloss", 6).alias("zloss"), F.round("aux", 6).alias("aux"))


@query("stat_1", "WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, round(sqrt(sum(v * v)), 6) AS norm, round(max(abs(v)), 6) AS largest, round(sqrt(avg(v * v)), 6) AS rms FROM u GROUP BY label")
def stat_1(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    return tensors.norms(rows, "label", "v").select("label", *[F.round(c, 6).alias(c) for c in ("norm", "largest", "rms")])


@query("spec_1", "SELECT run, round(sum(is_greedy::INT) / greatest(count(*), 1), 6) AS rate FROM (SELECT DISTINCT run, item_id, choice_index, is_greedy FROM eval_scores WHERE run IS NOT NULL AND logprob IS NOT NULL AND NOT isnan(logprob)) GROUP BY run")
def spec_1(spark, d):
    by = evaluation.valid_scores(table(spark, d, "eval_scores")).groupBy("run").agg(F.sum(F.col("is_greedy").cast("int")).alias("a"), F.count("*").alias("n"))
    return by.select("run", F.round(tensors.acceptance(F.col("a"), F.col("n")), 6).alias("rate"))


_PROP = "pr AS (SELECT DISTINCT run || '/' || item_id AS seq, choice_index AS pos, exp(least(logprob, 0) / greatest(n_tokens, 1)) AS pt, 1.0::DOUBLE / (2 + choice_index) AS pd, ((item_id * 37 + choice_index * 17) % 100) / 100 AS u FROM eval_scores WHERE run IS NOT NULL AND logprob IS NOT NULL AND NOT isnan(logprob))"


@query("spec_1_rule", f"WITH {_PROP}, j AS (SELECT *, NOT (pd <= 0 OR u < least(1.0, pt / pd)) AS refused FROM pr), s AS (SELECT seq, min(pos) FILTER (refused) AS stop FROM j GROUP BY seq) SELECT j.seq, count(*) AS proposed, sum((stop IS NULL OR pos < stop)::BIGINT)::BIGINT AS accepted FROM j JOIN s ON j.seq = s.seq WHERE stop IS NULL OR pos <= stop GROUP BY j.seq")
def spec_1_rule(spark, d):
    """Scored choices taken as drafts of a sequence a run and item."""
    v = evaluation.valid_scores(table(spark, d, "eval_scores"))
    rows = v.select(F.concat("run", F.lit("/"), "item_id").alias("seq"), F.col("choice_index").alias("pos"), F.exp(F.least("logprob", F.lit(0.0)) / F.greatest("n_tokens", F.lit(1))).alias("p_target"),
                    (1 / (2 + F.col("choice_index"))).alias("p_draft"), ((F.col("item_id") * 37 + F.col("choice_index") * 17) % 100 / 100).alias("u"))
    return tensors.speculated(rows)


@query("spec_1_residual", f"WITH {_X}, p AS (SELECT row, class, exp(logit) / sum(exp(logit)) OVER (PARTITION BY row) AS p FROM x), b AS (SELECT p.row, p.class, p.p, greatest(p.p - coalesce(q.p, 0), 0) AS o FROM p LEFT JOIN p AS q ON q.row = p.row + 1 AND q.class = p.class), w AS (SELECT row, class, CASE WHEN sum(o) OVER (PARTITION BY row) > 0 THEN o ELSE p END AS w FROM b) SELECT row, class, round(w / sum(w) OVER (PARTITION BY row), 6) AS p FROM w")
def spec_1_residual(spark, d):
    """Each row's distribution as the target, the next row's as the draft."""
    x = logits(spark, d)
    p = x.join(tensors.log_sum_exp(x), "row").select("row", "class", F.exp(F.col("logit") - F.col("lse")).alias("p"))
    return tensors.residual(p, p.withColumn("row", F.col("row") - 1)).withColumn("p", F.round("p", 6))
