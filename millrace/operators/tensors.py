"""Logits, losses and routing as operations on rows (row, class, logit).

A row's classes are a model's vocabulary or its experts, so windows and groups over a row are bounded by that size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _row():
    return W.partitionBy("row")


def long_logits(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(row, class, logit): a row per element of the vector, classes from 0. Null vectors and elements are left out."""
    return rows.select(F.col(id_col).alias("row"), F.posexplode(vector).alias("class", "logit")).where("logit is not null").withColumn("logit", F.col("logit").cast("double"))


def segments(tokens: DataFrame, end_id: int) -> DataFrame:
    """tokens (seq, pos, tok) with doc: the document of each position in its sequence, from 0; an end token belongs to what it ends."""
    end = (F.col("tok") == end_id).cast("int")
    before = W.partitionBy("seq").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return tokens.withColumn("doc", F.coalesce(F.sum(end).over(before), F.lit(0)).cast("int"))


def visible_from(segmented: DataFrame, window: int = 0) -> DataFrame:
    """segmented rows with first: the earliest position each may attend to. All from there up to itself are visible, so no pair is made."""
    start = F.min("pos").over(W.partitionBy("seq", "doc"))
    return segmented.withColumn("first", F.greatest(start, F.col("pos") - window + 1) if window > 0 else start)


def penalised(logits: DataFrame, seen: DataFrame, repetition: float = 1.0, frequency: float = 0.0) -> DataFrame:
    """Logits of classes seen in the row (row, class; repeats count) lowered: positive ones divided, others multiplied, then minus frequency per time."""
    counts = seen.groupBy("row", "class").agg(F.count("*").alias("__n"))
    x = F.col("logit")
    lowered = F.when(x > 0, x / repetition).otherwise(x * repetition) - frequency * F.col("__n")
    return logits.join(counts, ["row", "class"], "left").withColumn("logit", F.when(F.col("__n").isNull(), x).otherwise(lowered)).drop("__n")


def tempered(logits: DataFrame, temperature: float) -> DataFrame:
    return logits if temperature == 1.0 else logits.withColumn("logit", F.col("logit") / max(temperature, 1e-6))


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """The k largest of each row, and all equal to the k-th."""
    return logits.withColumn("__r", F.rank().over(_row().orderBy(F.desc("logit")))).where(F.col("__r") <= k).drop("__r") if k else logits


def with_probability(logits: DataFrame, name: str = "p") -> DataFrame:
    e = F.exp(F.col("logit") - F.max("logit").over(_row()))
    return logits.withColumn("__e", e).withColumn(name, F.col("__e") / F.sum("__e").over(_row())).drop("__e")


def min_p(logits: DataFrame, share: float) -> DataFrame:
    """Classes of at least share times the largest probability of the row."""
    if share <= 0:
        return logits
    rows = with_probability(logits, "__p").withColumn("__top", F.max("__p").over(_row()))
    return rows.where(F.col("__p") >= share * F.col("__top")).drop("__p", "__top")


def top_p(logits: DataFrame, mass: float) -> DataFrame:
    """The likeliest classes until their probability exceeds mass; the one that crosses it stays. Ties go by class."""
    if not 0 < mass < 1:
        return logits
    before = _row().orderBy(F.desc("logit"), "class").rowsBetween(W.unboundedPreceding, -1)
    rows = with_probability(logits, "__p").withColumn("__c", F.coalesce(F.sum("__p").over(before), F.lit(0.0)))
    return rows.where(F.col("__c") <= mass).drop("__p", "__c")


def filtered(logits: DataFrame, temperature: float = 1.0, k: int = 0, share: float = 0.0, mass: float = 1.0) -> DataFrame:
    """Temperature, then the k largest, then min-p, then nucleus."""
    return top_p(min_p(top_k(tempered(logits, temperature), k), share), mass)


def greedy(logits: DataFrame) -> DataFrame:
    """(row, class): the largest logit of each row, of equal ones the first."""
    return logits.groupBy("row").agg(F.max_by("class", F.struct("logit", -F.col("class"))).alias("class"))


def log_sum_exp(logits: DataFrame) -> DataFrame:
    """(row, lse)."""
    top = logits.withColumn("__m", F.max("logit").over(_row()))
    return top.groupBy("row").agg((F.max("__m") + F.log(F.sum(F.exp(F.col("logit") - F.col("__m"))))).alias("lse"))


def cross_entropy(logits: DataFrame, targets: DataFrame, softcap: float = 0.0, ignore: int = -100) -> DataFrame:
    """(ce, zloss, n_tokens): means over targets (row, target[, mask]) that are neither ignored nor masked, over at least one."""
    x = logits.withColumn("logit", F.tanh(F.col("logit") / softcap) * softcap) if softcap > 0 else logits
    mask = F.col("mask") if "mask" in targets.columns else F.lit(1)
    t = targets.select("row", "target", mask.alias("__w")).where((F.col("target") != ignore) & (F.col("__w") > 0))
    hit = x.join(t, (x.row == t.row) & (x["class"] == t.target)).select(x.row, "logit", "__w")
    rows = hit.join(log_sum_exp(x), "row")
    n = F.greatest(F.coalesce(F.sum("__w"), F.lit(0)), F.lit(1))
    total = lambda c: F.coalesce(F.sum(c * F.col("__w")), F.lit(0.0))
    return rows.agg((total(F.col("lse") - F.col("logit")) / n).alias("ce"), (total(F.col("lse") * F.col("lse")) / n).alias("zloss"), n.alias("n_tokens"))


def distillation(student: DataFrame, teacher: DataFrame, temperature: float = 2.0, k: int = 0, mask: DataFrame | None = None) -> DataFrame:
    """(loss): mean over rows, weighted by mask (row, mask) if there is one (weights of less than 1 together count as 1), of KL(teacher || student) at a temperature, times its square; with k, over the teacher's k largest, renormalised."""
    t = max(temperature, 1e-3)
    scale = lambda rows: rows.withColumn("logit", F.col("logit") / t)
    s = scale(student)
    s = s.join(log_sum_exp(s), "row").select("row", "class", (F.col("logit") - F.col("lse")).alias("ls"))
    q = scale(teacher)
    if k:
        q = q.withColumn("__n", F.row_number().over(_row().orderBy(F.desc("logit"), "class"))).where(F.col("__n") <= k).drop("__n")
    q = q.join(log_sum_exp(q), "row").select("row", "class", (F.col("logit") - F.col("lse")).alias("lq"))
    kl = q.join(s, ["row", "class"]).groupBy("row").agg(F.sum(F.exp("lq") * (F.col("lq") - F.col("ls"))).alias("kl"))
    if mask is None:
        return kl.agg((F.avg("kl") * t * t).alias("loss"))
    live = kl.join(mask.select("row", "mask"), "row")
    sums = live.agg(F.sum(F.col("kl") * F.col("mask")).alias("s"), F.sum("mask").alias("n"))
    return sums.select((F.coalesce("s", F.lit(0.0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1.0)) * t * t).alias("loss"))


def routed(logits: DataFrame, k: int, bias: DataFrame | None = None) -> DataFrame:
    """(row, class, weight): the k experts of highest sigmoid score plus bias, weighted by their scores; of equal ones the first."""
    rows = logits.withColumn("score", 1 / (1 + F.exp(-F.col("logit"))))
    rows = rows.join(F.broadcast(bias), "class", "left") if bias is not None else rows.withColumn("bias", F.lit(0.0))  # a row per expert
    rows = rows.withColumn("__s", F.col("score") + F.coalesce("bias", F.lit(0.0)))
    rows = rows.withColumn("__n", F.row_number().over(_row().orderBy(F.desc("__s"), "class"))).where(F.col("__n") <= k)
    return rows.select("row", "class", (F.col("score") / F.greatest(F.sum("score").over(_row()), F.lit(1e-9))).alias("weight"))


def expert_load(routes: DataFrame, n_experts: int) -> DataFrame:
    """(class, load) of all experts, unused ones with 0."""
    every = routes.sparkSession.range(n_experts).select(F.col("id").cast("int").alias("class"))
    return every.join(routes.groupBy("class").agg(F.count("*").alias("load")), "class", "left").na.fill(0, ["load"])


def load_variation(load: DataFrame) -> DataFrame:
    """(cv): sample deviation of the loads over their mean."""
    return load.agg((F.stddev_samp("load") / F.greatest(F.sum("load") / F.count("*"), F.lit(1e-9))).alias("cv"))


def bias_update(load: DataFrame, rate: float) -> DataFrame:
    """(class, delta): rate up for experts below the mean load, down for those above, nothing without load."""
    mean, total = load.agg(F.avg("load")).scalar(), load.agg(F.sum("load")).scalar()
    rows = load.withColumn("__m", mean).withColumn("__t", total)
    return rows.select("class", F.when(F.col("__t") > 0, rate * F.signum(F.col("__m") - F.col("load"))).otherwise(0.0).alias("delta"))


def combined(routes: DataFrame, outputs: DataFrame) -> DataFrame:
    """(row, value): outputs (row, class, value) of the experts a row went to, summed by weight."""
    return routes.join(outputs, ["row", "class"]).groupBy("row").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def router_losses(logits: DataFrame, routes: DataFrame, n_experts: int) -> DataFrame:
    """(zloss, aux): mean squared log-sum-exp, and experts times the sum of load share by mean score."""
    z = log_sum_exp(logits).agg(F.avg(F.col("lse") * F.col("lse")).alias("zloss"))
    prob = logits.groupBy("class").agg(F.avg(1 / (1 + F.exp(-F.col("logit")))).alias("prob"))
    load = expert_load(routes, n_experts)
    sums = load.join(prob, "class").agg(F.sum(F.col("load") * F.col("prob")).alias("s"))
    total = load.agg(F.greatest(F.sum("load"), F.lit(1))).scalar()
    return z.withColumn("aux", n_experts * sums.scalar() / total)


def norms(values: DataFrame, group: str, value: str) -> DataFrame:
    """(<group>, norm, largest, rms) of the numbers of each group."""
    v = F.col(value)
    return values.groupBy(group).agg(F.sqrt(F.sum(v * v)).alias("norm"), F.max(F.abs(v)).alias("largest"), F.sqrt(F.avg(v * v)).alias("rms"))


def acceptance(accepted: Column, proposed: Column) -> Column:
    """Share of accepted proposals, of at least one."""
    return accepted / F.greatest(proposed, F.lit(1))


def speculated(proposals: DataFrame) -> DataFrame:
    """(seq, proposed, accepted) of draft tokens (seq, pos, p_target, p_draft, u), u being uniform in [0, 1).

    A token is kept with probability min(1, p_target / p_draft), or where the draft gave it none; the first one refused ends its sequence, and
    those after it were never looked at.
    """
    kept = (F.col("p_draft") <= 0) | (F.col("u") < F.least(F.lit(1.0), F.col("p_target") / F.col("p_draft")))
    first = proposals.groupBy("seq").agg(F.min(F.when(~kept, F.col("pos"))).alias("stop"))
    seen = proposals.join(first, "seq").where(F.col("stop").isNull() | (F.col("pos") <= F.col("stop")))
    return seen.groupBy("seq").agg(F.count("*").alias("proposed"), F.sum((F.col("stop").isNull() | (F.col("pos") < F.col("stop"))).cast("bigint")).alias("accepted"))


def residual(target: DataFrame, draft: DataFrame) -> DataFrame:
    """(row, class, p): what a refused token is drawn from: the target's excess over the draft (row, class, p), or the target where it has none."""
    both = target.join(draft.select("row", "class", F.col("p").alias("q")), ["row", "class"], "left")
    rows = both.withColumn("over", F.greatest(F.col("p") - F.coalesce("q", F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("w", F.when(F.sum("over").over(_row()) > 0, F.col("over")).otherwise(F.col("p")))
    return rows.select("row", "class", (F.col("w") / F.sum("w").over(_row())).alias("p"))
