"""Queries on metric logs, checkpoint catalogs, schedules and costs. events is read as a log: event_type is the run, value the loss."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import checkpoints as ck
from millrace.operators import planning, settings, telemetry
from millrace.plans.registry import query
from millrace.runtime import cut, small, table

_LOG = "lg AS (SELECT event_type AS run, event_id, ts, value, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step, epoch_us(ts) AS us FROM events)"
_DT = f"{_LOG}, dt AS (SELECT *, us - lag(us) OVER (PARTITION BY run ORDER BY step) AS dt FROM lg)"
_MEAN = f"{_DT}, mn AS (SELECT run, step, value, coalesce(sum(dt) OVER w // count(dt) OVER w, 0) / 1e6 AS step_time FROM dt WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"


def log(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("run"), "event_id", "ts", "value", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return telemetry.stepped(rows, "run", ["ts", "event_id"])


def timed(spark, d):
    rows = telemetry.trailing(log(spark, d), "run", 2, "__p", lambda w: F.first("us").over(w))
    rows = rows.withColumn("dt", F.when(F.col("step") > 0, F.col("us") - F.col("__p"))).drop("__p")
    rows = telemetry.trailing(rows, "run", 50, "__sum", lambda w: F.struct(F.sum("dt").over(w).alias("s"), F.count("dt").over(w).alias("n")))
    mean = F.when(F.col("__sum.n") > 0, F.expr("__sum.s div __sum.n")).otherwise(0) / 1e6  # whole microseconds
    return rows.withColumn("step_time", mean).drop("__sum")


@query("tel_1", f"WITH {_LOG} SELECT run, step, to_json({{'step': step, 'time': (us - 1704067200000000) / 1e6, 'train/loss': value}})::VARCHAR AS line FROM lg")
def tel_1(spark, d):
    seconds = (F.col("us") - 1704067200000000) / 1e6
    return log(spark, d).select("run", "step", telemetry.record(F.col("step"), seconds, {"loss": F.col("value")}).alias("line"))


@query("tel_2", f"WITH {_MEAN} SELECT run, step, step_time FROM mn")
def tel_2(spark, d):
    return timed(spark, d).select("run", "step", "step_time")


_DEVICES = [("click", "NVIDIA A100-SXM4-80GB"), ("view", "Tesla T4"), ("error", "cpu"), ("signup", "NVIDIA GeForce RTX 4090"), ("purchase", "NVIDIA L40S")]
_DEV = "dv AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _DEVICES) + ") AS v(run, device))"
_PK = "pk AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {v}::DOUBLE)" for i, (k, v) in enumerate(telemetry.PEAKS)) + ") AS v(i, key, peak))"
_PEAK = f"{_DEV}, {_PK}, dp AS (SELECT dv.run, device, arg_min(peak, i) AS peak FROM dv LEFT JOIN pk ON contains(replace(lower(device), ' ', ''), key) GROUP BY dv.run, device)"


def devices(spark):
    rows = spark.createDataFrame(_DEVICES, "run string, device string")
    return rows.withColumn("peak", telemetry.peak_tflops(F.col("device")))


@query("tel_4", f"WITH {_PEAK} SELECT run, device, peak FROM dp")
def tel_4(spark, d):
    return devices(spark)


@query("tel_3", f"WITH {_MEAN}, {_PEAK} SELECT mn.run, step, CASE WHEN peak IS NOT NULL AND step_time > 0 THEN round(524288 * 2.43e9 / step_time / (peak * 1e12) * 1000, 6) END AS mfu FROM mn JOIN dp USING (run)")
def tel_3(spark, d):
    rows = timed(spark, d).join(F.broadcast(devices(spark)), "run")  # one row per run named in the query
    used = telemetry.utilisation(F.lit(524288), 2.43e9, F.col("step_time"), F.col("peak"))
    return rows.select("run", "step", F.round(used * 1000, 6).alias("mfu"))


@query("tel_5", f"WITH {_MEAN} SELECT run, step, round(524288 / nullif(step_time, 0), 3) AS tokens_per_sec, round((3000 - step) * step_time / 3600, 5) AS eta_hours FROM mn")
def tel_5(spark, d):
    t = F.col("step_time")
    return timed(spark, d).select("run", "step", F.round(524288 / F.nullif(t, F.lit(0.0)), 3).alias("tokens_per_sec"), F.round((3000 - F.col("step")) * t / 3600, 5).alias("eta_hours"))


@query("tel_6", "SELECT o_orderkey, CASE WHEN n >= 1e9 THEN printf('%.1fB', round(n / 1e9, 1)) WHEN n >= 1e6 THEN printf('%.1fM', round(n / 1e6, 1)) WHEN n >= 1e3 THEN printf('%.1fK', round(n / 1e3, 1)) ELSE n::VARCHAR END AS n FROM (SELECT o_orderkey, o_orderkey * o_custkey AS n FROM orders)")
def tel_6(spark, d):
    return table(spark, d, "orders").select("o_orderkey", telemetry.short_number(F.col("o_orderkey") * F.col("o_custkey")).alias("n"))


@query("tel_7", f"WITH {_MEAN} SELECT run, step, printf('step %7d/%d | loss %7.4f | ppl %8.2f | lr %.2e | %6.0f ms', step, 3000, value, round(exp(least(value, 20)), 2), 0.0006::DOUBLE, round(1000 * step_time, 0)) AS line FROM mn")
def tel_7(spark, d):
    return timed(spark, d).select("run", "step", telemetry.console_line(F.col("step"), 3000, F.col("value"), F.lit(0.0006), F.col("step_time")).alias("line"))


@query("tel_8", f"WITH {_LOG} SELECT run, step, min(value) OVER (PARTITION BY run ORDER BY step) AS best FROM lg")
def tel_8(spark, d):
    return telemetry.running_min(log(spark, d), "run", "value", "best").select("run", "step", "best")


_LAST = "fin AS (SELECT event_type AS run, arg_max(value, (ts, event_id)) FILTER (user_id % 2 = 0) AS final_train, arg_max(value, (ts, event_id)) FILTER (user_id % 2 = 1 AND event_type <> 'error') AS final_val FROM events GROUP BY event_type)"


def finals(spark, d):
    even = F.col("user_id") % 2 == 0
    val = ~even & (F.col("event_type") != "error")
    rows = table(spark, d, "events").select(F.col("event_type").alias("run"), "ts", "event_id", F.when(even, F.col("value")).alias("train_loss"), F.when(val, F.col("value")).alias("val_loss"))
    return telemetry.last_losses(rows, "run", F.struct("ts", "event_id"))


@query("abl_1", f"WITH {_LAST} SELECT run, final_train, final_val FROM fin")
def abl_1(spark, d):
    return finals(spark, d)


@query("abl_2", f"WITH {_LAST} SELECT run, final_train, final_val, coalesce(printf('%+.4f', round(final_val - (SELECT final_val FROM fin WHERE run = 'view'), 4)), '-') AS delta FROM fin")
def abl_2(spark, d):
    return telemetry.against_baseline(finals(spark, d), "run", "view")


_CK = [(f"step_{s:08d}", s, s in (1, 25), s not in (7,), True) for s in range(1, 31)] + [("step_00000031.tmp", 31, False, True, True), ("notes", 32, False, True, True), ("step_00000033", 33, False, True, False)]
_CKV = "ck AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {s}::BIGINT, {str(p).lower()}, {str(m).lower()}, {str(i).lower()})" for n, s, p, m, i in _CK) + ") AS v(name, step, permanent, m, is_dir))"
_CAT = f"{_CKV}, cat AS (SELECT name, step, permanent FROM ck WHERE is_dir AND m AND starts_with(name, 'step_') AND NOT ends_with(name, '.tmp'))"


def catalog(spark):
    rows = spark.createDataFrame([(n, s, p, "{}" if m else None, i) for n, s, p, m, i in _CK], "name string, step bigint, permanent boolean, manifest string, is_dir boolean")
    return ck.listed(rows).select("name", "step", "permanent")


@query("ckpt_1", "SELECT o_orderkey, printf('step_%08d', o_orderkey) AS name, o_orderkey AS step FROM orders")
def ckpt_1(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", ck.name_for(F.col("o_orderkey")).alias("name"))
    return rows.withColumn("step", ck.step_of(F.concat(F.lit("runs/a/"), "name", F.lit("/"))))


@query("ckpt_3", f"WITH {_CAT} SELECT name, step, permanent FROM cat")
def ckpt_3(spark, d):
    return catalog(spark)


# Each checkpoint has two files of known size; those of every 6th are short, every 10th lacks one, and every 15th has another hash.
_FILES = "w AS (SELECT name, step, f AS file, step * 10 + f AS size, md5(name || f) AS sha FROM cat, (VALUES (0), (1)) AS v(f))"
_OK = f"{_CAT}, {_FILES}, ok AS (SELECT name, bool_and(NOT (step % 6 = 0 AND file = 1) AND NOT (step % 10 = 0 AND file = 0) AND step % 15 <> 0) AS ok FROM w GROUP BY name)"


def verdicts(spark):
    f = catalog(spark).withColumn("file", F.explode(F.array(F.lit(0), F.lit(1))))
    wanted = f.select("name", "file", (F.col("step") * 10 + F.col("file")).alias("size"), F.md5(F.concat("name", F.col("file").cast("string"))).alias("sha256"))
    short = (F.col("step") % 6 == 0) & (F.col("file") == 1)
    there = f.where(~((F.col("step") % 10 == 0) & (F.col("file") == 0))).select(
        "name", "file", (F.col("step") * 10 + F.col("file") - short.cast("int")).alias("size"),
        F.when(F.col("step") % 15 == 0, "other").otherwise(F.md5(F.concat("name", F.col("file").cast("string")))).alias("sha256"),
    )
    return ck.verified(wanted, there)


@query("ckpt_4", f"WITH {_OK} SELECT name, ok FROM ok")
def ckpt_4(spark, d):
    return verdicts(spark)


@query("ckpt_5", f"WITH {_OK} SELECT name, step FROM cat JOIN ok USING (name) WHERE ok ORDER BY step DESC LIMIT 1")
def ckpt_5(spark, d):
    return ck.latest(catalog(spark), verdicts(spark), "step_00000030").select("name", "step")


@query("ckpt_6", f"WITH {_CAT} SELECT name FROM (SELECT name, row_number() OVER (ORDER BY step DESC) AS n FROM cat WHERE NOT permanent AND step % 5 <> 0) WHERE n > 2")
def ckpt_6(spark, d):
    return ck.rotated_out(catalog(spark), 2, 5).select("name")


@query("ckpt_7", f"WITH {_CAT} SELECT name FROM (SELECT name, row_number() OVER (ORDER BY step DESC) AS n FROM cat WHERE NOT permanent) WHERE n > 2")
def ckpt_7(spark, d):
    return ck.pruned_from_mirror(catalog(spark), 2).select("name")


@query("ckpt_8", f"WITH {_CAT} SELECT name, permanent OR row_number() OVER (ORDER BY step) % 2 = 0 AS due FROM cat")
def ckpt_8(spark, d):
    return ck.mirrored(catalog(spark), 2)


@query("ckpt_10", "SELECT s_suppkey, 'blocks.' || s_suppkey || '.module.w' AS key FROM supplier")
def ckpt_10(spark, d):
    k = F.concat(F.lit("_orig_mod.module._orig_mod.blocks."), "s_suppkey", F.lit(".module.w"))
    return table(spark, d, "supplier").select("s_suppkey", ck.clean_key(k).alias("key"))


_SCH = {
    "wsd": "CASE WHEN s < 800 THEN 1.0 ELSE 0.1 + 0.9 * (1 - sqrt(least(1.0, (s - 800) / 200))) END",
    "cosine": "0.1 + 0.45 * (1 + cos(pi() * least(1.0, (s - 100) / 900)))",
    "linear": "1.0 - 0.9 * least(1.0, (s - 100) / 900)",
    "constant": "1.0",
}


@query("sch_1", " UNION ALL ".join(f"SELECT '{k}' AS schedule, s AS step, round(CASE WHEN s < 100 THEN (s + 1) / 100 ELSE {v} END, 6)::DOUBLE AS lr FROM range(1100) AS t(s)" for k, v in _SCH.items()))
def sch_1(spark, d):
    out = None
    for name in _SCH:
        lr = planning.learning_rate(F.col("id"), 1.0, 1000, 100, schedule=name)
        part = spark.range(1100).select(F.lit(name).alias("schedule"), F.col("id").alias("step"), F.round(lr, 6).alias("lr"))
        out = part if out is None else out.unionByName(part)
    return out


@query("sch_2", "SELECT o_orderkey, round(6e-4 * sqrt(o_custkey / 256), 9) AS lr FROM orders")
def sch_2(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(planning.batch_scaled(F.lit(6e-4), F.col("o_custkey"), F.lit(256)), 9).alias("lr"))


_CFG = [("small", 12, 768, 64, 12, 4, 2048, False, 0, 0, 0, 0, 0, 1, 4, 0, 0, 32768, True, True, 2048), ("large", 24, 1024, 64, 16, 4, 2816, False, 0, 0, 0, 0, 0, 1, 4, 1024, 6, 32768, True, True, 2048),
        ("experts", 8, 512, 64, 8, 8, 1408, True, 32, 4, 1, 256, 2, 2, 0, 512, 0, 49152, False, False, 4096),
        ("latent", 6, 640, 80, 8, 8, 1728, False, 0, 0, 0, 0, 0, 1, 0, 0, 0, 32000, True, True, 1024, "mla", 96, 128, 32, 80, 64, 0), ("latent_full_query", 6, 640, 80, 8, 8, 1728, False, 0, 0, 0, 0, 0, 1, 0, 0, 0, 32000, False, True, 1024, "mla", 0, 128, 32, 80, 64, 2),
        ("expert_heads", 7, 512, 64, 8, 4, 1408, True, 16, 2, 1, 256, 1, 3, 0, 0, 0, 32768, True, True, 2048, "gqa", 0, 0, 0, 0, 0, 3)]
_CFG = [(*r, "gqa", 0, 0, 0, 0, 0, 0) if len(r) == 21 else r for r in _CFG]
_CFG_COLS = "name n_layer d_model d_head n_head n_kv_head ffn_hidden moe n_experts n_experts_active n_shared expert_hidden moe_first_dense moe_layer_freq nope_every sliding_window global_attn_every vocab_size tied qk_norm max_seq_len attn_type q_lora_rank kv_lora_rank qk_rope_head_dim qk_nope_head_dim v_head_dim mtp_depth".split()
_CFGV = "cf AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(repr(x).lower() if isinstance(x, bool) else repr(x) for x in r) + ")" for r in _CFG) + f") AS v({', '.join(_CFG_COLS)}))"
_LAY = f"{_CFGV}, ly AS (SELECT *, moe AND layer >= moe_first_dense AND (layer - moe_first_dense) % greatest(moe_layer_freq, 1) = 0 AS ex FROM (SELECT *, unnest(range(n_layer))::INT AS layer FROM cf))"


def configs(spark):
    kinds = {"name": "string", "attn_type": "string", "moe": "boolean", "tied": "boolean", "qk_norm": "boolean"}
    return spark.createDataFrame(_CFG, ", ".join(f"{c} {kinds.get(c, 'int')}" for c in _CFG_COLS))


@query("cfg_6", f"WITH {_LAY} SELECT name, layer, ex AS is_expert, nope_every > 0 AND (layer + 1) % greatest(nope_every, 1) = 0 AS is_nope, sliding_window <= 0 OR (global_attn_every > 0 AND (layer + 1) % greatest(global_attn_every, 1) = 0) AS is_global FROM ly")
def cfg_6(spark, d):
    return planning.layers(configs(spark)).select("name", "layer", "is_expert", "is_nope", "is_global")


_MLA_Q = "CASE WHEN q_lora_rank > 0 THEN d_model * q_lora_rank + q_lora_rank * n_head * (qk_nope_head_dim + qk_rope_head_dim) ELSE d_model * n_head * (qk_nope_head_dim + qk_rope_head_dim) END"
_PARTS = f"""{_CFGV}, l0 AS (SELECT *, unnest(range(n_layer + mtp_depth))::INT AS layer FROM cf),
pt AS (SELECT name, tied, layer >= n_layer AS hd, d_model::BIGINT AS d, (vocab_size * d_model)::BIGINT AS e, moe AND layer >= moe_first_dense AND (layer - moe_first_dense) % greatest(moe_layer_freq, 1) = 0 AS ex, n_experts, n_experts_active, n_shared, expert_hidden, ffn_hidden,
CASE WHEN attn_type = 'mla' THEN {_MLA_Q} + d_model * (kv_lora_rank + qk_rope_head_dim) + kv_lora_rank * n_head * (qk_nope_head_dim + v_head_dim) + n_head * v_head_dim * d_model ELSE 2 * d_model * n_head * d_head + 2 * d_model * n_kv_head * d_head END AS w,
CASE WHEN attn_type = 'mla' THEN kv_lora_rank + q_lora_rank WHEN qk_norm THEN 2 * d_head ELSE 0 END AS g, 12 * n_head * d_head * max_seq_len AS sc FROM l0),
ff AS (SELECT *, CASE WHEN ex THEN 3 * d * expert_hidden * (n_experts + n_shared) + d * n_experts ELSE 3 * d * ffn_hidden END AS t, CASE WHEN ex THEN 3 * d * expert_hidden * (n_experts_active + n_shared) ELSE 3 * d * ffn_hidden END AS a, CASE WHEN ex THEN d * n_experts ELSE 0 END AS ro FROM pt)"""


@query("cfg_4", f"""WITH {_PARTS}, b AS (SELECT name, any_value(w + g) AS att, sum(w + g + 2 * d + t) FILTER (NOT hd) AS bl, coalesce(sum(w + g + 4 * d + 2 * d * d + t) FILTER (hd), 0) AS mt, sum(w + g + 2 * d + a) FILTER (NOT hd) AS ac,
any_value(e) AS e, any_value(tied) AS tied, any_value(d) AS d, sum(w + a + ro) AS met, coalesce(sum(2 * d * d + e) FILTER (hd), 0) AS more, sum(sc) AS sc FROM ff GROUP BY name)
SELECT name, att::BIGINT AS attention, bl::BIGINT AS blocks, mt::BIGINT AS mtp, (e + bl + mt + d + CASE WHEN tied THEN 0 ELSE e END)::BIGINT AS total, (e + ac + d + CASE WHEN tied THEN 0 ELSE e END)::BIGINT AS active, (6 * (met + more + e) + sc)::BIGINT AS flops FROM b""")
def cfg_4(spark, d):
    return planning.parameter_counts(configs(spark))


@query("cfg_7", "SELECT o_orderkey, greatest(1, (o_orderkey * 1000000) // 524288)::BIGINT AS max_steps FROM orders")
def cfg_7(spark, d):
    return table(spark, d, "orders").select("o_orderkey", planning.budget_steps(F.col("o_orderkey") * 1000000, 524288).alias("max_steps"))


@query("plan_1", "SELECT 30::BIGINT AS max_steps UNION ALL SELECT 110::BIGINT UNION ALL SELECT min(n)::BIGINT FROM range(50, 500) AS t(n) WHERE n - greatest(1, floor(n * 0.2)) >= 50")
def plan_1(spark, d):
    a = planning.fitted_steps(spark, 10, 50, 100, 10, 2.0, decay_steps=1)
    b = planning.fitted_steps(spark, 10, 0, 100, 0, 1.0, decay_steps=1)
    return a.union(b).union(planning.fitted_steps(spark, 50, 100, 100, 0, 1.0))


@query("plan_2", f"WITH {_DT} SELECT run, round(median(dt) / 1e6 + 12.5 / 50, 6) AS per_step FROM (SELECT * FROM dt QUALIFY step > max(step) OVER (PARTITION BY run) - 200) GROUP BY run")
def plan_2(spark, d):
    """Median of the last 200 step times, with the cost of an evaluation every 50 steps."""
    rows = timed(spark, d)
    last = rows.groupBy("run").agg(F.max("step").alias("last"))
    return rows.join(small(cut(last)), "run").where("step > last - 200").groupBy("run").agg(F.round(F.median("dt") / 1e6 + 12.5 / 50, 6).alias("per_step"))


@query("plan_3", "SELECT o_orderkey, greatest(1, round_even(524288 / ((o_custkey + 1) * 1024), 0))::BIGINT AS accum FROM orders")
def plan_3(spark, d):
    return table(spark, d, "orders").select("o_orderkey", planning.accumulation(F.lit(524288), (F.col("o_custkey") + 1) * 1024).alias("accum"))


@query("ckpt_2", "SELECT doc_id, strlen(text)::BIGINT AS size, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def ckpt_2(spark, d):
    """Size and hash of contents, as a manifest has them."""
    files = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return ck.manifest_files(files).withColumnRenamed("path", "doc_id")


@query("ckpt_9", f"WITH {_OK} SELECT name, step FROM cat JOIN ok USING (name) WHERE ok AND step < 29 ORDER BY step DESC LIMIT 1")
def ckpt_9(spark, d):
    """What is fetched from a mirror that has the checkpoints before step 29."""
    return ck.latest(catalog(spark).where("step < 29"), verdicts(spark), None).select("name", "step")


@query("sch_3", "SELECT s AS step, round(0.02 * (CASE WHEN s < 100 THEN (s + 1) / 100 ELSE 1 END), 6)::DOUBLE AS lr FROM range(700) AS t(s)")
def sch_3(spark, d):
    """The rate of a second group, in the ratio of the first."""
    main = planning.learning_rate(F.col("id"), 6e-4, 1000, 100)
    return spark.range(700).select(F.col("id").alias("step"), F.round(planning.group_rate(main, 6e-4, 0.02), 6).alias("lr"))


@query("plan_4", "SELECT s AS step, s + greatest(1, floor(0.2 * 1000))::BIGINT AS max_steps FROM range(500) AS t(s)")
def plan_4(spark, d):
    """An early finish at each step: the decay begins there."""
    return spark.range(500).select(F.col("id").alias("step"), planning.early_finish(F.col("id"), 1000).alias("max_steps"))


# Settings are made of orders: a priority's number and an order's status make the path, the order is the layer. Every 400th order sets the whole priority.
_SET = "st AS (SELECT o_orderkey AS layer, 'p' || left(o_orderpriority, 1) || CASE WHEN o_orderkey % 400 = 0 THEN '' ELSE '.' || o_orderstatus || '.' || (o_custkey % 40) END AS path, o_totalprice AS value FROM orders)"


@query("cfg_1", f"""WITH {_SET}, b AS (SELECT path, max(layer) AS layer, arg_max(value, layer) AS value FROM st GROUP BY path)
SELECT path, value FROM b WHERE NOT EXISTS (SELECT 1 FROM b AS o WHERE o.path <> b.path AND (starts_with(b.path, o.path || '.') AND o.layer > b.layer OR starts_with(o.path, b.path || '.') AND o.layer >= b.layer))""")
def cfg_1(spark, d):
    """Layered settings, of which the latest hold."""
    o = table(spark, d, "orders")
    inner = F.concat(F.lit("."), "o_orderstatus", F.lit("."), (F.col("o_custkey") % 40).cast("string"))
    path = F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1), F.when(F.col("o_orderkey") % 400 == 0, "").otherwise(inner))
    return settings.resolved(o.select(F.col("o_orderkey").alias("layer"), path.alias("path"), F.col("o_totalprice").alias("value")))


@query("cfg_2", "SELECT s_suppkey, 'optim.g' || s_suppkey || '.lr' AS path, s_nationkey || '=' || s_name AS value FROM supplier")
def cfg_2(spark, d):
    """Settings as they stand on a command line, read into path and value."""
    text = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "--").otherwise(""), F.lit("optim.g"), "s_suppkey", F.lit(".lr="), "s_nationkey", F.lit("="), "s_name")
    path, value = settings.override_parts(text)
    return table(spark, d, "supplier").select("s_suppkey", path.alias("path"), value.alias("value"))


_KIND = [("k0", "bool"), ("k1", "int"), ("k2", "float"), ("k3", "str")]
_RAW = [" Yes", "on", "12", "7.5", "no such", "-3", "true ", "0"]


@query("cfg_3", "WITH s AS (SELECT c_custkey, c_custkey % 6 AS k, [" + ", ".join(f"'{x}'" for x in _RAW) + """][1 + c_custkey // 6 % 8] AS v FROM customer)
SELECT c_custkey, ['bool', 'int', 'float', 'str'][1 + k] AS kind, CASE k WHEN 0 THEN (lower(trim(v)) IN ('1', 'true', 'yes', 'on'))::VARCHAR WHEN 1 THEN coalesce(CASE WHEN regexp_full_match(trim(v), '[+-]?[0-9]+') THEN try_cast(trim(v) AS BIGINT)::VARCHAR END, v)
WHEN 2 THEN coalesce(try_cast(trim(v) AS DOUBLE)::VARCHAR, v) ELSE v END AS value FROM s WHERE k < 4""")
def cfg_3(spark, d):
    """Settings as texts brought to the kinds that a schema has; those that it doesn't have are ignored."""
    known = spark.createDataFrame(_KIND, "path string, kind string")
    value = F.element_at(F.array(*map(F.lit, _RAW)), (F.expr("c_custkey div 6 % 8") + 1).cast("int"))
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("k"), F.col("c_custkey") % 6).alias("path"), value.alias("value"))
    return rows.join(known, "path").select("c_custkey", "kind", settings.coerced(F.col("value"), F.col("kind")).alias("value"))


@query("abl_3", "SELECT * FROM (VALUES " + ", ".join("('{}', {}, {})".format(run, *[f"'{x}'" for x in t.split("=", 1)] if t else ("NULL", "NULL")) for run, ts in settings.ABLATIONS for t in ts or [""]) + ") AS v(run, path, value)")
def abl_3(spark, d):
    """The runs of the study with their settings."""
    return settings.ablations(spark)
