import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import bpe
from millrace.operators import chat, checkpoints, corpus, evaluation, mixture, planning, telemetry, tensors, windows
from millrace.operators.order import positioned, restarting_groups
from millrace.sources import shards, text
from millrace.streaming import incremental as inc

BYTES = bpe.Vocabulary([], ["<|endoftext|>", "<|pad|>", "<|system|>", "<|user|>", "<|assistant|>"])


def sequential(lengths, size, rule):
    out, grp, run = [], 0, 0
    for n in lengths:
        if rule == "pack" and run and run + n > size:
            grp, run = grp + 1, 0
        out.append(grp)
        run += n
        if rule == "roll" and run >= size:
            grp, run = grp + 1, 0
    return out


@pytest.mark.parametrize("rule", ["roll", "pack"])
@pytest.mark.parametrize("size", [90, 400, 5000, 10**6])
def test_restarting_groups_equal_a_loop(spark, rule, size):
    rng = random.Random(size)
    lengths = [rng.choice([1, 2, 5, 30, 90]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lengths)), "id bigint, len bigint").repartition(7)
    at = positioned(df, ["id"], ["len"])
    got = dict(map(tuple, restarting_groups(at, size, rule).collect()))
    assert [got[k] for k in sorted(got)] == sequential(lengths, size, rule)


def test_positions(spark):
    df = spark.createDataFrame([(3, 5), (1, None), (2, 7), (None, 1)], "id bigint, n bigint")
    assert sorted((r.ord, r.id, r.before_n) for r in positioned(df, ["id"], ["n"]).collect()) == [(1, None, 0), (2, 1, 1), (3, 2, 1), (4, 3, 8)]
    assert positioned(df.limit(0), ["id"], ["n"]).count() == 0


def test_corpus_sources(spark, tmp_path):
    d = tmp_path / "mixed"
    d.mkdir()
    (d / "b.jsonl").write_text('{"text": "one"}\n\nbroken {\n{"text": ""}\n{"other": 1}\n"plain"\ntrue\n12\n{"text": 5} x\n{"text": "two"}\n')
    (d / "a.txt").write_bytes(b"line\r\nbad \xff byte")
    (d / "c.txt.gz").write_bytes(gzip.compress("zipped".encode()))
    (d / "skip.bin").write_bytes(b"x")
    (d / "index.json").write_text('{"text": "not read"}')
    spark.createDataFrame([("p",), (None,), ("",), (" ",)], "text string").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    got = [r.text for r in text.read_corpus(spark, str(d)).orderBy("path", "pos").collect()]
    assert got == ["line\nbad � byte", "one", "plain", "True", "12", "two", "zipped"]
    assert sorted(r.text for r in text.read_corpus(spark, str(tmp_path / "t.parquet")).collect()) == [" ", "p"]
    assert text.read_corpus(spark, str(d), limit=2).count() == 2
    (tmp_path / "e.txt").write_text("")
    assert [r.text for r in text.read_corpus(spark, str(tmp_path / "e.txt")).collect()] == [""]
    (tmp_path / "s.txt").write_text("one\n\n \n\ntwo\nlines")
    assert [r.text for r in text.read_corpus(spark, str(tmp_path / "s.txt"), split_blank=True).orderBy("pos").collect()] == ["one\n\n", "two\nlines\n\n"]
    assert text.is_json_path("x.jsonl.gz") and not text.is_json_path("x.json.gz")
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nbroken\n')
    assert text.json_rows(spark, str(tmp_path / "bad.jsonl"), "a int", 3).count() == 2
    with pytest.raises(Exception):
        text.json_rows(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_hub_spec():
    assert text.hub_spec("hf://a/b@c:d") == text.HubSpec("a/b", "c", "d") and text.hub_spec("hf://a/b") == text.HubSpec("a/b", None, "train")
    with pytest.raises(ValueError):
        text.hub_spec("file:///x")


def test_windows_of_the_corpus(spark):
    docs = spark.createDataFrame([(k,) for k in range(400)], "tok int").select("tok", F.col("tok").alias("ord"))
    parts = [list(range(a, min(a + 37, 400))) for a in range(0, 400, 37)]
    df = spark.createDataFrame([(p, p[0]) for p in parts] + [([], 5)], "ids array<int>, before_len bigint")
    got = {r.seq_idx: r.tokens for r in windows.windows(df, 64).collect()}
    assert got == {k: list(range(64 * k, 64 * k + 65)) for k in range(6)} and docs.count() == 400
    assert {r.chunk: r.tokens for r in windows.chunks(df, 150).collect()} == {0: list(range(150)), 1: list(range(150, 300)), 2: list(range(300, 400))}
    assert windows.sequence_count(4096, 128) == 31
    with pytest.raises(ValueError):
        windows.sequence_count(64, 1024)


def test_plan_does_not_depend_on_ranks(spark):
    one = windows.batch_plan(spark, 127, range(40), 8, 1, 3).collect()
    two = windows.batch_plan(spark, 127, range(40), 4, 2, 3).collect()
    assert sorted((r.step, r.slot, r.seq_idx) for r in one) == sorted((r.step, r.rank * 4 + r.slot, r.seq_idx) for r in two)
    first = [r.seq_idx for r in one if r.epoch == 0]
    assert len(set(first)) == len(first) == 120
    late = windows.batch_plan(spark, 127, range(20, 40), 8, 1, 3).collect()
    assert sorted(late) == sorted(r for r in one if r.step >= 20)
    assert windows.skipped(0, 16, 8, 127) == (1, 1)
    with pytest.raises(ValueError):
        windows.batch_plan(spark, 7, range(1), 8, 1, 3)


def test_mixture(spark):
    drawn = mixture.draws(spark, 10_000, {"a": 0.8, "b": 0.2, "z": 0.0})
    share = dict(map(tuple, mixture.realised(drawn, {"a": 0.8, "b": 0.2, "z": 0.0}).collect()))
    assert abs(share["a"] - 0.8) < 0.01 and share["z"] == 0
    with pytest.raises(ValueError):
        mixture.edges({"a": 0.0})
    steps = spark.createDataFrame([(s,) for s in (0, 69, 70, 95, 200)], "s int").select(mixture.stage_of(F.col("s") / 100, [0.7, 0.9, 1.0]).alias("g"))
    assert [r.g for r in steps.collect()] == [0, 0, 1, 2, 2]


@pytest.mark.parametrize("rule,size", [("roll", 40), ("pack", 40), ("roll", 900), ("pack", 5000), ("roll", 100_000)])
def test_summaries_in_levels_equal_a_loop(spark, rule, size):
    rng = random.Random(size)
    lengths = [rng.choice([1, 3, 9, 60] if rule == "pack" else [0, 1, 3, 9, 60]) for _ in range(1500)]
    keys = sorted(rng.choice("aab") for _ in lengths)
    df = spark.createDataFrame([(k, key, n) for k, (key, n) in enumerate(zip(keys, lengths))], "id bigint, key string, len bigint")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    at = positioned(df, ["key", "id"], ["len"])
    got = {(r.key, r.ord): r.grp for r in restarting_groups(at, size, rule, "key", fan=2).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = [g for key in "ab" for g in sequential([n for k, n in zip(keys, lengths) if k == key], size, rule)]
    assert [got[k] for k in sorted(got)] == want


def test_shards_round_trip(spark, tmp_path):
    tokens = spark.createDataFrame([(0, 1, [1, 2, 3]), (0, 2, []), (0, 3, [4]), (1, 4, [5, 6])], "grp bigint, ord bigint, ids array<int>")
    out = str(tmp_path / "s")
    index = shards.write_shards(tokens, out, 300)
    shards.write_index(spark, out, index, 300, {"eos_id": 0})
    got = {r.shard: (r.ids, r.doc_starts) for r in shards.read_shards(spark, out).collect()}
    assert got == {"shard_00000.bin": ([1, 2, 3, 4], [0, 3]), "shard_00001.bin": ([5, 6], [0])}
    assert shards.discover(spark, out) == ["shard_00000.bin", "shard_00001.bin"]
    meta = json.loads((tmp_path / "s" / "index.json").read_text())
    assert meta["n_tokens"] == 6 and meta["eos_id"] == 0 and [r.n_docs for r in shards.read_index(spark, out + "/index.json").orderBy("ord").collect()] == [2, 1]
    shards.mirror(spark, out, str(tmp_path / "copy"))
    (tmp_path / "copy" / "shard_00000.docs").unlink()
    assert {r.shard: r.doc_starts for r in shards.read_shards(spark, str(tmp_path / "copy")).collect()}["shard_00000.bin"] == []
    assert not list((tmp_path / "s").glob("*.tmp"))


def test_shard_header():
    data, starts = shards.shard_bytes([[1] * 10, [2] * 20, [3] * 5, []], 70_000)
    assert shards.unpack_header(data) == {"dtype": "uint32", "n_tokens": 35, "vocab_size": 70_000, "n_docs": 3} and len(data) == 1024 + 140
    assert [int.from_bytes(starts[k : k + 8], "little") for k in (0, 8, 16)] == [0, 10, 30]
    with pytest.raises(ValueError):
        shards.shard_bytes([[300]], 300)
    with pytest.raises(ValueError):
        shards.unpack_header(b"x" * 64)
    assert shards.dtype_name(65536) == "uint16" and shards.dtype_name(65537) == "uint32"


def test_preparing_a_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(k, "x" * (k % 9)) for k in range(60)] + [(99, None)], "doc_id bigint, text string")
    train, val = str(tmp_path / "train"), str(tmp_path / "val")
    out = corpus.prepare(docs, BYTES, train, val, 50, 0.25)
    used = [(k, k % 9) for k in range(60) if k % 9]
    want = [n + 1 for i, (_, n) in enumerate(used, 1) if i % 4]
    assert out["tokens"] == sum(want) and out["docs"] == len(used) and out["shards"] == sequential(want, 50, "roll")[-1] + 1
    meta = json.loads((tmp_path / "val" / "index.json").read_text())
    assert meta["n_documents"] == len(used) and abs(meta["bytes_per_token"] - sum(n for _, n in used) / (sum(n for _, n in used) + len(used))) < 1e-9
    with pytest.raises(ZeroDivisionError):
        corpus.prepare(docs, BYTES, train, val, 50, 0.0)
    assert corpus.every_kth(0.07) == 14 and corpus.every_kth(0.3) == 3


def test_records(spark):
    lines = [
        '{"messages": [{"role": "user", "content": "q"}, {"role": "x", "content": "y"}, {"role": "assistant", "content": ""}]}',
        '{"messages": [], "prompt": "p", "response": "r"}',
        '{"instruction": "i", "input": "in", "output": "", "response": "r"}',
        '{"instruction": "i", "prompt": "p", "answer": "a"}',
        '{"question": "q", "completion": "c"}',
        '{"prompt": "p"}', "not json", "", '{"prompt": "p", "response": "r"} x', "[1]",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    got = {r.n: r.messages and [(m.role, m.content) for m in r.messages] for r in chat.parse_records(df).collect()}
    assert got == {0: [("user", "q")], 1: None, 2: [("user", "i\n\nin"), ("assistant", "r")], 3: None, 4: [("user", "q"), ("assistant", "c")], **{k: None for k in range(5, 10)}}


def test_examples_and_packing(spark):
    m = spark.createDataFrame([(1, 1, "User", "ab"), (1, 2, "assistant", "c"), (1, 2, "assistant", "c"), (1, 3, None, "x"), (2, 1, "system", "s"), (3, 1, "user", None)], "conv_id int, turn int, role string, content string")
    ex = {r.conv_id: (r.ids, r.mask) for r in chat.encode_examples(chat.conversations(m), BYTES).collect()}
    s = BYTES.specials
    assert ex == {1: ([s["<|user|>"], 97, 98, s["<|assistant|>"], 99, s["<|endoftext|>"]], [0, 0, 0, 0, 1, 1]), 2: ([s["<|system|>"], 115], [0, 0])}
    with pytest.raises(ValueError):
        chat.encode_examples(chat.conversations(m), bpe.Vocabulary([], ["<|endoftext|>"]))
    rows = [(k, list(range(n)), [1] * n) for k, n in enumerate([5, 5, 3, 20, 1])] + [(8, None, None), (9, [1, 2], None), (10, [7], [])]
    df = spark.createDataFrame(rows, "o int, ids array<int>, mask array<tinyint>")
    got = sorted((r.window_id, r.ids, r.mask) for r in chat.pack(df, 9, -1, "o").collect())
    assert [len(x[1]) for x in got] == [10] * len(got) and all(m == 0 for _, i, ms in got for t, m in zip(i, ms) if t == -1)
    assert [x[1] for x in got] == [list(range(5)) * 2, [0, 1, 2] + [-1] * 7, list(range(10)), [0, 1, 2, 7] + [-1] * 6]
    assert len(chat.pack(df, 9, -1, "o", drop_long=True).collect()) == 2
    assert chat.pack(df.limit(0), 9, -1, "o").count() == 0


def test_scores(spark):
    items = spark.createDataFrame([(1, "c", [" a", " b"], "T", 1), (2, "c", [" w"], "one", 0), (3, "c", [" a", " b"], "t", None), (4, "c", [" a", " b"], "t", 0)], "item_id bigint, context string, choices array<string>, task string, gold int")
    rows = [("r", 1, 0, -2.0, 1, 1, False), ("r", 1, 1, -2.0, 1, 2, False), ("r", 2, 0, -1.0, 1, 2, True), ("r", 3, 0, -1.0, 1, 1, True), ("r", 3, 1, -3.0, 1, 1, True), ("r", 4, 0, float("nan"), 1, 1, True), ("r", 4, 1, -1.0, 1, 1, True)]
    s = spark.createDataFrame(rows + rows[:2], "run string, item_id bigint, choice_index int, logprob double, n_tokens int, n_chars int, is_greedy boolean")
    got = {r.task: r for r in evaluation.accuracy(evaluation.judged(items, s)).collect()}
    assert (got["t"].n, got["t"].acc, got["t"].acc_norm, got["t"].random_baseline) == (2, 0.0, 0.5, 0.5)
    assert (got["one"].n, got["one"].acc, got["one"].random_baseline) == (1, 1.0, 0.0)
    assert evaluation.accuracy(evaluation.judged(items.limit(0), s)).count() == 0
    lines = [r.line for r in evaluation.report(evaluation.accuracy(evaluation.judged(items, s)), "acc_norm").orderBy("ord", "task").collect()]
    assert lines == ["| one | 1 | 100.00 | 0.00 |", "| t | 2 | 50.00 | 50.00 |", "| **average** | | **75.00** | |"]


def test_tensor_goldens(spark):
    seq = spark.createDataFrame([(0, k, t) for k, t in enumerate([5, 6, 0, 7, 8, 0, 9])], "seq int, pos int, tok int")
    got = tensors.segments(seq, 0).orderBy("pos").collect()
    assert [r.doc for r in got] == [0, 0, 0, 1, 1, 1, 2]
    four = spark.createDataFrame([(0, k, 5) for k in range(4)], "seq int, pos int, tok int")
    rows = tensors.visible_from(tensors.segments(four, 0), 2).orderBy("pos").collect()
    assert [[int(r["first"] <= k <= r.pos) for k in range(4)] for r in rows] == [[1, 0, 0, 0], [1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 1]]
    import math

    p = spark.createDataFrame([(0, [math.log(x) for x in (0.8, 0.1, 0.05, 0.05)])], "id int, v array<double>")
    assert [r["class"] for r in tensors.min_p(tensors.long_logits(p, "id", "v"), 0.2).collect()] == [0]
    n = spark.createDataFrame([(0, [math.log(x) for x in (0.5, 0.25, 0.15, 0.06, 0.04)])], "id int, v array<double>")
    assert tensors.top_p(tensors.long_logits(n, "id", "v"), 0.88).count() == 3
    tie = spark.createDataFrame([(0, [1.0, 3.0, 3.0, 0.0, None])], "id int, v array<double>")
    x = tensors.long_logits(tie, "id", "v")
    assert tensors.top_k(x, 1).count() == 2 and tensors.greedy(x).head()["class"] == 1
    ones = spark.createDataFrame([(0, [1.0] * 10)], "id int, v array<double>")
    seen = spark.createDataFrame([(0, 3), (0, 3), (0, 7)], "row int, class int")
    low = {r["class"]: r.logit for r in tensors.penalised(tensors.long_logits(ones, "id", "v"), seen, 2.0, 0.25).collect()}
    assert low[3] == 0.0 and low[7] == 0.25 and low[5] == 1.0
    assert tensors.greedy(x.limit(0)).count() == 0


def test_planning(spark):
    assert planning.fitted_steps(spark, 10, 0, 100, 0, 1.0).head()[0] == 110
    assert planning.fitted_steps(spark, 10, 50, 100, 10, 2.0).head()[0] == 30
    with pytest.raises(ValueError):
        planning.learning_rate(F.lit(1), 1.0, 10, schedule="nope")
    assert planning.overrides(["--a.b=3e-4", "c=[1, 2]", "d=x"]) == {"a": {"b": 3e-4}, "c": [1, 2], "d": "x"}
    with pytest.raises(ValueError):
        planning.overrides(["a"])
    assert planning.deep_merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": {"e": 1}}) == {"a": {"b": 9, "c": 2}, "d": {"e": 1}}


def test_layered_files(tmp_path):
    (tmp_path / "base.yaml").write_text("a: {b: 1, c: 2}\n")
    (tmp_path / "top.yaml").write_text("_base_: base.yaml\na: {b: 5}\n")
    (tmp_path / "loop.yaml").write_text("_base_: loop.yaml\n")
    assert planning.load_layers(str(tmp_path / "top.yaml")) == {"a": {"b": 5, "c": 2}}
    with pytest.raises(ValueError):
        planning.load_layers(str(tmp_path / "loop.yaml"))


def test_telemetry(spark):
    df = spark.createDataFrame([(n,) for n in (999, 1000, 1_500_000, 2_000_000_000)], "n bigint").select(telemetry.short_number(F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == ["999", "1.0K", "1.5M", "2.0B"]
    rec = spark.range(1).select(telemetry.record(F.lit(1), F.lit(0.5), {"loss": F.lit("x"), "lr": F.lit("3")}).alias("r")).head().r
    assert rec == '{"step":1,"time":0.5,"train/loss":"NaN","train/lr":3.0}' or json.loads(rec.replace("NaN", "null").replace('"null"', "null"))["train/lr"] == 3.0
    rows = spark.createDataFrame([("a", k, float(k)) for k in range(9000)], "run string, step bigint, v double")
    got = telemetry.trailing(rows, "run", 3, "m", lambda w: F.sum("v").over(w)).where("step in (0, 1, 4096, 8999)").orderBy("step").collect()
    assert [r.m for r in got] == [0.0, 1.0, 4096 * 3 - 3.0, 8999 * 3 - 3.0]


def test_checkpoints(spark):
    assert spark.range(1).select(checkpoints.clean_key(F.lit("_orig_mod.module.blocks.0.attn.wo.weight"))).head()[0] == "blocks.0.attn.wo.weight"
    c = spark.createDataFrame([(f"step_{s:08d}", s, s == 1) for s in range(1, 13)], "name string, step bigint, permanent boolean")
    gone = {r.step for r in checkpoints.rotated_out(c, 2, 5).collect()}
    assert set(range(1, 13)) - gone == {1, 5, 10, 11, 12}
    w = spark.createDataFrame([("a", "f", 3, "h"), ("b", "f", 3, "h"), ("b", "g", 1, None), ("c", None, None, None)], "name string, file string, size bigint, sha256 string")
    t = spark.createDataFrame([("a", "f", 3, "h"), ("b", "f", 3, "h"), ("b", "g", 2, "z")], "name string, file string, size bigint, sha256 string")
    assert dict(map(tuple, checkpoints.verified(w, t).collect())) == {"a": True, "b": False, "c": True}
    assert checkpoints.pruned_from_mirror(c, 0).count() == 0


def test_decoding_as_tokens_come():
    for s in ("naïve 日本 🙂 end", "plain", ""):
        assert "".join(inc.decode_chunks(list(s.encode()), BYTES)) == s
    assert inc.decode_chunks([0xE6, 0x97], BYTES) == ["�"] and inc.decode_chunks([0xFF, 97], BYTES) == ["�", "a"]
    assert len(inc.decode_chunks(list("日".encode()), BYTES)) == 1


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    docs = lambda a, b: spark.createDataFrame([(k, "x" * k) for k in range(a, b)], "doc_id bigint, text string")
    docs(0, 5).write.parquet(str(folder / "documents.parquet"))
    assert inc.prepare_incrementally(inc.table_stream(spark, str(folder), "documents"), state).count() == 4
    docs(5, 9).write.mode("append").parquet(str(folder / "documents.parquet"))
    assert sorted(r.n_tokens for r in inc.prepare_incrementally(inc.table_stream(spark, str(folder), "documents"), state).collect()) == list(range(2, 10))


def test_tasks_by_name(spark):
    from millrace.operators import tasks

    raw = spark.createDataFrame([("q", ["A", "B"], [" x ", "y"], "B", 1), ("r", ["1", "2"], ["x", "y"], "C", 2)], "question string, label array<string>, text array<string>, answerKey string, item int")
    raw = raw.select("question", F.struct("label", "text").alias("choices"), "answerKey", "item")
    got = {r.item: (r.choices, r.gold) for r in tasks.load("arc_easy", raw).collect()}
    assert got == {1: ([" x", " y"], 1), 2: ([" x", " y"], 0)}
    assert tasks.load("arc_easy", raw, 1, ["item"]).count() == 1 and tasks.load("sanity").count() == 3
    with pytest.raises(KeyError):
        tasks.load("nope", raw)
    lines = spark.createDataFrame([("the  last word \n",), ("one",)], "text string")
    assert [(r.context, r.choices) for r in tasks.load("lambada", lines).collect()] == [("the  last", [" word"]), ("", [" one"])]


def test_settings_as_rows(spark):
    from millrace.operators import settings

    rows = spark.createDataFrame([(1, "a.b", "1"), (1, "a.c", "2"), (2, "a.b", "3"), (3, "d", "x"), (4, "d.e", "y"), (1, "f.g", "z"), (5, "f", "w"), (None, "h", "v"), (1, None, "v")], "layer int, path string, value string")
    assert dict(map(tuple, settings.resolved(rows).collect())) == {"a.b": "3", "a.c": "2", "d.e": "y", "f": "w"}
    assert settings.deep_merge({"a": {"b": 1}, "c": 2}, {"a": 5, "c": {"d": 1}, "e": {}}) == {"a": 5, "c": {"d": 1}, "e": {}}
    assert settings.deep_merge({"a": {"b": 1}}, {"a": {}}) == {"a": {"b": 1}}
    assert settings.nested(settings.stacked(settings.leaves(settings.overrides(t)) for _, t in settings.ABLATIONS))["model"]["n_experts"] == 16


def test_counts_of_a_published_size(spark):
    from millrace.operators import planning

    cols = "name n_layer d_model d_head n_head n_kv_head ffn_hidden moe n_experts n_experts_active n_shared expert_hidden moe_first_dense moe_layer_freq nope_every sliding_window global_attn_every vocab_size tied qk_norm max_seq_len mtp_depth".split()
    row = ("300m", 24, 1024, None, 16, 4, None, False, 0, 0, 0, None, 0, 1, 4, 0, 0, 32768, True, True, 2048, 1)
    kinds = {"name": "string", "moe": "boolean", "tied": "boolean", "qk_norm": "boolean"}
    r = planning.parameter_counts(spark.createDataFrame([row], ", ".join(f"{c} {kinds.get(c, 'int')}" for c in cols))).head()
    assert (r.total, r.active) == (317_513_856, 304_140_288)


def test_shards_are_read_in_blocks(spark, tmp_path):
    docs = [(0, k, list(range(k, k + n))) for k, n in enumerate([5, 7, 1, 30, 2])] + [(1, 9, [1, 2, 3])]
    path = str(tmp_path / "s")
    shards.write_shards(spark.createDataFrame(docs, "grp bigint, ord bigint, ids array<int>"), path, 70_000).count()
    (tmp_path / "s" / "shard_00001.docs").unlink()
    flat = [x for g, _, d in docs if g == 0 for x in d]
    for block in (4, 10, 1000):
        got = sorted((r.shard, r.start, r.ids, r.doc_starts) for r in shards.read_blocks(spark, path, block).collect())
        own = [r for r in got if r[0] == "shard_00000.bin"]
        assert [x for r in own for x in r[2]] == flat and all(len(r[2]) <= block for r in own)
        assert [x for r in own for x in r[3]] == [0, 5, 12, 13, 43] and all(r[1] <= x < r[1] + len(r[2]) for r in own for x in r[3])
        assert [x for r in got if r[0] != "shard_00000.bin" for x in r[2]] == [1, 2, 3]


def test_following_a_log_in_tiers(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    want = {}
    for k in range(7):
        rows = [(f"u{(k * 3 + j) % 5}", k * 10 + j, float(k + j)) for j in range(4)]
        want |= {u: v for u, _, v in rows}
        spark.createDataFrame(rows, "u string, t int, v double").coalesce(1).write.mode("append").parquet(str(folder / "log.parquet"))
        got = inc.follow_log(inc.table_stream(spark, str(folder), "log"), state, ["u"], ["t"], "v", fan=2)
        assert dict(map(tuple, got.collect())) == want
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("table-")]) <= 6


def test_resuming_a_mixture(spark):
    w = {"a": 0.6, "b": 0.4}
    whole = {r.k: (r.domain, r.local_step) for r in mixture.local_steps(mixture.draws(spark, 500, w)).collect()}
    saved = mixture.state(mixture.draws(spark, 200, w), 8)
    rest = {r.k: (r.domain, r.local_step) for r in mixture.resumed(spark, saved, 500, w).collect()}
    assert rest == {k: v for k, v in whole.items() if k >= 200}
    changed = mixture.reweighted(spark, 300, [(100, {"z": 1.0}), (0, w)]).collect()
    assert {r.domain for r in changed if r.k >= 100} == {"z"} and [r.domain for r in sorted(changed) if r.k < 100] == [whole[k][0] for k in range(100)]


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace as N

    from millrace import runtime

    fake = N(conf=N(get=lambda *_: None), sparkContext=N(master="yarn", applicationId="x", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isEmpty=lambda: True)))))
    with pytest.raises(RuntimeError):
        runtime.shared_dir(fake)


def test_samples_read_some_files_only(spark, tmp_path):
    from millrace.runtime import some_files

    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 12).write.parquet(path)
    df = spark.read.parquet(path)
    few = some_files(df, 3)
    assert 0 < few.count() < 500 and sorted(few.collect()) == sorted(some_files(df, 3).collect())
    assert some_files(df, 12).count() == 1000 and some_files(df.groupBy("id").count(), 3).count() == 1000
    scan = few._jdf.queryExecution().executedPlan().toString()
    assert "file_name" in scan
