import random

from pyspark.sql import functions as F

from millrace.llm import mixing

SIZES = "doc_id bigint, source string, n_tokens bigint"
TARGETS = "source string, target_share double, max_repeats int, doc_id string"


def mix(spark, sizes, targets, seed=1):
    s = spark.createDataFrame(sizes, SIZES)
    t = spark.createDataFrame([(*x, "x") for x in targets], TARGETS)
    chosen = mixing.mix(s, t, seed=seed)
    return chosen.collect(), {r.source: r for r in mixing.shares_report(s, t, chosen).collect()}


def test_shares_are_met_and_repeats_bounded(spark):
    rng = random.Random(2)
    sizes = [(k, rng.choice("aaaabbc"), int(rng.lognormvariate(4, 1)) + 1) for k in range(3000)]
    rows, report = mix(spark, sizes, [("a", 0.2, 1), ("B ", 0.5, 3), ("c", 0.28, 2), ("none", 0.02, 5)])
    total = sum(n for _, _, n in sizes)
    most = {"a": 1, "b": 3, "c": 2}
    assert all(1 <= r.uses <= most[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    for s, share in (("a", 0.2), ("b", 0.5), ("c", 0.28)):
        got = sum(r.uses * r.n_tokens for r in rows if r.source == s)
        assert got == report[s].tokens
        if report[s].reachable:
            assert abs(got / total - share) < 0.002
        else:  # every document as often as it may be
            assert all(r.uses == most[s] for r in rows if r.source == s) and got == most[s] * report[s].source_tokens
    assert report["none"].tokens == 0 and not report["none"].reachable


def test_each_copy_count_is_the_expected_one_rounded(spark):
    sizes = [(k, "a", 10) for k in range(100)] + [(1000 + k, "b", 10) for k in range(100)]
    rows, _ = mix(spark, sizes, [("a", 0.75, 9), ("b", 0.25, 9)])
    a = [r.uses for r in rows if r.source == "a"]
    assert set(a) == {1, 2} and sum(a) == 150 and len(a) == 100
    assert sum(r.uses for r in rows if r.source == "b") == 50


def test_the_seed_decides(spark):
    sizes = [(k, "a", 1 + k % 7) for k in range(200)] + [(900, "b", 500)]
    one, two, three = (mix(spark, sizes, [("a", 0.3, 1)], s)[0] for s in (1, 1, 2))
    assert sorted(one) == sorted(two) and sorted(one) != sorted(three)


def test_nulls_and_empty(spark):
    sizes = [(1, None, 5), (2, "a", 0), (3, "a", None), (None, "a", 4), (5, "a", 4), (5, "a", 4)]
    rows, report = mix(spark, sizes, [("a", 1.0, 2), (None, 0.5, 1), ("b", None, 1), ("c", 0.1, None), ("d", 0.0, 3)])
    assert {r.doc_id for r in rows} <= {None, 5} and report["a"].source_docs == 3 and set(report) == {"a"}
    assert mix(spark, [], [("a", 1.0, 2)])[0] == [] and mix(spark, sizes, [])[0] == []


def test_spellings_of_a_source(spark):
    names = ["Web-Crawl", " web_crawl ", "WEB  CRAWL", "web_crawl", "", " ", None]
    got = spark.createDataFrame([(n,) for n in names], "s string").select(mixing.source_key(F.col("s")).alias("k")).collect()
    assert [r.k for r in got] == ["web_crawl"] * 4 + [None] * 3


def test_one_offset_gives_each_document_its_expected_copies(spark):
    sizes = spark.createDataFrame([(k, "a", 10 + k % 7) for k in range(60)] + [(100, "b", 400)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.3, 2)], "source string, target_share double, max_repeats int")
    plan = mixing.shares_plan(sizes, targets).head()
    uses = {}
    for seed in range(8):
        for r in mixing.mix(sizes, targets, seed=seed, ranked=5, draws=1).collect():
            uses[r.doc_id] = uses.get(r.doc_id, 0) + r.uses
    assert abs(sum(uses.values()) / 8 - 60 * plan.expected) < 0.5
    assert all(abs(uses.get(k, 0) / 8 - plan.expected) < 0.75 for k in range(60))
