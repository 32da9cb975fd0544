import random

import pytest

from millrace.llm import packing, queries, tokens
from tests.compare import differences

PROF = "profile string, capacity int, max_tokens string"


def pack(spark, sizes, profiles=(("a", 10), ("b", 25))):
    s = spark.createDataFrame(list(sizes), "doc_id bigint, n_tokens bigint")
    p = spark.createDataFrame([(*x, "x") for x in profiles], PROF)
    return packing.pack(s, p).collect()


def test_every_item_once_and_no_container_overfull(spark):
    rng = random.Random(1)
    sizes = [(k, int(rng.lognormvariate(1.8, 1)) + 1) for k in range(600)]
    rows = pack(spark, sizes)
    for profile, cap in (("a", 10), ("b", 25)):
        own = [r for r in rows if r.profile == profile]
        load, parts = {}, {}
        for r in own:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
            parts.setdefault(r.doc_id, []).append((r.piece, r.token_start, r.n_tokens))
        assert max(load.values()) <= cap and sorted(load) == list(range(len(load)))
        for k, n in sizes:
            p = sorted(parts[k])
            assert len(p) == -(-n // cap) and [x[0] for x in p] == list(range(len(p)))
            assert [x[1] for x in p] == [cap * i for i in range(len(p))] and sum(x[2] for x in p) == n
        assert len(load) <= 1.02 * sum(n for _, n in sizes) / cap + 1


def test_nulls_zero_repeats_and_bad_profiles(spark):
    rows = pack(spark, [(1, None), (2, 0), (None, 3), (4, 4), (4, 4)], [("a", 10), ("a", 8), ("n", None), (None, 9), ("z", 0)])
    assert sorted((r.profile, r.capacity, r.doc_id or 0, r.n_tokens) for r in rows) == [("a", 10, 0, 3), ("a", 10, 1, 0), ("a", 10, 2, 0), ("a", 10, 4, 4), ("a", 10, 4, 4)]
    assert {r.container_id for r in rows if not r.n_tokens} <= {r.container_id for r in rows if r.n_tokens}
    assert [(r.container_id, r.n_tokens) for r in pack(spark, [(1, 0)], [("a", 10)])] == [(0, 0)]
    assert pack(spark, []) == [] and pack(spark, [(1, 1)], []) == []


@pytest.mark.parametrize("hist", [{5: 7}, {10: 3, 4: 9, 6: 9}, {3: 100}, {7: 5, 3: 4, 2: 1}, {1: 1}, {}])
def test_plan_places_each_count(hist):
    load = {}
    for size, lo, hi, first, per in packing.plan_blocks(hist, 10):
        for k in range(lo, hi):
            c = first + (k - lo) // per
            load[c] = load.get(c, 0) + size
    assert sum(load.values()) == sum(s * c for s, c in hist.items()) and max(load.values(), default=0) <= 10
    assert len(load) >= -(-sum(load.values()) // 10)


def test_one_length_for_a_third_of_all_items(spark):
    rows = pack(spark, [(k, 5 if k % 3 == 0 else 1 + k % 9) for k in range(900)], [("a", 10)])
    assert len({(r.doc_id) for r in rows}) == 900 and packing.fill_report(spark.createDataFrame(rows)).head().fill > 0.95


def test_token_sizes(spark):
    docs = spark.createDataFrame([(1, "Hello world", "s"), (2, None, "s"), (3, "", None), (4, "<|endoftext|>", "s")], "doc_id bigint, text string, n_tokens string")
    got = dict((r.doc_id, r.n_tokens) for r in tokens.token_sizes(docs, "doc_id", "text").collect())
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


def test_hot_lengths_and_pieces_that_fill_containers(spark):
    rows = [(k, 7) for k in range(300)] + [(1000, 95), (1001, 40), (1001, 40), (1002, 10), (1003, 3), (1004, None)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    profiles = spark.createDataFrame([("p", 10), ("q", 20)], "profile string, capacity int")
    got = packing.pack(sizes, profiles, ranked=20).collect()
    for p, cap in (("p", 10), ("q", 20)):
        own = [r for r in got if r.profile == p]
        used = {}
        for r in own:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        assert max(used.values()) <= cap and sorted(used) == list(range(len(used)))
        assert sum(used.values()) == sum(n or 0 for _, n in rows)
        assert sorted((r.token_start, r.n_tokens) for r in own if r.doc_id == 1000) == [(k, min(cap, 95 - k)) for k in range(0, 95, cap)]
        assert len([r for r in own if r.doc_id < 1000]) == 300 and len({(r.doc_id, r.container_id) for r in own if r.doc_id == 1000}) == -(-95 // cap)


@pytest.fixture
def folder(spark, tmp_path):
    def write(texts, profiles=(("a", 10), ("b", 25))):
        out = tmp_path / str(len(list(tmp_path.iterdir())))
        spark.createDataFrame(list(texts), "doc_id bigint, text string, source string").write.parquet(f"{out}/documents.parquet")
        spark.createDataFrame([(*x, "x") for x in profiles], PROF).write.parquet(f"{out}/window_profiles.parquet")
        return str(out)

    return write


TEXTS = [(k, " a" * n, "s") for k, n in ((1, 3), (2, 10), (3, 25), (4, 26), (5, 47), (6, 0))]


@pytest.mark.parametrize(
    "lost, documents, overfull, incomplete",
    [
        ("true", 6, 0, 0),
        ("not (doc_id = 4 and piece = 2)", 6, 0, 1),  # the rest of a document
        ("not (doc_id = 5 and piece = 4)", 6, 0, 1),
        ("not (doc_id = 5 and piece = 1)", 6, 0, 1),
        ("doc_id <> 6", 5, 0, 1),
        ("doc_id > 2", 4, 0, 2),
    ],
)
def test_what_a_packing_loses_is_told(spark, folder, monkeypatch, lost, documents, overfull, incomplete):
    whole = packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **k: whole(*a, **k).where(f"profile = 'b' or {lost}"))
    got = {r.profile: tuple(r)[1:] for r in queries.p5_verified(spark, folder(TEXTS)).collect()}
    assert got == {"a": (documents, overfull, incomplete), "b": (6, 0, 0)}


@pytest.mark.parametrize(
    "change, overfull, incomplete",
    [({"n_tokens": "n_tokens - if(doc_id = 3 and piece = 2, 1, 0)"}, 0, 1), ({"token_start": "if(doc_id = 5 and piece = 1, 0, token_start)"}, 0, 1), ({"container_id": "0L"}, 1, 0), ({"capacity": "1000L", "container_id": "0L"}, 1, 0)],
)
def test_what_a_packing_changes_is_told(spark, folder, monkeypatch, change, overfull, incomplete):
    whole = packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **k: whole(*a, **k).selectExpr(*[f"{change.get(c, c)} as {c}" for c in ("profile", "capacity", "container_id", "doc_id", "piece", "token_start", "n_tokens")]))
    assert [tuple(r) for r in queries.p5_verified(spark, folder(TEXTS, [("a", 10)])).collect()] == [("a", 6, overfull, incomplete)]


@pytest.mark.parametrize("texts", [[], [(1, " a" * 47, "s"), (1, " a" * 47, "s"), (1, " a" * 12, "s"), (None, " a" * 31, None), (None, " a", "s"), (2, None, "s"), (2, "", "s")]])
def test_repeats_nulls_and_no_documents_equal_sql(spark, folder, texts):
    assert differences(spark, queries.p5_verified, queries.P5_VERIFIED, folder(texts)) is None
