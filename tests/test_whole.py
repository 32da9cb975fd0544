"""Queries that have no SQL, against loops over the whole table."""

from collections import Counter

import numpy as np
import pytest
import regex

import __spark_entry__ as entry
from millrace.functions import bpe, shuffle
from millrace.functions.pieces import PATTERN
from millrace.plans import corpus
from tests.test_functions import naive_training
from tests.test_operators import sequential

QUERIES = entry.queries()
TEXTS = [(k, None if k % 50 == 7 else ("wörd %d, " % k) * (k % 60)) for k in range(700)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(TEXTS, "doc_id bigint, text string").write.parquet(str(d / "documents.parquet"))
    return str(d)


def stream():
    return [t for _, text in TEXTS if text for t in [*text.encode(), 256]]


def test_plans_and_gathers_every_window(spark, folder):
    toks = stream()
    n = (len(toks) - 1) // 512
    assert n > 127
    want, steps = {}, n // 8
    for e in range(2):
        order = shuffle.permuted(np.arange(n), n, shuffle.epoch_seed(1337, e)).tolist()
        for place in range(steps * 8):
            want[e * steps + place // 8, place % 8 // 4, place % 4] = order[place]
    got = QUERIES["win_5_all"](spark, folder).collect()
    assert {(r.step, r["rank"], r.slot): r.seq_idx for r in got} == want and len(got) == len(want)
    assert all((r["first"], r.id_sum) == (toks[512 * r.seq_idx], sum(toks[512 * r.seq_idx : 512 * r.seq_idx + 513])) for r in got)
    plan = QUERIES["load_4_all"](spark, folder).collect()
    assert {(r.step, r["rank"], r.slot): r.seq_idx for r in plan} == want
    assert all((r.epoch, r.cursor) == (r.step // steps, r.step % steps * 8) for r in plan)
    assert sorted(QUERIES["load_2_all"](spark, folder).collect()) == [(s, s // steps, s % steps * 8) for s in range(2 * steps)]
    assert sorted(QUERIES["load_3_all"](spark, folder).collect()) == [(s, r, s % steps * 8 + 4 * r) for s in range(2 * steps) for r in range(2)]
    assert sorted(QUERIES["load_6_all"](spark, folder).collect()) == [(s, s // steps, (s % steps + 1) * 8, (s + 1) * 4096, 1337, True) for s in range(2 * steps)]
    for name, seed, a, b in (("perm_5_all", shuffle.epoch_seed(1337, 0), 0, n), ("perm_6_all", 5, n * 3 // 10, n * 4 // 10), ("load_1_all", shuffle.epoch_seed(1337, 3), 0, n)):
        assert sorted(QUERIES[name](spark, folder).collect()) == [*enumerate(shuffle.permuted(np.arange(n), n, seed).tolist())][a:b]


@pytest.fixture(scope="module")
def by_hand():
    """(merges, ids of each piece, pieces of each document), learned and applied by loops."""
    one = regex.compile(PATTERN)
    pieces = {k: one.findall(text) for k, text in TEXTS if text}
    merges = naive_training(Counter(p for ps in pieces.values() for p in ps), 32_768 - 257)
    ids = {}
    for p in {p for ps in pieces.values() for p in ps}:
        s = "".join(chr(bpe.BASE + b) for b in p.encode())
        for a, b, new in merges:
            s = s.replace(chr(bpe.BASE + a) + chr(bpe.BASE + b), chr(bpe.BASE + new))
        ids[p] = [ord(c) - bpe.BASE for c in s]
    return merges, ids, pieces


def test_learns_and_encodes_with_all_merges(spark, folder, by_hand):
    merges, ids, pieces = by_hand
    assert len(merges) > 500
    assert sorted(QUERIES["tok_7_full"](spark, folder).collect()) == [(r, *m) for r, m in enumerate(merges)]
    assert dict(map(tuple, QUERIES["tok_11_full"](spark, folder).collect())) == {p: len(x) for p, x in ids.items()}
    flat = {k: [i for p in ps for i in ids[p]] for k, ps in pieces.items()}
    size = {k: len(text.encode()) for k, text in TEXTS if text}
    assert sorted(QUERIES["tok_12_full"](spark, folder).collect()) == [(k, len(x), sum(x)) for k, x in sorted(flat.items())]
    assert sorted(QUERIES["tok_17_full"](spark, folder).collect()) == [(k, size[k] / len(x)) for k, x in sorted(flat.items())]
    assert sorted(QUERIES["prep_1_full"](spark, folder).collect()) == [(k, len(x) + 1, size[k]) for k, x in sorted(flat.items())]


def test_prepares_with_the_learned_vocabulary(spark, folder, by_hand, monkeypatch):
    monkeypatch.setattr(corpus, "SHARD", 300)  # several shards of so few tokens
    _, ids, pieces = by_hand
    docs = [(k, [i for p in ps for i in ids[p]] + [32_767], len(TEXTS[k][1].encode())) for k, ps in sorted(pieces.items())]
    split = lambda ord: "train" if ord % 14 else "val"
    parts = {s: [x for n, x in enumerate(docs, 1) if split(n) == s] for s in ("train", "val")}

    def shards(size):
        for s, rows in parts.items():
            groups = sequential([len(x) for _, x, _ in rows], size, "roll")
            for g in sorted(set(groups)):
                own = [x for (_, x, _), h in zip(rows, groups) if h == g]
                yield s, g, len(own), sum(map(len, own)), sum(map(sum, own))

    got = lambda name: sorted(map(tuple, QUERIES[name](spark, folder).collect()))
    assert got("prep_4_full") == [(k, len(x), split(n)) for n, (k, x, _) in enumerate(docs, 1)]
    tokens, size = sum(len(x) for _, x, _ in docs), sum(b for *_, b in docs)
    assert got("prep_5_full") == [(len(docs), tokens, size, round(size / tokens, 6))] and size > 1.5 * tokens
    assert got("prep_6_full") == [(s, len(p), sum(len(x) for _, x, _ in p), sum(b for *_, b in p)) for s, p in parts.items()]
    assert got("prep_7_full") == [(s, f"shard_{g:05d}.bin", t, n, i) for s, g, n, t, i in shards(7500)]
    small = [*shards(300)]
    assert len(small) > 20 and got("snk_5_full") == [x[:4] for x in small]
    train = [(g, t) for s, g, _, t, _ in small if s == "train"]
    assert got("win_1_full") == [(g, t, sum(u for _, u in train[:g])) for g, t in train]
    toks = [i for _, x, _ in docs for i in x]
    cuts = [toks[512 * k : 512 * k + 513] for k in range((len(toks) - 1) // 512)]
    assert got("win_3_full") == [(k, w[0], w[-1], sum(i * t for i, t in enumerate(w, 1))) for k, w in enumerate(cuts)]
    assert got("src_19_full") == [(k, len(toks[a : a + 10_000]), sum(toks[a : a + 10_000])) for k, a in enumerate(range(0, len(toks), 10_000))]


def test_a_long_json_text_is_read_whole(spark, tmp_path):
    long = '{"k": "' + "x" * (1 << 20) + '"}'
    rows = [(3, " " + long), (4, long), (6, " " + long[:-1])]
    spark.createDataFrame(rows, "event_id bigint, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert dict(map(tuple, QUERIES["src_22"](spark, str(tmp_path)).collect())) == {3: True, 4: True, 6: False}


def test_conversation_batches_equal_a_loop(spark, folder="/root/testdata/sf0.001"):
    from millrace.plans import chat as queries

    rows = {r.window_id: (r.ids, r.mask) for r in queries.packed(spark, folder).collect()}
    n = len(rows)
    got = {(r.step, r.rank, r.slot): (r.seq_idx, r.x_sum, r.y_trained) for r in queries.sft_7_batches(spark, folder).collect()}
    assert len(got) == 2 * (n // 8) * 8
    for (step, rank, slot), have in got.items():
        epoch, at = divmod(step, n // 8)
        k = int(shuffle.permuted([at * 8 + rank * 4 + slot], n, shuffle.epoch_seed(1337, epoch))[0])
        ids, mask = rows[k]
        assert have == (k, sum(ids[:-1]), sum(t * m for t, m in zip(ids[1:], mask[1:])))
