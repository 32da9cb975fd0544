import random

import numpy as np

from millrace.llm import splitting as sp

VOCAB = [(0, b"a"), (1, b" b"), (2, b"."), (3, b"\n"), (4, b"c!"), (5, b"\nd"), (10, b"<|endoftext|>"), (11, b"<|pad|>"), (12, b"<|system|>"), (13, b"<|user|>"), (14, b"<|assistant|>")]
PROFILES = [("p", 20, 4), ("q", 50, 10), ("bad", 5, 5), (None, 9, 1)]
COLS = "example_id bigint, profile string, ids array<int>, mask array<tinyint>, cut string, max_tokens string"


def tables(spark, rows):
    return (
        spark.createDataFrame([(*r, "x", "y") for r in rows], COLS),
        spark.createDataFrame(PROFILES, "profile string, max_tokens int, overlap int"),
        spark.createDataFrame([(i, bytearray(b)) for i, b in VOCAB], "token_id int, token_bytes binary"),
    )


def natural(ids):
    b = dict(VOCAB)
    return [k for k in range(1, len(ids)) if ids[k] in (12, 13, 14) or ids[k - 1] == 10 or b.get(ids[k - 1], b"").endswith(b"\n")
            or (b.get(ids[k - 1], b"")[-1:] in (b".", b"!", b"?") and b.get(ids[k], b"")[:1] in (b" ", b"\n"))]


def unpad(ids):
    ids = list(ids)
    while ids and ids[-1] == 11:
        ids.pop()
    return ids


def test_pieces_hold_what_was_promised(spark):
    rng = random.Random(11)
    limits = {p: (m, o) for p, m, o in PROFILES if p}
    rows = []
    for k in range(150):
        n = rng.randint(0, 200)
        pool = [0, 0, 1, 2, 3, 4, 5, 10, 12, 13, 14, 99] if k % 2 else [0] * 12 + [1, 2, 13]
        ids = [rng.choice(pool) for _ in range(n)] + [11] * rng.choice([0, 0, 3])
        rows.append((k, rng.choice(["p", "q"]), ids, [rng.randint(0, 1) for _ in range(max(0, len(ids) - rng.choice([0, 0, 5])))]))
    ex, pr, vo = tables(spark, rows + rows[:20])
    by = {}
    for r in sp.split_examples(ex, pr, vo).collect():
        by.setdefault(r.example_id, []).append(r)
    verdict = dict(map(tuple, sp.split_examples(ex, pr, vo, True).collect()))
    assert verdict == {k: v[0].cut for k, v in by.items()}
    for k, p, ids, mask in rows:
        most, overlap = limits[p]
        real = unpad(ids)
        assert (k in by) == (len(real) > most)
        if k not in by:
            continue
        pieces = sorted(by[k], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(pieces[0].n_pieces))
        assert all(len(r.ids) <= most and len(r.ids) == len(r.mask) for r in pieces)
        whole = list(pieces[0].ids)
        for a, b in zip(pieces, pieces[1:]):
            assert a.ids[-overlap:] == b.ids[:overlap] or b.start == 0
            assert b.start + (len(whole) - b.start) == len(whole) and whole[b.start :] == b.ids[: len(whole) - b.start]
            whole += b.ids[len(whole) - b.start :]
        assert whole == real
        full = (list(mask) + [0] * len(real))[: len(real)]
        assert all(r.mask == full[r.start : r.start + len(r.ids)] for r in pieces)
        places = natural(real)
        gap = max(b - a for a, b in zip([0, *places], [*places, len(real)]))
        assert pieces[0].cut == ("forced" if gap > most - overlap else "natural")
        if pieces[0].cut == "natural":
            assert all(r.start + overlap in places or r.start == 0 for r in pieces[1:])


def test_nulls_and_limits(spark):
    rows = [(1, "p", None, None), (2, "p", [], []), (3, None, [0] * 60, None), (4, "nope", [0] * 60, None), (5, "bad", [0] * 60, None), (6, "p", [0] * 10 + [None] + [0] * 15, None), (7, "p", [0] * 20 + [11] * 9, None), (8, "p", [11] * 30, None)]
    got = sp.split_examples(*tables(spark, rows)).collect()
    assert {r.example_id for r in got} == {6} and {r.cut for r in got} == {"forced"} and all(set(r.mask) == {0} for r in got)
    assert sum(x is None for r in got for x in r.ids) >= 1
    assert sp.split_examples(*tables(spark, [])).collect() == []


def test_the_stronger_boundary_near_the_middle_is_taken():
    v = sp.Vocab(VOCAB)
    ids = np.array([0] * 8 + [2, 1] + [0] * 3 + [13] + [0] * 6)
    cuts, forced = sp.bisect_cuts(v.strengths(ids), 16)
    assert cuts == [13] and not forced
    assert sp.bisect_cuts(np.zeros(40, np.int8), 16) == ([10, 20, 30], True)
