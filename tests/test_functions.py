import random
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import bpe, shuffle
from millrace.functions.pieces import PATTERN, piece_counts, pieces, prune_rare

TEXTS = ["", "a", "naïve café", "日本語のテキスト", "🙂🙃", "def f(x):\n\treturn x\n\n", "  lead and trail  ", "it's WE'LL ſ'ſ 12345", "\x00\x01\x02", "a" * 500, "x y z \r\n w", "á b"]


def test_pieces_equal_the_pattern_in_python(spark):
    rng = random.Random(1)
    pool = "ab Z9'ſsdmt\n\r\t   .,!é日🙂_-"
    texts = TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", pieces(F.col("text")).alias("p")).collect()
    one = regex.compile(PATTERN)
    for r in rows:
        assert r.p == one.findall(texts[r.i]) and "".join(r.p) == texts[r.i]


def test_counts_and_pruning(spark):
    df = spark.createDataFrame([("a b a",), (None,), ("",), ("a",)], "text string")
    counts = dict(map(tuple, piece_counts(df).collect()))
    assert counts == {"a": 2, " b": 1, " a": 1}
    c = piece_counts(df)
    assert prune_rare(c, 2, above=100).count() == 3 and [r.piece for r in prune_rare(c, 2, above=2).collect()] == ["a"]


def naive_training(counts, n):
    """Counts all pairs again for each merge."""
    words = {w: list(w.encode()) for w in counts}
    merges = []
    while len(merges) < n:
        pairs = Counter()
        for w, s in words.items():
            for p in zip(s, s[1:]):
                pairs[p] += counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        new = 256 + len(merges)
        merges.append((*best, new))
        for w, s in words.items():
            out, i = [], 0
            while i < len(s):
                hit = i + 1 < len(s) and (s[i], s[i + 1]) == best
                out.append(new if hit else s[i])
                i += 1 + hit
            words[w] = out
    return merges


def test_training_both_ways(spark, monkeypatch):
    text = "the thin thing thinks; then the other there — naïve naïve aaa aaaa 日本 日本\n" * 3
    df = spark.createDataFrame([(text,)], "text string")
    counts = piece_counts(df)
    want = naive_training(dict(map(tuple, counts.collect())), 30)
    assert bpe.train(counts, 30) == want
    monkeypatch.setattr(bpe, "DRIVER_PIECES", 0)
    assert bpe.train(counts, 12) == want[:12]
    assert len(bpe.train(piece_counts(spark.createDataFrame([("ab",)], "text string")), 9)) == 1


MERGES = [(101, 114, 256), (116, 104, 257), (257, 256, 258), (97, 97, 259), (259, 259, 260)]
V = bpe.Vocabulary(MERGES, ["<|endoftext|>", "<|pad|>"], 300)


def test_encode_equals_replaying_merges_and_decodes(spark):
    df = spark.createDataFrame([*enumerate(TEXTS + ["other there aaaaa aaaa", "<|pad|>"]), (99, None)], "doc_id int, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, V).collect()}
    one = regex.compile(PATTERN)
    for r in df.where("text is not null").collect():
        want = []
        for p in one.findall(r.text):
            s = "".join(chr(bpe.BASE + b) for b in p.encode())
            for a, b, new in MERGES:
                s = s.replace(chr(bpe.BASE + a) + chr(bpe.BASE + b), chr(bpe.BASE + new))
            want += [ord(c) - bpe.BASE for c in s]
        assert got[r.doc_id] == want
    back = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame([(k, v) for k, v in got.items()], "doc_id int, ids array<int>"), V).collect()}
    assert back == {r.doc_id: r.text for r in df.where("text is not null").collect()} and 99 not in got


def test_vocabulary():
    assert V.size == 300 and V.specials == {"<|endoftext|>": 298, "<|pad|>": 299} and V.end_id() == 298 and V.bytes[258] == b"ther"
    assert bpe.Vocabulary.from_json(V.to_json()).to_json() == V.to_json()
    with pytest.raises(ValueError):
        bpe.Vocabulary(MERGES, [], 258)
    with pytest.raises(KeyError):
        bpe.Vocabulary([]).end_id()
    with pytest.raises(ValueError):
        V.decode_bytes([280])
    assert V.decode_bytes([258, 298]) == b"ther<|endoftext|>"


def test_splitting_at_specials(spark):
    df = spark.createDataFrame([("a<|pad|><|endoftext|>b<|pa",)], "t string")
    assert df.select(bpe.split_specials(F.col("t"), ["<|pad|>", "<|endoftext|>"]).alias("p")).head().p == ["a", "<|pad|>", "<|endoftext|>", "b<|pa"]
    assert df.select(bpe.split_specials(F.col("t"), []).alias("p")).head().p == ["a<|pad|><|endoftext|>b<|pa"]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 100, 1000, 4096, 65537])
def test_permutation_is_a_bijection(n):
    assert sorted(shuffle.permuted(np.arange(n), n, 1234)) == list(range(n))


def test_permutation_anchors():
    assert shuffle.epoch_seed(1337, 0) == 1738338114952549487 and shuffle.epoch_seed(1337, 1) == 7579156953206895765
    assert shuffle.permuted(np.arange(10), 10, 1337).tolist() == [1, 0, 2, 3, 8, 9, 4, 5, 7, 6]
    assert len({shuffle.epoch_seed(1337, e) for e in range(200)}) == 200
    big = shuffle.permuted(np.arange(1024), 10**12, 5)
    assert len(set(big)) == 1024 and big.min() >= 0 and big.max() < 10**12


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 5000), st.integers(0, 2**62), st.data())
def test_a_slice_of_the_permutation(n, seed, data):
    a = data.draw(st.integers(0, n - 1))
    b = data.draw(st.integers(a, n))
    assert shuffle.permuted(np.arange(a, b), n, seed).tolist() == shuffle.permuted(np.arange(n), n, seed)[a:b].tolist()


def test_the_permutation_looks_shuffled():
    p = shuffle.permuted(np.arange(10_000), 10_000, 3)
    assert abs(np.corrcoef(np.arange(10_000), p)[0, 1]) < 0.05
    assert np.histogram(p[:1000], 10, (0, 10_000))[0].min() > 60


def test_symbols_skip_the_surrogates_and_go_on(spark):
    ids = [0, 255, 41_727, 41_728, 41_983, 41_984, 60_000, 900_000]
    assert [bpe.symbol(bpe.char(k)) for k in ids] == ids and all(not "\ud800" <= bpe.char(k) <= "\udfff" for k in ids)
    assert sorted(map(bpe.char, ids)) == [bpe.char(k) for k in ids]
    a, b = bpe.char(41_728), bpe.char(60_000)
    df = spark.createDataFrame([(f"x{a}{b}{a}{b}y",)], "symbols string")
    got = df.select(bpe.merge(F.col("symbols"), a + b, 70_000).alias("s")).head().s
    assert got == f"x{bpe.char(70_000) * 2}y" and bpe.pair_counts(df.selectExpr("symbols", "3L as freq")).count() == 4
    with pytest.raises(ValueError):
        bpe.train(spark.createDataFrame([("a", 1)], "piece string, freq bigint"), 2_000_000)


def test_rounds_of_many_merges_equal_one_at_a_time(spark, monkeypatch):
    from millrace.runtime import table

    counts = piece_counts(table(spark, "/root/testdata/sf0.001", "documents").select("text").where("text is not null")).orderBy(F.desc("freq"), "piece").limit(700)
    here = bpe.train(counts, 150)
    assert here == naive_training(dict(map(tuple, counts.collect())), 150)
    monkeypatch.setattr(bpe, "DRIVER_PIECES", 0)
    assert bpe.train(counts, 60) == here[:60]
    assert bpe.apart(["ab", "cd", "ef", "bg", "hi"]) == ["ab", "cd", "ef"] and bpe.apart(["aa", "ab"]) == ["aa"]


def test_long_pieces_merge_like_short_ones():
    rng = random.Random(2)
    text = "".join(rng.choice("theaaer o") for _ in range(4000))
    v = bpe.Vocabulary(MERGES, [], 300)
    ids = list(text.encode())
    while True:
        known = [(v.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in v.rank]
        if not known:
            break
        r = min(known)[0]
        i = 0
        while i < len(ids) - 1:
            if v.rank.get((ids[i], ids[i + 1]), (-1,))[0] == r:
                ids[i : i + 2] = [v.rank[ids[i], ids[i + 1]][1]]
            i += 1
    assert v.encode_piece(text) == ids and len(v.encode_piece("a" * 300_000)) == 75_000


def test_encoding_with_specials(spark):
    text = "<|pad|>er<|endoftext|>the <|pad|>"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "<|pad|>")], "doc_id int, text string")
    end, pad = V.specials["<|endoftext|>"], V.specials["<|pad|>"]
    spell = lambda s: V.encode_piece(s)
    get = lambda allowed: {r.doc_id: r.ids for r in bpe.encode(df, V, allowed=allowed).collect()}
    assert get("all") == {1: [pad, 256, end, *spell("the"), *spell(" "), pad], 2: [], 4: [pad]}
    some = get({"<|endoftext|>", "<|none|>"})
    assert some[1].count(end) == 1 and pad not in some[1] and V.decode_bytes(some[1]).decode() == text
    assert end not in get("none")[1] and get(set())[4] == get("none")[4]
