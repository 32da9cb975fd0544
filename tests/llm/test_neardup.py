import random

from millrace.llm import neardup

COLS = "id bigint, grp string, content string, digest string"


def run(spark, rows, **kw):
    nd = neardup.NearDuplicates(spark.createDataFrame([(i, g, t, "x") for i, g, t in rows], COLS), **kw)
    return nd, sorted(map(tuple, nd.pairs().collect()))


def brute(rows, threshold=0.7, least=20):
    rows = {(i, g, t) for i, g, t in rows if None not in (i, g, t)}
    bags = sorted((i, g, w) for i, g, t in rows if len(w := neardup.WORD.findall(t.lower())) >= least)
    return sorted({(a[0], b[0]) for k, a in enumerate(bags) for b in bags[k + 1 :] if a[0] != b[0] and a[1] == b[1] and neardup.bag_likeness(a[2], b[2]) >= threshold})


def edited(rng, words, vocab):
    w = list(words)
    for _ in range(rng.randint(0, 9)):
        k = rng.randrange(len(w))
        what = rng.random()
        if what < 0.4:
            w[k] = rng.choice(vocab)
        elif what < 0.7:
            w.insert(k, rng.choice(vocab))
        elif len(w) > 1:
            del w[k]
    if rng.random() < 0.3:
        rng.shuffle(w)
    return " ".join(w)


def test_recall_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"word{k}" for k in range(300)]
    rows, n = [], 0
    for _ in range(120):
        base = [rng.choice(vocab) for _ in range(rng.randint(18, 60))]
        for _ in range(rng.randint(1, 5)):
            rows.append((n, rng.choice(["user", "assistant"]), edited(rng, base, vocab)))
            n += 1
    want = brute(rows)
    _, got = run(spark, rows)
    assert not set(got) - set(want)
    assert len(want) > 80 and len(set(got) & set(want)) >= 0.98 * len(want)


def test_words_count_as_often_as_they_occur(spark):
    a = " ".join(["x"] * 20 + ["y"] * 10)
    rows = [(1, "u", a), (2, "u", a.replace("y", "Y!")), (3, "u", " ".join(["x"] * 10 + ["y"] * 20)), (4, "v", a), (5, "u", " ".join(["x"] * 19))]
    assert run(spark, rows)[1] == brute(rows) == [(1, 2)]


def test_nulls_repeats_short_and_empty(spark):
    t = " ".join(f"t{k}" for k in range(25))
    rows = [(1, "u", t), (1, "u", t), (2, "u", t), (3, None, t), (None, "u", t), (4, "u", None), (5, "u", ""), (6, "u", "short text"), (7, "u", "short text")]
    nd, got = run(spark, rows)
    assert got == [(1, 2)]
    assert sorted(map(tuple, nd.groups().collect())) == [(1, 1, 0), (2, 1, 0)]
    assert run(spark, [])[1] == []


def rebuilt(nd):
    """All pairs, from classes() and text_links()."""
    rows = nd.classes().collect()
    by_class, by_text = {}, {}
    for r in rows:
        by_class.setdefault(r.class_id, set()).add(r.id)
        by_text.setdefault(r.text_id, set()).add(r.id)
    assert all(len(by_class[r.class_id]) == r.class_rows for r in rows)
    out = {(p, q) for ids in by_class.values() for p in ids for q in ids if p < q}
    for r in nd.text_links().collect():
        out |= {(min(p, q), max(p, q)) for p in by_text[r.text_a] for q in by_text[r.text_b]}
    return out


def test_linked_groups_of_a_thousand_copies_give_every_pair(spark):
    n = 1000
    t = " ".join(f"t{k}" for k in range(30))
    rows = [(k, "u", t) for k in range(n)] + [(2000 + k, "u", t + " more") for k in range(n)] + [(5000, "u", " ".join(f"z{k}" for k in range(30)))]
    nd = neardup.NearDuplicates(spark.createDataFrame([(i, g, t, "x") for i, g, t in rows], COLS))
    got = nd.pairs()
    assert got.count() == n * (n - 1) + n * n == got.distinct().count()
    assert {(r.class_rows, r.links) for r in nd.classes().collect()} == {(n, 1)} and nd.text_links().count() == 1
    groups = nd.groups().collect()
    assert {g.group_id for g in groups} == {0} and len(groups) == 2 * n and {g.links for g in groups} == {1}


def test_larger_groups_of_copies_lose_no_link_and_can_be_rebuilt(spark):
    t = " ".join(f"t{k}" for k in range(30))
    rows = [(k, "u", t) for k in range(40)] + [(100 + k, "u", t + " more") for k in range(30)] + [(200, "u", t + " less")]
    nd = neardup.NearDuplicates(spark.createDataFrame([(i, g, t, "x") for i, g, t in rows], COLS))
    few = set(map(tuple, nd.pairs(expand=6).collect()))
    assert {(0, k) for k in range(1, 40)} | {(100, 100 + k) for k in range(1, 30)} <= few  # stars
    assert {(k, 100) for k in range(40)} | {(0, 100 + k) for k in range(30)} | {(k, 200) for k in range(40)} <= few  # each row keeps its link
    assert few <= set(brute(rows)) and len(few) < len(brute(rows))
    assert rebuilt(nd) == set(brute(rows)) == set(map(tuple, nd.pairs().collect()))


def templates(rng, n, first, slots=2):
    base = [f"t{first}x{k}" for k in range(40)]
    for k in range(n):
        w = list(base)
        for s in rng.sample(range(40), slots):
            w[s] = f"slot{rng.randrange(10**9)}"
        yield first + k, "u", " ".join(w)


def test_long_runs_of_a_band_key_lose_no_link(spark):
    rng = random.Random(3)
    rows = [*templates(rng, 120, 0), *templates(rng, 60, 1000, 5), *templates(rng, 9, 2000, 1)]
    mixed = [w if k % 4 else f"t2000x{k}" for k, w in enumerate(next(templates(rng, 1, 0, 0))[2].split())]
    rows += [(3000 + k, "u", " ".join(mixed[:39] + [f"m{k}"])) for k in range(40)] + [(3100, "v", rows[0][2])]
    want = set(brute(rows))
    for run, whole in ((4, 8), (16, 4096)):
        nd = neardup.NearDuplicates(spark.createDataFrame([(i, g, t, "x") for i, g, t in rows], COLS), longest_run=run, whole_run=whole)
        got = set(map(tuple, nd.pairs().collect()))
        assert nd.family is not None and nd.family.count() > 50
        assert not got - want and len(got) >= 0.98 * len(want) and rebuilt(nd) == got


def test_texts_of_one_template_take_linear_work(spark):
    n = 20_000
    df = spark.createDataFrame([(*r, "x") for r in templates(random.Random(5), n, 0)], COLS)
    nd = neardup.NearDuplicates(df)
    assert nd.met.count() <= 3 * neardup.BANDS * n
    classes = nd.classes()
    largest = classes.groupBy("class_id").count().agg({"count": "max"}).head()[0]
    assert largest >= 0.99 * n and nd.links.count() <= 0.02 * n * n / 2
    assert nd.pairs().select("id_b").distinct().count() == n - 1


def test_groups_are_connected_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 10), (10, 11), (11, 12), (12, 13), (13, 9), (20, 30), (30, 25), (25, 24), (24, 50)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, **{k: 9 for k in range(9, 14)}, 20: 20, 24: 20, 25: 20, 30: 20, 50: 20}


def test_bounds_of_the_posterior():
    need = neardup.fewest_agreements(0.7)
    assert all(a < b for a, b in zip(need, need[1:])) and all(0.6 < m / (64 * (k + 1)) < 0.85 for k, m in enumerate(need))
