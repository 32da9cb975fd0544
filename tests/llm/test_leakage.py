import random

import pytest

from millrace.llm import leakage
from millrace.llm.words import words

ITEM = "item_id bigint, context string, choices array<string>, task string, doc_id bigint"
DOC = "doc_id bigint, text string, item_id string"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], DOC)
    q = spark.createDataFrame([(i, c, ch, "t", 7) for i, c, ch in items], ITEM)
    return sorted(map(tuple, leakage.find_leaks(d, q, **kw).collect()))


def brute(docs, items, run=10):
    out = set()
    for i, c, ch in items:
        for x in ch or [""]:
            w = words(f"{c or ''} {x or ''}")
            have = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
            for j, t in docs:
                v = words(t or "")
                if j is not None and i is not None and any(tuple(v[k : k + run]) in have for k in range(len(v) - run + 1)):
                    out.add((j, i))
    return sorted(out)


@pytest.mark.parametrize(
    "text",
    [
        PASSAGE.upper(),
        PASSAGE.replace(" ", ",\n> "),
        PASSAGE.replace("seven", "se-\nven"),
        PASSAGE.replace("seven", "se­ve​n"),
        PASSAGE.replace(" ", "&nbsp;").replace("six", "<b>s</b>ix"),
        "<p>" + PASSAGE.replace(" ", "<br/>") + "</p>",
        "_" + PASSAGE.replace(" ", "_ **") + "**",
    ],
)
def test_spelling_of_the_passage_does_not_matter(spark, text):
    assert found(spark, [(1, f"before {text} after")], [(5, PASSAGE, [" last"])]) == [(1, 5)]


def test_run_must_be_ten_words_within_one_reading_of_the_item(spark):
    items = [(1, "a b c d e f", [" g h i j", " k l m n"])]
    docs = [(1, "a b c d e f g h i j"), (2, "a b c d e f k l m n"), (3, "a b c d e f g h i x"), (4, "c d e f g h i j k l m n"), (5, "f g h i j k l m n o")]
    assert found(spark, docs, items) == [(1, 1), (2, 1)]


def test_nulls_repeats_and_empty_tables(spark):
    docs = [(1, None), (2, ""), (None, PASSAGE), (3, PASSAGE), (3, PASSAGE), (4, "short")]
    items = [(1, PASSAGE, None), (1, PASSAGE, None), (2, None, [None, PASSAGE]), (3, None, None), (None, PASSAGE, []), (4, PASSAGE, [])]
    assert found(spark, docs, items) == [(3, 1), (3, 2), (3, 4)]
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_against_brute_force_also_in_blocks(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choice(vocab[:6]) if rng.random() < 0.7 else rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.randint(0, 25)), [" " + text(rng.randint(0, 8)) for _ in range(rng.randint(0, 3))]) for k in range(30)]
    docs = []
    for k in range(200):
        parts = [text(rng.randint(0, 12))]
        if rng.random() < 0.5:
            w = items[rng.randrange(30)][1].split()
            a = rng.randint(0, 5)
            parts += [" ".join(w[a : a + rng.randint(8, 16)]), text(5)]
        docs.append((k, " ".join(parts)))
    want = brute(docs, items)
    assert want and found(spark, docs, items) == want and found(spark, docs, items, block=40) == want


def test_a_hot_passage_in_a_third_of_all_documents(spark):
    docs = [(k, PASSAGE if k % 3 == 0 else f"other words {k} here") for k in range(900)]
    assert found(spark, docs, [(1, PASSAGE, [])]) == [(k, 1) for k in range(0, 900, 3)]


def test_very_long_text(spark):
    assert found(spark, [(1, "pad words " * 100_000 + PASSAGE)], [(1, PASSAGE, [" x"])]) == [(1, 1)]


def test_a_long_item_may_lie_in_several_blocks(spark, monkeypatch):
    words = [f"w{k}" for k in range(300)]
    items = spark.createDataFrame([(1, " ".join(words), ["x"]), (2, " ".join(words[50:90]), None)], "item_id bigint, context string, choices array<string>")
    docs = spark.createDataFrame([(k, "a b " + " ".join(words[k : k + 12]) + " c d") for k in range(0, 280, 7)] + [(900, " ".join(words[10:19])), (901, None)], "doc_id bigint, text string")
    want = {(k, 1) for k in range(0, 280, 7)} | {(k, 2) for k in range(0, 280, 7) if any(50 <= a and a + 10 <= 90 for a in range(k, k + 3))}
    for block in (10**6, 60):
        got = [tuple(r) for r in leakage.find_leaks(docs, items, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
