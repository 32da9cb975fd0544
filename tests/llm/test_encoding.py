import random
import re
from pathlib import Path

import pytest

from millrace.llm import encoding as en

SENTENCES = [
    "Für uns prüft der Schlüssel die übrigen Gewichte außerhalb der Übungsphase, und zwar täglich.",
    "Häufig erklärt die Verlustkurve das Gedächtnis zugunsten der Qualität für kürzere Texte.",
    "Après coup, l’étape d’échauffement protège le résumé précédent malgré la limite, à ce stade.",
    "Côté élève, la tâche vérifie les étiquettes dès le début et répète l’entrée près du seuil.",
    "Quizá, el máximo explicó las señales débiles durante la mañana según la línea básica.",
    "También, la revisión añadió el párrafo inicial después del último tramo, más allá del límite.",
    "Não raro, a função também moveu as lições do mês até o fim da pressão, então o órgão copiou.",
    "Często próg opóźnia świeże dane w późniejszej fazie ćwiczeń, zgodnie z wyraźną ścieżką zapisu źródła.",
    "Dziś wątek główny śledzi żadną z masek, już od środy łączy małą próbkę i długi zapis.",
    "Потом планировщик объясняет старые метки без видимой причины, то есть сокращает границы абзацев.",
    "На практике редактор проверяет половину корпуса согласно сводке и хранит лишние копии.",
    "We call the queue “closed filter” since it — as planned — isn’t shadowing the scale… It costs 5 € per run.",
    "Šíře Ñandú Ångström Ðerep Øre – The funnel overlaps some steps.",
    "© ® ™ † ‡ ° ± ² ³ µ ¶ · ¼ ½ ¾ Below this line the curriculum pads.",
    "σ(x) ≈ 12 ∑ √π → ∞, every valve pads. ✅ 😀 └────┴─────┘",
]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    sample = []
    for s in SENTENCES:
        w = s.split()
        for _ in range(25):
            a = rng.randint(0, max(0, len(w) - 6))
            sample.append(" ".join(w[a : a + rng.randint(5, 14)]))
        sample.append(s)
    return en.Classifier(sorted(set(sample)))


@pytest.mark.parametrize("chain", [c for c in en.chains() if c.strict and not c.lost], ids=lambda c: c.name)
def test_round_trip_of_utf8_chains(model, chain):
    for s in SENTENCES[:12]:
        bad = chain.garble(s)
        if bad is None:
            continue
        (found,) = model.look([bad])
        assert found
        # chunks between blanks are restored; where a wrong character is itself a blank they are not told apart
        (_, back) = found[next(iter(found))]
        assert all(good in s for good in back.values())


@pytest.mark.parametrize("real,assumed,k", [("cp1251", "cp1252", 9), ("koi8_r", "cp1251", 10), ("cp866", "cp1251", 9), ("iso8859_2", "cp1250", 7), ("cp1250", "cp1252", 8)])
def test_one_byte_chains(model, real, assumed, k):
    bad = en.Chain("x", [(real, assumed)]).garble(SENTENCES[k])
    (found,) = model.look([bad])
    (name, back), = found.values()
    assert name in (f"{real}>{assumed}", f"{real}>latin_1") and set(back.values()) <= set(SENTENCES[k].split())


def test_lost_characters_are_found_but_not_restored(model):
    bad = SENTENCES[1].encode("cp1252").decode("utf_8", "replace")
    (found,) = model.look([bad])
    assert [b for _, b in found.values()] == [{}]


@pytest.mark.parametrize("text", [*SENTENCES, *[s.upper() for s in SENTENCES], "If you see “Ã©” in a shard, decode it again.", "The reader puts � where bytes are invalid;", "plain ASCII", "", None])
def test_sound_texts(model, text):
    assert model.look([text]) == [{}]


def test_operator_on_a_table(spark):
    rows = [(k, s, "x") for k, s in enumerate(SENTENCES * 8)]
    bad = "Erste Zeile ist gut.\n" + SENTENCES[0].encode().decode("cp1252") + " " + SENTENCES[1]
    rows += [(900, bad, "x"), (900, bad, "x"), (901, None, "x"), (902, "", "x"), (None, SENTENCES[4].encode().decode("latin_1"), "x"), (903, "word " * 200_000 + SENTENCES[2].encode().decode("cp1252"), "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, chains string")
    assert sorted(str(r.doc_id) for r in en.repair(df, found_only=True).collect()) == ["900", "903", "None"]
    fixed = {r.doc_id: r for r in en.repair(df).collect()}
    assert fixed[900].text == "Erste Zeile ist gut.\n" + SENTENCES[0] + " " + SENTENCES[1] and fixed[900].chains == ["utf_8>cp1252"]
    assert fixed[903].text.endswith(SENTENCES[2]) and (fixed[900].restored, fixed[900].lost) == (1, 0)
    assert en.repair(spark.createDataFrame([], df.schema), found_only=True).collect() == []


def sentences(path, seed):
    import pyarrow.parquet as pq

    texts = pq.read_table(path, columns=["text"]).column("text").to_pylist()
    random.Random(seed).shuffle(texts)
    return sorted({s for t in texts[:6000] if t and not t.isascii() for s in en.parts(t)[:3] if len(s) <= 400})


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").is_dir(), reason="no test tables here")
def test_every_chain_is_found_and_restored_on_held_out_sentences():
    model = en.Classifier(sentences("/root/testdata/sf0.01/documents.parquet", 1))
    clean = [s for s in sentences("/root/testdata/sf0.1/documents.parquet", 2)]
    clean = [s for s, x in zip(clean, model.look(clean)) if not x]
    random.Random(3).shuffle(clean)
    for c in model.chains:
        cases = [(s, g) for s in clean if (g := c.garble(s)) is not None and g != s and (c.restore(g) == s or c.lost and "�" in g)][:200]
        assert len(cases) == 200, c.name
        got = model.look([g for _, g in cases])
        named = restored = 0
        for (s, g), found in zip(cases, got):
            names = set()
            for p, (name, back) in found.items():
                names |= {name, *model.equal(en.chunks(p), back)}
                g = g.replace(p, "".join(back.get(w, w) for w in re.split(r"([ \t\n\r\f\v]+)", p)))
            named, restored = named + (c.name in names), restored + (g == s)
        assert sum(map(bool, got)) >= 180, c.name
        assert c.lost or named >= 180 and restored >= 180, c.name


@pytest.mark.parametrize("text", ["σ(x) ≈ 1507 ∑ √π → ∞, that narrow chunk unblocks.", "Elle a dû ôter “ça” — l’été, à côté…", "Größe „Über“ – ÖPNV", "� at the end", "a·b = c·d für große Öle"])
def test_rare_but_proper_characters(text):
    model = en.Classifier(SENTENCES * 2)
    assert model.look([text]) == [{}]
