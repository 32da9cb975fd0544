import random
from pathlib import Path

import pytest

from millrace.llm import language, pairs

EN = "the quick model reads every line of the long file and writes the answer to the table while the loader waits for the next batch"
DE = "das schnelle Modell liest jede Zeile der langen Datei und schreibt die Antwort in die Tabelle, während der Lader auf den Stapel wartet"
FR = "le modèle rapide lit chaque ligne du long fichier et écrit la réponse dans la table pendant que le chargeur attend le prochain lot"
COLS = "message_id bigint, conv_id bigint, turn bigint, role string, content string, defect string"
ITEMS = ["- lower the table behind the lane", "- raise the batch under the long loader", "- count the lane near the file", "- split the model past the batch"]


def docs(spark):
    rows = [(k, f"{EN} {k}", "en-GB") for k in range(20)] + [(k, f"{DE} {k}", "DE") for k in range(20)] + [(k, f"{FR} {k}", "fr") for k in range(20)]
    return spark.createDataFrame([*rows, (1, None, "en"), (2, EN, None)], "doc_id bigint, text string, lang string")


def found(spark, rows):
    # Enough sound replies to learn from how lines end.
    base = [(9000 + k, "assistant", f"The loader waits for line {k}. It reads the file.\nThe model writes the table.") for k in range(40)]
    base += [(9100 + k, "assistant", "\n".join(ITEMS[(k + j) % 4] for j in range(4))) for k in range(40)]
    m = [(c, c, 1, r, t, "x") for c, r, t in base]
    m += [(k, *r, "x") for k, r in enumerate(rows)]
    return {(r.conv_id, r.turn): r.defect for r in pairs.defective_pairs(spark.createDataFrame(m, COLS), docs(spark)).collect()}


def pair(conv, prompt, reply):
    return [(conv, 1, "Human", prompt), (conv, 2, " GPT ", reply)]


@pytest.mark.parametrize("reply", [None, "", " \n\t", "​﻿", "<p></p>", "```\n```", "...", "***", "{}", '""', "N/A", "(empty)", "[no answer]", "TBD", "None", "<answer></answer>"])
def test_empty(reply):
    assert pairs.is_empty(reply)


@pytest.mark.parametrize("reply", ["No.", "0", "yes", "x", "The answer is null because it is not set.", "Es gibt keine."])
def test_not_empty(reply):
    assert not pairs.is_empty(reply)


@pytest.mark.parametrize("reply", ["I'm sorry, but I can't help with that.", "Request declined. Nothing further can be provided.", "Diese Anfrage muss ich ablehnen.", "Je préfère ne pas répondre à cette demande.", "Извините, я не могу с этим помочь.", "i cant do that", "Lo siento, no puedo ayudar con eso. Please rephrase."])
def test_refusal(reply):
    assert pairs.is_refusal(reply)


@pytest.mark.parametrize("reply", ["As a rule I won't touch frozen layers. " + EN + ".", "You can't and shouldn't skip it. " + EN, "The launcher refuses to start without a manifest.", "I can't answer the first part, but " + EN + ". " + EN])
def test_no_refusal(reply):
    assert not pairs.is_refusal(reply)


def test_long_refusals_and_short_copies():
    sorry = "I am very sorry about this, and I do understand that it is not what you were hoping to read from me today after all the work that you have put in. "
    assert pairs.is_refusal("I can't help with that. " + sorry * 6) and pairs.is_refusal(sorry * 4 + "I cannot assist with this request.")
    assert not pairs.is_refusal(sorry + "The loader waits for the next batch. It reads every line of the file. Then it writes the table and stops.")
    assert not pairs.is_refusal("The loader waits. It reads. I can't say more.") and not pairs.is_refusal("I can't help with the first. " + EN * 9)
    assert pairs.is_copy("Why?", "why") and pairs.is_copy("Go on", "Go on.") and not pairs.is_copy("Why?", "Because") and not pairs.is_copy("?", "!")


@pytest.mark.parametrize("n", [1, 20, 700])
def test_an_item_cut_inside_a_word_at_any_sample_size(n):
    ends = pairs.EndModel(["\n".join(ITEMS)] * n)
    assert ends.score("- split the model past the batc") <= -2.0


def test_copy_and_answer_after_repeating():
    q = "Why does the long loader wait for the next batch of lines?"
    assert pairs.is_copy(q, q.lower()) and pairs.is_copy(q, "You ask: " + q) and pairs.is_copy(q, q.replace("long", "odd"))
    assert not pairs.is_copy(q, f"> {q}\n\n{EN}") and not pairs.is_copy(q, "Because it must.") and not pairs.is_copy(q, "")


def test_defects_of_pairs(spark):
    code = "```python\ndef f(x):\n    return x\n```"
    rows = []
    cases = [
        (1, EN + "?", "It waits for the loader.", None),
        (2, EN + "?", "...", "empty"),
        (3, EN + "?", EN, "copy"),
        (4, EN + "?", "I cannot assist with this request.", "refusal"),
        (5, EN + "?", DE + ".", "language"),
        (6, "Translate into German: " + EN, DE + ".", None),
        (7, EN + "?", "It waits for the loader. Then the model reads the", "truncated"),
        (8, "Write a function. " + EN, code, None),
        (9, "Write a function. " + EN, code[:-4], "truncated"),
        (10, "List what to check. " + EN, "\n".join(ITEMS), None),
        (11, "List what to check. " + EN, "\n".join(ITEMS[:3]) + "\n- split the", "truncated"),
        (12, "How many? " + EN, "88", None),
        (13, "I found this line: " + FR + ". Why? " + EN + ". What does it do when the loader waits for the file?", "It waits for the loader and reads the file.", None),
        (14, None, "It waits for the loader.", None),
    ]
    for c, p, r, _ in cases:
        rows += pair(c, p, r)
    # The closest earlier row decides, also one of null role; delivered again and gaps change nothing.
    rows += [(20, 1, "user", "q"), (20, 3, None, "x"), (20, 4, "assistant", "")]
    rows += [(21, 1, "user", "q"), (21, 7, "model", ""), (21, 7, "model", "")]
    rows += [(22, 1, "assistant", ""), (23, 1, "user", "q"), (23, 2, "assistant", "ok."), (23, 3, "assistant", "")]
    rows += [(None, 1, "user", "q"), (None, 2, "bot", ""), (24, None, "user", "q"), (24, 2, "bot", "")]
    got = {k: v for k, v in found(spark, rows).items() if k[0] < 9000}
    want = {(c, 2): d for c, _, _, d in cases if d} | {(21, 7): "empty"}
    assert got == want


def test_a_long_conversation_is_paired_across_windows(spark):
    n = 3 * pairs.TURNS + 10
    rows = [(1, k, "user" if k % 2 else "assistant", "q" if k % 2 else "") for k in range(n)]
    got = [k for k in found(spark, rows) if k[0] < 9000]
    assert sorted(got) == [(1, k) for k in range(2, n, 2)]


def test_empty_tables(spark):
    m, d = spark.createDataFrame([], COLS), spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert pairs.defective_pairs(m, d).collect() == []


def test_language_model_on_held_out_text():
    sample = [("en", f"{EN} {k}") for k in range(9)] + [("de", DE)] * 9 + [("fr", FR)] * 9 + [("fr", EN)]
    m = language.LanguageModel(sample)
    texts = ["the table of the model", "die Antwort der langen Zeile", "la ligne du fichier et le lot"]
    assert [m.names[k] for k in m.scores(texts).argmax(axis=1)] == ["en", "de", "fr"]


# Phrasings that are none of the labelled examples, in languages of the data and two others.
HELD_OUT = """
I apologize, but I must refrain from discussing this matter.
This is a subject I have been asked not to touch.
Unfortunately I can't offer any guidance on that.
I'm declining to reply to this message.
Giving an answer here would break the rules I follow.
Sorry, I don't discuss things like this.
I would prefer not to respond.
It's not appropriate for me to give an opinion on this.
I am restricted from sharing anything about it.
There is nothing I am permitted to say about this.
I shall not answer this.
Please don't ask me about this, I'm not able to help.
Leider bin ich nicht berechtigt, darauf zu antworten.
Auf solche Anfragen gehe ich nicht ein.
Ich muss Ihre Bitte leider ablehnen.
Das zu beantworten ist mir nicht gestattet.
Je suis désolé, mais je dois décliner votre demande.
Il m’est impossible de vous répondre sur ce point.
Je ne donnerai pas d’avis là-dessus.
Mes consignes ne me permettent pas d’en parler.
Me temo que no puedo dar una respuesta a eso.
No me corresponde opinar sobre esta cuestión.
Debo negarme a responder a esa pregunta.
Mis normas no me permiten tratar ese tema.
Receio não poder dar uma resposta a isso.
Não me cabe opinar sobre esta questão.
Devo negar-me a responder a essa pergunta.
As minhas normas não me permitem tratar esse tema.
Obawiam się, że nie mogę na to odpowiedzieć.
Nie chcę wypowiadać się na ten temat.
Moje wytyczne nie pozwalają mi o tym mówić.
Боюсь, я не могу дать ответ на это.
Не хочу высказываться на эту тему.
Мне не позволено давать такие сведения.
Temo di non poter rispondere.
Le mie regole non me lo permettono.
Ik kan hier helaas niet op ingaan.
Dat mag ik u niet vertellen.
Sorry, this request violates our content policy.
I am not permitted to disclose that.
That's not something I'm willing to get into.
I do not provide opinions on such matters.
""".strip().splitlines()
SOUND = """
I would say it is the scheduler.
I'm afraid the disk is full.
You have to decline the invitation in the dialog.
The request was refused by the proxy because the token expired.
We can't answer that without the logs, but the likely cause is a lost shard.
Sorry, I meant the other flag.
It does not help to restart the loader.
My advice is to lower the rate.
Es tut nicht weh, den Lauf neu zu starten.
Das Modell kann die Frage beantworten.
Le serveur ne répond pas à la demande.
El servidor no responde a la petición.
O servidor não responde ao pedido.
Serwer nie odpowiada na prośbę.
Сервер не отвечает на запрос.
No.
Not yet.
Nothing was written to the log.
None of them.
I can't see the second plot in the report.
They are not permitted by the parser.
This is not supported on Windows.
The policy network is trained first.
Il modello non converge.
Je ne vois pas d’erreur dans le journal.
No veo ningún error en el registro.
Não vejo nenhum erro no registo.
Nie widzę błędu w dzienniku.
Не вижу ошибки в журнале.
Ich sehe keinen Fehler im Protokoll.
""".strip().splitlines()


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="no test tables here")
def test_refusals_in_other_words():
    import pyarrow.parquet as pq

    from millrace.llm import refusals

    replies = pq.read_table("/root/testdata/sf0.01/messages.parquet", columns=["content"]).column("content").to_pylist()
    said = sorted({s for r in replies if r for s in pairs.sentences(r)[: pairs.SENTENCES]})
    m = refusals.RefusalModel([s for s in said if not pairs._REFUSAL.search(s)], [s for s in said if pairs._REFUSAL.search(s)])
    caught = [s for s in HELD_OUT if pairs.is_refusal(s, said=[s], score=m.scores([s]).tolist())]
    assert len(caught) >= 0.9 * len(HELD_OUT), set(HELD_OUT) - set(caught)
    wrong = [s for s in SOUND if pairs.is_refusal(s, said=[s], score=m.scores([s]).tolist())]
    assert len(wrong) <= 0.1 * len(SOUND), wrong
    assert not set(HELD_OUT) & {*refusals.DECLINING, *refusals.made()}
    assert m.scores([]).tolist() == [] and not m.declines("") and not m.declines("?") and not m.declines("x " * 100_000)


@pytest.mark.parametrize("reply", ["[redacted]", "(no reply given)", "Coming soon.", "[your answer here]", "<!-- " + "x" * 1000 + " -->", "&nbsp;" * 300, "_N/A_"])
def test_placeholders(reply):
    assert pairs.is_empty(reply)


@pytest.mark.parametrize("reply", ["(yes)", "Nothing is missing here.", "not yet", "The output is empty.", "It is pending review.", "No reply arrived before noon."])
def test_no_placeholders(reply):
    assert not pairs.is_empty(reply)


def test_cut_replies_by_kind():
    rng = random.Random(4)
    nouns, verbs, adjectives = ("loader batch table file model lane queue shard".split(), "reads writes counts splits holds moves".split(), "long old small spare".split())
    sentence = lambda: f"The {rng.choice(adjectives)} {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} in the {rng.choice(adjectives)} {rng.choice(nouns)}."
    item = lambda: f"- {rng.choice(verbs)} the {rng.choice(adjectives)} {rng.choice(nouns)} near the {rng.choice(adjectives)} {rng.choice(nouns)}"
    prose = lambda: "\n".join(" ".join(sentence() for _ in range(3)) for _ in range(2))
    items = lambda: "\n".join(item() for _ in range(4))
    ends = pairs.EndModel([f() for _ in range(300) for f in (prose, items)])
    for make in (prose, items):
        whole = [make() for _ in range(100)]
        assert not any(map(ends.is_truncated, whole))
        cut = [w[: rng.randint(len(w) // 2, len(w) - 2)].rstrip() for w in whole]
        cut = [c for c, w in zip(cut, whole) if c[-1] not in "." and w[len(c)] != "\n"]
        assert sum(map(ends.is_truncated, cut)) >= 0.9 * len(cut)
    assert ends.is_truncated("```\nx = 1\n") and ends.is_truncated("The loader reads `--bat") and ends.is_truncated(items() + "\n-")


def test_long_texts_teach_too(spark):
    """Before, replies and documents above 20,000 characters were left out of all models."""
    d = [(k, f"{EN} {k}", "en") for k in range(20)] + [(k, "\n".join([FR] * 200), "fr") for k in range(3)]
    m = [(k, k, 1, "assistant", "The loader waits for the line. It reads the file.\nThe model writes the table.\n" * 300, "x") for k in range(3)]
    rows = [*pair(10, EN + "?", "It waits for the loader. It reads the file."), *pair(11, FR + " ?", EN + ".")]
    m += [(k, *r, "x") for k, r in enumerate(rows)]
    got = pairs.defective_pairs(spark.createDataFrame(m, COLS), spark.createDataFrame(d, "doc_id bigint, text string, lang string")).collect()
    assert {(r.conv_id, r.turn): r.defect for r in got} == {(11, 2): "language"}


def test_models_of_all_files_are_those_of_all_rows_in_memory(spark, tmp_path):
    """Before, they came from 64 files, 12,000 replies, four sentences of each and 3,000 documents."""
    import numpy as np

    from millrace.llm import ends, refusals

    rng = random.Random(7)
    words = [*EN.split(), *DE.split(), "I", "can't", "help", "with", "that.", "sorry", "end.", "(end.)", "5", "1.5,", "`x`", "\u00a0"]
    line = lambda: rng.choice(["", "- ", "3. ", "* "]) + " ".join(rng.choices(words, k=rng.randint(1, 20)))
    replies = ["\n".join(line() for _ in range(rng.randint(1, 7))) for _ in range(280)] + ["", "I can't help with that. " * 3, "```\nx\n```\n" + EN]
    labelled = [(lang, f"{text} {line()}") for lang, text in (("en", EN), ("de", DE), ("fr", FR)) for _ in range(30)] + [("fr", EN)]
    spark.createDataFrame([(t,) for t in replies], "content string").repartition(70).write.parquet(str(tmp_path / "m"))
    spark.createDataFrame(labelled, "lang string, text string").repartition(70).write.parquet(str(tmp_path / "d"))
    table, docs = spark.read.parquet(str(tmp_path / "m")), spark.read.parquet(str(tmp_path / "d"))
    assert len(table.inputFiles()) > 64

    want = language.LanguageModel(labelled)
    got = language.train(docs)
    assert got.names == want.names and (got.log == want.log).all()

    said = {s for r in replies for s in pairs.sentences(r)}
    assert {r.s for r in pairs.sentences_of(table).collect()} == said
    told = {s for s in said if pairs._REFUSAL.search(s)}
    assert told and (pairs.train_refusals(table).odds == refusals.RefusalModel(sorted(said - told), sorted(told)).odds).all()

    want = pairs.EndModel(replies)
    counts = ends.counted(table.unionByName(table))  # copies change nothing
    assert want.counts == pairs.EndModel(replies * 3).counts
    model, known = ends.fitted(counts)
    assert (model.share == want.share).all() and (model.size == want.size).all() and known.count() > 0
    lines = sorted({x for r in replies for x in r.split("\n") if x.strip()} | {EN, "- unknown", "Odd end?"})
    items, n, keys = ends.last_contexts(lines, ends.Tokens())
    rows = spark.createDataFrame([(bool(a), int(b), *map(int, k)) for a, b, k in zip(items, n, keys.T)], "item boolean, n bigint, k0 bigint, k1 bigint, k2 bigint")
    found = {tuple(r) for r in ends.truncated(rows, counts).collect()}
    cut = np.array([want.score(x) < 0 for x in lines])
    assert 0 < cut.sum() < len(lines)
    assert [(bool(a), int(b), *map(int, k)) in found for a, b, k in zip(items, n, keys.T)] == cut.tolist()


def test_the_line_ends_counted_as_they_were():
    """The counts of contexts against a plain count with words."""
    from collections import Counter

    from millrace.llm import ends

    rng = random.Random(3)
    words = ["the", "The", "end", "5", "1.5", "`x y`", ".", "!", ".)", '."', "*", "_a", ","]
    replies = ["\n".join(rng.choice(["", "- "]) + " ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 5))) for _ in range(60)]

    def tokens(line):
        out = []
        item, found = ends._split(line)
        for t in map(ends._norm, found):
            if t in ends.CLOSERS and out and out[-1] in ends.STOPS:
                out[-1] += t
            else:
                out.append(t)
        return item, out

    seen, ended = Counter(), Counter()
    for r in replies:
        lines = [x for x in r.split("\n") if x.strip()]
        for k, line in enumerate(lines):
            item, own = tokens(line)
            whole = k + 1 < len(lines) and (not item or tokens(lines[k + 1])[0])
            for i in range(len(own)):
                for lo in range(i, max(i - 3, -1), -1):
                    if i + 1 < len(own) or whole:
                        seen[item, *own[lo : i + 1]] += 1
                        ended[item, *own[lo : i + 1]] += i + 1 == len(own)
    found = Counter()
    for key, _, n, e, _ in ends.count([replies]):
        for k, a, b in zip(key.tolist(), n.tolist(), e.tolist()):
            found[k] += complex(a, b)
    got = sorted((int(v.real), int(v.imag)) for k, v in found.items() if k not in ends.FIXED and v)
    assert got == sorted((n, ended[k]) for k, n in seen.items())


def test_the_search_of_batches_misses_nothing():
    rng = random.Random(5)
    parts = ["I", "can't", "İ", "ı", "won’t", "help", "\u00a0", " ", "ASSIST", "aſſist", "with", "that", "je", "ne", "peux", "aider", "ich", "kann", "nicht", "helfen", "désolé", "sorry", "I understand", "не", "могу", "помочь", "No", "comment", "\x1c", "\u2003", "ma\u212ae", "puedo", "ayudar"]
    said = ["".join(x + rng.choice([" ", "", "\u00a0", "  "]) for x in rng.choices(parts, k=rng.randint(1, 8))) for _ in range(20_000)] + HELD_OUT + SOUND
    for s, (refuses, excuses) in zip(said, pairs.may_be(said)):
        assert refuses or not pairs._REFUSAL.search(s)
        assert excuses or not pairs._EXCUSE.search(s)
    assert sum(bool(pairs._REFUSAL.search(s)) for s in said) > 20
