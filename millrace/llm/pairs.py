"""Prompts whose reply is no proper reply (problem 2).

Empty replies and copies are told by their words, refusals by character n-gram naive Bayes over sentences, which a lexicon of declining words labels. Language is compared by the posteriors of prompt and reply under character
n-gram naive Bayes. A reply is truncated if an n-gram model of how lines of prose and list items end finds its last
tokens likelier inside a line than at the end of one, or if it stops inside a block of code. The models are fitted on all
labelled documents and all replies.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import ends, language, refusals
from millrace.llm.counts import summed
from millrace.llm.ends import INVISIBLE, WORD, EndModel  # noqa: F401
from millrace.llm.turns import speaker
from millrace.runtime import cut, small

#: Nats for declining from which the lexicon is asked too.
DOUBT = -25.0
#: Sentences of each reply that the model of refusals is fitted on: all.
SENTENCES = None
#: Nats by which a language must be likelier than the other's, for the prompt and for the reply.
LANGUAGE_MARGIN = 12.0
#: Letters that a reply must have, beside code and quotations, for its language to be judged.
LANGUAGE_LETTERS = 12
#: A conversation is paired in windows of so many turns, so that a hot one isn't sorted in one task.
TURNS = 1024

_MARKUP = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|&[A-Za-z#0-9]+;", re.S)
#: Words of what stands in place of a reply, and words that may stand beside them there.
PLACEHOLDERS = frozenset(
    "null none nil nan undefined tbd tba todo empty blank placeholder missing unavailable answer response reply redacted pending omitted removed deleted lorem ipsum".split()
)
BESIDE = frozenset("no not a an n the your insert here content output data text available provided given left intentionally to be yet is was has been dolor sit amet coming soon follow added".split())
#: Whole replies of these words are placeholders too.
STANDINS = frozenset("na|n a|no content|no output|no data|no text|not available|not provided|coming soon|to be added|to follow|your text here|insert text here|no text provided|no content available".split("|"))

#: Words that decline, in the seven languages of the data. ACT is what is declined.
_ACT = (
    r"(?:help|assist|answer|respond|reply|comment|discuss|talk|speak|say|share|weigh|look\s+into|explain|give|go\s+into|provide|offer|engage|advise|address|fulfil|comply|continue|support|do\s+that|do\s+this)"
)
_NOT = r"(?:can\W{0,2}t|cannot|can\s+not|won\W{0,2}t|will\s+not|am\s+(?:not\s+able|unable)\s+to|m\s+(?:not\s+able|unable)\s+to|have\s+to\s+refuse\s+to|must\s+refuse\s+to|refuse\s+to|decline\s+to|d\s+rather\s+not|would\s+rather\s+not|prefer\s+not\s+to)"
REFUSALS = [
    rf"\bi\W{{0,2}}\s*{_NOT}\s+(?:\w+\s+){{0,2}}?{_ACT}\b",
    rf"\b(?:something|a\s+(?:topic|subject|matter))\s+(?:that\s+)?i\W{{0,2}}\s*{_NOT}\s+{_ACT}\b",
    r"\bi\s+(?:must|have\s+to|will\s+have\s+to|need\s+to)\s+(?:respectfully\s+|politely\s+)?(?:decline|refuse|pass)\b",
    r"\bi\s+(?:do\s+not|don\W?t)\s+(?:have\s+(?:the\s+)?(?:permission|authori[sz]ation)|feel\s+comfortable)\b",
    r"\b(?:have\s+no\s+way|not\s+my\s+place|not\s+(?:be\s+)?appropriate\s+for\s+me|not\s+in\s+a\s+position)\s+to\b",
    r"\b(?:isn\W?t|is\s+not)\s+possible\s+for\s+me\b|\boutside\s+(?:of\s+)?what\s+i\s+(?:may|can|am)\b|\bkeeps?\s+me\s+from\b|\bagainst\s+my\s+(?:guidelines|policy|rules)\b",
    r"^\W*no\s+comment\b|\brequest\s+(?:declined|denied|refused)\b",
    r"\bich\s+(?:\w+\s+){0,3}?nicht\s+(?:helfen|beantworten|sagen|antworten|äußern)\b|\bmuss\s+ich\s+(?:\w+\s+){0,2}?ablehnen\b|\b(?:darf|kann|möchte|werde)\s+ich\s+(?:\w+\s+){0,4}?(?:nichts|nicht)\b|\bäußere\s+ich\s+mich\s+\w*\s*nicht\b",
    r"\bje\s+(?:ne\s+(?:peux|veux|souhaite|suis\s+pas\s+en\s+mesure)\b[^.]{0,30}\b(?:aider|répondre|parler|commenter|dire)|préfère\s+ne\s+pas)\b|\bil\s+ne\s+m\W?est\s+pas\s+permis\b|\bje\s+dois\s+(?:refuser|décliner)\b",
    r"\bno\s+(?:puedo|quiero)\s+(?:\w+\s+)?(?:ayudar|responder|hablar|comentar|decir)|\bprefiero\s+no\b|\bno\s+me\s+está\s+permitido\b|\b(?:debo|tengo\s+que)\s+(?:rechazar|negarme|declinar)\b",
    r"\bnão\s+(?:posso|quero)\s+(?:\w+\s+)?(?:ajudar|responder|falar|comentar|dizer)|\bprefiro\s+não\b|\bnão\s+me\s+é\s+permitido\b|\b(?:devo|tenho\s+(?:de|que))\s+(?:recusar|declinar)\b",
    r"\bnie\s+mogę\s+(?:\w+\s+){0,3}?(?:pomóc|odpowiedzieć|rozmawiać|mówić|komentować)|\bwolę\s+nie\b|\bmuszę\s+odmówić\b|\bnie\s+wolno\s+mi\b",
    r"\bне\s+могу\s+(?:\w+\s+){0,4}?(?:помочь|ответить|отвечать|говорить|обсуждать|комментировать)|\bпредпочту\s+не\b|\bмне\s+нельзя\b|\bвынужден\w*\s+отказать",
]
_REFUSAL = re.compile("|".join(REFUSALS), re.I)
_STOP = re.compile(r"(?<=[.!?])\s+|\n+")
#: Apologies, and reasons that speak of the one who declines, as refusals have around them.
_EXCUSE = re.compile(
    r"\b(?:sorry|apologi[sz]e|apolog(?:y|ies)|regret|my\s+(?:guidelines|policy|policies|rules|instructions)|(?:i|we)\s+(?:do\s+)?understand|i\s+(?:realise|realize|know)\s+(?:that\s+)?this|thank\s+you\s+for|es\s+tut\s+mir\s+leid|entschuldig\w+|désolée?|lo\s+siento|disculp\w+|desculp\w+|lamento|przepraszam|przykro\s+mi|извин\w+|к\s+сожалению)\b",
    re.I,
)


def _superset(pattern: str) -> str:
    """A pattern for RE2 that finds all that `pattern` finds in Python, and more: whole batches are searched with it before."""
    return pattern.replace(r"\b", "").replace(r"\w", r"\S").replace(r"\s", r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ]") + "|[İı]"


_MAY_REFUSE, _MAY_EXCUSE = _superset(_REFUSAL.pattern), _superset(_EXCUSE.pattern)
#: A refusal may be followed by a courtesy, but not by more words than this in other sentences, which would be an answer.
COURTESY = 16
#: Names of languages in the languages of the data, by ISO code, as beginnings of words.
LANGUAGES = {
    "en": "english englisch anglais ingl[eéê]s angielsk английск",
    "de": "german deutsch allemand alem[aáã] niemieck немецк",
    "fr": "french franz[öo]s fran[çc]ais franc[eéê]s francusk французск",
    "es": "spanish spanisch espagnol espa[ñn]ol espanhol castellano hiszpa испанск",
    "pt": "portugu portugies portugalsk португальск",
    "pl": "polish polnisch polonais polaco polon[eê]s polsk польск",
    "ru": "russian russisch russe ruso russo rosyjsk русск",
}
_ASKED = {k: re.compile(r"\b(?:" + "|".join(v.split()) + ")", re.I) for k, v in LANGUAGES.items()}


def is_empty(text: str | None) -> bool:
    """Nothing, only what can't be seen, marks and markup without text, or a placeholder."""
    if text is None:
        return True
    bare = text if text.isascii() else INVISIBLE.sub("", text)
    left = [m[0].lower() for m in islice(WORD.finditer(_MARKUP.sub(" ", bare) if "<" in bare or "&" in bare else bare), 9)]
    if not left:
        return True
    if len(left) > 8:
        return False
    if " ".join(left) in STANDINS or len(left) == 1 and left[0] in PLACEHOLDERS:
        return True
    shown = bare.strip().strip("*_`")
    closed = shown[:1] in "([{<" and shown[-1:] in ")]}>" or len(left) <= 2
    return closed and not PLACEHOLDERS.isdisjoint(left) and PLACEHOLDERS.union(BESIDE).issuperset(left)


@lru_cache(maxsize=1)
def _refusals() -> refusals.RefusalModel:
    """The model of the labelled examples alone."""
    return refusals.RefusalModel()


def sentences(text: str) -> list[str]:
    return [s for s in _STOP.split(text.replace("*", "")) if s.strip()]


def may_be(said: list[str]) -> list[tuple[bool, bool]]:
    """For each sentence, False where the lexicons of refusals and of excuses find nothing in it."""
    own = pa.array(said, pa.string())
    return list(zip(*(pc.match_substring_regex(own, x, ignore_case=True).to_pylist() for x in (_MAY_REFUSE, _MAY_EXCUSE))))


def is_refusal(text: str, prompt: str | None = None, said: list[str] | None = None, score: list[float] | None = None, may: list[tuple[bool, bool]] | None = None) -> bool:
    """The whole reply declines: some sentence does, and what is left beside apologies and reasons is no more than a courtesy, or
    fewer sentences than those and without a longer word of the prompt. said, score and may: its sentences with the scores of a RefusalModel and what may_be() says of them."""
    said = sentences(text) if said is None else said
    score = _refusals().scores(said).tolist() if score is None and said else score
    declines, early, rest, words = False, False, [], 0
    for k, s in enumerate(said):
        if score[k] >= refusals.LEAST or score[k] > DOUBT and (may is None or may[k][0]) and _REFUSAL.search(s):
            declines, early = True, early or k < 2
        elif may is not None and not may[k][1] or not _EXCUSE.search(s):
            rest.append(s)
            words += len(WORD.findall(s))
            if words > COURTESY and 2 * len(rest) > len(said):
                return False
    if not declines:
        return False
    if words <= (COURTESY if early else 0):
        return True
    topic = {w for w in WORD.findall((prompt or "").lower()) if len(w) > 4}
    return bool(topic) and 2 * len(rest) < len(said) and topic.isdisjoint(WORD.findall(" ".join(rest).lower()))


def is_copy(prompt: str, reply: str) -> bool:
    """The prompt again, whole or nearly, perhaps with a lead-in of up to six words, and nothing else."""
    p, r = WORD.findall(prompt.lower()), WORD.findall(reply.lower())
    if len(p) < 3 or len(r) < 3:
        return bool(p) and p == r
    if len(r) > 1.2 * len(p) + 8 or len(r) < 0.6 * len(p):
        return False  # more or fewer words than the rules below allow
    bag = Counter(p)
    common = sum((bag & Counter(r)).values())
    lead = 0
    while lead < min(6, len(r)) and r[lead] not in bag:
        lead += 1
    whole = 0.6 if common >= 0.95 * (len(r) - lead) else 0.7  # word for word, the prompt's last sentence may be missing
    return common >= whole * len(p) and common >= 0.85 * (len(r) - lead) and len(r) - lead <= 1.2 * len(p) + 2


def reply_pairs(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, reply) of each assistant message whose closest earlier row in its conversation is a user message.

    A row delivered again (equal conversation and turn) counts once. Conversations are cut into windows of TURNS turns; a
    window's first row finds its predecessor through a table of the windows' last rows, kept only for longer conversations.
    """
    m = messages.where("conv_id is not null and turn is not null").select(
        "conv_id", "turn", speaker(F.col("role")).alias("who"), "content", F.expr(f"floor(turn / {TURNS})").alias("part")
    )
    w = W.partitionBy("conv_id", "part").orderBy("turn", F.col("who").isNull(), "who", F.col("content").isNull(), "content")
    own = m.select("*", *[F.lag(c).over(w).alias(f"before_{c}") for c in ("turn", "who", "content")])
    good = own.where("who = 'assistant' and before_turn < turn and before_who = 'user'")
    pairs = good.select("conv_id", "turn", F.col("before_content").alias("prompt"), F.col("content").alias("reply"))
    long = cut(m.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("conv_id"))
    if not long.isEmpty():
        rows = m.join(small(long), "conv_id", "left_semi")
        edge = rows.groupBy("conv_id", "part").agg(
            F.min_by(F.struct("turn", "who", "content"), F.struct("turn", F.col("who").isNull(), "who", F.col("content").isNull(), "content")).alias("first"),
            F.max_by(F.struct("who", "content"), F.struct("turn", F.col("who").isNull(), "who", F.col("content").isNull(), "content")).alias("last"),
        )
        step = edge.withColumn("before", F.lag("last").over(W.partitionBy("conv_id").orderBy("part")))
        first = step.where("first.who = 'assistant' and before.who = 'user'")
        pairs = pairs.unionByName(first.select("conv_id", F.col("first.turn").alias("turn"), F.col("before.content").alias("prompt"), F.col("first.content").alias("reply")))
    return pairs


#: What Python calls blank, for Java's patterns.
_BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def sentences_of(replies: DataFrame) -> DataFrame:
    """(s), each different one of sentences() of the replies (content) once."""
    parts = F.split(F.translate("content", "*", ""), rf"(?<=[.!?])[{_BLANK}]+|\n+", -1)
    return replies.select(F.explode(parts).alias("s")).where(F.col("s").rlike(f"[^{_BLANK}]")).distinct()


def train_refusals(replies: DataFrame) -> refusals.RefusalModel:
    """Fit the model of refusals on all different sentences of the replies (content)."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = pc.match_substring_regex(b.column(0), _MAY_REFUSE, ignore_case=True).to_pylist()
            told = [m and _REFUSAL.search(s) is not None for m, s in zip(may, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(told, pa.bool_())], names=["s", "told"])

    said = cut(sentences_of(replies).mapInArrow(label, "s string, told boolean"))
    size = 1 << refusals.BITS
    model = refusals.RefusalModel()

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, size), np.int64)
        for b in batches:
            for told in (0, 1):
                out[told] += model.count([s for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if x == bool(told)])
        return out.ravel()

    n_data, n_told = summed(said, count, 2 * size).reshape(2, size)
    model.fit(n_data, n_told)
    first = replies.sparkSession.sparkContext.broadcast(model)

    def doubted(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(size, np.int64)
        for b in batches:
            own = b.column(0).to_pylist()
            out += first.value.count([s for s, x in zip(own, first.value.scores(own)) if x >= refusals.LEAST])
        return out

    model = refusals.RefusalModel()
    model.fit(n_data - summed(said.where("not told").select("s"), doubted, size), n_told)
    return model


_BREAK = re.compile(r"(?<=[.!?:])\s+|\n+")


def prompt_languages(prompts: list[str], langs: language.LanguageModel) -> list[int | None]:
    """The language most sentences of each prompt are in, of equally many that of the latest; a line quoted in another language doesn't decide."""
    said, own = [], []
    for k, p in enumerate(language.plain(prompts)):
        for s in _BREAK.split(p):
            if len(s) >= LANGUAGE_LETTERS:
                said.append(s.lower())
                own.append(k)
    votes: list[dict[int, int]] = [{} for _ in prompts]
    if said:
        score = langs.scores(said)
        best = score.argmax(axis=1)
        lead = score[np.arange(len(said)), best] - np.partition(score, -2, axis=1)[:, -2] if score.shape[1] > 1 else np.zeros(len(said))
        for k, lang, sure in zip(own, best.tolist(), (lead > LANGUAGE_MARGIN / 2).tolist()):
            if sure:
                n = votes[k].pop(lang, 0)  # put back at the end, so that the latest comes last
                votes[k][lang] = n + 1
    return [max(reversed(v), key=v.get) if v else None for v in votes]


def defects(prompts: list[str | None], replies: list[str | None], langs: language.LanguageModel, refuses: refusals.RefusalModel) -> tuple[list[str | None], dict[int, str]]:
    """The defect of each pair or None, and by pair the last lines that decide whether it has the last of them. A pair has the first that applies of empty, copy, refusal, language, truncated."""
    out: list[str | None] = [None] * len(replies)
    lines: dict[int, str] = {}
    left, rest = [], []
    for k, (p, r) in enumerate(zip(prompts, replies)):
        if is_empty(r):
            out[k] = "empty"
        elif p and is_copy(p, r):
            out[k] = "copy"
        else:
            left.append(k)
    said = [sentences(replies[k]) for k in left]
    flat = [s for x in said for s in x]
    score, may = refuses.scores(flat).tolist(), may_be(flat)
    at = 0
    for k, x in zip(left, said):
        if is_refusal(replies[k], prompts[k], x, score[at : at + len(x)], may[at : at + len(x)]):
            out[k] = "refusal"
        else:
            rest.append(k)
        at += len(x)
    rr = language.prose([replies[k] for k in rest])
    lp, sr = prompt_languages([prompts[k] or "" for k in rest], langs), langs.scores(rr)
    for i, k in enumerate(rest):
        p, r = lp[i], int(sr[i].argmax())
        if p is not None and p != r and sr[i, r] - sr[i, p] > LANGUAGE_MARGIN and sum(map(len, WORD.findall(rr[i]))) >= LANGUAGE_LETTERS:
            asked = _ASKED.get(langs.names[r])
            if not (asked and asked.search(prompts[k])):
                out[k] = "language"
                continue
        found = ends.rule(replies[k])
        if found is True:
            out[k] = "truncated"
        elif found:
            lines[k] = found
    return out, lines


def defective_pairs(messages: DataFrame, docs: DataFrame) -> DataFrame:
    """(conv_id, turn, defect) of each defective pair; turn is the reply's.

    messages: (conv_id, turn, role, content); docs: (text, lang), labelled texts to learn languages from. A null reply is empty; to a
    null or empty prompt no copy or other language is found. Rows of null conv_id or turn are left out, and rows of equal
    conv_id and turn count once (of differing ones the first by speaker and content). Rows of null or unknown role separate what stands
    before and after them.
    """
    replies = messages.where((speaker(F.col("role")) == "assistant") & F.col("content").isNotNull()).select("content")
    model = messages.sparkSession.sparkContext.broadcast((language.train(docs), train_refusals(replies)))
    pairs = reply_pairs(messages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, refuses = model.value
        tokens = ends.Tokens()
        for b in batches:
            found, lines = defects(b.column("prompt").to_pylist(), b.column("reply").to_pylist(), langs, refuses)
            told = [k for k, d in enumerate(found) if d]
            items, n, keys = ends.last_contexts(list(lines.values()), tokens)
            at, none = pa.array([*told, *lines], pa.int64()), pa.nulls(len(told))
            line = [pa.concat_arrays([none.cast(x.type), x]) for x in (pa.array(items), pa.array(n, pa.int64()), *map(pa.array, keys))]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id").take(at), b.column("turn").take(at), pa.array([*(found[k] for k in told), *[None] * len(lines)], pa.string()), *line], names=["conv_id", "turn", "defect", *ends.LINE]
            )

    kinds = dict(messages.select("conv_id", "turn").dtypes)
    keys = ", ".join(f"{k} bigint" for k in ends.KEYS)
    rows = cut(pairs.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, defect string, item boolean, n bigint, {keys}"))
    lines = rows.where("defect is null")
    cut_off = lines.join(small(ends.truncated(lines, ends.counted(replies))), ends.LINE, "left_semi")
    return rows.where("defect is not null").select("conv_id", "turn", "defect").unionByName(cut_off.select("conv_id", "turn", F.lit("truncated").alias("defect")))
