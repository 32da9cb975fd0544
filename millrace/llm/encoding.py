"""Text that was decoded in a wrong character encoding (problem 7).

A multinomial classifier over hashed byte bigrams (of the UTF-8 form) names the chain of wrong decodings a sentence went
through. It is trained on clean sentences of a bounded sample, garbled here along every known chain. The named chain is inverted,
and that counts only if each step decodes strictly; a chain of one-byte encodings, in which everything
decodes, must also make the text clearly likelier as clean text.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.runtime import some_files, spread

#: The training sample: at most so many documents, and sentences of each; both are bounds on what the driver reads.
SAMPLE_DOCS, SAMPLE_SENTENCES = 2000, 3
#: Buckets of the hashed bigrams, smoothing, and the nats by which a garbled reading must be likelier.
BUCKETS, ALPHA, MARGIN = 1 << 13, 0.2, 6.0
#: A sentence longer than this is classified in parts.
LONGEST = 1000

#: Encodings that UTF-8 is mistaken for, and pairs (real, assumed) of encodings of one byte a character.
READ_AS = "latin_1 cp1252 iso8859_15 cp1250 iso8859_2 cp1251 koi8_r cp866 cp437 cp850 mac_roman".split()
TWICE = [("latin_1", "latin_1"), ("cp1252", "cp1252"), ("latin_1", "cp1252"), ("cp1252", "latin_1")]
ONE_BYTE = [
    ("cp1251", "latin_1"), ("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp1251", "mac_roman"),
    ("koi8_r", "cp1251"), ("koi8_r", "latin_1"), ("koi8_r", "cp866"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp866", "koi8_r"), ("iso8859_5", "cp1251"),
    ("iso8859_2", "cp1250"), ("iso8859_2", "cp1252"), ("cp1250", "iso8859_2"), ("cp1250", "cp1252"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1250"), ("cp1252", "cp1251"),
    ("mac_roman", "cp1252"), ("mac_roman", "latin_1"), ("cp850", "cp1252"), ("cp437", "cp1252"),
]
LOST = ["cp1252", "cp1250", "cp1251", "iso8859_2"]
_GAP = re.compile(r"[ \t\n\r\f\v]+")
_SENTENCE = re.compile(r"(?<=[.!?;:])[ \t]+")
#: Characters shown as an example: no letter or digit of ASCII, between marks of quotation.
_SHOWN = re.compile(r"^[(\[\"'“„«`‘]+[^A-Za-z0-9]{1,12}[)\]\"'”“»`’]+[.,;:!?]*$")
#: Characters that proper text has beside letters, signs it has after a letter or before a number, and those of them that don't follow a letter.
_TYPOGRAPHY = frozenset("\xa0\xad\u2009\u200a\u202f…–—‘’‚“”„«»‹›•·µ¿¡")
_NEVER_AFTER = frozenset("±¶§¼½¾÷£¥¢")
_SIGNS = frozenset("©®™°±²³¶§†‡¼½¾×÷€£¥¢")
#: Letters of two alphabets side by side: no restored text.
_TWO_SCRIPTS = re.compile(r"[A-Za-zÀ-ɏ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ɏ]")
_LOST_IN_WORD = re.compile("[^\\W_]�|�[^\\W_]")
_LOST_WORD = re.compile("�{3,}")
#: Signs that stand around words, and signs that proper text hasn't between two letters.
_AROUND = frozenset("“”„‘’‚«»‹›–—…")
_NOT_INSIDE = frozenset("·„“”«»‹›•¿¡‚")


def _tells(garbled: str, restored: str) -> bool:
    """Whether a character became what proper text would have in its place, and was what it wouldn't: a letter for a sign or a letter of
    another word, a sign around a word for a letter or a control character there. Drawn lines tell nothing."""
    if all("\u2500" <= x <= "\u259f" or x.isascii() for x in garbled):
        return False
    last = len(garbled) - 1
    for i, (x, y) in enumerate(zip(garbled, restored)):
        if x == y:
            continue
        before, after = garbled[i - 1 : i].isalpha(), garbled[i + 1 : i + 2].isalpha()
        if y.isalpha():
            if x in _TYPOGRAPHY:
                if x in _NOT_INSIDE and before and after:
                    return True
            elif x not in _SIGNS or after or x in _NEVER_AFTER and before:
                return True
        elif y in _AROUND and ("\x80" <= x <= "\x9f" or (x.isalpha() or "\u2320" <= x <= "\u25a0") and (i == 0 or i == last or not before or not after)):
            return True
    return False


def _table(codec: str) -> list[str]:
    """The 256 characters of a one-byte encoding; undefined bytes are the control characters of that number."""
    out = []
    for k in range(256):
        try:
            out.append(bytes([k]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(k))
    return out


_READ = {c: "".join(_table(c)) for c in {*READ_AS, *(x for p in ONE_BYTE for x in p), *LOST}}
_BYTE = {c: codecs.charmap_build(t) for c, t in _READ.items()}


def to_bytes(text: str, codec: str) -> bytes | None:
    try:
        return text.encode() if codec == "utf_8" else codecs.charmap_encode(text, "strict", _BYTE[codec])[0]
    except UnicodeEncodeError:
        return None


def from_bytes(data: bytes, codec: str) -> str | None:
    try:
        return data.decode() if codec == "utf_8" else codecs.charmap_decode(data, "strict", _READ[codec])[0]
    except UnicodeDecodeError:
        return None


class Chain:
    """Wrong decodings in a row: each a pair (real encoding, assumed encoding)."""

    def __init__(self, name: str, steps: list[tuple[str, str]], lost: bool = False):
        self.name, self.steps, self.lost = name, steps, lost
        self.strict = steps[0][0] == "utf_8"
        if self.strict:
            # The first byte of a letter as the last step shows it, and after it another byte or nothing more of the word.
            shown = lambda codes: "[" + "".join(re.escape(_READ[steps[-1][1]][k]) for k in codes if not _READ[steps[-1][1]][k].isascii()) + "]"
            self.traces = re.compile(shown(range(0xC2, 0xF0)) + shown(range(0x80, 0xC0)))

    def garble(self, text: str) -> str | None:
        """The text as it looks after the wrong decodings; None where they can't have happened."""
        for real, assumed in self.steps:
            data = to_bytes(text, real)
            if data is None:
                return None
            text = data.decode("utf_8", "replace") if self.lost else from_bytes(data, assumed)
        return text

    def restore(self, text: str) -> str | None:
        """The text before the wrong decodings; None unless every step inverts strictly."""
        if self.lost:
            return None
        for real, assumed in reversed(self.steps):
            data = to_bytes(text, assumed)
            text = None if data is None else from_bytes(data, real)
            if text is None:
                return None
        return text


def chains() -> list[Chain]:
    """All known chains; number k here is class k + 1 of the classifier, class 0 is clean text."""
    once = [Chain(f"utf_8>{x}", [("utf_8", x)]) for x in READ_AS]
    twice = [Chain(f"utf_8>{x},utf_8>{y}", [("utf_8", x), ("utf_8", y)]) for x, y in TWICE]
    other = [Chain(f"{x}>{y}", [(x, y)]) for x, y in ONE_BYTE]
    lost = [Chain(f"{x}>utf_8 lossy", [(x, "utf_8")], lost=True) for x in LOST]
    return once + twice + other + lost


def parts(text: str) -> list[str]:
    """The text's sentences with other characters than ASCII, in pieces of at most about LONGEST characters."""
    out = []
    for line in text.split("\n"):
        if line.isascii():
            continue
        for s in _SENTENCE.split(line):
            if not s.isascii():
                if len(s) <= LONGEST:
                    out.append(s)
                    continue
                piece, size = [], 0
                for w in s.split(" "):
                    piece.append(w)
                    size += len(w) + 1
                    if size >= LONGEST:
                        out.append(" ".join(piece))
                        piece, size = [], 0
                out.append(" ".join(piece))
    return out


def chunks(part: str) -> list[str]:
    """What lies between blanks of ASCII and holds other characters, but for characters that are only shown."""
    return [w for w in _GAP.split(part) if not w.isascii() and w != "�" and not (len(w) < 24 and _SHOWN.match(w))]


def _bigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the bigrams of all words, each with a blank before and after, and where each word's begin."""
    data = [w.encode("utf_8", "surrogatepass") for w in words]
    b = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8).astype(np.uint32)
    hashed = (b[:-1] * np.uint32(0x9E3779B1)) ^ (b[1:] * np.uint32(0x85EBCA77))
    sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
    return (hashed >> np.uint32(32 - 13)) & np.uint32(BUCKETS - 1), np.cumsum(sizes) - sizes


def _count(texts: list[list[str]]) -> np.ndarray:
    words = [w for t in texts for w in t]
    return np.bincount(_bigrams(words)[0], minlength=BUCKETS).astype(float) if words else np.zeros(BUCKETS)


class Classifier:
    """log P(bucket | class) of clean text and of each chain."""

    def __init__(self, sample: list[str]):
        self.chains = chains()
        sample = sample + [s.upper() for s in sample[::8]]  # headings in capitals are rarer than the sample shows
        self.log = self._fit(sample)
        if sample:  # the sample itself may hold garbled sentences: leave those out and fit again
            own = [chunks(s) for s in sample]
            sound = [s for s, w, v in zip(sample, own, self.score(own)) if not self.judge(w, v)]
            self.log = self._fit(sound)

    def _fit(self, sample: list[str]) -> np.ndarray:
        counts = [_count([chunks(s) for s in sample])]
        for c in self.chains:
            turned = [c.garble(s) for s in sample]
            counts.append(_count([[w for w in chunks(g)] for s, g in zip(sample, turned) if g is not None and g != s]))
        m = np.array(counts) + ALPHA
        return np.log(m / m.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()

    def of(self, word: str) -> np.ndarray:
        """Log-likelihood of a chunk in each class."""
        return self.log[_bigrams([word])[0]].sum(axis=0)

    def score(self, texts: list[list[str]]) -> np.ndarray:
        """Log-likelihood of each list of chunks in each class; a chunk that recurs is looked at once."""
        number: dict[str, int] = {}
        at = [number.setdefault(w, len(number)) for t in texts for w in t]
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), self.log.shape[1]), np.float32)
        if not at:
            return out
        words = list(number)
        each = np.empty((len(words), out.shape[1]), np.float32)
        for lo in range(0, len(words), 20_000):  # words at a time
            grams, starts = _bigrams(words[lo : lo + 20_000])
            each[lo : lo + len(starts)] = np.add.reduceat(self.log[grams], starts, axis=0)
        some = np.flatnonzero(sizes)
        out[some] = np.add.reduceat(each[np.array(at)], np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), axis=0)
        return out

    def judge(self, words: list[str], score: np.ndarray, strict_only: bool = False) -> tuple[str, dict[str, str]] | None:
        """The chain's name and the restored chunks of a sentence; no chunks if it can't be restored; None if it is sound.

        Chains are tried in order of likelihood; the first that restores everything is taken, else the one that restores most.
        """
        likelier = [k for k in np.argsort(-score, kind="stable").tolist() if k and score[k] >= score[0] + MARGIN]
        best, back = None, {}
        for k in likelier:  # UTF-8 can't come about by chance
            c = self.chains[k - 1]
            if c.strict:
                new = {w: r for w in words if (r := c.restore(w)) is not None and r != w}
                if len(new) > len(back):
                    best, back = c, new
                    if len(new) == len(set(words)):
                        break
        if best and 3 * len(back) >= len(set(words)):
            again = self.judge(list(back.values()), self.score([list(back.values())])[0], True)
            if again and again[1]:
                return f"{again[0]},{best.name}", {w: again[1].get(r, r) for w, r in back.items()}
            return best.name, back
        if strict_only:
            return None
        for k in likelier:
            c = self.chains[k - 1]
            if c.lost:
                if any(_LOST_IN_WORD.search(w) for w in words) or sum(bool(_LOST_WORD.search(w)) for w in words) > 1:
                    return c.name, {}
                continue
            if score[k] < score[0] + 2 * MARGIN:
                continue
            if c.strict:
                if 2 * sum(bool(c.traces.search(w)) for w in words) >= len(words):  # bytes were lost on the way
                    return c.name, back if c is best else {}
                continue
            new = {w: c.restore(w) for w in words}
            if None in new.values():
                continue
            telling = {w: r for w, r in new.items() if _tells(w, r)}
            # Also without case, as capitals are rare enough to look garbled.
            gain = min(sum(self.of(f(r))[0] - self.of(f(w))[0] for w, r in telling.items()) for f in (str, str.lower))
            if telling and gain > MARGIN and not any(map(_TWO_SCRIPTS.search, telling.values())):
                return c.name, {w: r for w, r in new.items() if r != w}
        return None

    def equal(self, words: list[str], back: dict[str, str]) -> list[str]:
        """The chains that restore a sentence's chunks to just that: where they agree on its characters they can't be told apart."""
        return [c.name for c in self.chains if back and all((c.restore(w) or w) == back.get(w, w) for w in words)]

    def look(self, texts: list[str | None]) -> list[dict[str, tuple[str, dict[str, str]]]]:
        """For each text its garbled sentences, each with chain and restored chunks."""
        own, where = [], []
        for k, t in enumerate(texts):
            if t and not t.isascii():
                for p in parts(t):
                    w = chunks(p)
                    if w:
                        own.append((p, w))
                        where.append(k)
        out: list[dict] = [{} for _ in texts]
        step = 50_000
        for lo in range(0, len(own), step):
            score = self.score([w for _, w in own[lo : lo + step]])
            for i in np.flatnonzero(score[:, 1:].max(axis=1) >= score[:, 0] + MARGIN):
                p, w = own[lo + i]
                found = self.judge(w, score[i])
                if found:
                    out[where[lo + i]][p] = found
        return out


def train(spark: SparkSession, docs: DataFrame, text_col: str) -> Classifier:
    """Fit the classifier on at most SAMPLE_DOCS documents, the same ones in every run."""
    docs = some_files(docs)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    n = docs.count()
    if n > SAMPLE_DOCS:
        texts = texts.where(F.expr(f"pmod(xxhash64(text), 1000000) < {max(1, int(1.2e6 * SAMPLE_DOCS / n))}"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for t in b.column(0).to_pylist():
                if t and not t.isascii():
                    p = [x for x in parts(t) if len(x) <= 400]
                    got += p[:: max(1, len(p) // SAMPLE_SENTENCES)][:SAMPLE_SENTENCES]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["s"])

    rows = texts.where("text is not null").mapInArrow(pick, "s string").limit(SAMPLE_DOCS * SAMPLE_SENTENCES).collect()
    return Classifier(sorted({r[0] for r in rows}))


def repair(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", found_only: bool = False) -> DataFrame:
    """The documents with garbled characters: (<id>, chains, alike, restored, lost, text), or the ids alone.

    chains: the chains of wrong decodings named, sorted; alike: other chains that restore some sentence to the same; restored and lost: how many sentences could and couldn't be restored; text: the whole
    text with what could be restored. Null, empty and pure ASCII texts are sound; so are characters between marks of
    quotation without letters around them and a lone replacement character, which are only shown. Repeated rows are judged each;
    found_only gives an id once. Rows of null id are judged like others.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(spark, docs, text_col))
    src = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(r"text rlike '[^\\x00-\\x7F]'")
    src = spread(src)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            seen = model.value.look(texts)
            at = [k for k, x in enumerate(seen) if x]
            ids = b.column("id").take(pa.array(at, pa.int64()))
            if found_only:
                yield pa.RecordBatch.from_arrays([ids], names=["id"])
                continue
            rows = []
            for k in at:
                t, alike = texts[k], set()
                for p, (name, back) in seen[k].items():
                    alike |= {*model.value.equal(chunks(p), back)} - {name}
                    new = "".join(back.get(w, w) for w in re.split(r"([ \t\n\r\f\v]+)", p))
                    t = t.replace(p, new) if new != p else t
                ok = sum(bool(back) for _, back in seen[k].values())
                rows.append((sorted({c for c, _ in seen[k].values()}), sorted(alike), ok, len(seen[k]) - ok, t))
            cols = list(zip(*rows)) or [(), (), (), (), ()]
            types = [pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols, types)]], names=["id", "chains", "alike", "restored", "lost", "text"])

    if found_only:
        return src.mapInArrow(run, f"id {kind}").distinct().withColumnRenamed("id", doc_id)
    out = src.mapInArrow(run, f"id {kind}, chains array<string>, alike array<string>, restored int, lost int, text string")
    return out.select(F.col("id").alias(doc_id), "chains", "alike", "restored", "lost", F.col("text").alias(text_col))
