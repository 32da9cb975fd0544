"""Language of a text by character n-gram naive Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.counts import chunks, summed
from millrace.runtime import cut, spread

#: Hashed byte trigrams, and the smoothing of their counts.
BITS, ALPHA = 16, 0.1
#: A label that fewer documents have is no language, unless all are as rare.
RARE = 3
#: In the syntax of RE2, as it is applied to whole batches.
ASIDE = r"(?s)```.*?(?:```|\z)|`[^`\n]*`|“[^”]*”|\"[^\"\n]*\"|«[^»]*»|[\pL\pN_.-]*[_/@][\pL\pN_./@-]*|[\pL\p{Nl}\p{No}_]*\p{Nd}[\pL\pN_.,%-]*"


def plain(texts: list[str]) -> list[str]:
    """Texts without code, quotations, identifiers and numbers."""
    return pc.replace_substring_regex(pa.array(texts, pa.string()), ASIDE, " ").to_pylist()


def prose(texts: list[str]) -> list[str]:
    """The same in lower case."""
    return [t.lower() for t in plain(texts)]


class LanguageModel:
    """log P(trigram | language), from labelled texts; those with wrong labels are left out in a second fit."""

    def __init__(self, sample: list[tuple[str, str]] = ()):
        self.names = sorted({lang for lang, _ in sample}) or ["und"]
        texts = prose([t for _, t in sample])
        at = np.array([self.names.index(lang) for lang, _ in sample], np.int64)
        self.fit(self.count(texts, at))
        if texts:
            self.refit(self.count(texts, at, right=True))

    def count(self, texts: list[str], at: np.ndarray, right: bool = False) -> np.ndarray:
        """How often each language has each trigram in the texts, of which at[k] is the language; right: of the texts alone that the model finds in it."""
        out = np.zeros((len(self.names), 1 << BITS), np.int64)
        for lo, hi in chunks(texts):
            ok = self.scores(texts[lo:hi]).argmax(axis=1) == at[lo:hi] if right else np.ones(hi - lo, bool)
            for k in np.unique(at[lo:hi][ok]).tolist():
                own = [t for t, a, x in zip(texts[lo:hi], at[lo:hi].tolist(), ok.tolist()) if x and a == k]
                out[k] += np.bincount(self._grams(own)[0], minlength=1 << BITS)
        return out

    def refit(self, counts: np.ndarray) -> None:
        """Fit to the counts; languages without any are dropped."""
        kept = np.flatnonzero(counts.any(axis=1)).tolist()
        if kept:
            self.names = [self.names[k] for k in kept]
            self.fit(counts[kept])

    def fit(self, counts: np.ndarray) -> None:
        counts = counts + ALPHA
        counts[:, self._blank()] = 0
        log = np.log((counts + 1e-9) / counts.sum(axis=1, keepdims=True)).astype(np.float32)
        log[:, self._blank()] = 0  # blanks say nothing
        self.log = log

    @staticmethod
    def _hash(a, b, c):
        x = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)
        return (x * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)

    def _blank(self) -> int:
        s = np.array([32], np.uint32)
        return int(self._hash(s, s, s)[0])

    def _grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all trigrams, and where each text's begin; every text has at least one."""
        data = [b"  " + t.encode("utf_8", "surrogatepass") + b"  " for t in texts]
        b = np.frombuffer(b"".join(data), np.uint8)
        b = np.where(b < 33, 32, b)
        # digits and marks are blanks too
        b = np.where((b < 65) | ((b > 90) & (b < 97)) | ((b > 122) & (b < 128)), 32, b).astype(np.uint32)
        grams = self._hash(b[:-2], b[1:-1], b[2:])
        starts = np.concatenate([[0], np.cumsum([len(d) for d in data])[:-1]])
        return grams, starts

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text (as prose() gives it) in each language."""
        out = np.zeros((len(texts), len(self.names)), np.float32)
        for lo, hi in chunks(texts):
            grams, starts = self._grams(texts[lo:hi])
            for k in range(len(self.names)):
                out[lo:hi, k] = np.add.reduceat(self.log[k][grams], starts)
        return out


def language_key(c):
    """Two letters of a language tag, or null where it names no language."""
    key = F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]{2,3})(?:[-_ ].*)?\s*$", 1))
    return F.when(~key.isin("", "und", "mul", "zxx"), key)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on all documents with a language tag."""

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prose(b.column(1).to_pylist()), pa.string())], names=["lang", "text"])

    rows = docs.select(language_key(F.col(f"`{lang_col}`")).alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    rows = cut(spread(rows).mapInArrow(bare, "lang string, text string"))
    often = {lang: n for lang, n in rows.groupBy("lang").count().collect()}
    model = LanguageModel()
    model.names = sorted(lang for lang, n in often.items() if n >= RARE) or sorted(often) or model.names
    model.fit(_summed(rows, model, False))
    model.refit(_summed(rows, model, True))
    return model


def _summed(rows: DataFrame, model: LanguageModel, right: bool) -> np.ndarray:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    number = {lang: k for k, lang in enumerate(model.names)}

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((len(number), 1 << BITS), np.int64)
        for b in batches:
            at = np.array([number.get(x, -1) for x in b.column(0).to_pylist()], np.int64)
            own = np.flatnonzero(at >= 0)
            out += shared.value.count(b.column(1).take(pa.array(own)).to_pylist(), at[own], right)
        return out.ravel()

    return summed(rows, count, len(number) << BITS).reshape(len(number), -1)
