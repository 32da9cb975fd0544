"""How lines of prose and items of lists end, from counts over all replies."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.counts import chunks
from millrace.runtime import cut, small

#: A token that is rarer than this in the replies is unknown to the model.
KNOWN = 5
#: Nats for a token that is unknown to it, however many replies there are.
UNKNOWN = -2.0
#: Tokens of context, the weight of the shorter context in the longer (of none in one: 1), and the number of tokens beyond which items count as equally long.
ORDER, WEIGHT, LONG_ITEM = 3, 4.0, 15
#: Contexts are counted under 64-bit names; these small ones are the kinds of line alone, and items by their number of tokens.
PROSE, ITEM, SIZES = 0, 1, 100
FIXED = [PROSE, ITEM, *range(SIZES + 1, SIZES + LONG_ITEM + 1)]
#: Contexts are added up in a task until there are so many.
HELD = 4_000_000

STOPS, CLOSERS = ".!?…", "”\"'’)]»*_"
WORD = re.compile(r"[^\W_]+")
INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.M)
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_TOKEN = re.compile(r"\d[\w.,%-]*\w|`[^`\n]*`|[^\W_]+|[^\w\s]|_")
_WORDS = re.compile(r"(?<!\S)[^\W\d_]+(?!\S)")
_OPEN = re.compile(r"[,;:(\[{/&=+<–—-]\s*$")


def rule(text: str) -> bool | str:
    """Whether a text is truncated, where its form tells; else its last line, which the counts must judge."""
    text = (text if text.isascii() else INVISIBLE.sub("", text)).rstrip()
    if len(_FENCE.findall(text)) % 2:
        return True
    lines = text.split("\n")
    if lines[-1].strip().startswith(("```", "~~~")):
        return False
    if len(lines) == 1 and len(WORD.findall(text)) <= 2 and not _ITEM.match(text):
        return bool(_OPEN.search(text))  # a bare short answer
    if lines[-1].count("`") % 2 or _ITEM.fullmatch(lines[-1] + " "):
        return True  # inside a piece of code, or a marker without its item
    if lines[-1][-1:] in ",;([{" and len(_WORDS.findall(lines[-1])) > 2:
        return True
    return lines[-1]


def _norm(t: str) -> str:
    return "<num>" if t[0].isdigit() else "<code>" if t[0] == "`" and len(t) > 1 else t.lower()


def _name(t: str) -> int:
    return int.from_bytes(hashlib.blake2b(t.encode("utf_8", "surrogatepass"), digest_size=8).digest(), "little")


#: A mark that only closes is one token with the full stop before it.
_CLOSED = np.array([[_name(s + c) for c in CLOSERS] for s in STOPS], np.uint64)
_KINDS = np.array([_name("<prose>"), _name("<item>")], np.uint64)


class Tokens(dict):
    """A number for each token met; names[number] is the same in every process."""

    def __init__(self):
        self.names: list[int] = []
        for t in STOPS + CLOSERS:  # the first numbers
            self[t]

    def __missing__(self, t: str) -> int:
        self[t] = k = len(self.names)
        self.names.append(_name(_norm(t)))
        return k


def _split(line: str) -> tuple[bool, list[str]]:
    m = _ITEM.match(line)
    return m is not None, _TOKEN.findall(line, m.end()) if m else _TOKEN.findall(line)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _contexts(flat: list[str], sizes: list[int], items: np.ndarray, tokens: Tokens) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of lines, whose tokens follow each other in flat: for each place the names of its last 1 to ORDER tokens with the kind, its line and its number in
    it, and the tokens of each line. A context that reaches beyond the line's start has no meaning."""
    ids = np.fromiter(map(tokens.__getitem__, flat), np.int64, len(flat))
    h = np.array(tokens.names, np.uint64)[ids]
    line = np.repeat(np.arange(len(sizes)), sizes)
    stop, close = ids < len(STOPS), (ids >= len(STOPS)) & (ids < len(STOPS) + len(CLOSERS))
    merged = np.flatnonzero(close[1:] & stop[:-1] & (line[1:] == line[:-1])) + 1
    h[merged - 1] = _CLOSED[ids[merged - 1], ids[merged] - len(STOPS)]
    keep = np.ones(len(ids), bool)
    keep[merged] = False
    h, line = h[keep], line[keep]
    n = np.bincount(line, minlength=len(sizes))
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    keys = [_mix(_KINDS[items[line].astype(np.int64)], h)]
    for k in range(1, ORDER):
        keys.append(_mix(keys[-1], np.concatenate([np.zeros(min(k, len(h)), np.uint64), h[:-k]])))
    return [k.view(np.int64) for k in keys], line, place, n


def last_contexts(lines: list[str], tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each line is an item, its number of tokens as far as it counts, and the names of its last 1 to ORDER tokens, 0 where there are fewer."""
    parts = [_split(x) for x in lines]
    items = np.array([i for i, _ in parts], bool)
    keys, _, place, n = _contexts([t for _, x in parts for t in x], [len(x) for _, x in parts], items, tokens)
    out = np.zeros((ORDER, len(lines)), np.int64)
    last = np.cumsum(n) - 1
    for k in range(ORDER):
        own = n > k
        out[k, own] = keys[k][last[own]]
    return items, np.minimum(n, np.where(items, LONG_ITEM, ORDER)), out


def _groups(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values and how often each occurs."""
    a = np.sort(a)
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]]))
    return a[at], np.diff(np.append(at, len(a)))


def _lines(texts: list[str]) -> tuple[list[str], list[int], np.ndarray, np.ndarray]:
    """The tokens of all lines outside of code, how many each has, whether it is an item, and whether it is known to be complete.

    The last line may itself be truncated: only lines with others after them, items with another item, are known to be complete.
    """
    flat: list[str] = []
    sizes: list[int] = []
    items: list[bool] = []
    whole: list[bool] = []
    for text in texts:
        code = False
        lines = [x for x in text.split("\n") if x.strip()]
        for k, line in enumerate(lines):
            if line.lstrip().startswith(("```", "~~~")):
                code = not code
                continue
            if code:
                continue
            item, found = _split(line)
            if found:
                flat += found
                sizes.append(len(found))
                items.append(item)
                whole.append(k + 1 < len(lines) and (not item or _ITEM.match(lines[k + 1]) is not None))
    return flat, sizes, np.array(items, bool), np.array(whole, bool)


Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def count(texts: Iterable[list[str]]) -> Iterator[Rows]:
    """(key, first, seen, ended, tail): how often each context is seen and ends a complete line, and how many last lines of prose it ends, of which first
    is the context of the last token alone, else 0. Keys come several times, to be added up."""
    tokens, held, size = Tokens(), [], 0
    for batch in texts:
        for lo, hi in chunks(batch):
            if len(tokens) > HELD // 4:
                tokens = Tokens()
            flat, sizes, item, whole = _lines(batch[lo:hi])
            keys, line, place, n = _contexts(flat, sizes, item, tokens)
            inside = place + 1 < n[line]
            held += [keys[k][inside & (place >= k)] for k in range(ORDER)]
            size += ORDER * len(line)
            last = np.cumsum(n) - 1
            for own, tail in ((whole, 0), (~whole & ~item, 1)):
                at = [last[own & (n > k)] for k in range(ORDER)]
                key = np.concatenate([keys[k][x] for k, x in enumerate(at)])
                one, none = np.ones(len(key), np.int64), np.zeros(len(key), np.int64)
                yield (key, np.concatenate([keys[0][x] for x in at]), none, none, one) if tail else (key, none, one, one, none)
            kinds, ends = np.bincount(item[line[inside]], minlength=2), np.bincount(item[whole], minlength=2)
            longest = n[item] - 1  # an item has places of 1 to so many tokens inside
            within = [(longest >= k).sum() for k in range(1, LONG_ITEM)] + [np.maximum(longest - LONG_ITEM + 1, 0).sum()]
            at_end = np.bincount(np.minimum(n[item & whole], LONG_ITEM), minlength=LONG_ITEM + 1)[1:]
            none = np.zeros(len(FIXED), np.int64)
            yield np.array(FIXED), none, np.concatenate([kinds + ends, within]).astype(np.int64), np.concatenate([ends, at_end]).astype(np.int64), none
            if size > HELD:
                yield _inner(held)
                held, size = [], 0
    if held:
        yield _inner(held)


def _inner(held: list[np.ndarray]) -> Rows:
    key, seen = _groups(np.concatenate(held))
    none = np.zeros(len(key), np.int64)
    return key, none, seen, none, none


class EndModel:
    """How much likelier the end of a line is than a continuation after its last tokens, in prose and in list items.

    P(end | last ORDER tokens), each order interpolated with the one below it and the lowest with the kind's share of ends; also, for items, how
    much likelier their number of tokens is at the end than inside. Last lines count too if their last token is known from other lines and
    ends them at least as often as the kind's tokens do. Equal replies count once. This one counts in memory; counted(), fitted() and truncated() do the same with tables.
    """

    def __init__(self, replies: list[str] = ()):
        found: dict[int, list[int]] = {}
        for rows in count([list(dict.fromkeys(replies))]):
            for key, first, *n in zip(*(x.tolist() for x in rows)):
                own = found.setdefault(key, [0, 0, 0, 0])
                own[:] = [first or own[0], *map(int.__add__, own[1:], n)]
        fixed = {k: tuple(found.get(k, [0] * 4)[1:3]) for k in FIXED}
        s, e = fixed[PROSE]
        known = {k for k, (first, seen, ended, tail) in found.items() if tail and k == first and (e == 0 or seen >= KNOWN and ended * s >= e * seen)}
        self.counts = {k: (seen + tail * (first in known), ended + tail * (first in known)) for k, (first, seen, ended, tail) in found.items()}
        self.fit(fixed, sum(found[k][3] for k in known))

    def fit(self, fixed: dict[int, tuple[int, int]], known: int) -> None:
        """fixed: the counts of FIXED; known: how many last lines count too."""
        (s, e), (si, ei) = fixed[PROSE], fixed[ITEM]
        self.share = np.array([(e + known + 1) / (s + known + 2), (ei + 1) / (si + 2)])
        sizes = {n: fixed[SIZES + n] for n in range(1, LONG_ITEM + 1) if any(fixed[SIZES + n])}
        inside, ends, some = sum(x for x, _ in sizes.values()), sum(x for _, x in sizes.values()), 0.5 * len(sizes)
        self.size = np.full(LONG_ITEM + 1, -3.0)
        for n, (x, y) in sizes.items():
            if x + y >= KNOWN:
                self.size[n] = math.log((y + 0.5) / (ends + some)) - math.log((x + 0.5) / (inside + some))

    def scores(self, items: np.ndarray, n: np.ndarray, seen: np.ndarray, ended: np.ndarray) -> np.ndarray:
        """Nats for "the line is complete" against "it goes on", by the counts of its last 1 to ORDER tokens. An unknown token is most often part of a word and counts against it."""
        p = prior = self.share[items.astype(np.int64)]
        q = 1 - p
        for k in range(ORDER):
            weight = 1.0 if k == 0 else WEIGHT
            p = np.where(n > k, (ended[k] + weight * p) / (seen[k] + weight), p)
            q = np.where(n > k, (seen[k] - ended[k] + weight * q) / (seen[k] + weight), q)
        size = np.where(items, np.minimum(0.0, self.size[n] + 1.0), 0.0)
        score = np.log(p) - np.log(q) - np.log(prior) + np.log(1 - prior) + size
        return np.where((n == 0) | (seen[0] < KNOWN), UNKNOWN + size, score)

    def score(self, line: str) -> float:
        items, n, keys = last_contexts([line], Tokens())
        got = np.array([[self.counts.get(k, (0, 0)) for k in row] for row in keys.tolist()])
        return float(self.scores(items, n, got[:, :, 0], got[:, :, 1])[0])

    def is_truncated(self, text: str) -> bool:
        found = rule(text)
        return found if isinstance(found, bool) else self.score(found) < 0


KEYS = [f"k{k}" for k in range(ORDER)]
#: What the counts must judge: a line's kind, its number of tokens and its last contexts.
LINE = ["item", "n", *KEYS]


def counted(replies: DataFrame) -> DataFrame:
    """(key, first, seen, ended, tail) of count(), added up over all different replies (content), as copies are no further evidence; written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in count(b.column(0).to_pylist() for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["key", "first", "seen", "ended", "tail"])

    rows = replies.distinct().mapInArrow(run, "key bigint, first bigint, seen bigint, ended bigint, tail bigint")
    first = F.max(F.expr("nullif(first, 0)")).alias("first")
    return cut(rows.groupBy("key").agg(first, *[F.sum(c).alias(c) for c in ("seen", "ended", "tail")]))


def fitted(counts: DataFrame) -> tuple[EndModel, DataFrame]:
    """The model without its counts, and (first), the last tokens with which last lines count."""
    fixed = dict.fromkeys(FIXED, (0, 0)) | {r.key: (r.seen, r.ended) for r in counts.where(F.col("key").isin(FIXED)).collect()}
    s, e = fixed[PROSE]
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    ends_as_often = (wide("ended") * F.lit(s).cast("decimal(19,0)") >= wide("seen") * F.lit(e).cast("decimal(19,0)")) & (F.col("seen") >= KNOWN)
    known = cut(counts.where("tail > 0 and key = first").where(F.lit(True) if e == 0 else ends_as_often).select("first", "tail"))
    model = EndModel()
    model.fit(fixed, known.agg(F.coalesce(F.sum("tail"), F.lit(0))).first()[0])
    return model, known.select("first")


def truncated(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of LINE, each once, that are likelier to go on than to be complete; written out."""
    model, known = fitted(counts)
    shared = lines.sparkSession.sparkContext.broadcast(model)
    different = cut(lines.select(*LINE).distinct())
    keys = cut(different.select(F.explode(F.array(*KEYS)).alias("key")).distinct())
    own = counts.join(small(keys), "key", "left_semi").join(small(known).withColumn("known", F.lit(1)), "first", "left")
    more = F.when(F.col("known") == 1, F.col("tail")).otherwise(0)
    own = small(cut(own.select("key", (F.col("seen") + more).alias("seen"), (F.col("ended") + more).alias("ended"))))
    rows = different
    for k in KEYS:
        rows = rows.join(own.select(F.col("key").alias(k), F.col("seen").alias(f"seen_{k}"), F.col("ended").alias(f"ended_{k}")), k, "left")
    rows = rows.select(*LINE, *[F.coalesce(f"{c}_{k}", F.lit(0)).alias(f"{c}_{k}") for c in ("seen", "ended") for k in KEYS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, ended = (np.array([b.column(f"{c}_{k}").to_numpy() for k in KEYS]) for c in ("seen", "ended"))
            score = shared.value.scores(b.column("item").to_numpy(zero_copy_only=False), b.column("n").to_numpy(), seen, ended)
            yield b.select(LINE).filter(pa.array(score < 0))

    return cut(rows.mapInArrow(run, "item boolean, n bigint, " + ", ".join(f"{k} bigint" for k in KEYS)))
