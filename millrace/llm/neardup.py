"""Near-duplicate texts by banded minhash candidates and sequential Bayesian verification (problem 3).

Likeness is that of bags of words, so a word's k-th occurrence is a token of its own and minhash estimates the likeness.
BANDS keys of ROWS minima each bring candidates together; signatures of one bit per minimum are compared in batches of
BATCH bits, and after each batch a pair is dropped if the posterior probability that its likeness reaches the
threshold is below MISS. The first two batches and the number of words travel with the keys, so most candidates end inside the join;
the other batches are computed for the texts that still have a partner. What survives is verified exactly on its words.
Exact copies are one text from the start, named by a 64-bit hash of speaker and text.

One minus the likeness of bags is a metric. So texts within half the allowed distance of a common centre are all linked with each other and
form a family without being compared among themselves. Where more than RUN texts share a band key, each is compared with that key's head
alone, and with a centre: the bag of the words that at least half of a sample of the head's texts have. Texts of different
families are then compared pairwise. A key that is frequent within a task is thinned out before the shuffle. Up to WHOLE texts that share a key but
are mostly unlike each other are compared by their signatures at once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.runtime import cut, spread

#: A pair of likeness s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.989 at 0.70, 0.996 at 0.72, 0.9991 at 0.75.
ROWS, BANDS = 6, 36
#: Bits in a batch of the signature, batches, and the posterior probability under which a candidate is dropped.
BATCH, BATCHES, MISS = 64, 6, 1e-3
#: Batches that travel with the keys.
CARRIED = 2
#: Texts that share a band key are compared with each other up to so many, beyond it with the key's head first.
RUN = 64
#: Longer runs than RUN are still compared whole up to this, unless half of their texts differ from the head in no more than ALIKE carried bits.
WHOLE, ALIKE = 4096, 16
#: Texts of a head that its centre is taken from.
SAMPLE = 64
#: Keys that a task remembers as frequent.
FREQUENT = 100_000
#: Rows up to which a class is written out as all its pairs, see NearDuplicates.pairs().
EXPAND = 1000

WORD = re.compile(r"[^\W_]+")
#: Texts, and words, that are hashed at once.
_CHUNK, _CHUNK_WORDS = 1500, 200_000


def fewest_agreements(threshold: float, miss: float = MISS, batch: int = BATCH, batches: int = BATCHES) -> list[int]:
    """For 1..batches batches, the fewest equal bits at which P(likeness >= threshold | bits) is still at least `miss`.

    A bit of two minima is equal with probability (1 + s) / 2 at likeness s; the prior of s is uniform.
    """
    p = (1 + (np.arange(4000) + 0.5) / 4000) / 2
    like = p >= (1 + threshold) / 2
    out = []
    for k in range(1, batches + 1):
        n = batch * k
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[like].sum() / w.sum() >= miss:
                out.append(m)
                break
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def bag_tokens(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of (word, occurrence) of all texts, and where each text begins; no text may be empty."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes, names = pd.factorize(np.array([w for t in texts for w in t], object))
    key = np.repeat(np.arange(len(texts)), sizes) * len(names) + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.arange(len(key))
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    hashed = pd.util.hash_array(names, categorize=False)[codes[order]]
    token = _mix(hashed + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return token.astype(np.uint32), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def minima(tokens: np.ndarray, starts: np.ndarray, first: int, count: int) -> np.ndarray:
    """Minima of `count` hash functions from number `first` on: an array of texts x count."""
    seeds = _mix(np.arange(first + 1, first + count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(starts), count), np.uint32)
    for i, s in enumerate(seeds):
        v = (tokens ^ np.uint32(s & np.uint64(0xFFFFFFFF))) * np.uint32((s >> np.uint64(32)) | np.uint64(1))
        v ^= v >> np.uint32(15)
        out[:, i] = np.minimum.reduceat(v, starts)
    return out


def bits(m: np.ndarray) -> np.ndarray:
    """One bit of each of 64 minima, as a signed 64-bit number a text."""
    b = (m * np.uint32(0x85EBCA6B)) >> np.uint32(31)
    return (b.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(m: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """texts x BANDS keys from texts x (BANDS * ROWS) minima; keys of different bands or salts don't meet."""
    g = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    h = _mix(np.arange(BANDS, dtype=np.uint64)[None, :] + (salt.astype(np.uint64)[:, None] << np.uint64(20)))
    for r in range(ROWS):
        h = _mix(h ^ g[:, :, r]) + np.uint64(r)
    return h.view(np.int64)


def _texts(b: pa.RecordBatch, least: int) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Rows and words of the batch's different texts of at least `least` words, in chunks."""
    seen, rows, texts, size = set(), [], [], 0
    digests = b.column("digest").to_pylist()
    for k, t in enumerate(b.column("content").to_pylist()):
        if digests[k] in seen:
            continue
        seen.add(digests[k])
        w = WORD.findall(t.lower())
        if len(w) >= least:
            rows.append(k)
            texts.append(w)
            size += len(w)
            if len(rows) >= _CHUNK or size >= _CHUNK_WORDS:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _banded(least: int, longest: int | None):
    """Rows (key, digest, n, s0, s1) of each text's bands.

    If a key recurs more than `longest` times in a chunk, its further rows in this task become (random key, digest, -1, head, key): they needn't
    meet the others to be compared with the head. The head's own row has n = -2, so that the key is known to be frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: dict[int, int] = {}
        for b in batches:
            digest, group = b.column("digest").to_numpy(), b.column("grp").to_numpy()
            for rows, texts in _texts(b, least):
                tokens, starts = bag_tokens(texts)
                m = minima(tokens, starts, 0, BANDS * ROWS)
                key = band_keys(m, group[rows]).ravel()
                words = np.fromiter(map(len, texts), np.int32, len(texts))
                carried = [bits(minima(tokens, starts, BANDS * ROWS + BATCH * k, BATCH)) for k in range(CARRIED)]
                own, n, s0, s1 = (np.repeat(c, BANDS) for c in (digest[rows], words, *carried))
                if longest is not None:
                    at, head, marked = _thinned(key, own, frequent, longest)
                    n[marked] = -2
                    s0[at], s1[at], n[at] = head, key[at], -1
                    key[at] = _mix(own[at].view(np.uint64) ^ key[at].view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, own, n, s0, s1)], names=["key", "digest", "n", "s0", "s1"])

    return run


def _thinned(key: np.ndarray, digest: np.ndarray, frequent: dict[int, int], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of a chunk only need to meet a head, which head, and the rows of new heads; `frequent` remembers the heads of frequent keys, and is extended."""
    known = np.fromiter((k in frequent for k in key.tolist()), bool, len(key)) if frequent else np.zeros(len(key), bool)
    values, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    new = np.flatnonzero((count > longest + 1)[inverse] & ~known)
    late, marked = np.zeros(len(key), bool), new[:0]
    if len(new):
        order = new[np.lexsort((digest[new], key[new]))]
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        if len(frequent) > FREQUENT:
            frequent.clear()
            known[:] = False
        marked = order[first]
        frequent.update(zip(key[order][first].tolist(), digest[order][first].tolist()))
        place = np.arange(len(order))
        late[order[place - np.maximum.accumulate(np.where(first, place, 0)) > 0]] = True
    at = np.flatnonzero(known | late)
    return at, np.fromiter((frequent[k] for k in key[at].tolist()), np.int64, len(at)), marked


def _likely(n, s, i: np.ndarray, j: np.ndarray, threshold: float, most: list[int]) -> np.ndarray:
    """Whether rows i and j agree in size and in the carried batches of bits."""
    ok = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
    differ = np.zeros(len(i), np.int64)
    for x, limit in zip(s, most):
        differ = differ + np.bitwise_count((x[i] ^ x[j]).view(np.uint64))
        ok &= differ <= limit
    return ok


def _meet(threshold: float, most: list[int], longest: int, whole: int = WHOLE):
    """(a, b, hot) from rows sorted by key: likely pairs of a key's texts; of frequent keys each text with the head, and the key as hot."""

    def pairs(now: list[np.ndarray], i: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, digest, n = now[:3]
        for step in range(1, whole):
            i = i[i + step < len(key)]
            i = i[key[i] == key[i + step]]
            if not len(i):
                return
            good = i[_likely(n, now[3:], i, i + step, threshold, most)]
            if len(good):
                a, b = digest[good], digest[good + step]
                yield _met(np.minimum(a, b), np.maximum(a, b), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, long_key, long_head = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int64, np.int64)], None, 0
        for cols in [*_columns(batches), None]:
            now = left if cols is None else [np.concatenate(x) for x in zip(left, cols)]
            key, digest, n = now[:3]
            if not len(key):
                continue
            if (away := n == -1).any():  # has its head already
                yield _met(digest[away], now[3][away], now[4][away])
            stay = ~away
            if long_key is not None and (tail := stay & (key == long_key)).any():
                yield _met(digest[tail], np.full(int(tail.sum()), long_head), key[tail])
                stay &= ~tail
            now = _several([x[stay] for x in now])
            key, digest, n = now[:3]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(key)))
            hot = np.zeros(len(size), bool)
            for k in np.flatnonzero((size > longest) | (np.minimum.reduceat(n, start) == -2 if len(start) else False)).tolist():
                lo, hi = int(start[k]), int(start[k] + size[k])
                differ = sum(np.bitwise_count((x[lo:hi] ^ x[lo]).view(np.uint64)).astype(int) for x in now[3:])
                hot[k] = n[lo:hi].min() == -2 or hi - lo > whole or 2 * int((differ <= ALIKE).sum()) >= hi - lo
                if hot[k]:
                    yield _met(digest[lo:hi], np.full(hi - lo, digest[lo]), key[lo:hi])
            last = len(size) - 1
            if last >= 0 and hot[last]:
                long_key, long_head = key[-1], digest[start[last]]
            done = len(key) if cols is None or last < 0 or hot[last] else int(start[last])  # the last run may go on
            left = [x[done:] for x in now]
            yield from pairs([x[:done] for x in now], np.flatnonzero(np.repeat(~hot, size)[:done]))

    return run


def _several(now: list[np.ndarray]) -> list[np.ndarray]:
    """The rows of the keys that have several and of the last key, by key and digest, each text once."""
    key = now[0]
    if not len(key):
        return now
    first = np.append(True, key[1:] != key[:-1])
    at = np.flatnonzero(~(first & np.append(first[1:], False)))
    at = at[np.lexsort((now[2][at], now[1][at], key[at]))]
    key, digest = now[0][at], now[1][at]
    new = np.append(True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1]))
    return [x[at[new]] for x in now]


def _met(a: np.ndarray, b: np.ndarray, hot: np.ndarray | None) -> pa.RecordBatch:
    h = pa.nulls(len(a), pa.int64()) if hot is None else pa.array(hot)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), h], names=["a", "b", "hot"])


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for b in batches:
        yield [b.column(k).to_numpy() for k in range(5)]


def _signed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "n", *[f"s{k}" for k in range(BATCHES)], "content"]
        for b in batches:
            for rows, texts in _texts(b, least):
                tokens, starts = bag_tokens(texts)
                sig = [bits(minima(tokens, starts, BANDS * ROWS + BATCH * k, BATCH)) for k in range(BATCHES)]
                at = pa.array(rows, pa.int64())
                n = pa.array(list(map(len, texts)), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("digest").take(at), n, *map(pa.array, sig), b.column("content").take(at)], names=names)

    return run


def bag_likeness(a: list[str], b: list[str]) -> float:
    common = sum((Counter(a) & Counter(b)).values())
    return common / (len(a) + len(b) - common) if a or b else 0.0


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Counter, int]] = {}

        def bag(text: str) -> tuple[Counter, int]:
            got = known.get(text)
            if got is None:
                if len(known) >= 4096:
                    known.clear()
                words = WORD.findall(text.lower())
                got = known[text] = (Counter(words), len(words))
            return got

        for b in batches:
            like = []
            for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist()):
                (p, m), (q, n) = sorted((bag(x), bag(y)), key=lambda z: len(z[0]))
                common = sum(min(c, q[w]) for w, c in p.items() if w in q)
                like.append(common / (m + n - common))
            at = pa.array([k for k, s in enumerate(like) if s >= threshold], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at), pa.array(like, pa.float64()).take(at)], names=["a", "b", "likeness"])

    return run


def _centre(texts: pd.DataFrame) -> pd.DataFrame:
    """(head, centre, content): each word as often as at least half of the texts have it."""
    count: dict[str, list[int]] = {}
    for t in texts["content"]:
        for w, c in Counter(WORD.findall(t.lower())).items():
            count.setdefault(w, []).append(c)
    need = -(-len(texts) // 2)
    words = [w for w in sorted(count) if len(count[w]) >= need for _ in range(sorted(count[w])[-need])]
    content = " ".join(words)
    digest = int.from_bytes(hashlib.blake2b(content.encode("utf_8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return pd.DataFrame({"head": [texts["head"].iloc[0]], "centre": [digest], "content": [content]})


def _differing(a: str, b: str, last: int) -> str:
    """SQL of the number of differing bits in batches 0 to last of two signatures."""
    return "(" + " + ".join(f"bit_count({a}s{k} ^ {b}s{k})" for k in range(last + 1)) + ")"


BANDED = "key bigint, digest bigint, n int, " + ", ".join(f"s{k} bigint" for k in range(CARRIED))


class NearDuplicates:
    """The families of texts of `rows`, and the links between texts of different families, of likeness at least `threshold`.

    rows: (id, grp, content); only texts of one grp (any type) are compared. Null ids, groups and contents, and texts of
    fewer than `least_words` words, are left out; a row delivered several times counts once. Words are lower-cased runs
    of letters and digits, likeness is common words over words in either, counted as often as they occur.
    `members` is (digest, id); `family` (digest, family), the texts that share a family with others, or None if no key is frequent: all texts of a family
    are linked with each other; `links` is (a, b, likeness) of digests of different families, a < b.
    """

    def __init__(self, rows: DataFrame, threshold: float = 0.7, least_words: int = 20, longest_run: int = RUN, whole_run: int = WHOLE):
        base = rows.where("id is not null and grp is not null and content is not null").where(F.length("content") >= 2 * least_words - 1)
        base = base.select("id", F.xxhash64(F.col("grp").cast("string"), "content").alias("digest"), F.xxhash64(F.col("grp").cast("string")).alias("grp"), "content")
        self.threshold, self.least, self.need = threshold, least_words, fewest_agreements(threshold)
        banded = spread(base.select("digest", "grp", "content")).mapInArrow(_banded(least_words, longest_run), BANDED)
        most = [BATCH * (k + 1) - self.need[k] for k in range(CARRIED)]
        sorted_keys = banded.repartition("key").sortWithinPartitions("key")  # one long number, so by radix
        self.met = cut(sorted_keys.mapInArrow(_meet(threshold, most, longest_run, whole_run), "a bigint, b bigint, hot bigint"))
        self.members = cut(base.select("digest", "id").distinct())
        self.copied = cut(self.members.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("first")).where("copies > 1"))
        wanted = self.met.select(F.explode(F.array("a", "b")).alias("digest")).union(self.copied.select("digest")).distinct()
        schema = "digest bigint, n int, " + ", ".join(f"s{k} bigint" for k in range(BATCHES)) + ", content string"
        self.texts = cut(base.select("digest", "content").join(wanted, "digest", "left_semi").mapInArrow(_signed(least_words), schema).dropDuplicates(["digest"]))
        pairs = self.met.where("hot is null").select("a", "b").distinct()
        self.family = None
        if not (hot := self.met.where("hot is not null")).isEmpty():
            self.family = cut(self._families(hot))
            pairs = cut(self._apart(pairs.union(self._between(base, hot))))
        sig = self.texts.drop("content")
        kept = pairs.join(sig.select(*[F.col(c).alias(f"a_{c}") for c in sig.columns]), F.col("a") == F.col("a_digest"))
        kept = kept.join(sig.select(*[F.col(c).alias(f"b_{c}") for c in sig.columns]), F.col("b") == F.col("b_digest"))
        for k in range(CARRIED, BATCHES):  # one batch of the signature after the other
            kept = kept.where(F.expr(f"{_differing('a_', 'b_', k)} <= {BATCH * (k + 1) - self.need[k]}"))
        self.links = cut(self._verified(kept.select("a", "b"), threshold, self.texts))

    @staticmethod
    def _verified(pairs: DataFrame, threshold: float, texts: DataFrame, others: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) of that likeness: digests of `texts` (digest, content), b of `others` if given."""
        both = pairs.join(texts.select(F.col("digest").alias("a"), F.col("content").alias("ta")), "a").join(
            (texts if others is None else others).select(F.col("digest").alias("b"), F.col("content").alias("tb")), "b"
        )
        return both.select("a", "b", "ta", "tb").mapInArrow(_exact(threshold), "a bigint, b bigint, likeness double")

    def _families(self, hot: DataFrame) -> DataFrame:
        """(digest, family): texts of frequent keys within half the allowed distance of a centre, each with the centre that has most texts.

        A text whose centres are all weak is also compared with the one that most texts of its centre have chosen.
        """
        half = 1 - (1 - self.threshold) / 2 + 1e-9
        digests = hot.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
        texts = cut(self.texts.select("digest", "content").join(digests, "digest", "left_semi"))
        at = self._verified(hot.select("a", "b").where("a <> b").distinct(), self.threshold, texts).select("a", "b")
        at = cut(at.union(hot.select("b", "b").distinct()).toDF("a", "head"))
        some = at.withColumn("k", F.row_number().over(W.partitionBy("head").orderBy(F.xxhash64("a", "head")))).where(F.col("k") <= SAMPLE)
        told = some.join(texts.select(F.col("digest").alias("a"), "content"), "a").select("head", "content")
        made = cut(told.groupBy("head").applyInPandas(_centre, "head bigint, centre bigint, content string"))
        centres = cut(made.select(F.col("centre").alias("digest"), "content").dropDuplicates(["digest"]))
        tried = at.join(made.select("head", F.col("centre").alias("b")), "head").select("a", "b").distinct()
        near = cut(self._verified(tried, half, texts, centres).select("a", "b"))
        rank = near.groupBy("b").agg(F.struct(F.count("*").alias("n"), F.min("b").alias("b")).alias("rank"))
        chosen = cut(near.join(rank, "b").groupBy("a").agg(F.max("rank").alias("rank")).select("a", F.col("rank.b").alias("own")))
        other = near.join(chosen, "a").groupBy("b", "own").agg(F.count("*").alias("n")).groupBy("b").agg(F.max_by("own", F.struct("n", "own")).alias("better"))
        moved = chosen.join(other.withColumnRenamed("b", "own"), "own").where("own <> better").select("a", F.col("better").alias("b"))
        moved = self._verified(moved, half, texts, centres).select("a", F.col("b").alias("better"))
        got = cut(chosen.join(moved, "a", "left").select(F.col("a").alias("digest"), F.coalesce("better", "own").alias("family")))
        return got.join(got.groupBy("family").agg(F.count("*").alias("n")).where("n > 1").select("family"), "family").select("digest", "family")

    def _family_of(self, rows: DataFrame, digest: str, name: str) -> DataFrame:
        if self.family is None:
            return rows.withColumn(name, F.col(digest))
        f = self.family.select(F.col("digest").alias(digest), F.col("family").alias("__f"))
        return rows.join(f, digest, "left").withColumn(name, F.coalesce("__f", digest)).drop("__f")

    def _between(self, base: DataFrame, hot: DataFrame) -> DataFrame:
        """Likely pairs of texts that share a frequent key and are of different families; families meet by key before their texts do."""
        digests = cut(hot.select(F.explode(F.array("a", "b")).alias("digest")).distinct())
        own = base.select("digest", "grp", "content").join(digests, "digest", "left_semi").dropDuplicates(["digest"])
        rows = own.mapInArrow(_banded(self.least, None), BANDED).join(hot.select(F.col("hot").alias("key")).distinct(), "key", "left_semi")
        rows = cut(self._family_of(rows, "digest", "family"))
        of = rows.select("key", "family").distinct()
        mixed = of.groupBy("key").agg(F.min("family").alias("x"), F.max("family").alias("y")).where("x < y").select("key")
        of = cut(of.join(mixed, "key"))
        two = of.select("key", F.col("family").alias("fa")).join(of.select("key", F.col("family").alias("fb")), "key").where("fa < fb")
        side = lambda x: rows.select("key", F.col("family").alias(f"f{x}"), F.col("digest").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "s0", "s1")])
        likely = " and ".join(f"{_differing('a_', 'b_', k)} <= {BATCH * (k + 1) - self.need[k]}" for k in range(CARRIED))
        met = two.join(side("a"), ["key", "fa"]).join(side("b"), ["key", "fb"]).where(f"least(a_n, b_n) >= {self.threshold!r} * greatest(a_n, b_n) and {likely}")
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _apart(self, pairs: DataFrame) -> DataFrame:
        rows = self._family_of(self._family_of(pairs.distinct(), "a", "fa"), "b", "fb")
        return rows.where("fa <> fb").select("a", "b")

    def classes(self) -> DataFrame:
        """(id, text_id, class_id, class_rows, links): every row that is linked to another.

        text_id is the smallest id of the rows of the same text, class_id that of the rows of its family, of which there are class_rows, and
        links the number of texts of other families that the text is linked to. With text_links() this gives every pair: two rows are linked if they
        have the same class_id or if their texts are linked.
        """
        long_enough = self.texts.select("digest")
        rows = self._family_of(self.members.join(long_enough, "digest", "left_semi"), "digest", "family")
        degree = self.links.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count("*").alias("links"))
        text = rows.groupBy("digest").agg(F.min("id").alias("text_id"))
        family = rows.groupBy("family").agg(F.min("id").alias("class_id"), F.count("*").alias("class_rows"))
        got = rows.join(text, "digest").join(family, "family").join(degree, "digest", "left")
        got = got.where("class_rows > 1 or links is not null")
        return got.select("id", "text_id", "class_id", "class_rows", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))

    def text_links(self) -> DataFrame:
        """(text_a, text_b, likeness): linked texts of different families, each named by the smallest id of its rows; text_a < text_b."""
        first = self.members.groupBy("digest").agg(F.min("id").alias("first"))
        both = self.links.join(first.select(F.col("digest").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("digest").alias("b"), F.col("first").alias("y")), "b")
        return both.select(F.least("x", "y").alias("text_a"), F.greatest("x", "y").alias("text_b"), "likeness")

    def pairs(self, expand: int = EXPAND) -> DataFrame:
        """(id_a, id_b), id_a < id_b: linked rows; all of them, unless classes (families with their copies) exceed `expand` rows.

        In a larger class each row is paired with the smallest id alone; of two linked texts with more than expand^2 pairs of
        rows, each row is paired with the other text's smallest id. No text loses a link by that, and classes() with text_links() give all pairs at any size.
        """
        rows = self._family_of(self.members.join(self.texts.select("digest"), "digest", "left_semi"), "digest", "family")
        size = rows.groupBy("family").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
        own = cut(rows.join(size, "family").select("family", "id", "n", "first"))
        few = own.where(F.col("n") <= expand).select("family", "id")
        x, y = few.alias("x"), few.alias("y")
        within = x.join(y, F.expr("x.family = y.family and x.id < y.id")).select(F.col("x.id").alias("p"), F.col("y.id").alias("q"))
        stars = own.where((F.col("n") > expand) & (F.col("id") != F.col("first"))).select(F.col("first").alias("p"), F.col("id").alias("q"))
        # The texts that are linked: how many rows they have, and the smallest id.
        ends = self.links.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
        rows = cut(self.members.join(ends, "digest", "left_semi"))
        size = cut(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")))
        side = lambda s: size.select(F.col("digest").alias(s), F.col("n").alias(f"n_{s}"), F.col("first").alias(f"first_{s}"))
        links = cut(self.links.join(side("a"), "a").join(side("b"), "b"))
        full = F.col("n_a") * F.col("n_b") <= expand * expand
        one = rows.select(F.col("digest").alias("a"), F.col("id").alias("p"))
        other = rows.select(F.col("digest").alias("b"), F.col("id").alias("q"))
        across = links.where(full).select("a", "b").join(one, "a").join(other, "b").select("p", "q")
        many = links.where(~full)
        to_b = many.select("a", F.col("first_b").alias("q")).join(one, "a").select("p", "q")
        to_a = many.select("b", F.col("first_a").alias("p")).join(other, "b").select("p", "q")
        every = within.union(stars).union(across).union(to_b).union(to_a)
        return every.where("p <> q").select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()

    def groups(self) -> DataFrame:
        """(id, group_id, links): every row with a partner, the smallest id of its group, and how many texts of other families its own is linked to."""
        edges = self.links.select("a", "b") if self.family is None else self.links.select("a", "b").union(self.family.select("digest", "family"))
        alone = self.copied.select("digest").join(self.texts.select("digest"), "digest", "left_semi")
        comp = components(edges)
        degree = self.links.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count("*").alias("links"))
        texts = comp.select(F.col("node").alias("digest"), "component").unionByName(alone.select("digest", F.col("digest").alias("component")))
        texts = texts.groupBy("digest").agg(F.min("component").alias("component")).join(degree, "digest", "left")
        rows = cut(self.members.join(texts, "digest"))
        first = rows.groupBy("component").agg(F.min("id").alias("group_id"))
        return rows.join(first, "component").select("id", "group_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph of edges (a, b): the smallest node of each connected component.

    Alternates linking each node's larger neighbours, then its smaller ones, to its smallest neighbour until nothing changes;
    every round is written to the shared folder. A node's neighbours are only aggregated, never collected.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v")
        new = cut(new.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
