"""Byte-level pair encoding: training, encoding and decoding.

A piece is written as one character per symbol (see char), so that merging a pair is replace() on a string (left to
right, without overlap) and all of it stays in the JVM. Training counts pairs over distinct pieces, weighted by frequency.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.pieces import pieces
from millrace.runtime import cut, spread

#: Symbol id k is the character U+3400 + k; those from the surrogates on are moved past them.
BASE, SURROGATES, MOVED = 0x3400, 0xD800, 0x800
#: The most symbols that there are characters for.
MOST_IDS = 0x110000 - BASE - MOVED
BYTES = 256
#: Distinct pieces up to which training runs in the driver instead of in one job per merge.
DRIVER_PIECES = 400_000
#: Most frequent pairs that a round of distributed training looks at, and the length from which a piece is merged with a heap.
TOP, LONG_PIECE = 256, 48
#: Rounds of distributed training after which the symbols are written out, to keep plans short.
ROUNDS_PER_CUT = 8
#: Pieces whose ids a worker remembers.
MEMO = 500_000

def char(k: int) -> str:
    """The character of symbol k."""
    return chr(BASE + k if BASE + k < SURROGATES else BASE + k + MOVED)


def symbol(c: str) -> int:
    """The symbol of a character."""
    return ord(c) - BASE - (MOVED if ord(c) > SURROGATES else 0)


_BYTE_CHARS = "".join(char(k) for k in range(BYTES))


def symbols(piece: Column) -> Column:
    """A piece's UTF-8 bytes, one character per byte."""
    codes = F.regexp_extract_all(F.hex(F.encode(piece, "UTF-8")), F.lit(".."), F.lit(0))
    table = F.array(*[F.lit(c) for c in _BYTE_CHARS])
    return F.array_join(F.transform(codes, lambda h: F.element_at(table, F.conv(h, 16, 10).cast("int") + 1)), "")


def pair_counts(words: DataFrame) -> DataFrame:
    """(pair, cnt) of words (symbols, freq): how often two symbols stand side by side; aaa holds aa twice."""
    pairs = F.expr("transform(sequence(1, length(symbols) - 1), i -> substr(symbols, i, 2))")
    rows = words.where("length(symbols) > 1").select(F.explode(pairs).alias("pair"), "freq")
    return rows.groupBy("pair").agg(F.sum("freq").alias("cnt"))


def best_pair(counts: DataFrame) -> DataFrame:
    """The most frequent pair, of equal ones the smaller; no row if there is none."""
    return counts.where("cnt > 0").orderBy(F.desc("cnt"), "pair").limit(1)


def merge(symbol_col: Column, pair: str, new_id: int) -> Column:
    """Replace a pair (two characters) by a new symbol."""
    return F.replace(symbol_col, F.lit(pair), F.lit(char(new_id)))


def train(counts: DataFrame, n_merges: int) -> list[tuple[int, int, int]]:
    """Merges (a, b, new_id) in order, learned from (piece, freq); ends early when no pair is left.

    Up to DRIVER_PIECES distinct pieces the loop runs in the driver, beyond it in rounds of an aggregation each, which take all pairs
    that can't have been changed by the ones before them.
    """
    if n_merges > MOST_IDS - BYTES:
        raise ValueError(f"at most {MOST_IDS - BYTES} merges")
    words = cut(counts.select(symbols(F.col("piece")).alias("symbols"), "freq"))
    if words.limit(DRIVER_PIECES + 1).count() <= DRIVER_PIECES:
        return _train_here([(r[0], r[1]) for r in words.toLocalIterator()], n_merges)
    merges: list[tuple[int, int, int]] = []
    rounds = 0
    while len(merges) < n_merges:
        top = pair_counts(words).where("cnt > 0").orderBy(F.desc("cnt"), "pair").limit(TOP).collect()
        if not top:
            break
        for pair in apart([r["pair"] for r in top])[: n_merges - len(merges)]:
            new = BYTES + len(merges)
            merges.append((symbol(pair[0]), symbol(pair[1]), new))
            words = words.select(merge(F.col("symbols"), pair, new).alias("symbols"), "freq")
        rounds += 1
        if rounds % ROUNDS_PER_CUT == 0:
            words = cut(words)
    return merges


def apart(pairs: list[str]) -> list[str]:
    """The first pairs, in order of frequency, up to one that shares a symbol with one before it.

    Merging a pair changes the counts of pairs with its symbols alone, and a new pair is at most as frequent as an old one with one of these; as those
    all come later, the pairs given are the ones that a round each would have chosen.
    """
    used: set[str] = set()
    for k, pair in enumerate(pairs):
        if used & {*pair}:
            return pairs[:k]
        used |= {*pair}
    return pairs


def _train_here(words: list[tuple[str, int]], n_merges: int) -> list[tuple[int, int, int]]:
    """The same loop over words in memory; only the words that hold a merged pair are counted again."""
    text = [w for w, _ in words]
    freq = [f for _, f in words]
    count: dict[str, int] = defaultdict(int)
    where: dict[str, set[int]] = defaultdict(set)

    def tally(k: int, sign: int, touched: set[str]) -> None:
        w = text[k]
        for p in map("".join, zip(w, w[1:])):
            count[p] += sign * freq[k]
            touched.add(p)
            if sign > 0:
                where[p].add(k)

    for k in range(len(text)):
        tally(k, 1, set())
    heap = [(-c, p) for p, c in count.items()]  # also holds counts that are no longer true, which are passed over
    heapify(heap)
    merges: list[tuple[int, int, int]] = []
    while len(merges) < n_merges and heap:
        c, pair = heappop(heap)
        if c >= 0 or count.get(pair) != -c:
            continue
        new = BYTES + len(merges)
        merges.append((symbol(pair[0]), symbol(pair[1]), new))
        touched: set[str] = set()
        for k in where.pop(pair):
            if pair in text[k]:
                tally(k, -1, touched)
                text[k] = text[k].replace(pair, char(new))
                tally(k, 1, touched)
        for p in touched:
            if count[p] > 0:
                heappush(heap, (-count[p], p))
            else:
                del count[p]
                where.pop(p, None)
    return merges


class Vocabulary:
    """Merges and special tokens of a tokenizer. Specials are the last ids of vocab_size, with a gap if merges ended early."""

    def __init__(self, merges: list[tuple[int, int, int]], specials: list[str] = (), vocab_size: int | None = None):
        floor = BYTES + len(merges) + len(specials)
        vocab_size = floor if vocab_size is None else vocab_size
        if vocab_size < floor:
            raise ValueError(f"vocab_size {vocab_size} is below {floor}")
        self.merges = list(merges)
        self.rank = {(a, b): (r, new) for r, (a, b, new) in enumerate(merges)}
        self.specials = {s: vocab_size - len(specials) + k for k, s in enumerate(specials)}
        self.bytes = {k: bytes([k]) for k in range(BYTES)}
        for a, b, new in merges:
            self.bytes[new] = self.bytes[a] + self.bytes[b]

    @property
    def size(self) -> int:
        return max(BYTES + len(self.merges), max(self.specials.values(), default=-1) + 1)

    def end_id(self) -> int:
        """The id of the first end token there is."""
        for name in ("<|endoftext|>", "<|eot|>", "</s>"):
            if name in self.specials:
                return self.specials[name]
        raise KeyError("no end token among the specials")

    def encode_piece(self, piece: str) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until no pair is known."""
        ids = list(piece.encode("utf_8", "surrogatepass"))
        if len(ids) > LONG_PIECE:
            return self._merge_long(ids)
        while len(ids) > 1:
            known = [(self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
            if not known:
                break
            _, i = min(known)
            ids[i : i + 2] = [self.rank[ids[i], ids[i + 1]][1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n: a heap of known pairs over a chain of what is left; entries whose ids have changed are passed over."""
        rank, after, before = self.rank, list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(rank[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapify(heap)
        end = len(ids)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i] if ids[i] == a else end
            if j >= end or ids[j] != b:
                continue
            ids[i], ids[j] = rank[a, b][1], -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < end and (p := (ids[k], ids[after[k]])) in rank:
                    heappush(heap, (rank[p][0], k, *p))
        return [x for x in ids if x >= 0]

    def decode_bytes(self, ids: list[int]) -> bytes:
        names = {i: s.encode() for s, i in self.specials.items()}
        out = []
        for i in ids:
            if i not in names and i not in self.bytes:
                raise ValueError(f"unknown token id {i}")
            out.append(names.get(i) or self.bytes[i])
        return b"".join(out)

    def to_json(self) -> str:
        return json.dumps({"merges": self.merges, "specials": self.specials, "size": self.size})

    @classmethod
    def from_json(cls, text: str) -> Vocabulary:
        d = json.loads(text)
        names = sorted(d["specials"], key=d["specials"].get)
        return cls([tuple(m) for m in d["merges"]], names, d["size"])


def vocabulary_table(spark, v: Vocabulary) -> DataFrame:
    """(id, bytes, is_special) of a vocabulary."""
    rows = [(k, bytearray(b), False) for k, b in v.bytes.items()] + [(k, bytearray(s.encode()), True) for s, k in v.specials.items()]
    return spark.createDataFrame(rows, "id int, bytes binary, is_special boolean")


def merges_table(spark, v: Vocabulary) -> DataFrame:
    return spark.createDataFrame([(r, *m) for r, m in enumerate(v.merges)], "rank int, a int, b int, new_id int")


def encode_pieces(distinct: DataFrame, v: Vocabulary) -> DataFrame:
    """(piece, ids) of distinct pieces: each is encoded once, in Arrow batches."""
    shared = distinct.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [shared.value.encode_piece(p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["piece", "ids"])

    return distinct.select("piece").mapInArrow(run, "piece string, ids array<int>")


def encode(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text", allowed: str | set[str] = "none") -> DataFrame:
    """(<id>, ids): every non-null text encoded; an empty text has no ids.

    allowed: the specials whose ids stand for them, "all" or "none". Unless it is "none" the text is cut around all specials, and those that
    aren't allowed are encoded as the text they are.

    Each batch encodes its different pieces once and keeps them for the batches after it, so no piece is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(v)
    src = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    names = {"all": set(v.specials), "none": set()}[allowed] if isinstance(allowed, str) else {*allowed} & {*v.specials}
    if v.specials and allowed != "none":
        parts = split_specials(F.col("text"), list(v.specials))
        cut_up = F.flatten(F.transform(parts, lambda x: F.when(x.isin(*sorted(names)), F.array(x)).otherwise(pieces(x)) if names else pieces(x)))
    else:
        cut_up = pieces(F.col("text"))
    src = spread(src).select("id", cut_up.alias("pieces"))
    own = {n: [v.specials[n]] for n in names}  # no piece reads like a special that was cut out
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = dict(own)
        for b in batches:
            column = b.column("pieces")
            bounds = column.offsets.to_numpy() - column.offsets[0].as_py()
            coded = column.flatten().dictionary_encode()
            if len(known) >= MEMO:
                known = dict(own)
            each = []
            for p in coded.dictionary.to_pylist():
                got = known.get(p)
                if got is None:
                    got = known[p] = shared.value.encode_piece(p)
                each.append(got)
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            flat = np.fromiter((i for ids in each for i in ids), np.int32, int(sizes.sum()))
            begins = np.cumsum(sizes) - sizes
            which = coded.indices.to_numpy()
            n = sizes[which]
            ends = np.cumsum(n)
            place = np.repeat(begins[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            offsets = np.concatenate([[0], ends])[bounds].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[place]))
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], names=["id", "ids"])

    return src.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def split_specials(text: Column, specials: list[str]) -> Column:
    """The text cut around special tokens, which are parts of their own; empty parts are dropped."""
    if not specials:
        return F.filter(F.array(text), lambda x: x != "")
    names = "|".join("\\Q" + s + "\\E" for s in sorted(specials, key=len, reverse=True))
    return F.filter(F.split(text, f"(?={names})|(?<={names})"), lambda x: x != "")


def decode(rows: DataFrame, v: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(<id>, text) of (<id>, ids); invalid UTF-8 becomes U+FFFD, an unknown id is an error, null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(v)
    src = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else shared.value.decode_bytes(x).decode("utf_8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], names=["id", "text"])

    return src.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def compression(text: Column, n_ids: Column) -> Column:
    """UTF-8 bytes per token, of at least one token."""
    return F.octet_length(text) / F.greatest(n_ids, F.lit(1))
