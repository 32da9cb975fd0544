"""Evaluation items leaking into documents (problem 1), as a prefix-filtered set join.

A document holds an item's passage if RUN words in a row of it stand in a row in the item. Each window of RUN words of
an item is the set of its RUN - SHINGLE + 1 shingles, all of which a matching place must have; so of the shingles in
order of rarity the prefix that has to be joined is one long: the window's rarest shingle. The length bound (RUN words) and the positional
bound (the window must fit around the shingle) leave the places where the window's words are compared one by one.

A long item's windows may lie in several blocks. Documents are read once a block. Of each, only the stretches are kept in which RUN - SHINGLE + 1 shingles in a row belong to any item; that
test needs the items' shingles alone, which go to the executors in blocks of at most BLOCK shingles. Shingle counts, the
join and the comparison then run over these stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import words
from millrace.runtime import cut, spread

#: Words in a row that make a leak, and words in a shingle.
RUN, SHINGLE = 10, 5
#: Words of an item that go into the same block.
STRETCH = 65_536
#: Shingles of items that one pass over the documents looks for; more items take more passes.
BLOCK = 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_keys(ids: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit keys of all runs of `size` in an array of word ids; a run with a 0 in it gets key 0."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64)
    key, real = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        part = x[k : k + n]
        key = (key ^ part) * _MIX
        key ^= key >> np.uint64(29)
        real &= part != 0
    key |= np.uint64(1)
    key[~real] = 0
    return key


class ItemIndex:
    """The words of a block of items by number, and its sorted shingle keys."""

    def __init__(self, words: dict[str, int], keys: np.ndarray):
        self.words, self.keys = words, np.unique(keys[keys != 0])
        bits = max(16, int(len(self.keys)).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True

    @classmethod
    def of(cls, windows: DataFrame) -> ItemIndex:
        """The index of a block; the driver gets its different words and, worked out by the executors, a number per different shingle."""
        shingles = windows.select(F.explode("shingles").alias("s")).distinct()
        names = shingles.select(F.explode(F.split("s", " ")).alias("w")).distinct().toArrow().column(0).to_pylist()
        number = {w: k for k, w in enumerate(sorted(names), 1)}
        shared = windows.sparkSession.sparkContext.broadcast(number)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = np.array([shared.value[w] for s in b.column(0).to_pylist() for w in s.split(" ")], np.int64)
                keys = shingle_keys(ids)[::SHINGLE] if len(ids) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

        keys = shingles.mapInArrow(keyed, "key bigint").toArrow().column(0).to_numpy()
        shared.unpersist()
        return cls(number, keys.view(np.uint64))

    def ids(self, text: list[str]) -> list[int]:
        get = self.words.get
        return [get(w, 0) for w in text]

    def members(self, keys: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero((keys != 0) & self.seen[(keys >> self.shift).astype(np.int64)])
        if len(maybe) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
            maybe = maybe[self.keys[at] == keys[maybe]]
        out = np.zeros(len(keys), bool)
        out[maybe] = len(self.keys) > 0
        return out


def stretches(hit: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs [a, b) of at least `least` True in a row."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    keep = b - a >= least
    return list(zip(a[keep].tolist(), b[keep].tolist()))


def _item_texts(items: DataFrame, item_id: str) -> DataFrame:
    """(item_id, text): an item's context followed by each of its choices; without choices the context alone."""
    choices = F.when(F.size("choices") > 0, F.col("choices")).otherwise(F.array(F.lit("")))
    return (
        items.select(F.col(f"`{item_id}`").alias("item_id"), F.coalesce("context", F.lit("")).alias("context"), F.explode(choices).alias("choice"))
        .select("item_id", F.concat_ws(" ", "context", "choice").alias("text"))
        .distinct()
    )


def _windows(texts: DataFrame, run: int) -> DataFrame:
    """(item_id, part, window array<string>, shingles array<string>): the distinct windows of `run` words of each item; part counts its stretches of STRETCH words."""
    kind = texts.schema["item_id"].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, part, wins, shs = [], [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                w = words(t)
                for i in range(len(w) - run + 1):
                    at.append(k)
                    part.append(i // STRETCH)
                    wins.append(w[i : i + run])
                    shs.append([" ".join(w[i + j : i + j + SHINGLE]) for j in range(run - SHINGLE + 1)])
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("item_id").take(pa.array(at, pa.int64())), pa.array(part, pa.int64()), pa.array(wins, strings), pa.array(shs, strings)],
                names=["item_id", "part", "window", "shingles"],
            )

    rows = texts.mapInArrow(cut_up, f"item_id {kind}, part bigint, window array<string>, shingles array<string>")
    return rows.groupBy("item_id", "window", "shingles").agg(F.min("part").alias("part"))


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", run: int = RUN, block: int = BLOCK
) -> DataFrame:
    """(<doc id>, <item id>): each document with each item of which it holds `run` or more words in a row.

    An item is its context followed directly by any one of its choices; words are runs of letters and digits of the
    text without case, markup, entities, invisible characters and hyphens at line ends. Null and empty texts, contexts
    and choices hold no words; items and documents of fewer than `run` words match nothing. Repeated rows of
    either table change nothing; every item that has the words is reported. Rows of null id are left out. run must be SHINGLE or more.
    """
    windows = cut(_windows(_item_texts(items.where(F.col(f"`{item_id}`").isNotNull()), item_id), run))
    n = windows.select(F.explode("shingles").alias("s")).agg(F.count_distinct("s")).head()[0]
    parts = max(1, -(-n // block))
    found = None
    for k in range(parts):
        own = windows if parts == 1 else windows.where(F.expr(f"pmod(xxhash64(item_id, part), {parts}) = {k}"))
        got = _leaks_of(docs, own, doc_id, text_col, run)
        found = got if found is None else found.unionByName(got)
    found = found.distinct() if parts > 1 else found  # a document may have been found by several blocks of an item
    return found.select(F.col("doc").alias(doc_id), F.col("item_id").alias(item_id))


def _leaks_of(docs: DataFrame, windows: DataFrame, doc_id: str, text_col: str, run: int) -> DataFrame:
    spark = docs.sparkSession
    # The block's windows, at most BLOCK shingles: evaluation items, not documents.
    index = spark.sparkContext.broadcast(ItemIndex.of(windows))
    src = docs.where(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text_col}`").alias("text")
    )
    kind = src.schema["doc"].dataType.simpleString()
    need = run - SHINGLE + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for b in batches:
            at, out = [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                w = words(t)
                if len(w) < run:
                    continue
                hit = ix.members(shingle_keys(np.array(ix.ids(w), np.int64)))
                for lo, hi in stretches(hit, need):
                    at.append(k)
                    out.append(w[lo : hi + SHINGLE - 1])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(pa.array(at, pa.int64())), pa.array(out, pa.list_(pa.string()))], names=["doc", "words"]
            )

    found = cut(spread(src).mapInArrow(scan, f"doc {kind}, words array<string>"))
    shingles = found.select(
        "doc", "words", F.posexplode(F.expr(f"transform(sequence(0, size(words) - {SHINGLE}), i -> array_join(slice(words, i + 1, {SHINGLE}), ' '))")).alias("pos", "shingle")
    )
    counts = shingles.groupBy("shingle").agg(F.count_distinct("doc").alias("df"))
    own = windows.select("item_id", "window", F.posexplode("shingles").alias("offset", "shingle"))
    prefix = cut(
        own.join(counts, "shingle")  # a window with a shingle that no document has can't match
        .groupBy("item_id", "window")
        .agg(F.min(F.struct("df", "shingle", "offset")).alias("rare"), F.count("*").alias("n"))
        .where(F.col("n") == need)
        .select("item_id", "window", F.col("rare.shingle").alias("shingle"), F.col("rare.offset").alias("offset"))
    )
    return (
        shingles.join(prefix, "shingle")  # of the stretches found, not of the documents
        .where((F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + run <= F.size("words")))
        .where(F.expr(f"slice(words, pos - offset + 1, {run}) = window"))
        .select("doc", "item_id")
        .distinct()
    )
