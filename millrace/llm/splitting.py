"""Cutting token sequences above a limit at natural boundaries, with overlap (problem 4).

Recursive bisection: a stretch that exceeds limit - overlap is cut at the strongest boundary near its midpoint, and so
are its halves; then each piece but the first is given the last `overlap` ids of the stretch before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The special tokens of the encoding.
PAD, END = b"<|pad|>", b"<|endoftext|>"
ROLES = (b"<|system|>", b"<|user|>", b"<|assistant|>")
#: Strengths of boundaries: at a role or end token, after a line feed, after a sentence.
TURN, LINE, SENTENCE = 3, 2, 1
#: "Near" the midpoint is within this part of the stretch's length on either side.
NEAR = 0.25
#: A vocabulary is a configuration table; more ids than this are refused.
VOCAB_ROWS = 4_000_000


class Vocab:
    """Lookup tables by token id of a vocabulary (token_id, token_bytes); ids outside it have no properties."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        n = max((i for i, _ in rows), default=-1) + 1
        self.line, self.stop, self.blank, self.role, self.end, self.pad = (np.zeros(n + 1, bool) for _ in range(6))
        for i, b in rows:
            self.line[i] = b.endswith(b"\n")
            self.stop[i] = b.endswith((b".", b"!", b"?"))
            self.blank[i] = b.startswith((b" ", b"\n"))
            self.role[i], self.end[i], self.pad[i] = b in ROLES, b == END, b == PAD
        self.n = n

    def strengths(self, ids: np.ndarray) -> np.ndarray:
        """For each position i, how strong a boundary lies before ids[i]; 0 for none and at i = 0."""
        at = np.where((ids >= 0) & (ids < self.n), ids, self.n)
        out = np.zeros(len(ids), np.int8)
        if len(ids) > 1:
            left, right = at[:-1], at[1:]
            out[1:] = np.where(
                self.role[right] | self.end[left], TURN,
                np.where(self.line[left], LINE, np.where(self.stop[left] & self.blank[right], SENTENCE, 0)),
            )
        return out

    def unpadded(self, ids: np.ndarray) -> int:
        """Length without the <|pad|> tokens at the end."""
        at = np.where((ids >= 0) & (ids < self.n), ids, self.n)
        real = np.flatnonzero(~self.pad[at])
        return int(real[-1]) + 1 if len(real) else 0


def bisect_cuts(strength: np.ndarray, most: int) -> tuple[list[int], bool]:
    """Cut positions (sorted) so that no stretch exceeds `most`, and whether some cut had no natural boundary to take."""
    places = np.flatnonzero(strength)
    cuts, forced, todo = [], False, [(0, len(strength))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= most:
            continue
        mid = (lo + hi) // 2
        inside = places[np.searchsorted(places, lo, "right") : np.searchsorted(places, hi, "left")]
        if len(inside):
            near = inside[np.abs(inside - mid) <= NEAR * (hi - lo)]
            if len(near):
                order = np.lexsort((near, np.abs(near - mid), -strength[near].astype(int)))
                cut = int(near[order[0]])
            else:
                cut = int(inside[np.abs(inside - mid).argmin()])
        else:
            cut, forced = mid, True
        cuts.append(cut)
        todo += [(lo, cut), (cut, hi)]
    return sorted(cuts), forced


def split_examples(
    examples: DataFrame, profiles: DataFrame, vocab: DataFrame, verdict_only: bool = False, id_col: str = "example_id"
) -> DataFrame:
    """Pieces of every example above its profile's max_tokens, padding at the end not counted.

    Result: (<id>, profile, piece, n_pieces, start, ids, mask, cut); start is the piece's first position in the example, its
    overlap included; cut is `forced` if any stretch of more than max_tokens - overlap ids has no natural boundary,
    else `natural`. verdict_only: (<id>, cut), once per example. Examples that fit, null or empty ids, and
    null or unknown profiles give no rows. A null or too short mask is filled with 0, a longer one cut; trailing padding is
    left out of the pieces. A null id inside `ids` is kept in the piece and is no boundary. Repeated rows give
    one result per id and profile; rows of one id that differ give the result of each. A profile needs
    0 <= overlap < max_tokens, others are left out; profiles and vocab are configuration tables, read by the driver.
    """
    limits = {
        r[0]: (r[1], r[2])
        for r in profiles.where("profile is not null and overlap >= 0 and max_tokens > overlap").select("profile", "max_tokens", "overlap").collect()
    }
    rows = vocab.where("token_id >= 0 and token_bytes is not null").select("token_id", "token_bytes").limit(VOCAB_ROWS + 1).collect()
    if len(rows) > VOCAB_ROWS:
        raise ValueError(f"a vocabulary of more than {VOCAB_ROWS} ids")
    voc = examples.sparkSession.sparkContext.broadcast(Vocab([(r[0], bytes(r[1])) for r in rows]))
    longest = F.create_map(*[F.lit(x) for p, (m, _) in limits.items() for x in (p, m)]) if limits else None
    known = examples.select(F.col(f"`{id_col}`").alias("id"), "profile", "ids", "mask")
    known = known.where(F.size("ids") > F.try_element_at(longest, F.col("profile"))) if limits else known.where("false")
    if verdict_only:
        known = known.drop("mask")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = voc.value
        for b in batches:
            out: list[list] = [[] for _ in range(2 if verdict_only else 8)]
            id_at, prof = b.column("id"), b.column("profile").to_pylist()
            picked = []
            for k in range(b.num_rows):
                most, overlap = limits[prof[k]]
                values = b.column("ids")[k].values
                ids = values.fill_null(-1).to_numpy(zero_copy_only=False)
                n = v.unpadded(ids)
                if n <= most:
                    continue
                cuts, forced = bisect_cuts(v.strengths(ids[:n]), most - overlap)
                cut = "forced" if forced else "natural"
                if verdict_only:
                    picked.append(k)
                    out[1].append(cut)
                    continue
                m = b.column("mask")[k]
                mask = m.values.fill_null(0).to_numpy(zero_copy_only=False)[:n] if m.is_valid else np.zeros(0, np.int8)
                mask = np.pad(mask, (0, n - len(mask)))
                edges = [0, *cuts, n]
                for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    start = max(0, lo - overlap) if i else 0
                    picked.append(k)
                    for col, x in zip(out[1:], (prof[k], i, len(edges) - 1, start, values.slice(start, hi - start).to_pylist(), mask[start:hi].tolist(), cut)):
                        col.append(x)
            first = id_at.take(pa.array(picked, pa.int64()))
            types = [pa.string()] if verdict_only else [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.string()]
            names = ["id", "cut"] if verdict_only else ["id", "profile", "piece", "n_pieces", "start", "ids", "mask", "cut"]
            yield pa.RecordBatch.from_arrays([first, *[pa.array(c, t) for c, t in zip(out[1:], types)]], names=names)

    kind = known.schema["id"].dataType.simpleString()
    if verdict_only:
        return known.mapInArrow(pieces, f"id {kind}, cut string").distinct().withColumnRenamed("id", id_col)
    schema = f"id {kind}, profile string, piece int, n_pieces int, start int, ids array<int>, mask array<tinyint>, cut string"
    return known.mapInArrow(pieces, schema).dropDuplicates(["id", "profile", "piece", "start", "ids", "mask"]).withColumnRenamed("id", id_col)
