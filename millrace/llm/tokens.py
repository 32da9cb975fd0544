"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import spread

#: Folder of the public vocabulary files, and the file used unless the caller names another.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict = {}


def encoder(path: str):
    """The tokenizer of a .tiktoken rank file; kept for the life of the Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_sizes(docs: DataFrame, id_col: str, text_col: str, keep: list[str] = (), path: str | None = None) -> DataFrame:
    """One row (id, *keep, n_tokens bigint) per row of docs; null and empty texts have 0 tokens.

    Specials in a text are ordinary text. Whole texts are encoded, a batch at a time; lone surrogates count as U+FFFD.
    """
    path = path or os.path.join(TOKENIZER_DIR, TOKENIZER_FILE)
    cols = [F.col(f"`{c}`") for c in (id_col, *keep)]
    narrow = docs.select(*cols, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    docs.sparkSession.sparkContext.addFile(path)  # executors get the file from the driver
    name = os.path.basename(path)
    out_schema = docs.select(*cols, F.lit(0).cast("bigint").alias("n_tokens")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(sizes, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"]
            )

    return spread(narrow).mapInArrow(count, out_schema)
