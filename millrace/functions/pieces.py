"""Splitting text into pieces with the cl100k-style pattern, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern. (?U) gives Java the Unicode meaning of \s and of letter case.
PATTERN = (
    r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}"
    r"| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
)


def pieces(text: Column) -> Column:
    """The pieces of a text in order; joined again they are the text. Null stays null, an empty text has none."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


def piece_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(piece, freq) over all texts; null and empty texts have no pieces. Partial counts are made before the shuffle."""
    return docs.select(F.explode(pieces(F.col(f"`{text_col}`"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("freq"))


def prune_rare(counts: DataFrame, min_frequency: int = 2, above: int = 100_000) -> DataFrame:
    """Drop pieces rarer than min_frequency, but only if there are more than `above` different ones."""
    few = counts.agg((F.count("*") <= above).alias("few")).scalar()
    return counts.where(few | (F.col("freq") >= min_frequency))
