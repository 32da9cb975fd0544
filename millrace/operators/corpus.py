"""Preparing a corpus: ordinals, split, totals, and rolling documents into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions import bpe
from millrace.operators.order import positioned, restarting_groups
from millrace.runtime import cut
from millrace.sources import shards


def usable(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with a text; null and empty ones are dropped, white ones kept."""
    c = F.col(f"`{text_col}`")
    return docs.where(c.isNotNull() & (c != ""))


def every_kth(fraction: float) -> int:
    """Which document of how many goes to validation: int(1 / fraction). A fraction of 0 has no such document and is an error."""
    return int(1 / fraction)


def split_name(ordinal: Column, fraction: float) -> Column:
    """val for each k-th document (1-based, over all of them), train for the others; all train if fraction is 0."""
    if not fraction:
        return F.lit("train")
    return F.when(ordinal % every_kth(fraction) == 0, "val").otherwise("train")


def measured(docs: DataFrame, id_col: str, text_col: str, n_ids: Column | None = None) -> DataFrame:
    """positioned() rows (<id>, n_bytes, len) of usable documents; len is the number of tokens with the end token; bytes count none for it."""
    n = F.octet_length(F.col(f"`{text_col}`")).cast("bigint")
    rows = usable(docs, text_col).select(F.col(f"`{id_col}`"), n.alias("n_bytes"), ((n if n_ids is None else n_ids) + 1).alias("len"))
    return positioned(rows, [f"`{id_col}`"], ["len"])


def split_totals(rows: DataFrame, fraction: float) -> DataFrame:
    """(split, n_docs, n_tokens, n_bytes) of measured() rows."""
    by = rows.groupBy(split_name(F.col("ord"), fraction).alias("split"))
    return by.agg(F.count("*").alias("n_docs"), F.sum("len").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"))


def corpus_totals(rows: DataFrame) -> DataFrame:
    """(n_docs, n_tokens, n_bytes, bytes_per_token) over both splits; tokens include the end tokens, of at least one."""
    t = rows.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))
    return t.withColumn("bytes_per_token", F.round(F.col("n_bytes") / F.greatest("n_tokens", F.lit(1)), 6))


def rolled(rows: DataFrame, shard_tokens: int, fraction: float) -> DataFrame:
    """(split, shard, n_docs, n_tokens): whole documents rolled into shards, which end with the document that reaches shard_tokens."""
    own = rows.select(split_name(F.col("ord"), fraction).alias("split"), F.col("ord").alias("doc"), "len")
    own = positioned(own, ["split", "doc"], ["len"])
    groups = own.select("split", "ord", "len").join(restarting_groups(own, shard_tokens, "roll", "split"), ["split", "ord"])
    return groups.groupBy("split", F.col("grp").alias("shard")).agg(F.count("*").alias("n_docs"), F.sum("len").alias("n_tokens"))


def prepare(docs: DataFrame, v: bpe.Vocabulary, train_dir: str, val_dir: str | None = None, shard_tokens: int = 100_000_000, fraction: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode a corpus, split it, roll it into shards and write them with their indexes; gives the train split's shards and tokens, and the progress counts.

    Both indexes carry the bytes per token and number of documents of the whole corpus. A val_dir with a fraction of 0 is an error.
    """
    if val_dir and not fraction:
        raise ZeroDivisionError("a validation folder needs a fraction")
    seen = Observation("prepare")
    src = usable(docs, text_col).observe(seen, F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes"))
    end = F.array(F.lit(v.end_id()))
    enc = cut(bpe.encode(src, v, id_col, text_col).withColumn("ids", F.concat("ids", end)))
    rows = positioned(enc.select(id_col, F.size("ids").cast("bigint").alias("len")), [id_col], ["len"])
    counts = seen.get
    tokens = rows.agg(F.coalesce(F.sum("len"), F.lit(0))).head()[0]
    extra = {"bytes_per_token": counts["bytes"] / max(tokens, 1), "n_documents": counts["docs"], "eos_id": v.end_id()}
    done = {}
    for split, folder in (("train", train_dir), ("val", val_dir)):
        if not folder:
            continue
        own = positioned(rows.where(split_name(F.col("ord"), fraction) == split).select(id_col, "len"), [id_col], ["len"])
        grp = own.select(id_col, "ord").join(restarting_groups(own, shard_tokens, "roll"), "ord")
        index = cut(shards.write_shards(enc.join(grp, id_col).select("grp", "ord", "ids"), folder, v.size))
        shards.write_index(docs.sparkSession, folder, index, v.size, extra)
        if split == "train":
            done = {"shards": index.count(), "tokens": index.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).head()[0]}
    return done | dict(counts)
