"""Incremental forms: preparing a growing corpus, following a metric log, decoding tokens as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from millrace.functions.bpe import Vocabulary
from millrace.operators.corpus import usable


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream; the rate limit bounds what a batch holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(str(path)).schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(str(path)) if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_available(stream: DataFrame, state: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process what there is, batch by batch, and stop; `state` keeps the offsets, so the next call goes on from there."""
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{state}/offsets").foreachBatch(each).start()
    query.awaitTermination()


def prepare_incrementally(docs: DataFrame, state: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(batch, <id>, n_tokens, n_bytes) of all documents seen so far, each batch written once under its number.

    A batch that is run again after a failure overwrites itself, so the result is the same.
    """
    spark = docs.sparkSession
    rows = usable(docs, text_col).select(F.col(id_col), (F.octet_length(text_col) + 1).cast("bigint").alias("n_tokens"), F.octet_length(text_col).cast("bigint").alias("n_bytes"))
    run_available(rows, state, lambda df, k: df.write.mode("overwrite").parquet(f"{state}/out/batch={k}"))
    return spark.read.parquet(f"{state}/out")


def follow_log(log: DataFrame, state: str, keys: list[str], order: list[str], value: str, fan: int = 8) -> DataFrame:
    """(*keys, value): the last value of each key.

    Each batch adds a table of its own keys; `fan` tables of one level are merged into one of the next, so a row is written once a level. A batch that is
    run again starts from the list of tables that the batch before left; what a batch replaced is deleted with the next one.
    """
    spark = log.sparkSession
    latest = lambda rows: rows.groupBy(*keys).agg(F.max_by("v", F.struct(*[f"v.{o}" for o in order])).alias("v"))
    named = lambda k: f"{state}/tables-{k}"

    def listed(k: int) -> list[tuple[str, int]]:
        return [(r.name, r.level) for r in spark.read.parquet(named(k)).orderBy("ord").collect()] if k >= 0 else []

    def fold(df: DataFrame, k: int) -> None:
        had = listed(k - 1)
        new = df.groupBy(*keys).agg(F.max_by(F.struct(*order, value), F.struct(*order)).alias("v"))
        name, level = f"{state}/table-{k}-0", 0
        new.write.mode("overwrite").parquet(name)
        now, made = [*had, (name, level)], [name]
        while sum(x == level for _, x in now) >= fan:
            merged = [n for n, x in now if x == level]
            name, level = f"{state}/table-{k}-{level + 1}", level + 1
            latest(spark.read.parquet(*merged)).write.mode("overwrite").parquet(name)
            now = [(n, x) for n, x in now if n not in merged] + [(name, level)]
            made.append(name)
        spark.createDataFrame([(j, *t) for j, t in enumerate(now)], "ord int, name string, level int").coalesce(1).write.mode("overwrite").parquet(named(k))
        spark.createDataFrame([(k,)], "k bigint").coalesce(1).write.mode("overwrite").parquet(f"{state}/last")
        kept = {n for n, _ in [*had, *now]}
        old = [named(k - 2), *[n for n, _ in listed(k - 2)]] if k >= 2 else []
        for n in {*old, *made} - kept:
            gone = spark._jvm.org.apache.hadoop.fs.Path(n)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    run_available(log, state, fold)
    k = spark.read.parquet(f"{state}/last").head()[0]
    return latest(spark.read.parquet(*[n for n, _ in listed(k)])).select(*keys, F.col(f"v.{value}").alias(value))


def complete_text(held: bytes) -> tuple[str, bytes]:
    """What can be decoded of held bytes, and the beginning of a character that isn't complete."""
    for n in range(1, min(3, len(held)) + 1):
        lead = held[-n]
        if lead >= 0xC0:  # a lead byte: is its character complete?
            size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            if n < size and lead <= 0xF4:
                return held[:-n].decode("utf_8", "replace"), held[-n:]
            break
        if lead < 0x80:
            break
    return held.decode("utf_8", "replace"), b""


def decode_chunks(ids: list[int], v: Vocabulary) -> list[str]:
    """Texts as they become complete, token by token; what is left at the end is flushed with replacement."""
    held, out = b"", []
    for i in ids:
        text, held = complete_text(held + v.decode_bytes([i]))
        if text:
            out.append(text)
    if held:
        out.append(held.decode("utf_8", "replace"))
    return out


def decode_stream(tokens: DataFrame, names: dict[int, bytes], state: str) -> DataFrame:
    """(seq, pos, text) of a stream of tokens (seq, pos, tok): each batch gives what became complete, the rest waits in the state.

    Within a batch tokens go by pos; tokens of a sequence come in order of batches.
    """
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(names)

    def step(key, frames: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        held = kept.get[0] if kept.exists else b""
        rows = pd.concat(list(frames)).sort_values("pos")
        text, held = complete_text(held + b"".join(shared.value[int(t)] for t in rows["tok"]))
        kept.update((held,))
        yield pd.DataFrame({"seq": [key[0]], "pos": [int(rows["pos"].iloc[0])], "text": [text]})

    kind = tokens.schema["seq"].dataType.simpleString()
    out = tokens.groupBy("seq").applyInPandasWithState(step, f"seq {kind}, pos int, text string", "held binary", "append", GroupStateTimeout.NoTimeout)
    run_available(out, state, lambda df, k: df.write.mode("overwrite").parquet(f"{state}/out/batch={k}"))
    return spark.read.parquet(f"{state}/out").select("seq", "pos", "text")
