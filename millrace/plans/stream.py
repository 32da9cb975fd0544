"""Queries on the incremental forms; each runs its stream over all that is there and gives the final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import bpe
from millrace.plans.registry import query
from millrace.runtime import new_path, table
from millrace.streaming import incremental as inc


def _state(spark) -> str:
    return new_path(spark, "stream")


@query("str_1", "SELECT count(*) AS n_docs, sum(strlen(text) + 1)::BIGINT AS n_tokens, sum(strlen(text))::BIGINT AS n_bytes FROM documents WHERE text <> ''")
def str_1(spark, d):
    rows = inc.prepare_incrementally(inc.table_stream(spark, d, "documents"), _state(spark))
    return rows.agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"))


@query("str_5", "SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type, user_id")
def str_5(spark, d):
    return inc.follow_log(inc.table_stream(spark, d, "events"), _state(spark), ["event_type", "user_id"], ["ts", "event_id"], "value")


def _names(spark, d) -> dict[int, bytes]:
    """Bytes of the ids of a vocabulary, a configuration table."""
    return {r[0]: bytes(r[1]) for r in table(spark, d, "vocab").select("token_id", "token_bytes").collect()}


_TEXTS = """WITH e AS (SELECT DISTINCT example_id, ids FROM examples WHERE len(ids) > 0), u AS (SELECT example_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM e)
SELECT example_id, md5(decode(unhex(string_agg(hex(token_bytes), '' ORDER BY pos)))) AS digest FROM u JOIN vocab ON token_id = id GROUP BY example_id"""


@query("str_4", _TEXTS.replace("SELECT example_id, md5", "SELECT example_id AS seq, md5"))
def str_4(spark, d):
    """Examples decoded as a stream: (seq, digest of the text)."""
    tokens = inc.table_stream(spark, d, "examples").where("size(ids) > 0").select(F.col("example_id").alias("seq"), "ids").distinct()
    long = tokens.select("seq", F.posexplode("ids").alias("pos", "tok"))
    rows = inc.decode_stream(long, _names(spark, d), _state(spark))
    parts = rows.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"))
    return parts.select("seq", F.md5(F.array_join(F.col("p.text"), "")).alias("digest"))


@query("tok_16", _TEXTS)
def tok_16(spark, d):
    """Token by token, with incomplete characters held back; the chunks make up the text."""
    names = spark.sparkContext.broadcast(_names(spark, d))

    @F.pandas_udf("string")
    def chunked(ids):
        import pandas as pd

        class Plain(bpe.Vocabulary):
            def decode_bytes(self, some):
                return b"".join(names.value[int(i)] for i in some)

        v = Plain([])
        return pd.Series(["".join(inc.decode_chunks(list(x), v)) for x in ids])

    rows = table(spark, d, "examples").where("size(ids) > 0").select("example_id", "ids").distinct()
    return rows.select("example_id", F.md5(chunked("ids")).alias("digest"))
