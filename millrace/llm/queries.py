"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import encoding, leakage, mixing, neardup, packing, pairs, splitting, tokens, turns
from millrace.runtime import cut, small, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p1_items(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, documents): in how many documents each leaked item stands."""
    return p1_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "messages"), table(spark, d, "documents"))


def p2_defects(spark: SparkSession, d: str) -> DataFrame:
    """(defect, pairs): how many pairs have each defect."""
    return p2_found(spark, d).groupBy("defect").agg(F.count("*").alias("pairs"))


def _near_duplicates(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    who = turns.speaker(F.col("role"))
    rows = table(spark, d, "messages").where(who.isin("user", "assistant"))
    return neardup.NearDuplicates(rows.select(F.col("message_id").alias("id"), who.alias("grp"), "content"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    linked = _near_duplicates(spark, d).pairs()
    return linked.select(F.col("id_a").alias("message_id_a"), F.col("id_b").alias("message_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near_duplicates(spark, d).groups().withColumnRenamed("id", "message_id")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """(message_id, text_id, class_id, class_rows, links); with p3_links it gives every pair, however large a class is."""
    return _near_duplicates(spark, d).classes().withColumnRenamed("id", "message_id")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """(text_a, text_b, likeness): linked texts of different classes, by the smallest message_id of each."""
    return _near_duplicates(spark, d).text_links()


def _split(spark: SparkSession, d: str, verdict_only: bool) -> DataFrame:
    return splitting.split_examples(table(spark, d, "examples"), table(spark, d, "window_profiles"), table(spark, d, "vocab"), verdict_only)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, True)


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d, False)


def p4_verified(spark: SparkSession, d: str) -> DataFrame:
    """(example_id, profile, n, too_long, wrong_overlap) of p4_pieces: how many ids an example's pieces cover without their overlaps, and what breaks the rules."""
    limits = small(table(spark, d, "window_profiles").select("profile", "max_tokens", "overlap"))
    rows = p4_pieces(spark, d).join(limits, "profile")
    w = W.partitionBy("example_id", "profile").orderBy("piece")
    rows = rows.withColumn("end", F.col("start") + F.size("ids")).withColumn("before", F.lag("end").over(w)).withColumn("tail", F.expr("slice(lag(ids) over (partition by example_id, profile order by piece), -overlap, overlap)"))
    shared = F.least("before", "overlap")
    bad = F.col("before").isNotNull() & ((F.col("start") != F.col("before") - shared) | (F.col("overlap") > 0) & (F.size("tail") == F.col("overlap")) & (F.expr("slice(ids, 1, overlap)") != F.col("tail")))
    return rows.groupBy("example_id", "profile").agg(
        F.max("end").cast("int").alias("n"), F.sum((F.size("ids") > F.col("max_tokens")).cast("int")).cast("int").alias("too_long"), F.sum(F.coalesce(bad, F.lit(False)).cast("int")).cast("int").alias("wrong_overlap")
    )


def p5_verified(spark: SparkSession, d: str) -> DataFrame:
    """(profile, documents, overfull, incomplete) of p5_containers, a row per row of window_profiles: documents that have a container,
    containers above the capacity, and documents whose pieces aren't those that their tokens make."""
    sizes, profiles = _sizes(spark, d), table(spark, d, "window_profiles")
    return packing.verify(cut(packing.pack(sizes, profiles)), sizes, profiles)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("source", mixing.source_key(F.col("source")))
    return cut(tokens.token_sizes(docs, "doc_id", "text", ["source"]))


def p5_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), table(spark, d, "window_profiles"))


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p5_containers(spark, d))


def p6_chosen(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "mixture_targets"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _sizes(spark, d), table(spark, d, "mixture_targets")
    plan = cut(mixing.shares_plan(sizes, targets))
    return mixing.shares_report(sizes, targets, mixing.mix(sizes, targets, plan=plan), plan)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair(table(spark, d, "documents"), found_only=True)


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_items": p1_items,
        "p2_found": p2_found,
        "p2_defects": p2_defects,
        "p3_found": p3_found,
        "p3_groups": p3_groups,
        "p3_classes": p3_classes,
        "p3_links": p3_links,
        "p4_found": p4_found,
        "p4_pieces": p4_pieces,
        "p4_verified": p4_verified,
        "p5_verified": p5_verified,
        "p5_containers": p5_containers,
        "p5_fill": p5_fill,
        "p6_chosen": p6_chosen,
        "p6_shares": p6_shares,
        "p7_found": p7_found,
        "p7_restored": p7_restored,
    }


#: Where natural boundaries lie, and whether more than max_tokens - overlap ids follow each other without one.
P4_FOUND = """
WITH e AS (SELECT DISTINCT example_id, ids, max_tokens, max_tokens - overlap AS most FROM examples JOIN window_profiles USING (profile)),
u AS (SELECT example_id, max_tokens, most, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM e),
v AS (SELECT token_id, token_bytes IN (encode('<|system|>'), encode('<|user|>'), encode('<|assistant|>')) AS is_role, token_bytes = encode('<|endoftext|>') AS is_end, token_bytes = encode('<|pad|>') AS is_pad,
right(hex(token_bytes), 2) = '0A' AS is_line, right(hex(token_bytes), 2) IN ('2E', '21', '3F') AS is_stop, left(hex(token_bytes), 2) IN ('20', '0A') AS is_blank
FROM vocab),
t AS (SELECT u.*, is_role, is_end, is_pad, is_line, is_stop, is_blank FROM u LEFT JOIN v ON id = token_id),
n AS (SELECT example_id, max(pos) FILTER (NOT coalesce(is_pad, false)) + 1 AS n FROM t GROUP BY example_id),
b AS (SELECT example_id, pos, coalesce(is_role, false) OR coalesce(lag(is_end OR is_line) OVER w, false) OR (coalesce(lag(is_stop) OVER w, false) AND coalesce(is_blank, false)) AS cut FROM t WINDOW w AS (PARTITION BY example_id ORDER BY pos)),
edges AS (SELECT example_id, pos FROM b JOIN n USING (example_id) WHERE (cut AND pos > 0 AND pos < n) OR pos = 0 UNION ALL SELECT example_id, n FROM n),
gaps AS (SELECT example_id, max(g) AS g FROM (SELECT example_id, pos - lag(pos) OVER (PARTITION BY example_id ORDER BY pos) AS g FROM edges) GROUP BY example_id)
SELECT e.example_id, CASE WHEN g > most THEN 'forced' ELSE 'natural' END AS cut FROM e JOIN n USING (example_id) JOIN gaps USING (example_id) WHERE n > max_tokens
"""


#: Every example above its limit is covered whole, without padding, and no piece breaks the rules.
P4_VERIFIED = """
WITH e AS (SELECT DISTINCT example_id, profile, ids, max_tokens FROM examples JOIN window_profiles USING (profile)), u AS (SELECT example_id, profile, max_tokens, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM e),
n AS (SELECT example_id, profile, max_tokens, max(pos) FILTER (id NOT IN (SELECT token_id FROM vocab WHERE token_bytes = encode('<|pad|>'))) + 1 AS n FROM u GROUP BY ALL)
SELECT example_id, profile, n::INT AS n, 0::INT AS too_long, 0::INT AS wrong_overlap FROM n WHERE n > max_tokens
"""
#: Every document has its containers in every profile, none of them overfull.
P5_VERIFIED = "SELECT profile, (SELECT count(*) FROM documents) AS documents, 0::INT AS overfull, 0::INT AS incomplete FROM window_profiles"


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_FOUND, "p4_verified": P4_VERIFIED, "p5_verified": P5_VERIFIED}
