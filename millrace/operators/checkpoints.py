"""A catalog of checkpoints: (name, step, permanent, files) and the files that are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def name_for(step: Column) -> Column:
    return F.format_string("step_%08d", step)


def step_of(name: Column) -> Column:
    """The number in the last part of a checkpoint's path; null if it is none."""
    return F.regexp_extract(F.regexp_replace(name, "/+$", ""), r"(?:^|/)step_(\d+)$", 1).try_cast("bigint")


def listed(entries: DataFrame) -> DataFrame:
    """Folders named step_..., not .tmp, with a readable manifest."""
    return entries.where("is_dir and name like 'step\\_%' and name not like '%.tmp' and manifest is not null")


def manifest_files(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of files read as binaryFile."""
    return files.select("path", F.length("content").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))


def verified(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """(name, ok): whether all files of a manifest are there with their size and, if it has one, their hash.

    wanted, there: (name, file, size, sha256). A manifest without files is in order.
    """
    t = there.select("name", "file", F.col("size").alias("t_size"), F.col("sha256").alias("t_sha"))
    same = (F.col("size") == F.col("t_size")) & (F.coalesce("sha256", F.lit("")).isin("") | (F.col("sha256") == F.col("t_sha")))
    ok = F.col("file").isNull() | F.coalesce(same, F.lit(False))
    return wanted.join(t, ["name", "file"], "left").groupBy("name").agg(F.bool_and(ok).alias("ok"))


def latest(catalog: DataFrame, ok: DataFrame, pointer: str | None) -> DataFrame:
    """The pointer's checkpoint if it verifies, else the newest that does; no row if none does."""
    good = catalog.join(ok.where("ok"), "name", "left_semi")
    return good.orderBy(F.desc(F.col("name") == F.lit(pointer)), F.desc("step")).limit(1)


def _older(rows: DataFrame, keep: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.orderBy(F.desc("step")))).where(F.col("__n") > keep).drop("__n")  # a catalog is small


def rotated_out(catalog: DataFrame, keep: int, permanent_every: int) -> DataFrame:
    """Checkpoints to delete: all but the newest `keep` (at least one) of those neither permanent nor at a milestone."""
    rolling = catalog.where("not permanent")
    if permanent_every:
        rolling = rolling.where(F.col("step") % permanent_every != 0)
    return _older(rolling, max(1, keep))


def pruned_from_mirror(catalog: DataFrame, keep: int) -> DataFrame:
    """Likewise for a mirror, where only the permanent mark protects; keep of 0 or less prunes nothing."""
    return _older(catalog.where("not permanent"), keep) if keep > 0 else catalog.where("false")


def mirrored(catalog: DataFrame, every: int) -> DataFrame:
    """(name, due): permanent ones and each every-th save go to the mirror."""
    nth = F.row_number().over(W.orderBy("step"))
    return catalog.select("name", (F.col("permanent") | (nth % max(1, every) == 0)).alias("due"))


def clean_key(key: Column) -> Column:
    """A parameter's name without the prefixes of wrappers."""
    return F.regexp_replace(key, r"^((_orig_mod|module)\.)+", "")
