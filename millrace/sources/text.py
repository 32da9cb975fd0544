"""Text sources: one row (path, ord, text) per document, in the order of files and of records in them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, pos bigint, text string"


def parquet_texts(spark: SparkSession, path: str | list[str], text_key: str = "text") -> DataFrame:
    """One column of Parquet files, read alone; null and empty texts are dropped. pos is the row's place in the scan of its file."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path)).select(F.col(f"`{text_key}`").cast("string").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("pos"))
    return rows.where("text is not null and text <> ''").select("path", "pos", "text")


def strict_json(raw: Column) -> Column:
    """A JSON value as a variant, null if the text is anything else. Spark's parser stops after a first value, so what follows it
    is told by two wrappings that can't both be closed early."""
    listed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"a":'), raw, F.lit("}")))
    single = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(listed.isNotNull() & member.isNotNull() & single, F.try_variant_get(listed, "$[0]", "variant"))


def _value_text(raw: Column, text_key: str) -> Column:
    """The text of a JSON line: the key's value of an object, or the value itself as Python would print it."""
    v = strict_json(raw)
    kind = F.schema_of_variant(v)
    member = F.try_variant_get(v, f"$['{text_key}']", "string")
    falsy = F.schema_of_variant(F.try_variant_get(v, f"$['{text_key}']", "variant")).isin("VOID") | member.isin("", "0", "0.0", "false")
    plain = F.try_variant_get(v, "$", "string")
    printed = F.when(kind == "BOOLEAN", F.initcap(plain)).when(kind == "VOID", F.lit("None")).otherwise(plain)
    return F.when(kind.startswith("OBJECT"), F.when(~falsy, member)).otherwise(printed)


def json_texts(spark: SparkSession, path: str, text_key: str = "text") -> DataFrame:
    """JSON lines (gzip by extension): blank and malformed lines are skipped, and falsy texts dropped; other values than objects are printed."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))
    raw = raw.withColumn("pos", F.monotonically_increasing_id())
    return raw.where(r"trim(value) <> ''").select("path", "pos", _value_text(F.col("value"), text_key).alias("text")).where("text is not null and text <> ''")


def decode_bytes(content: Column) -> Column:
    """UTF-8 with replacement of what is invalid, and line ends as \\n."""
    text = F.decode(content, "UTF-8")
    return F.regexp_replace(text, "\r\n?", "\n")


def whole_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A file is a document, even an empty one; gzip by extension, invalid UTF-8 replaced."""
    def gunzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            out = []
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                data = gzip.decompress(c) if p.endswith(".gz") else c
                out.append(data.decode("utf_8", "replace").replace("\r\n", "\n").replace("\r", "\n"))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([0] * len(out), pa.int64()), pa.array(out, pa.string())], names=["path", "pos", "text"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(gunzip, SCHEMA)
    empty = []  # Spark's scans leave out files without a byte
    for p in [path] if isinstance(path, str) else path:
        hp = spark._jvm.org.apache.hadoop.fs.Path(p)
        listed = hp.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hp) or []
        empty += [(f.getPath().toString(), 0, "") for f in listed if f.isFile() and not f.getLen()]
    return found.unionByName(spark.createDataFrame(empty, SCHEMA)) if empty else found


def blank_line_parts(docs: DataFrame, keep: list[str] = (), text_col: str = "text") -> DataFrame:
    """(*keep, part, text): documents cut at blank lines; white parts are dropped, the others end in a blank line again. Null texts have no parts."""
    cols = [F.col(f"`{c}`") for c in keep]
    parts = docs.select(*cols, F.posexplode(F.split(F.col(f"`{text_col}`"), "\n\n")).alias("part", "text"))
    return parts.where(r"text rlike '(?U)\\S'").withColumn("text", F.concat("text", F.lit("\n\n")))


def is_json_path(path: str) -> bool:
    """Any path with .jsonl in it, or ending in .json; so .json.gz is plain text."""
    return ".jsonl" in path or path.endswith(".json")


@dataclass(frozen=True)
class HubSpec:
    name: str
    config: str | None
    split: str


def hub_spec(uri: str) -> HubSpec:
    """hf://name[@config][:split], split train unless named."""
    m = re.fullmatch(r"hf://([^@:]+)(?:@([^:]*))?(?::(.*))?", uri)
    if not m:
        raise ValueError(f"no hub dataset: {uri}")
    return HubSpec(m[1], m[2] or None, m[3] or "train")


#: Files of a corpus folder that aren't text.
SKIPPED = (".bin", ".json", ".docs")


def read_corpus(spark: SparkSession, uri: str, text_key: str = "text", split_blank: bool = False, limit: int = 0) -> DataFrame:
    """(path, pos, text) of a file, a folder (its files in order of name, not below it) or a glob of Parquet files.

    A hub dataset is read from local Parquet files only: registering a data source named hf makes them readable. limit 0 is no limit;
    split_blank cuts single plain-text files alone.
    """
    if uri.startswith("hf://"):
        spec = hub_spec(uri)
        docs = spark.read.format("hf").option("name", spec.name).option("config", spec.config or "").option("split", spec.split).load()
    elif any(ch in uri for ch in "*?["):
        docs = parquet_texts(spark, uri, text_key)
    else:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.getFileStatus(path).isDirectory() and not uri.rstrip("/").endswith(".parquet"):
            names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isFile())
            names = [n for n in names if not n.endswith(SKIPPED) and not n.startswith(("_", "."))]
            docs = None
            for group in ("parquet", "json", "text"):
                own = [p for n in names if _kind(p := f"{uri.rstrip('/')}/{n}") == group]
                if own:
                    part = _read_kind(spark, own, group, text_key)
                    docs = part if docs is None else docs.unionByName(part)
            if docs is None:
                docs = spark.createDataFrame([], SCHEMA)
        else:
            docs = _read_kind(spark, [uri], _kind(uri), text_key)
            if split_blank and _kind(uri) == "text":
                docs = blank_line_parts(docs, ["path", "pos"]).select("path", (F.col("pos") + F.col("part")).alias("pos"), "text")
    return docs.orderBy("path", "pos").limit(limit) if limit else docs


def _kind(path: str) -> str:
    return "parquet" if path.endswith(".parquet") else "json" if is_json_path(path) else "text"


def _read_kind(spark: SparkSession, paths: list[str], kind: str, text_key: str) -> DataFrame:
    if kind == "parquet":
        return parquet_texts(spark, paths, text_key)
    if kind == "json":
        return json_texts(spark, paths, text_key)
    return whole_texts(spark, paths)


def skip_and_take(docs: DataFrame, skip: int, take: int, ord_col: str = "ord") -> DataFrame:
    """Rows skip + 1 to skip + take by ordinal; take 0 is all the rest."""
    o = F.col(ord_col)
    return docs.where((o > skip) & (o <= skip + take)) if take else docs.where(o > skip)


def character_budget(positioned_docs: DataFrame, most: int, len_col: str = "len") -> DataFrame:
    """The longest prefix of at most `most` characters; stops before the document that would exceed it."""
    return positioned_docs.where(F.col(f"before_{len_col}") + F.col(len_col) <= most)


def json_rows(spark: SparkSession, path: str, schema: str, limit: int = 0) -> DataFrame:
    """JSON lines of a known schema; the limit counts lines, blank ones too, and a malformed line is an error."""
    raw = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    raw = raw.orderBy("pos").limit(limit) if limit else raw
    return raw.where("trim(value) <> ''").select("pos", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("pos", "r.*")


def metric_log(spark: SparkSession, path: str) -> DataFrame:
    """A metric log: JSON lines, in which NaN and Infinity may stand bare."""
    return spark.read.option("allowNonNumericNumbers", True).json(path)


def manifest(text: Column) -> Column:
    """A manifest, or null where it is missing or malformed."""
    return strict_json(text)
