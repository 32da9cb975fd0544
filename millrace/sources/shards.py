"""Token shards: a binary file of fixed-width tokens behind a header of 1,024 bytes, and the index of a folder of them."""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.runtime import cut, spread

#: Layout of the header and codes of the two widths.
MAGIC, VERSION, HEADER_BYTES = b"SLMTOK\x00\x00", 1, 1024
LAYOUT = struct.Struct("<8s5Q")
WIDTHS = {0: np.dtype("<u2"), 1: np.dtype("<u4")}


def dtype_name(vocab_size: int) -> str:
    return "uint16" if vocab_size <= 65536 else "uint32"


def dtype_column(vocab_size: Column) -> Column:
    """Column form of dtype_name()."""
    return F.when(vocab_size <= 65536, dtype_name(65536)).otherwise(dtype_name(65537))


def pack_header(n_tokens: int, vocab_size: int, n_docs: int) -> bytes:
    code = 0 if dtype_name(vocab_size) == "uint16" else 1
    return LAYOUT.pack(MAGIC, VERSION, code, n_tokens, vocab_size, n_docs).ljust(HEADER_BYTES, b"\0")


def unpack_header(data: bytes) -> dict:
    magic, version, code, n_tokens, vocab_size, n_docs = LAYOUT.unpack_from(data)
    if magic != MAGIC or version != VERSION or code not in WIDTHS:
        raise ValueError("not a token shard")
    return {"dtype": WIDTHS[code].name, "n_tokens": n_tokens, "vocab_size": vocab_size, "n_docs": n_docs}


def shard_bytes(docs: list[list[int]], vocab_size: int) -> tuple[bytes, bytes]:
    """A shard and its sidecar of document starts (uint64); empty documents are ignored, ids out of the vocabulary refused."""
    docs = [d for d in docs if len(d)]
    flat = np.concatenate([np.asarray(d, np.int64) for d in docs]) if docs else np.zeros(0, np.int64)
    if len(flat) and (flat.min() < 0 or flat.max() >= vocab_size):
        raise ValueError("a token id is outside the vocabulary")
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]]).astype("<u8") if docs else np.zeros(0, "<u8")
    body = flat.astype(WIDTHS[0 if dtype_name(vocab_size) == "uint16" else 1]).tobytes()
    return pack_header(len(flat), vocab_size, len(docs)) + body, starts.tobytes()


def shard_tokens(data: bytes) -> np.ndarray:
    head = unpack_header(data)
    return np.frombuffer(data, np.dtype(head["dtype"]).newbyteorder("<"), head["n_tokens"], HEADER_BYTES)


def _uri(path: str) -> str:
    """A path as Arrow's file systems take it."""
    return re.sub("^(?:file:)?(?=/)", "file://", re.sub("^file:///", "/", path))


def write_shards(tokens: DataFrame, path: str, vocab_size: int) -> DataFrame:
    """Write tokens (grp, ord, ids) as shard_%05d.bin with .docs sidecars; gives the index rows (name, n_tokens, n_docs, dtype).

    Executors write the shards, in streams of Arrow batches in order, to any file system that Arrow knows. A file gets its name when it is
    complete, so a task that is run again only replaces it. Empty documents are ignored, an id outside the vocabulary is an error.
    """
    dtype = WIDTHS[0 if dtype_name(vocab_size) == "uint16" else 1]
    live = tokens.where(F.size("ids") > 0)
    # The windows also keep each shard in one task: a bare repartition may be dropped, and a join's partitions split, by the planner.
    whole, inside = W.partitionBy("grp"), W.partitionBy("grp").orderBy("ord")
    rows = live.select("grp", "ord", "ids", F.sum(F.size("ids").cast("bigint")).over(whole).alias("n_tokens"), F.count("*").over(whole).alias("n_docs"))
    rows = rows.withColumn("k", F.row_number().over(inside)).where("k > 0").select("grp", "ids", "n_tokens", "n_docs")
    base = _uri(path.rstrip("/"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        now, out, starts, done, total = None, None, [], [], 0

        def finish() -> None:
            out.close()
            name = f"{root}/shard_{now:05d}"
            with fs.open_output_stream(f"{name}.docs.tmp{tag}") as side:
                side.write(np.asarray(starts, "<u8").tobytes())
            fs.move(f"{name}.docs.tmp{tag}", f"{name}.docs")
            fs.move(f"{name}.bin.tmp{tag}", f"{name}.bin")

        for b in batches:
            sizes = b.column("ids").value_lengths().to_numpy()
            flat = b.column("ids").flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= vocab_size):
                raise ValueError("a token id is outside the vocabulary")
            ends = np.cumsum(sizes)
            grp = b.column("grp").to_numpy()
            for lo in [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1)] if len(grp) else []:
                hi = int(np.searchsorted(grp, grp[lo], "right"))
                if grp[lo] != now:
                    if out is not None:
                        finish()
                    now, starts, total, tag = int(grp[lo]), [], 0, uuid.uuid4().hex
                    n, d = b.column("n_tokens")[lo].as_py(), b.column("n_docs")[lo].as_py()
                    done.append((now, n, d))
                    out = fs.open_output_stream(f"{root}/shard_{now:05d}.bin.tmp{tag}")
                    out.write(pack_header(n, vocab_size, d))
                begin = ends[lo - 1] if lo else 0
                starts += (total + ends[lo:hi] - sizes[lo:hi] - begin).tolist()
                out.write(flat[begin : ends[hi - 1]].astype(dtype).tobytes())
                total += int(ends[hi - 1] - begin)
        if out is not None:
            finish()
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["grp", "n_tokens", "n_docs"])

    index = cut(rows.mapInArrow(write, "grp bigint, n_tokens bigint, n_docs bigint"))
    return index.select(F.format_string("shard_%05d.bin", "grp").alias("name"), "n_tokens", "n_docs", F.lit(dtype_name(vocab_size)).alias("dtype"))


def read_blocks(spark: SparkSession, path: str, block: int = 1 << 20) -> DataFrame:
    """(shard, start, ids, doc_starts) of all shards of a folder, in blocks of at most so many tokens; an empty shard gives one empty block.

    start is the block's place in its shard, doc_starts the places of the documents that begin in it; a missing sidecar gives none. Only names
    and sizes go into the plan: each task opens its ranges of the files.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    side = files.where("path like '%.docs'").select(F.regexp_replace("path", r"\.docs$", ".bin").alias("path"), F.col("length").alias("side"))
    both = files.where("path like '%.bin'").join(side, "path", "left")
    last = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("length") - HEADER_BYTES - 1) / (2 * block)).cast("bigint"))  # tokens have two bytes at least
    ranges = spread(cut(both.select("path", F.coalesce("side", F.lit(-1)).alias("side"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for b in batches:
            for p, side, k in zip(b.column("path").to_pylist(), b.column("side").to_pylist(), b.column("k").to_pylist()):
                fs, name = FileSystem.from_uri(_uri(p))
                with fs.open_input_file(name) as f:
                    head = unpack_header(f.read_at(HEADER_BYTES, 0))
                    kind = np.dtype(head["dtype"]).newbyteorder("<")
                    lo, hi = k * block, min((k + 1) * block, head["n_tokens"])
                    if lo >= hi and k:
                        continue
                    data = np.frombuffer(f.read_at(max(0, hi - lo) * kind.itemsize, HEADER_BYTES + lo * kind.itemsize), kind)
                starts = np.zeros(0, np.int64)
                if side > 0:
                    with fs.open_input_file(re.sub(r"\.bin$", ".docs", name)) as f:
                        n = side // 8
                        a, z = (_first_at(f, n, x) for x in (lo, hi))
                        starts = np.frombuffer(f.read_at((z - a) * 8, a * 8), "<u8").astype(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (data.astype(np.int32), starts)]
                yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]]), pa.array([lo], pa.int64()), *lists], names=["shard", "start", "ids", "doc_starts"])

    return ranges.mapInArrow(run, "shard string, start bigint, ids array<int>, doc_starts array<bigint>")


def _first_at(f, n: int, place: int) -> int:
    """The first of n sorted uint64 in a file that is at least `place`, by bisection on the file."""
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi) // 2
        if int.from_bytes(f.read_at(8, mid * 8), "little") < place:
            lo = mid + 1
        else:
            hi = mid
    return lo


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, ids, doc_starts) of all shards of a folder, each as one value; for large shards see read_blocks()."""
    parts = read_blocks(spark, path).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("start", "ids", "doc_starts"))).alias("p"))
    return parts.select("shard", F.flatten("p.ids").alias("ids"), F.flatten("p.doc_starts").alias("doc_starts"))


def index_json(shards: list[dict], vocab_size: int, extra: dict | None = None) -> str:
    """The index of a folder: totals, the shards, and extras beside them."""
    total = {"version": VERSION, "vocab_size": vocab_size, "n_tokens": sum(s["n_tokens"] for s in shards), "n_shards": len(shards), "shards": shards}
    return json.dumps(total | (extra or {}))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, n_tokens, n_docs, dtype) of an index file."""
    shards = spark.read.json(path, multiLine=True).select(F.posexplode("shards").alias("ord", "s"))
    return shards.select("ord", "s.name", "s.n_tokens", "s.n_docs", "s.dtype")


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Shard names in the order of the folder's index, or sorted if it has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(path))
    if "index.json" in names:
        return [r.name for r in read_index(spark, f"{folder}/index.json").orderBy("ord").collect()]
    return [n for n in names if n.endswith(".bin")]


def write_index(spark: SparkSession, folder: str, shards: DataFrame, vocab_size: int, extra: dict | None = None) -> None:
    """Write index.json for index rows (a row per shard) beside the shards, under a temporary name that is then renamed."""
    rows = [r.asDict() for r in shards.orderBy("name").collect()]
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(Path(f"{folder}/index.json.tmp"), True)
    out.write(bytearray(index_json(rows, vocab_size, extra).encode()))
    out.close()
    fs.delete(Path(f"{folder}/index.json"), False)
    fs.rename(Path(f"{folder}/index.json.tmp"), Path(f"{folder}/index.json"))


def mirror(spark: SparkSession, folder: str, target: str) -> None:
    """Copy a folder to another file system that Hadoop knows."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
