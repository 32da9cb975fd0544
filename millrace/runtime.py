"""Session helpers shared by every operator: lineage cuts, bounded broadcasts, table access."""

from __future__ import annotations

import atexit
import hashlib
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 64 bytes or less that may be sent to every executor; beyond it a join is left to shuffle.
BROADCAST_ROWS = 500_000

_written: list[tuple[SparkSession, str]] = []


_shipped: set[str] = set()
_local: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Put this package where the executors' Python finds it, once per application, by way of the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = f"{shared_dir(spark).rstrip('/')}/{root.name}-{app}.zip"
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hp.getFileSystem(spark._jsc.hadoopConfiguration()).create(hp, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the first one read also ships the package to the executors."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local session without any (a test) gets one of its own; on a cluster it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if not own.isEmpty():
        return own.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="millrace-test-")
        _written.append((spark, _local[sc.applicationId]))
    return _local[sc.applicationId]


def new_path(spark: SparkSession, name: str, ending: str = "") -> str:
    """A path of its own in the shared folder; what is written there is removed when the driver process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}{ending}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lost executor then costs no recomputation.

    The table is removed when the driver process ends.
    """
    spark = df.sparkSession
    path = new_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written() -> None:
    """Remove the tables that cut() wrote."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is gone, so the folder's owner cleans up
            return


atexit.register(drop_written)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores if it has fewer, as a table in one small file has; otherwise as it is.

    For scans that are followed by much work a row. A large table has more splits than cores, and is never shuffled by this. A plan
    with exchanges is left alone, as its partitions are known only once it has run.
    """
    run = df._jdf.queryExecution()
    if run.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if run.toRdd().getNumPartitions() < cores else df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to hold at most `rows` rows; otherwise df as it is, to be shuffled.

    df should already be materialised (see cut), as the count runs it.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def some_files(df: DataFrame, most: int = 64) -> DataFrame:
    """The rows of at most so many of the files that df reads, the same ones in every run; df itself if it has no more, or isn't a plain scan.

    For samples that models are fitted on, so that they don't cost a scan of the whole table.
    """
    files = df.inputFiles()
    if len(files) <= most:
        return df
    names = {unquote(f).rsplit("/", 1)[-1] for f in files}
    picked = sorted(names, key=lambda f: hashlib.md5(f.encode()).digest())[:most]
    try:
        return df.where(F.col("_metadata.file_name").isin(picked))
    except AnalysisException:
        return df
