"""Where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import functools
import hashlib
import pathlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temp folder where unset (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if folder is None:
        current = sc.getCheckpointDir()
        if current:
            return current.rsplit("/", 1)[0]
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="trackflux-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame) -> DataFrame:
    """Write once to reliable checkpoint files and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@functools.cache
def _code_version() -> str:
    root = pathlib.Path(__file__).resolve().parents[1]
    digest = hashlib.md5()
    for f in sorted(root.rglob("*.py")):
        digest.update(f.read_bytes())
    return digest.hexdigest()[:10]


def fingerprint(spark: SparkSession, paths: list[str], *settings) -> str:
    """Identity of input files (path, length, change time), settings and code."""
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm = spark.sparkContext._jvm
    digest = hashlib.md5(repr((_code_version(), settings)).encode())
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(hconf).listFiles(path, True)  # files in nested folders count too
        marks = []
        while files.hasNext():
            st = files.next()
            marks.append(f"{st.getPath()}|{st.getLen()}|{st.getModificationTime()}")
        digest.update("\n".join(sorted(marks)).encode())
    return digest.hexdigest()[:16]


def content_mark(df: DataFrame) -> str:
    """Identity of a table: its files if it is read from files, else a hash over all columns of all rows."""
    files = df.inputFiles()
    if files:
        return fingerprint(df.sparkSession, sorted(files), *df.columns)
    rows = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return hashlib.md5(repr((df.dtypes, rows[0], str(rows[1]))).encode()).hexdigest()[:16]


def checked_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it has at most ``rows`` (narrow) rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached_table(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame],
                 settings: tuple = (), partition_by: list[str] | None = None, force: bool = False) -> DataFrame:
    """Build a table once per distinct input and read it from the shared folder.

    The folder name carries the fingerprint, so changed inputs, settings or
    code never meet an old table.
    """
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{fingerprint(spark, inputs, name, settings)}"
    if force or not exists(spark, f"{path}/_SUCCESS"):
        writer = build().write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.parquet(path)
