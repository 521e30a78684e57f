"""Recording bundles: three CSV tables per recording, and cached tables."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.numeric import finite_number
from ..functions.storage import content_mark, exists, fingerprint
from ..schema import NEIGHBOR_SLOTS, RAW_TO_INTERNAL

BUNDLE_PARTS = ("tracks", "tracksMeta", "recordingMeta")
_WHOLE = {"vehicle_id", "frame", "lane_id", *NEIGHBOR_SLOTS}


def _files(spark: SparkSession, root: str, part: str) -> dict[tuple[str, ...], list[tuple[int, str]]]:
    """(recording_id, path) of all files of a part by their header. The driver lists names; files are opened by tasks."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(f"{root}/*_{part}.csv")
    fs = top.getFileSystem(conf)
    number_of: dict[str, int] = {}
    for status in fs.globStatus(top) or []:
        number = re.search(rf"(\d+)_{part}", status.getPath().getName())
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        for f in inside:
            if number is not None and not f.getPath().getName().startswith(("_", ".")):
                number_of[f.getPath().toString()] = int(number[1])
    header_of = first_lines(spark, list(number_of)) if number_of else {}
    found: dict[tuple[str, ...], list[tuple[int, str]]] = {}
    for path, number in number_of.items():
        line = header_of.get(_plain(path))
        found.setdefault(tuple(next(csv.reader([line]))) if line else (), []).append((number, path))
    return found


def _plain(path: str) -> str:
    """A path as both the file system and Spark's metadata column name it."""
    return re.sub("^file:/+", "/", unquote(path))


def first_lines(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first line of each text file that has one, read by a Spark job.

    While it runs, every file is a task of its own and hands over its lines one by one; a task ends with its first line, so a large file costs no
    more than a small one.
    """
    settings = {"spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes"), "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
    before = {k: spark.conf.get(k) for k in settings}

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
        rows = lines.mapInArrow(first, "path string, at bigint, value string").where("at = 0").select("path", "value").collect()  # a line per file
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return {_plain(r["path"]): r["value"] for r in rows}


def _read(spark: SparkSession, files: dict[tuple[str, ...], list[tuple[int, str]]], part: str) -> DataFrame:
    """One scan per distinct header; columns go by name, a column that a file lacks is NULL. Numbers are cast later."""
    out = None
    for header, members in sorted(files.items()):
        if not header:
            continue
        schema = StructType([StructField(c, StringType()) for c in header])
        raw = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv([p for _, p in members])
        number = F.regexp_extract(F.col("_metadata.file_path"), rf"(\d+)_{part}", 1).cast("bigint")
        df = raw.withColumn("recording_id", number)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no {part} files")
    return out


def read_bundle(spark: SparkSession, root: str, recording_id: int | None = None) -> dict[str, DataFrame]:
    """The three raw tables; a recording that lacks one of its files is an error. A file without rows is there."""
    files = {p: _files(spark, root, p) for p in BUNDLE_PARTS}
    have = {p: {i for members in f.values() for i, _ in members} for p, f in files.items()}
    lacking = sorted(set.union(*have.values()) - set.intersection(*have.values()))
    if lacking:
        raise FileNotFoundError(f"incomplete recordings: {lacking[:10]}")
    if recording_id is not None:
        files = {p: {h: [m for m in members if m[0] == recording_id] for h, members in f.items()} for p, f in files.items()}
        files = {p: {h: members for h, members in f.items() if members} for p, f in files.items()}
    return {p: _read(spark, f, p) for p, f in files.items()}


def rename_tracks(raw: DataFrame) -> DataFrame:
    """Exactly the mapped columns under internal names, typed, non-finite as NULL."""
    missing = [c for c in RAW_TO_INTERNAL if c not in raw.columns]
    if missing:
        raise ValueError(f"tracks lack columns {missing}")
    cols = []
    for src, name in RAW_TO_INTERNAL.items():
        c = finite_number(F.col(src))
        cols.append((c.cast("bigint") if name in _WHOLE else c).alias(name))
    out = raw.select("recording_id", *cols)
    return out.withColumn("lane_id", F.col("lane_id").cast("int"))


def rename_tracks_meta(raw: DataFrame) -> DataFrame:
    """Vehicle metadata with typed numbers and ``vehicle_id`` as key."""
    out = raw.withColumnsRenamed({"id": "vehicle_id"})
    typed = {}
    for c in out.columns:
        if c in ("recording_id", "class"):
            continue
        num = finite_number(F.col(c))
        whole = c in ("vehicle_id", "initialFrame", "finalFrame", "numFrames", "numLaneChanges")
        typed[c] = num.cast("bigint") if whole else num.cast("int") if c == "drivingDirection" else num
    return out.withColumns(typed)


def first_recordings(df: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` smallest recording ids."""
    keep = df.select("recording_id").distinct().orderBy("recording_id").limit(n)
    return df.join(keep, "recording_id", "left_semi")


def frame_range(df: DataFrame, first: int, last: int) -> DataFrame:
    """Inclusive frame range; the predicate reaches the Parquet scan."""
    return df.where(F.col("frame").between(first, last))


def load_frame_cache(spark: SparkSession, folder: str, n_recordings: int | None, build, inputs: list[str], force: bool = False) -> DataFrame:
    """Frame table named after the recording count and the files it is built from; reused unless one changed or forced."""
    path = f"{folder}/frames_{'all' if n_recordings is None else f'first{n_recordings}'}-{fingerprint(spark, inputs)}"
    if force or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").partitionBy("recording_id").parquet(path)
    return spark.read.parquet(path)


def load_window_cache(spark: SparkSession, folder: str, frames: DataFrame, W: int, stride: int, build,
                      force: bool = False) -> DataFrame:
    """Window table keyed by W, stride and the frames (their files, or their content if they have none)."""
    path = f"{folder}/W={W}/stride={stride}/frames={content_mark(frames)}"
    if force or not exists(spark, f"{path}/_SUCCESS"):
        build(frames, W, stride).write.mode("overwrite").parquet(path)
        spark.createDataFrame([(W, stride)], "W int, stride int").coalesce(1).write.mode("overwrite").json(f"{path}.meta")
    return spark.read.parquet(path)


def save_split(split: DataFrame, path: str, seed: int, train: float, val: float, W: int, stride: int) -> None:
    """Keys and settings of a split as JSON.

    Keys are JSON lines under one folder per split, so no list of all keys is
    ever held in one row; settings are one record beside them.
    """
    key = F.concat_ws(":", F.col("recording_id").cast("string"), F.col("vehicle_id").cast("string"))
    split.select("split", key.alias("key")).write.mode("overwrite").partitionBy("split").json(f"{path}/keys")
    split.sparkSession.createDataFrame(
        [(seed, train, val, W, stride)], "seed int, train_frac double, val_frac double, W int, stride int"
    ).coalesce(1).write.mode("overwrite").json(f"{path}/config")


def load_split(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Keys of a saved split; an unknown split name is an error."""
    if not exists(spark, f"{path}/keys"):
        raise FileNotFoundError(f"no split at {path}")
    if name is not None and name != "all" and not exists(spark, f"{path}/keys/split={name}"):
        raise KeyError(f"split {name!r} not in {path}")
    keys = spark.read.schema("key string, split string").json(f"{path}/keys")
    if name is not None and name != "all":
        keys = keys.where(F.col("split") == name)
    return keys.select(*parse_vehicle_key(F.col("key")), "split")


def parse_vehicle_key(key):
    """``"4.0:19.0"`` to (recording_id, vehicle_id)."""
    part = F.split(key, ":")
    return [
        part[i].cast("double").cast("bigint").alias(n) for i, n in enumerate(["recording_id", "vehicle_id"])
    ]


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """An aggregated report as one CSV or JSON file."""
    w = df.coalesce(1).write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.json(path)


def save_semantics(spark: SparkSession, path: str, styles: dict[int, str], actions: dict[tuple[int, int], str]) -> None:
    """Names of the states, one JSON record each."""
    rows = [(s, a, styles[s], name) for (s, a), name in actions.items()]
    spark.createDataFrame(rows, "s int, a int, style string, action string").coalesce(1).write.mode("overwrite").json(path)


def load_semantics(spark: SparkSession, path: str, S: int, A: int) -> list[str]:
    """``style/action`` names in state order; a state without record is an error, a missing name becomes its number."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no semantic map at {path}")
    rows = spark.read.schema("s int, a int, style string, action string").json(path).collect()  # one per state
    by = {(r["s"], r["a"]): f"{r['style'] or f's{r['s']}'}/{r['action'] or f'a{r['a']}'}" for r in rows}
    lost = [(s, a) for s in range(S) for a in range(A) if (s, a) not in by]
    if lost:
        raise KeyError(f"semantic map {path} lacks states {lost}")
    return [by[s, a] for s in range(S) for a in range(A)]
