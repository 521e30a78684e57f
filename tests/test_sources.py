"""CSV bundles by column name, caches that notice changes, samples and small reports."""

import pathlib

import pytest
from pyspark.sql import functions as F

from trackflux.functions.storage import content_mark, fingerprint
from trackflux.operators import kinematics as kin, reports as rep, sampling
from trackflux.sources import bundles

META = "id,class,drivingDirection,width\n1,Car,1,4.5\n"
REC = "upperLaneMarkings,lowerLaneMarkings\n0;4;8,10;14\n"


def bundle(root: pathlib.Path, tracks: dict[int, str], skip: tuple = ()):
    for i, text in tracks.items():
        for part, body in (("tracks", text), ("tracksMeta", META), ("recordingMeta", REC)):
            if (i, part) not in skip:
                (root / f"{i:02d}_{part}.csv").write_text(body)
    return str(root)


def test_columns_go_by_name_in_every_file(spark, tmp_path):
    root = bundle(tmp_path, {1: "id,frame,x,y\n7,1,10,20\n", 2: "id,frame,y,x\n7,1,20,10\n", 3: "y,id,frame\n20,7,1\n", 4: "id,frame,x,y\n"})
    t = bundles.read_bundle(spark, root)["tracks"]
    assert {(r.recording_id, r.x, r.y) for r in t.collect()} == {(1, "10", "20"), (2, "10", "20"), (3, None, "20")}
    assert [r.recording_id for r in bundles.read_bundle(spark, root, 2)["tracks"].collect()] == [2]


def test_headers_of_many_files_are_read_by_tasks(spark, tmp_path, monkeypatch):
    tracks = {i: ("id,frame,x,y\n" if i % 3 else "y,x,frame,id\n") + "".join(f"{i},{k},1,2\n" for k in range(300)) for i in range(1, 41)}
    tracks[41] = ""
    root = bundle(tmp_path, tracks)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    found = bundles._files(spark, root, "tracks")
    assert {h: sorted(i for i, _ in m) for h, m in found.items()} == {
        ("id", "frame", "x", "y"): [i for i in range(1, 41) if i % 3], ("y", "x", "frame", "id"): [i for i in range(1, 41) if not i % 3], (): [41]}
    assert before == {k: spark.conf.get(k) for k in before}
    assert bundles.read_bundle(spark, root)["tracks"].count() == 40 * 300
    # a directory of parts, with a space in its name, is one recording
    spark.createDataFrame([("7", "1")], "id string, frame string").repartition(1).write.option("header", True).csv(f"{tmp_path}/more here/77_tracks.csv")
    assert [m[0][0] for m in bundles._files(spark, f"{tmp_path}/more here", "tracks").values()] == [77]


def test_a_missing_part_is_an_error_but_an_empty_one_is_not(spark, tmp_path):
    root = bundle(tmp_path, {1: "id,frame,x,y\n", 2: "id,frame,x,y\n7,1,2,3\n"}, skip=((2, "recordingMeta"),))
    with pytest.raises(FileNotFoundError, match="2"):
        bundles.read_bundle(spark, root)


def test_fingerprint_sees_nested_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(4).withColumn("recording_id", F.col("id") % 2).write.partitionBy("recording_id").parquet(path)
    before = fingerprint(spark, [path])
    assert fingerprint(spark, [path]) == before
    spark.range(9, 10).coalesce(1).write.parquet(f"{path}/recording_id=1/more")
    assert fingerprint(spark, [path]) != before


def test_caches_are_built_again_when_a_value_changes(spark, tmp_path):
    built = []

    def build(frames, W, stride):
        built.append(1)
        return frames.withColumn("w", F.lit(W))

    rows = [(1, 1, k, float(k)) for k in range(5)]
    df = spark.createDataFrame(rows, "recording_id bigint, vehicle_id bigint, frame bigint, x double")
    other = df.withColumn("x", F.when(F.col("frame") == 3, 9.0).otherwise(F.col("x")))
    for frames, n in ((df, 1), (df, 1), (other, 2)):
        bundles.load_window_cache(spark, str(tmp_path), frames, 5, 1, build)
        assert len(built) == n
    assert content_mark(df) != content_mark(other)
    source = f"{tmp_path}/source"
    made = []
    for n, k in enumerate((5, 5, 6), 1):
        if n != 2:
            df.limit(k).unionByName(df.limit(n)).write.mode("overwrite").parquet(source)
        bundles.load_frame_cache(spark, str(tmp_path), None, lambda: made.append(1) or spark.read.parquet(source), [source])
    assert len(made) == 2


@pytest.mark.parametrize("n", [0, 1, 40, 1500, 2999, 3000, 9000])
def test_hash_sample_is_the_smallest_hashes(spark, n):
    df = spark.range(3000).withColumnRenamed("id", "recording_id")
    key = sampling.hash_key(5, F.col("recording_id"))
    want = {r.recording_id for r in df.orderBy(key).limit(n).collect()}
    assert {r.recording_id for r in sampling.hash_sample(df, n, 5, "recording_id").collect()} == want


def test_histogram_has_every_bin(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (None,)], "x double")
    got = {r.bin: r["count"] for r in rep.histogram(df, "x", bins=10).collect()}
    assert got == {k: int(k in (0, 9)) for k in range(10)}
    assert rep.histogram(df.where("x > 99"), "x").count() == 0


def test_no_events_give_three_zero_rows(spark):
    none = spark.createDataFrame([], "lc_side string")
    assert {(r.side, r["count"]) for r in rep.side_counts(none).collect()} == {(s, 0) for s in ("left", "right", "unknown")}


def test_a_marking_given_twice_makes_no_lane(spark):
    meta = spark.createDataFrame([(1, [0.0, 4.0, 4.0, 8.0], [1.0])], "recording_id bigint, upper array<double>, lower array<double>")
    spans = [r.asDict() for r in rep.lane_spans(meta).collect()]
    assert spans and all(r["y1"] > r["y0"] for r in spans if "y0" in r and r["y0"] is not None)


def test_gaps_cross_ranges(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(50), 1000, 1e9]], "v double")
    gaps = sorted(r.gap for r in rep.neighbour_gaps(df.repartition(3), "v").collect())
    assert gaps == [1.0] * 49 + [951.0, 1e9 - 1000]


def test_direction_from_vehicles_equals_direction_from_frames(spark):
    frames = spark.createDataFrame([(r, d) for r in (1, 2) for d in ((1, 2) if r == 1 else (2,)) for _ in range(3)], "recording_id bigint, meta_drivingDirection int")
    vehicles = frames.distinct().withColumnRenamed("meta_drivingDirection", "drivingDirection")
    key = lambda df: sorted(tuple(r) for r in df.select("recording_id", "meta_drivingDirection", "dir_sign").collect())
    assert key(kin.direction_sign(frames)) == key(kin.direction_sign(frames, vehicles=vehicles))


def test_registry_needs_no_session(tmp_path):
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-500:]
