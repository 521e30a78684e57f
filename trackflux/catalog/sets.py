"""Set operations, sort, limit, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import sampling as smp, selection as sel
from ..plans import frames as plan
from ..schema import KEYS
from ..sources import bundles, events_view as view
from . import sql as S
from .registry import query

K = "recording_id, vehicle_id, frame"
FK = [*KEYS, "frame"]

SPLIT = """
u AS (SELECT DISTINCT user_id % 5 AS recording_id, user_id AS vehicle_id FROM events),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('123|' || recording_id || ':' || vehicle_id)) - 1 AS rk, count(*) OVER () AS n FROM u),
split AS (SELECT recording_id, vehicle_id, CASE WHEN rk < floor(0.7::DOUBLE * n) THEN 'train'
  WHEN rk < floor(0.7::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


def split_table(spark, d):
    keys = view.table(spark, d, "events").select(
        (F.col("user_id") % 5).alias("recording_id"), F.col("user_id").alias("vehicle_id")
    ).distinct()
    return smp.split_assign(keys, 0.7, 0.1, 123)


@query("set_union_recordings", S.with_(S.KIN, f"SELECT {K}, lc, {S.r('vx')} AS vx FROM kin"))
def set_union_recordings(spark, d):
    df = plan.kinematic(spark, d).select(*FK, "lc", rounded(F.col("vx")).alias("vx"))
    even, odd = df.where("recording_id % 2 = 0"), df.where("recording_id % 2 = 1")
    return even.unionByName(odd)


@query("set_split_all", S.with_(SPLIT, "SELECT * FROM split"))
def set_split_all(spark, d):
    split = split_table(spark, d)
    parts = [split.where(F.col("split") == s) for s in ("train", "val", "test")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("set_split_disjoint", S.with_(SPLIT, """
SELECT 'train-val' AS pair, count(*) AS shared FROM (SELECT recording_id, vehicle_id FROM split WHERE split = 'train'
  INTERSECT SELECT recording_id, vehicle_id FROM split WHERE split = 'val')
UNION ALL SELECT 'train-test', count(*) FROM (SELECT recording_id, vehicle_id FROM split WHERE split = 'train'
  INTERSECT SELECT recording_id, vehicle_id FROM split WHERE split = 'test')
UNION ALL SELECT 'val-test', count(*) FROM (SELECT recording_id, vehicle_id FROM split WHERE split = 'val'
  INTERSECT SELECT recording_id, vehicle_id FROM split WHERE split = 'test')
UNION ALL SELECT 'duplicate-or-null', count(*) FROM (SELECT recording_id, vehicle_id FROM split GROUP BY 1, 2
  HAVING count(*) > 1 OR recording_id IS NULL OR vehicle_id IS NULL)"""))
def set_split_disjoint(spark, d):
    split = split_table(spark, d)
    part = {s: split.where(F.col("split") == s).select(*KEYS) for s in ("train", "val", "test")}
    out = None
    for a, b in (("train", "val"), ("train", "test"), ("val", "test")):
        n = part[a].intersect(part[b]).agg(F.count(F.lit(1)).alias("shared")).select(F.lit(f"{a}-{b}").alias("pair"), "shared")
        out = n if out is None else out.unionAll(n)
    bad = smp.split_overlap(split).agg(F.count(F.lit(1)).alias("shared"))
    return out.unionAll(bad.select(F.lit("duplicate-or-null").alias("pair"), "shared"))


@query("srt_trajectory_order", S.with_(S.TRACKS, f"SELECT {K}, event_id FROM tracks ORDER BY {K}"))
def srt_trajectory_order(spark, d):
    """Range partitioning on the full order also splits a hot trajectory."""
    df = view.tracks(spark, d).select(*FK, "event_id")
    return df.repartitionByRange(*FK, "event_id").sortWithinPartitions(*FK, "event_id")


@query("lim_first_recordings", S.with_(S.TRACKS, f"SELECT {K} FROM tracks WHERE recording_id < 2"))
def lim_first_recordings(spark, d):
    return bundles.first_recordings(plan.kinematic(spark, d), 2).select(*FK)


LOGP = "[ln(value + 1), -value / 5, (event_id % 7) * 1.0::DOUBLE, -1.5::DOUBLE, ln(value + 2), -0.25::DOUBLE, (event_id % 5) * 0.5::DOUBLE, -value]"


@query("top_k_states", f"""
WITH l AS (SELECT event_id, {LOGP} AS b FROM events),
p AS (SELECT event_id, list_transform(b, lambda x: exp(x - list_max(b))) AS e FROM l),
u AS (SELECT event_id, unnest(e) / list_sum(e) AS prob, unnest(range(8)) AS z FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY prob DESC, z) AS rank FROM u)
SELECT event_id, CAST(rank AS INTEGER) AS rank, CAST(z AS INTEGER) AS z, CAST(z // 4 AS INTEGER) AS s, CAST(z % 4 AS INTEGER) AS a,
  {S.r('prob')} AS prob FROM k WHERE rank <= 3""")
def top_k_states(spark, d):
    v, e = F.col("value"), F.col("event_id")
    logp = F.array(F.log(v + 1), -v / 5, (e % 7).cast("double"), F.lit(-1.5), F.log(v + 2), F.lit(-0.25), (e % 5) * 0.5, -v)
    df = view.table(spark, d, "events").select("event_id", sel.belief_prob(logp).alias("p"))
    top = sel.top_k(F.col("p"), 3)
    out = df.select("event_id", F.posexplode(top).alias("rank", "w"))
    s, a = sel.z_to_sa(F.col("w.z"))
    return out.select("event_id", (F.col("rank") + 1).alias("rank"), F.col("w.z").alias("z"), s.alias("s"), a.alias("a"),
                      rounded(F.col("w.prob")).alias("prob"))


@query("top_label_counts", S.with_(S.TRACKS, """
SELECT recording_id, vehicle_id, lane_id AS z, count(*) AS n,
  row_number() OVER (PARTITION BY vehicle_id ORDER BY count(*) DESC, lane_id) AS rank FROM tracks GROUP BY 1, 2, 3"""))
def top_label_counts(spark, d):
    return sel.label_counts(plan.kinematic(spark, d), "lane_id").withColumnRenamed("lane_id", "z")


@query("smp_split_assign", S.with_(SPLIT, "SELECT * FROM split"))
def smp_split_assign(spark, d):
    return split_table(spark, d)


@query("smp_reservoir", S.with_(S.KIN, f"""
SELECT {K}, {S.r('vx')} AS vx, {S.r('ay')} AS ay FROM kin WHERE vx IS NOT NULL AND ay IS NOT NULL
ORDER BY md5('123|' || recording_id || ':' || vehicle_id || ':' || frame) LIMIT 1000"""))
def smp_reservoir(spark, d):
    rows = smp.finite_rows(plan.kinematic(spark, d).select(*FK, "vx", "ay"), ["vx", "ay"])
    out = smp.hash_sample(rows, 1000, 123, *FK)
    return out.select(*FK, *[rounded(F.col(c)).alias(c) for c in ("vx", "ay")])


@query("smp_even_spaced", """
WITH u AS (SELECT DISTINCT user_id % 5 AS recording_id, user_id AS vehicle_id FROM events),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('7|' || recording_id || ':' || vehicle_id)) - 1 AS rk, count(*) OVER () AS n FROM u)
SELECT recording_id, vehicle_id FROM ranked WHERE n <= 11 OR rk IN (SELECT CAST(floor(i * (n - 1) / 10.0::DOUBLE) AS BIGINT) FROM range(11) q(i))""")
def smp_even_spaced(spark, d):
    keys = split_table(spark, d).select(*KEYS)
    return smp.evenly_spaced(keys, 11, smp.hash_key(7, *[F.col(k) for k in KEYS]))
