"""SQL building blocks for the oracles: the same tables, written in SQL."""

from __future__ import annotations

from ..schema import (
    FRAME_FEATURES, NEIGHBOR_SLOTS, REL_SUFFIXES, WINDOW_FEATURES, WINDOW_LEN, WINDOW_STRIDE,
)
from ..sources.events_view import LANE_CODES, NEIGHBOR_OFFSETS, TRUCK_SEGMENTS

W_TRACK = "(PARTITION BY vehicle_id ORDER BY frame)"


def r(x: str, d: int = 6) -> str:
    return f"(round({x}, {d}) + 0.0)"


def _cases(col: str, table: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"


TRACKS = f"""
ev AS (
  SELECT user_id AS vehicle_id, user_id % 5 AS recording_id, event_id,
         CAST(1 + (user_id // 5) % 2 AS INTEGER) AS dir, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         {_cases("event_type", LANE_CODES)} AS lane_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame
  FROM events),
tr1 AS (
  SELECT *, frame - 1 AS t, CASE WHEN dir = 1 THEN -value ELSE value END AS vx,
         k - lag(k) OVER {W_TRACK} AS vy FROM ev),
tr2 AS (
  SELECT *, vx - lag(vx) OVER {W_TRACK} AS ax, vy - lag(vy) OVER {W_TRACK} AS ay FROM tr1),
tracks AS MATERIALIZED (
  SELECT recording_id, vehicle_id, frame, t, event_id, dir AS meta_drivingDirection,
         lower(CASE WHEN c_mktsegment IN ({", ".join(repr(s) for s in TRUCK_SEGMENTS)}) THEN 'Truck' ELSE 'Car' END) AS meta_class,
         value AS x, k AS y, CAST(4 AS DOUBLE) AS width, CAST(2 AS DOUBLE) AS height,
         value + 2 AS x_center, k + 1 AS y_center, vx, vy, ax, ay, lane_id,
         value / 10 AS thw, value - 20 AS ttc, value AS dhw, CAST(event_id % 6 - 1 AS INTEGER) AS lane_pos,
         {", ".join(f"CASE WHEN vehicle_id + ({o}) > 0 THEN vehicle_id + ({o}) ELSE 0 END AS {c}" for c, o in NEIGHBOR_OFFSETS.items())}
  FROM tr2 LEFT JOIN customer ON c_custkey = vehicle_id)"""

KIN = TRACKS + f""",
dirs AS (
  SELECT recording_id, min(meta_drivingDirection) AS dmin, max(meta_drivingDirection) AS dmax,
         count(DISTINCT meta_drivingDirection) AS nd FROM tracks GROUP BY 1),
kin0 AS (
  SELECT tracks.*, CASE WHEN nd = 2 AND dmin = 1 AND dmax = 2 AND meta_drivingDirection = 1 THEN -1
                        WHEN nd = 2 AND dmin = 0 AND dmax = 1 AND meta_drivingDirection = 0 THEN -1 ELSE 1 END AS dir_sign
  FROM tracks JOIN dirs USING (recording_id)),
kin1 AS (
  SELECT * REPLACE (vx * dir_sign AS vx, vy * dir_sign AS vy, ax * dir_sign AS ax, ay * dir_sign AS ay),
         thw AS front_thw, ttc AS front_ttc, dhw AS front_dhw FROM kin0),
kin AS MATERIALIZED (
  SELECT *,
    CAST(coalesce(sign(lane_id - lag(lane_id) OVER {W_TRACK}) * dir_sign, 0) AS INTEGER) AS lc,
    CASE WHEN t = 0 THEN 0.0 ELSE (ax - lag(ax) OVER {W_TRACK}) / 0.04::DOUBLE END AS jerk_x,
    CASE WHEN t = 0 THEN 0.0 ELSE (ay - lag(ay) OVER {W_TRACK}) / 0.04::DOUBLE END AS jerk_y
  FROM kin1)"""

_slot_cols = []
_slot_joins = []
for _i, (_c, _s) in enumerate(NEIGHBOR_SLOTS.items()):
    _n = f"n{_i}"
    _slot_cols += [
        f"CAST({_n}.vehicle_id IS NOT NULL AS INTEGER) AS {_s}_exists",
        f"({_n}.x_center - e.x_center) * e.dir_sign AS {_s}_dx",
        f"({_n}.y_center - e.y_center) * e.dir_sign AS {_s}_dy",
        f"{_n}.vx - e.vx AS {_s}_dvx",
        f"{_n}.vy - e.vy AS {_s}_dvy",
    ]
    _slot_joins.append(
        f"LEFT JOIN kin {_n} ON {_n}.recording_id = e.recording_id AND {_n}.frame = e.frame"
        f" AND {_n}.vehicle_id = e.{_c} AND e.{_c} > 0"
    )

LANES = KIN + """,
marks(dir, lo, hi) AS (VALUES
  (1, 0.0::DOUBLE, 20.0::DOUBLE), (1, 20, 40), (1, 40, 60), (1, 60, 80),
  (2, 10, 30), (2, 30, 50), (2, 50, 70), (2, 70, 90)),
lanes AS MATERIALIZED (
  SELECT kin.*, CASE WHEN kin.meta_drivingDirection = 2 THEN y_center - lo ELSE hi - y_center END AS d_left_lane,
         CASE WHEN kin.meta_drivingDirection = 2 THEN hi - y_center ELSE y_center - lo END AS d_right_lane
  FROM kin LEFT JOIN marks ON marks.dir = kin.meta_drivingDirection AND y_center >= lo AND y_center < hi)"""

FRAMES = LANES + f""",
frames AS MATERIALIZED (
  SELECT e.*, {", ".join(_slot_cols)} FROM lanes e {" ".join(_slot_joins)})"""

REL = {f"{s}_{x}": f"{s}_exists" for s in NEIGHBOR_SLOTS.values() for x in REL_SUFFIXES}


def feature(name: str) -> str:
    """SQL aggregate for one window feature."""
    if name == "lc_left_present":
        return "max(CAST(lc = -1 AS DOUBLE))"
    if name == "lc_right_present":
        return "max(CAST(lc = 1 AS DOUBLE))"
    if name.endswith("_exists_frac"):
        return f"avg(CAST({name[:-5]} > 0.5 AS DOUBLE))"
    for sign, op in (("neg", "<"), ("pos", ">"), ("zero", "=")):
        if name.endswith(f"_{sign}_frac"):
            x = name.rsplit("_", 2)[0]
            return f"avg(CAST({x} {op} 0 AS DOUBLE)) FILTER (WHERE {x} IS NOT NULL)"
    x, stat = name.rsplit("_", 1)
    cond = f"{x} IS NOT NULL"
    if x in ("front_thw", "front_ttc", "front_dhw"):
        cond += f" AND {x} > 0 AND front_exists > 0.5"
        if stat == "vfrac":
            return f"avg(CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    elif x in REL:
        cond += f" AND {REL[x]} > 0.5"
    return {
        "last": f"arg_max({x}, i) FILTER (WHERE {cond})",
        "min": f"min({x}) FILTER (WHERE {cond})",
        "max": f"max({x}) FILTER (WHERE {cond})",
        "mean": f"avg({x}) FILTER (WHERE {cond})",
        "std": f"stddev_pop({x}) FILTER (WHERE {cond})",
        "rms": f"sqrt(avg({x} * {x}) FILTER (WHERE {cond}))",
        "p95": f"quantile_cont({x}, 0.95) FILTER (WHERE {cond})",
        "slope": f"CASE WHEN count(*) FILTER (WHERE {cond}) >= 2 THEN regr_slope({x}, i) FILTER (WHERE {cond}) END",
    }[stat]


def members(W: int = WINDOW_LEN, stride: int = WINDOW_STRIDE, source: str = "frames") -> str:
    return f"""
win_rows AS (
  SELECT *, t - window_idx * {stride} AS i FROM (
    SELECT *, unnest(generate_series(
      CAST(greatest(0, ceil((t - {W} + 1) / {stride})) AS BIGINT), CAST(t // {stride} AS BIGINT))) AS window_idx
    FROM {source}))"""


def windows(names: list[str] | None = None, W: int = WINDOW_LEN, stride: int = WINDOW_STRIDE) -> str:
    """CTEs ending in ``windows`` with the named features."""
    cols = ", ".join(f"{feature(n)} AS {n}" for n in (names or WINDOW_FEATURES))
    return FRAMES + "," + members(W, stride) + f""",
windows AS (
  SELECT recording_id, vehicle_id, window_idx, min(frame) AS start_frame, min(meta_class) AS meta_class, {cols}
  FROM win_rows GROUP BY recording_id, vehicle_id, window_idx HAVING count(*) = {W})"""


def with_(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{body.strip()}"


def rounded_list(names, alias: str = "", d: int = 6) -> str:
    p = f"{alias}." if alias else ""
    return ", ".join(f"{r(p + n, d)} AS {n}" for n in names)
