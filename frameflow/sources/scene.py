"""The scene: clips, ball, players, teams, landmarks and labels as views over the `events` table.

Every view is integer arithmetic on event ids, so that Spark and any other SQL engine give the same rows. SCENE_VIEWS has
the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.functions.court import TEMPLATE

FRAMES_PER_CLIP = 500
PLAYERS = 10
FPS = 30.0

FRAMES = "cast(floor(event_id / 500) as int) as clip_no, cast(event_id % 500 as int) as frame_idx, cast(user_id as int) as u, event_type as et, event_id as eid"
BALL = """clip_no, frame_idx,
  cast(40 + abs(((frame_idx * 9 + clip_no * 131) % 2400) - 1200) + (u % 7) - 3 + case when et = 'signup' then (u % 11 - 5) * 90 else 0 end as double) as cx,
  cast(120 + abs(((frame_idx * 5 + clip_no * 71) % 900) - 450) + (u % 5) - 2 as double) as cy,
  cast(0.3 as double) + (u % 70) / cast(100 as double) as confidence"""
PLAYER = """clip_no, frame_idx, p as track_id, p as det_order, eid,
  cast(20 + abs(((frame_idx * (6 + p) + clip_no * 131 + p * 17) % 2400) - 1200) as double) as x1,
  cast(60 + abs(((frame_idx * 5 + clip_no * 71 + p * 11) % 900) - 450) as double) as y1"""
TEAM = """clip_no, frame_idx, track_id as player_id,
  cast(case when (track_id <= 5) <> ((eid * 7 + track_id * 13) % 10 = 0) then 1 else 2 end as int) as predicted_team,
  cast(0.5 as double) + ((eid * 13 + track_id * 29) % 50) / cast(100 as double) as confidence, (eid + track_id) % 17 <> 0 as crop_ok"""
#: A known projective map per clip: image = (a x + b y + c) / w, with w = 1 + x/200 + y/300.
MAP_W = "(1 + x_m / 200 + y_m / 300)"
KEYPOINT = f"""clip_no, frame_idx, idx, eid,
  (38 * x_m + 3 * y_m + 60 + (clip_no % 5) * 10) / {MAP_W} as x, (2 * x_m + 29 * y_m + 90 + (clip_no % 7) * 5) / {MAP_W} as y,
  case when et = 'error' then cast(0 as double) else ((eid * 7 + idx * 13) % 100) / cast(100 as double) end as confidence"""
GT = """clip_no, frame_idx, track_id + 100 as gt_id, x1 + ((frame_idx + track_id) % 5) - 2 as x1, y1 + ((frame_idx + 2 * track_id) % 3) - 1 as y1"""
EVENT_GT = """clip_no, cast(frame_idx as int) as start_frame, cast(frame_idx + 4 + u % 9 as int) as end_frame,
  case u % 5 when 0 then 'pass' when 1 then 'interception' when 2 then 'steal' when 3 then 'pass' else 'shot' end as event_type,
  case when u % 6 = 0 then 'unclear' else cast(1 + u % 2 as string) end as from_team, case when u % 6 = 0 then 'unclear' else cast(1 + (u + 1) % 2 as string) end as to_team,
  case when u % 4 = 0 then 'unknown' else cast(1 + u % 10 as string) end as from_track_id, case when u % 4 = 0 then 'unknown' else cast(1 + (u + 3) % 10 as string) end as to_track_id"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spine: one row for each clip and frame. What is made from it is never broadcast unless a query asks for it: the size that Spark expects is that of the few stored bytes, not
    that of the ten players or 18 landmarks that a frame becomes, and such a table would pass through the driver. The hint goes with all rows that are derived before the next join."""
    return events(spark, sf_dir).select("event_id", "user_id", "event_type").selectExpr(*split(FRAMES)).hint("merge")


def split(columns: str) -> list[str]:
    """Top-level columns of a select list."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


def ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one raw ball a frame, by its centre; boxes are the centre and 6 pixels each way."""
    return frames(spark, sf_dir).where("et <> 'error'").selectExpr(*split(BALL))


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked players with their boxes; det_order is the order in which the tracker listed them."""
    rows = frames(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(1), F.lit(PLAYERS))).alias("p")).where("(eid * 7 + p * 13) % 11 <> 0")
    return rows.selectExpr(*split(PLAYER)).selectExpr("clip_no", "frame_idx", "track_id", "det_order", "eid", "x1", "y1", "x1 + 60 as x2", "y1 + 150 as y2")


def team_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team predictions of each frame before any threshold or vote."""
    return players(spark, sf_dir).selectExpr(*split(TEAM))


def template(spark: SparkSession) -> DataFrame:
    """The court's landmarks in metres: 18 rows, whatever the data."""
    return spark.createDataFrame([(i, x, y, n, m) for i, (x, y, n, m) in enumerate(TEMPLATE)], "idx int, x_m double, y_m double, name string, flip_index int")


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """18 landmarks for each frame; an unseen one has confidence 0."""
    points = F.broadcast(template(spark).select("idx", "x_m", "y_m"))
    rows = frames(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(TEMPLATE) - 1))).alias("idx"))
    return rows.join(points, "idx").selectExpr(*split(KEYPOINT))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled boxes on every 10th frame."""
    some = players(spark, sf_dir).where("frame_idx % 10 = 0 and (eid + track_id) % 13 <> 0")
    return some.selectExpr(*split(GT)).selectExpr("clip_no", "frame_idx", "gt_id", "x1", "y1", "x1 + 60 as x2", "y1 + 150 as y2")


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled events of each clip."""
    return frames(spark, sf_dir).where("frame_idx % 40 = 7").selectExpr(*split(EVENT_GT))


def _template_sql() -> str:
    return ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE, '{n}', {m})" for i, (x, y, n, m) in enumerate(TEMPLATE))


#: The views as common table expressions, each after those that it reads.
SCENE_VIEWS = {
    "scene_frames": f"SELECT {FRAMES} FROM events",
    "scene_ball": f"SELECT {BALL} FROM scene_frames WHERE et <> 'error'",
    "scene_players": f"SELECT *, x1 + 60 AS x2, y1 + 150 AS y2 FROM (SELECT {PLAYER} FROM scene_frames CROSS JOIN (SELECT CAST(unnest(range(1, 11)) AS INT) AS p) WHERE (eid * 7 + p * 13) % 11 <> 0)",
    "scene_team_raw": f"SELECT {TEAM} FROM scene_players",
    "court_template": f"SELECT * FROM (VALUES {_template_sql()}) AS t(idx, x_m, y_m, name, flip_index)",
    "scene_keypoints": f"SELECT {KEYPOINT} FROM scene_frames CROSS JOIN court_template",
    "scene_gt": f"SELECT *, x1 + 60 AS x2, y1 + 150 AS y2 FROM (SELECT {GT} FROM scene_players WHERE frame_idx % 10 = 0 AND (eid + track_id) % 13 <> 0)",
    "scene_event_gt": f"SELECT {EVENT_GT} FROM scene_frames WHERE frame_idx % 40 = 7",
}
