"""Queries: camera motion between frames, from landmarks and from pixels: B36, J12, K12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.operators import camera, flow
from frameflow.plans.registry import query
from frameflow.sources import scene

CENTRE, FEWEST = (640.0, 360.0), 6
#: A camera for the scene's landmarks: each frame has its own scale, rotation and shift (the complex numbers a + ib and p + iq), and one landmark is far off.
SHAKE = """clip_no, frame_idx, idx, confidence, a, b, p, q, (idx = (frame_idx * 7 + clip_no) % 18) as off,
  a * x - b * y + p + case when idx = (frame_idx * 7 + clip_no) % 18 then 60 + frame_idx % 40 else 0 end as x, b * x + a * y + q as y"""
POSE = """*, 1 + ((frame_idx * 13 + clip_no) % 7 - 3) / cast(1000 as double) as a, ((frame_idx * 5 + clip_no) % 5 - 2) / cast(1000 as double) as b,
  cast((frame_idx * 37 + clip_no * 11) % 21 - 10 as double) as p, cast((frame_idx * 17 + clip_no) % 9 - 4 as double) as q"""
MOVED = f"""
, shaken AS MATERIALIZED (SELECT {SHAKE} FROM (SELECT {POSE} FROM scene_keypoints)),
shot AS MATERIALIZED (SELECT *, lag(frame_idx) OVER w AS last_frame, lag(a) OVER w AS a0, lag(b) OVER w AS b0, lag(p) OVER w AS p0, lag(q) OVER w AS q0 FROM (SELECT DISTINCT clip_no, frame_idx, a, b, p, q FROM shaken) WINDOW w AS (PARTITION BY clip_no ORDER BY frame_idx)),
good AS MATERIALIZED (SELECT clip_no, frame_idx, idx, off FROM shaken WHERE confidence >= 0.5),
paired AS (SELECT s.clip_no, s.frame_idx, count(*) AS n, count(*) FILTER (NOT g.off AND NOT h.off) AS inliers FROM shot s JOIN good g ON g.clip_no = s.clip_no AND g.frame_idx = s.frame_idx JOIN good h ON h.clip_no = s.clip_no AND h.frame_idx = s.last_frame AND h.idx = g.idx GROUP BY s.clip_no, s.frame_idx),
ratio AS (SELECT *, (a * a0 + b * b0) / (a0 * a0 + b0 * b0) AS mr, (b * a0 - a * b0) / (a0 * a0 + b0 * b0) AS mi FROM shot WHERE last_frame IS NOT NULL),
moved AS (SELECT r.clip_no, r.frame_idx, r.last_frame, CAST(coalesce(n, 0) AS INT) AS n, CASE WHEN coalesce(n, 0) < {FEWEST} THEN 'few points' WHEN inliers < {FEWEST} THEN 'degenerate' ELSE 'ok' END AS status, CAST(CASE WHEN n >= {FEWEST} THEN inliers ELSE 0 END AS INT) AS inliers,
  mr * ({CENTRE[0]} - p0) - mi * ({CENTRE[1]} - q0) + p - {CENTRE[0]} AS dx, mi * ({CENTRE[0]} - p0) + mr * ({CENTRE[1]} - q0) + q - {CENTRE[1]} AS dy, sqrt(mr * mr + mi * mi) AS scale, degrees(atan2(mi, mr)) AS angle
  FROM ratio r LEFT JOIN paired m ON m.clip_no = r.clip_no AND m.frame_idx = r.frame_idx)"""


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaken = scene.keypoints(spark, sf_dir).selectExpr(*scene.split(POSE)).selectExpr(*scene.split(SHAKE)).select("clip_no", "frame_idx", "idx", "confidence", "x", "y")
    return camera.motion(camera.matched(shaken), CENTRE, FEWEST)


@query(MOVED + "SELECT clip_no, frame_idx, last_frame, n, status, inliers, " + ", ".join(f"CASE WHEN status = 'ok' THEN round({c}, 4) END AS {c}" for c in ("dx", "dy", "scale", "angle")) + " FROM moved")
def b36_camera_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift of the image centre, scale and angle between each frame and the one before, with a far-off landmark in each; the SQL divides the cameras that were put in."""
    return moved(spark, sf_dir).select("clip_no", "frame_idx", "last_frame", "n", "status", "inliers", *[F.round(c, 4).alias(c) for c in ("dx", "dy", "scale", "angle")])


@query(MOVED + """, ok AS (SELECT clip_no, CASE WHEN status = 'ok' THEN abs(dx) END AS d, CASE WHEN status = 'ok' THEN abs(scale - 1) END AS s FROM moved)
SELECT clip_no, count(*) AS frame_pairs, count(d) AS estimated, round(quantile_cont(d, 0.5), 4) AS median_dx, round(quantile_cont(d, 0.95), 4) AS p95_dx, round(quantile_cont(s, 0.5), 6) AS median_scale, round(max(s), 6) AS largest_scale, count(*) FILTER (d > 10) AS over_limit FROM ok GROUP BY clip_no""")
def j12_camera_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip's camera motion in figures."""
    s = camera.summary(moved(spark, sf_dir))
    return s.select("clip_no", "frame_pairs", "estimated", *[F.round(c, 4).alias(c) for c in ("median_dx", "p95_dx")], *[F.round(c, 6).alias(c) for c in ("median_scale", "largest_scale")], "over_limit")


#: Small frames with a spot for each landmark, all moved by the frame's own number of pixels.
HEIGHT, WIDTH, SPOTS = 72, 128, 24
SWAY, NOD = "(frame_idx * 37 + clip_no * 11) % 7 - 3", "(frame_idx * 17 + clip_no) % 5 - 2"


@query(f"""
, at AS (SELECT clip_no, frame_idx, {SWAY} AS sx, {NOD} AS sy FROM scene_frames),
hop AS (SELECT clip_no, frame_idx, lag(frame_idx) OVER w AS last_frame, sx - lag(sx) OVER w AS dx, sy - lag(sy) OVER w AS dy FROM at WINDOW w AS (PARTITION BY clip_no ORDER BY frame_idx))
SELECT clip_no, frame_idx, last_frame, true AS enough, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, 1.0::DOUBLE AS scale FROM hop WHERE last_frame IS NOT NULL""".replace(", at AS", ", swayed AS").replace("FROM at WINDOW", "FROM swayed WINDOW"))
def k12_point_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames drawn from the landmarks, points followed in their pixels, and the motion of the frame's centre; the SQL knows by how many pixels each frame was moved."""
    spots = scene.keypoints(spark, sf_dir).groupBy("clip_no", "frame_idx").agg(F.collect_list(F.struct((F.col("x") / 9 + F.expr(SWAY)).alias("x"), (F.col("y") / 9 + F.expr(NOD)).alias("y"), (90 + F.col("idx") * 37 % 110).alias("light"))).alias("points"))
    found = flow.drawn_motions(spots, HEIGHT, WIDTH, most=SPOTS)
    return found.select("clip_no", "frame_idx", "last_frame", (F.col("points") >= flow.FEWEST).alias("enough"), F.round("dx").cast("int").alias("dx"), F.round("dy").cast("int").alias("dy"), F.round("scale", 2).alias("scale"))
