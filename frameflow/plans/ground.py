"""Queries: court landmarks, maps, positions, their reports; camera motion, captions, render commands; files and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameflow.functions import court as plane
from frameflow.functions.boxes import Box, bucket
from frameflow.operators import court, kinematics
from frameflow.plans.game import placed, rounded
from frameflow.plans.registry import query
from frameflow.sources import scene, store
from frameflow.sources.files import clamped_label, mot_lines, pose_label, seed_rows

CONFIDENT = "SELECT * FROM scene_keypoints WHERE confidence >= 0.5"
#: Frames whose confident landmarks hold four without three on one line; twice the area in the comparison.
GOOD = f"""
, conf AS ({CONFIDENT}), pt AS (SELECT c.clip_no, c.frame_idx, c.idx, t.x_m, t.y_m FROM conf c JOIN court_template t USING (idx)),
n AS (SELECT clip_no, frame_idx, count(*) AS n, CAST(sum(1 << idx) AS BIGINT) AS mask FROM pt GROUP BY clip_no, frame_idx),
tri AS (SELECT a.idx AS i, b.idx AS j, c.idx AS k FROM court_template a JOIN court_template b ON b.idx > a.idx JOIN court_template c ON c.idx > b.idx
  WHERE abs((b.x_m - a.x_m) * (c.y_m - a.y_m) - (c.x_m - a.x_m) * (b.y_m - a.y_m)) / 2 >= 0.01::DOUBLE),
quad AS (SELECT CAST((1 << t.i) + (1 << t.j) + (1 << t.k) + (1 << d.idx) AS BIGINT) AS mask FROM tri t JOIN court_template d ON d.idx > t.k
  JOIN tri a ON a.i = t.i AND a.j = t.j AND a.k = d.idx JOIN tri b ON b.i = t.i AND b.j = t.k AND b.k = d.idx JOIN tri c ON c.i = t.j AND c.j = t.k AND c.k = d.idx),
good AS (SELECT DISTINCT m.mask FROM (SELECT DISTINCT mask FROM n) m WHERE EXISTS (SELECT 1 FROM quad q WHERE q.mask & m.mask = q.mask)),
fit AS (SELECT f.clip_no, f.frame_idx, CAST(coalesce(n.n, 0) AS INT) AS n, CASE WHEN coalesce(n.n, 0) < 4 THEN 'insufficient' WHEN g.mask IS NOT NULL THEN 'ok' ELSE 'degenerate' END AS status
  FROM scene_frames f LEFT JOIN n USING (clip_no, frame_idx) LEFT JOIN good g ON g.mask = n.mask)"""
#: The closed inverse of the scene's map, applied to foot points: two linear equations in x_m and y_m.
PLACES = """
, foot AS (SELECT p.clip_no, p.frame_idx, p.track_id, (x1 + x2) / 2 AS u, y2 AS v, (60 + (p.clip_no % 5) * 10)::DOUBLE AS c, (90 + (p.clip_no % 7) * 5)::DOUBLE AS f
  FROM scene_players p JOIN fit USING (clip_no, frame_idx) WHERE status = 'ok'),
lin AS (SELECT *, 38 - u / 200 AS a1, 3 - u / 300 AS b1, u - c AS r1, 2 - v / 200 AS a2, 29 - v / 300 AS b2, v - f AS r2 FROM foot),
solved AS (SELECT clip_no, frame_idx, track_id, (r1 * b2 - r2 * b1) / (a1 * b2 - a2 * b1) AS x, (a1 * r2 - a2 * r1) / (a1 * b2 - a2 * b1) AS y FROM lin),
placed AS (SELECT clip_no, frame_idx, track_id, CASE WHEN 1 + x / 200 + y / 300 > 0 THEN x END AS x_m, CASE WHEN 1 + x / 200 + y / 300 > 0 THEN y END AS y_m FROM solved),
stated AS (SELECT *, CASE WHEN x_m IS NULL THEN 'horizon' WHEN x_m BETWEEN -2.0 AND 30.65::DOUBLE AND y_m BETWEEN -2.0 AND 17.24::DOUBLE THEN 'ok' ELSE 'out_of_bounds' END AS status FROM placed)"""


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return court.point_sets(scene.keypoints(spark, sf_dir), scene.template(spark))


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return court.fits(sets(spark, sf_dir))


def court_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return court.positions(scene.players(spark, sf_dir), fitted(spark, sf_dir))


@query("SELECT clip_no, frame_idx, idx, CASE WHEN confidence >= 0.5 THEN confidence ELSE 0.0::DOUBLE END AS confidence, round(x, 6) AS x, round(y, 6) AS y FROM scene_keypoints")
def c04_zeroed_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(court.zeroed(scene.keypoints(spark, sf_dir)).select("clip_no", "frame_idx", "idx", "confidence", "x", "y"))


@query(GOOD + "SELECT clip_no, frame_idx, n, status FROM fit")
def c07_frame_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir).select("clip_no", "frame_idx", "n", "status")


@query(GOOD + PLACES + "SELECT clip_no, frame_idx, track_id, x_m, y_m, status FROM stated")
def k10_court_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted maps applied to every player's foot point; not rounded, as a fit's last digits would decide at half steps."""
    return court_positions(spark, sf_dir)


@query(GOOD + PLACES + """
, a AS (SELECT clip_no, count(*) AS n_frames, count(*) FILTER (status = 'ok') AS mapped, count(*) FILTER (status <> 'ok') AS unmapped, count(*) FILTER (status = 'insufficient') AS insufficient, count(*) FILTER (status = 'degenerate') AS degenerate FROM fit GROUP BY ROLLUP (clip_no)),
b AS (SELECT clip_no AS cb, count(*) FILTER (status = 'ok') AS positions, count(*) FILTER (status = 'out_of_bounds') AS out_of_bounds, count(*) FILTER (status = 'horizon') AS horizon FROM stated GROUP BY ROLLUP (clip_no))
SELECT clip_no, n_frames, mapped, unmapped, insufficient, degenerate, coalesce(positions, 0) AS positions, coalesce(out_of_bounds, 0) AS out_of_bounds, coalesce(horizon, 0) AS horizon FROM a LEFT JOIN b ON cb IS NOT DISTINCT FROM clip_no""")
def e16_mapping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fitted(spark, sf_dir)
    return court.report(scene.frames(spark, sf_dir).select("clip_no", "frame_idx"), f, court.positions(scene.players(spark, sf_dir), f))


@query()
def k11_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual of every landmark under the fit to the others, in metres and pixels, and the fit's conditioning."""
    return rounded(court.left_out(sets(spark, sf_dir)), 4)


#: One landmark of each frame is moved in the image, which the fit to the others does not know: its residual in pixels is the move, and in metres the way between its court place and
#: that of the moved point under the scene's map, which the SQL inverts.
ASTRAY = """
, m AS (SELECT clip_no, frame_idx, idx, x, y, x_m, y_m, idx = (frame_idx * 7 + clip_no) % 18 AS off FROM scene_keypoints JOIN court_template USING (idx) WHERE confidence >= 0.5),
many AS (SELECT clip_no, frame_idx, CAST(count(*) AS INT) AS n, CAST(sum(1 << idx) AS BIGINT) AS mask FROM m GROUP BY clip_no, frame_idx HAVING count(*) >= 5),
gone AS (SELECT m.clip_no, m.frame_idx, n, m.idx, many.mask - (1 << m.idx) AS rest, x + 9 + m.frame_idx % 30 AS u, y - 4 - m.frame_idx % 17 AS v, sqrt((9 + m.frame_idx % 30) ** 2 + (4 + m.frame_idx % 17) ** 2) AS error_px, x_m, y_m,
  (60 + (m.clip_no % 5) * 10)::DOUBLE AS c, (90 + (m.clip_no % 7) * 5)::DOUBLE AS f FROM m JOIN many ON many.clip_no = m.clip_no AND many.frame_idx = m.frame_idx WHERE off),
lin AS (SELECT *, 38 - u / 200 AS a1, 3 - u / 300 AS b1, u - c AS r1, 2 - v / 200 AS a2, 29 - v / 300 AS b2, v - f AS r2 FROM gone),
spot AS (SELECT *, (r1 * b2 - r2 * b1) / (a1 * b2 - a2 * b1) AS xp, (a1 * r2 - a2 * r1) / (a1 * b2 - a2 * b1) AS yp FROM lin),
judged AS (SELECT a.*, g.mask IS NOT NULL AS fine FROM spot a LEFT JOIN sound g ON g.mask = a.rest)
SELECT clip_no, frame_idx, n, idx, CASE WHEN fine THEN 'scored' ELSE 'collinear' END AS state, CASE WHEN fine THEN round(sqrt((xp - x_m) ** 2 + (yp - y_m) ** 2), 4) END AS error_m, CASE WHEN fine THEN round(error_px, 4) END AS error_px FROM judged"""
#: Sets of landmarks of five or more less one, and whether four of them are in general position.
SOUND = GOOD.split("\nfit AS")[0].rstrip().rstrip(",") + """,
part AS (SELECT DISTINCT n.mask - (1 << t.idx) AS mask FROM n JOIN court_template t ON (n.mask >> t.idx) & 1 = 1 WHERE n.n >= 5),
sound AS MATERIALIZED (SELECT mask FROM part m WHERE EXISTS (SELECT 1 FROM quad q WHERE q.mask & m.mask = q.mask))"""


@query(SOUND + ASTRAY)
def k11_landmark_astray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of a landmark that was moved in the image, under the fit to the others."""
    off = F.col("idx") == (F.col("frame_idx") * 7 + F.col("clip_no")) % 18
    moved = scene.keypoints(spark, sf_dir).withColumns({"x": F.when(off, F.col("x") + 9 + F.col("frame_idx") % 30).otherwise(F.col("x")), "y": F.when(off, F.col("y") - 4 - F.col("frame_idx") % 17).otherwise(F.col("y"))})
    return rounded(court.left_out(court.point_sets(moved, scene.template(spark))).where(off).drop("conditioning"), 4)


@query()
def e26_residual_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return court.by_bucket(court.left_out(sets(spark, sf_dir)), "n", "error_m")


def disturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of landmarks that are all found a few pixels off."""
    k = scene.keypoints(spark, sf_dir)
    off = lambda c, a, b: F.col(c) + (F.col("eid") * a + F.col("idx") * b) % 7 - 3
    return court.left_out(court.point_sets(k.withColumns({"x": off("x", 5, 3), "y": off("y", 3, 5)}), scene.template(spark)))


@query()
def e26_residuals_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of each landmark in metres and pixels, by clip and pooled."""
    return rounded(court.by_index(disturbed(spark, sf_dir)), 4)


@query()
def e26_conditioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditioning of the fits by bucket, by clip and pooled."""
    return rounded(court.conditioning(disturbed(spark, sf_dir)), 6)


@query(SOUND + """
, fits AS (SELECT n.clip_no, n.frame_idx, count(*) FILTER (s.mask IS NOT NULL) AS good, count(*) FILTER (s.mask IS NULL) AS flat FROM n JOIN court_template t ON (n.mask >> t.idx) & 1 = 1 LEFT JOIN sound s ON s.mask = n.mask - (1 << t.idx) WHERE n.n >= 5 GROUP BY n.clip_no, n.frame_idx)
SELECT f.clip_no, count(*) AS n_frames, count(*) FILTER (good IS NULL) AS skipped, CAST(0 AS BIGINT) AS lost_degenerate, count(*) FILTER (good = 0) AS lost_collinear, count(*) FILTER (good > 0) AS scored_frames, CAST(0 AS BIGINT) AS degenerate_fits,
  CAST(coalesce(sum(flat), 0) AS BIGINT) AS collinear_fits, CAST(coalesce(sum(good), 0) AS BIGINT) AS scored_fits, true AS reconciles FROM scene_frames f LEFT JOIN fits ON fits.clip_no = f.clip_no AND fits.frame_idx = f.frame_idx GROUP BY f.clip_no""")
def e26_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the frames went: too few landmarks, lost, scored."""
    return court.coverage(scene.frames(spark, sf_dir), court.left_out(sets(spark, sf_dir)))


@query(f"""
, c AS MATERIALIZED (SELECT clip_no, frame_idx, idx, x + (eid * idx) % 9 AS x, y FROM scene_keypoints WHERE confidence >= 0.5), prior AS MATERIALIZED (SELECT clip_no, frame_idx + 1 AS frame_idx, idx, x, y FROM c),
d AS (SELECT a.clip_no, a.idx, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS m FROM c a JOIN prior b ON b.clip_no = a.clip_no AND b.idx = a.idx AND b.frame_idx = a.frame_idx)
SELECT clip_no, idx, count(*) AS pairs, round(median(m), 4) AS median_px, round(list_sort(list(m))[CAST(round_even(0.95::DOUBLE * (count(*) - 1), 0) AS BIGINT) + 1], 4) AS p95_px FROM d GROUP BY clip_no, idx""")
def e26_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each landmark jumps from frame to frame."""
    shifted = scene.keypoints(spark, sf_dir).withColumn("x", F.col("x") + (F.col("eid") * F.col("idx")) % 9)
    return rounded(court.stability(court.displacements(shifted)), 4)


@query("""
, n AS (SELECT clip_no, frame_idx, count(*) FILTER (confidence >= 0.5) AS c FROM scene_keypoints GROUP BY clip_no, frame_idx)
SELECT clip_no, count(*) AS n_frames, count(*) FILTER (c >= 4) AS reach_4, count(*) FILTER (c >= 5) AS reach_5, round(avg(CASE WHEN c >= 4 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate_4 FROM n GROUP BY clip_no""")
def e24_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = court.sufficiency(scene.keypoints(spark, sf_dir))
    return n.groupBy("clip_no").agg(F.count("*").alias("n_frames"), F.count_if("reaches_4").alias("reach_4"), F.count_if("reaches_5").alias("reach_5"), F.round(F.avg(F.col("reaches_4").cast("double")), 6).alias("rate_4"))


@query("""
, n AS (SELECT clip_no, frame_idx, count(*) FILTER (confidence >= 0.5) AS c FROM scene_keypoints GROUP BY clip_no, frame_idx),
i AS (SELECT clip_no, frame_idx, frame_idx - row_number() OVER (PARTITION BY clip_no ORDER BY frame_idx) AS island FROM n WHERE c < 4)
SELECT clip_no, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS length FROM i GROUP BY clip_no, island""")
def f05_runs_below_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.runs(court.sufficiency(scene.keypoints(spark, sf_dir)), ~F.col("reaches_4"))


@query(f"""
, c AS MATERIALIZED ({CONFIDENT}), prior AS MATERIALIZED (SELECT clip_no, frame_idx + 1 AS frame_idx, idx, x, y FROM c)
SELECT a.clip_no, a.frame_idx, a.idx, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS moved_px FROM c a JOIN prior b ON b.clip_no = a.clip_no AND b.idx = a.idx AND b.frame_idx = a.frame_idx""")
def d17_keypoint_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(court.displacements(scene.keypoints(spark, sf_dir)))


@query(f"""
, c AS (SELECT *, x + (eid % 3) AS sx FROM ({CONFIDENT})), l AS (SELECT clip_no, frame_idx, idx, x, y FROM scene_keypoints WHERE (eid + idx) % 4 <> 0)
SELECT idx, count(*) FILTER (l_idx IS NOT NULL AND c_idx IS NOT NULL) AS matched, count(*) FILTER (l_idx IS NULL) AS false_positives, count(*) FILTER (c_idx IS NULL) AS misses, round(median(d), 6) AS median_px
FROM (SELECT coalesce(l.idx, c.idx) AS idx, l.idx AS l_idx, c.idx AS c_idx, abs(c.sx - l.x) AS d FROM c FULL JOIN l ON l.clip_no = c.clip_no AND l.frame_idx = c.frame_idx AND l.idx = c.idx) GROUP BY idx""")
def d18_keypoint_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found landmarks against labelled ones: matched, false, missed, median error."""
    every = scene.keypoints(spark, sf_dir)
    c = court.confident(every).select("clip_no", "frame_idx", "idx", (F.col("x") + F.col("eid") % 3).alias("sx"), F.lit(True).alias("c"))
    l = every.where("(eid + idx) % 4 <> 0").select("clip_no", "frame_idx", "idx", "x", F.lit(True).alias("l"))  # noqa: E741
    both = c.join(l, ["clip_no", "frame_idx", "idx"], "full")
    return both.groupBy("idx").agg(F.count_if(F.col("c").isNotNull() & F.col("l").isNotNull()).alias("matched"), F.count_if(F.col("l").isNull()).alias("false_positives"), F.count_if(F.col("c").isNull()).alias("misses"),
                                   F.round(F.percentile(F.abs(F.col("sx") - F.col("x")), F.lit(0.5)), 6).alias("median_px"))


@query(f"""
, c AS ({CONFIDENT})
SELECT c.clip_no, c.frame_idx, c.idx, t.idx AS asked, t.name, t.flip_index, round(t.x_m / 28.65::DOUBLE * 1000, 6) AS px, round(t.y_m / 15.24::DOUBLE * 532, 6) AS py FROM c JOIN court_template t ON t.idx = c.idx + c.frame_idx % 2""")
def b10_b11_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template's entry for each confident landmark, on odd frames for the one after it, in pixels of a drawing; a number that the template does not have is left out."""
    t = F.broadcast(scene.template(spark).withColumnRenamed("idx", "asked"))
    rows = court.confident(scene.keypoints(spark, sf_dir)).select("clip_no", "frame_idx", "idx", (F.col("idx") + F.col("frame_idx") % 2).alias("asked")).join(t, "asked")
    x, y = plane.to_pixels(F.col("x_m"), F.col("y_m"), 1000, 532)
    return rows.select("clip_no", "frame_idx", "idx", "asked", "name", "flip_index", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


@query("""
, n AS (SELECT clip_no, frame_idx, count(*) FILTER (confidence >= 0.5) AS c FROM scene_keypoints GROUP BY clip_no, frame_idx)
SELECT clip_no, CASE WHEN c >= 9 THEN '9+' WHEN c >= 5 THEN CAST(c AS VARCHAR) ELSE 'skipped' END AS bucket, count(*) AS n_frames, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY clip_no) AS DOUBLE), 6) AS share FROM n GROUP BY 1, 2""")
def e25_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by bucket; skipped and scored add up to all."""
    n = court.sufficiency(scene.keypoints(spark, sf_dir)).groupBy("clip_no", F.coalesce(bucket(F.col("confident_count")), F.lit("skipped")).alias("bucket")).agg(F.count("*").alias("n_frames"))
    return n.select("*", F.round(F.col("n_frames") / F.sum("n_frames").over(Window.partitionBy("clip_no")), 6).alias("share"))


@query(f"""
, c AS ({CONFIDENT}), m AS (SELECT a.clip_no, abs(a.x - b.x) AS d FROM c a JOIN c b ON b.clip_no = a.clip_no AND b.idx = a.idx AND b.frame_idx + 1 = a.frame_idx)
SELECT clip_no, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median_dx, round(quantile_cont(d, 0.95), 6) AS p95_dx, count(*) FILTER (d > 10) AS over_10 FROM m GROUP BY clip_no""")
def e14_camera_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of horizontal motion from frame to frame."""
    now = court.confident(scene.keypoints(spark, sf_dir)).select("clip_no", "frame_idx", "idx", "x")
    before = now.select("clip_no", (F.col("frame_idx") + 1).alias("frame_idx"), "idx", F.col("x").alias("px"))
    d = now.join(before, ["clip_no", "frame_idx", "idx"]).select("clip_no", F.abs(F.col("x") - F.col("px")).alias("d"))
    q = lambda p: F.round(F.percentile("d", F.lit(p)), 6)
    return d.groupBy("clip_no").agg(F.count("*").alias("n"), q(0.5).alias("median_dx"), q(0.95).alias("p95_dx"), F.count_if(F.col("d") > 10).alias("over_10"))


@query("""SELECT clip_no, track_id, count(*) AS n, list_sort(list(x1))[CAST(round_even(0.9::DOUBLE * (count(*) - 1), 0) AS BIGINT) + 1] AS p90, list_sort(list(x1))[CAST(round_even(0.5::DOUBLE * (count(*) - 1), 0) AS BIGINT) + 1] AS p50 FROM scene_players GROUP BY clip_no, track_id""")
def e13_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles: the row at the half-even rounded rank, by window instead of a collected list."""
    w = Window.partitionBy("clip_no", "track_id")
    rows = scene.players(spark, sf_dir).select("clip_no", "track_id", "x1", F.row_number().over(w.orderBy("x1")).alias("k"), F.count("*").over(w).alias("n"))
    at = lambda f: F.max(F.when(F.col("k") == F.bround(F.lit(f) * (F.col("n") - 1)) + 1, F.col("x1")))
    return rows.groupBy("clip_no", "track_id", "n").agg(at(0.9).alias("p90"), at(0.5).alias("p50"))


# --- B12-B14, B35, L: what to draw ----------------------------------------------------------------------------------
MAP_W, MAP_H, RADIUS = 300, 160, 5


@query(GOOD + PLACES + """
, px AS (SELECT clip_no, frame_idx, track_id, x_m / 28.65::DOUBLE * 300 AS x, y_m / 15.24::DOUBLE * 160 AS y FROM stated WHERE status = 'ok')
SELECT clip_no, frame_idx, track_id, round(greatest(5, least(x, 295)), 4) AS x, round(greatest(5, least(y, 155)), 4) AS y, x < 0 OR x > 300 OR y < 0 OR y > 160 AS is_off FROM px""")
def b12_minimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on the small map: clamped by the mark's radius, but off or on decided before, on the court: a point on one of its lines is on the map whatever the last digits of its fit."""
    rows = court_positions(spark, sf_dir).where("status = 'ok'")
    x, y = plane.to_pixels(F.col("x_m"), F.col("y_m"), MAP_W, MAP_H)
    p = rows.select("clip_no", "frame_idx", "track_id", x.alias("x"), y.alias("y"), (~plane.in_bounds(F.col("x_m"), F.col("y_m"), 0.0)).alias("is_off"))
    clamp = lambda c, most: F.round(F.greatest(F.lit(float(RADIUS)), F.least(F.col(c), F.lit(float(most - RADIUS)))), 4)
    return p.select("clip_no", "frame_idx", "track_id", clamp("x", MAP_W).alias("x"), clamp("y", MAP_H).alias("y"), "is_off")


@query("""SELECT clip_no, frame_idx, 'box' AS shape, 10 AS z, track_id AS subject, '#' || CAST(track_id AS VARCHAR) || ' ' || CAST(CAST(x1 AS INT) AS VARCHAR) || ',' || CAST(CAST(y1 AS INT) AS VARCHAR) AS caption FROM scene_players
  UNION ALL SELECT clip_no, frame_idx, 'ball', 20, 0, printf('ball %.2f', confidence) FROM scene_ball""")
def render_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to draw on each frame, bottom to top, as rows; no pixel is touched."""
    word = lambda c: F.col(c).cast("int").cast("string")
    a = scene.players(spark, sf_dir).select("clip_no", "frame_idx", F.lit("box").alias("shape"), F.lit(10).alias("z"), F.col("track_id").alias("subject"), F.concat(F.lit("#"), word("track_id"), F.lit(" "), word("x1"), F.lit(","), word("y1")).alias("caption"))
    b = scene.ball(spark, sf_dir).select("clip_no", "frame_idx", F.lit("ball").alias("shape"), F.lit(20).alias("z"), F.lit(0).alias("subject"), F.format_string("ball %.2f", "confidence").alias("caption"))
    return a.unionByName(b)


@query("""
, ev AS (SELECT clip_no, start_frame, event_type FROM scene_event_gt), live AS (SELECT f.clip_no, f.frame_idx, e.start_frame, e.event_type, row_number() OVER (PARTITION BY f.clip_no, f.frame_idx ORDER BY e.start_frame DESC) AS k
  FROM scene_frames f JOIN ev e ON e.clip_no = f.clip_no AND f.frame_idx BETWEEN e.start_frame AND e.start_frame + 14)
SELECT clip_no, frame_idx, event_type || ' @' || CAST(start_frame AS VARCHAR) AS caption, CAST(k AS INT) AS line FROM live WHERE k <= 3""")
def c15_live_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three events of the last 15 frames: each event is spread over its frames, so the join is an equi-join."""
    spread = scene.event_labels(spark, sf_dir).select("clip_no", "start_frame", "event_type", F.explode(F.sequence(F.col("start_frame"), F.col("start_frame") + 14)).alias("frame_idx"))
    live = spread.join(scene.frames(spark, sf_dir).select("clip_no", "frame_idx"), ["clip_no", "frame_idx"])
    k = F.row_number().over(Window.partitionBy("clip_no", "frame_idx").orderBy(F.col("start_frame").desc()))
    return live.select("clip_no", "frame_idx", F.concat("event_type", F.lit(" @"), F.col("start_frame").cast("string")).alias("caption"), k.alias("line")).where("line <= 3")


# --- A05, A09, A12, A13, A20, A26, B37, B38, B41, E36, G01, H: files, answers, splits --------------------------------
@query("""SELECT CAST(frame_idx + 1 AS VARCHAR) || ',' || CAST(track_id AS VARCHAR) || ',' || CAST(CAST(x1 AS INT) AS VARCHAR) || ',' || CAST(CAST(y1 AS INT) AS VARCHAR) || ',60,150,1,-1,-1,-1' AS value, clip_no FROM scene_players""")
def a13_mot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as lines of the annotation format."""
    return mot_lines(scene.players(spark, sf_dir), "clip_no")


@query("""
, t AS (SELECT clip_no, '{"' || CAST(clip_no AS VARCHAR) || '": [[1, 2, 3, 4], [' || CAST(frame_idx AS VARCHAR) || ', 6, 7, 8]]}' AS value, frame_idx FROM scene_frames)
SELECT clip_no AS frame_idx, CAST(0 AS INT) AS place, 1.0::DOUBLE AS x1, 2.0::DOUBLE AS y1, 3.0::DOUBLE AS x2, 4.0::DOUBLE AS y2 FROM t UNION ALL SELECT clip_no, 1, CAST(frame_idx AS DOUBLE), 6, 7, 8 FROM t""")
def a20_seed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = scene.frames(spark, sf_dir).select(F.format_string('{"%d": [[1, 2, 3, 4], [%d, 6, 7, 8]]}', "clip_no", "frame_idx").alias("value"))
    return seed_rows(texts)


@query("""SELECT eid AS doc, CAST(i AS INT) AS idx, CAST((u % 100) / 100.0::DOUBLE * 1280 AS DOUBLE) AS x, 180.0::DOUBLE AS y, CAST(eid % 3 AS INT) AS v FROM scene_frames, (SELECT unnest(range(0, 18)) AS i) WHERE eid % 3 >= 1""")
def a26_pose_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pose label lines to visible points in pixels."""
    f = scene.frames(spark, sf_dir)
    line = F.concat(F.lit("1 0.5 0.5 0.2 0.2"), F.repeat(F.concat(F.lit(" "), (F.col("u") % 100 / F.lit(100.0)).cast("string"), F.lit(" 0.25 "), (F.col("eid") % 3).cast("string")), 18))
    points = f.select(F.col("eid").alias("doc"), F.explode(pose_label(line, F.lit(1280.0), F.lit(720.0))).alias("p"))
    return points.select("doc", "p.idx", "p.x", "p.y", "p.v")


@query("""SELECT eid AS doc, '1 ' || CASE WHEN u % 2 = 0 THEN '0' ELSE '1' END || ' 0.5 0.25 1 0 1 ' || CAST(u % 3 AS VARCHAR) AS line FROM scene_frames""")
def b38_clamped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scene.frames(spark, sf_dir)
    line = F.concat(F.lit("1 "), F.when(F.col("u") % 2 == 0, "-0.25").otherwise("1.75"), F.lit(" 0.5 0.25 1.5 -3 7 "), (F.col("u") % 3).cast("string"))
    return f.select(F.col("eid").alias("doc"), clamped_label(line).alias("line"))


@query("""
, a AS (SELECT eid, CASE u % 6 WHEN 0 THEN ' Nobody ' WHEN 1 THEN 'U' WHEN 2 THEN '007' WHEN 3 THEN ' 12 ' WHEN 4 THEN 'x9' ELSE '0' END AS answer FROM scene_frames)
SELECT eid, CASE WHEN lower(trim(answer)) IN ('n', 'nobody') THEN 'nobody' WHEN lower(trim(answer)) IN ('u', 'unclear') THEN 'unclear' WHEN regexp_full_match(trim(answer), '[0-9]+') THEN CAST(CAST(trim(answer) AS INT) AS VARCHAR) END AS holder FROM a""")
def b41_parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u") % 6
    answer = F.when(u == 0, " Nobody ").when(u == 1, "U").when(u == 2, "007").when(u == 3, " 12 ").when(u == 4, "x9").otherwise("0")
    return scene.frames(spark, sf_dir).select("eid", store.parsed_holder(answer).alias("holder"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(_(jpg|png|jpeg)|\\.html|[?#].*)$', '') AS stem FROM pages""", scene=False)
def b37_file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and stem of a path, suffixes taken off."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_replace(F.regexp_extract("url", "([^/]*)$", 1), r"(_(jpg|png|jpeg)|\.html|[?#].*)$", "").alias("stem"))


@query("""
, k AS (SELECT unnest(['window', 'gap', 'threshold']) AS key, unnest([5.0::DOUBLE, 30, 0.6]) AS base), o AS (SELECT DISTINCT clip_no, 'gap' AS key, 10.0::DOUBLE + clip_no AS value FROM scene_frames WHERE clip_no % 2 = 0)
SELECT c.clip_no, k.key, coalesce(o.value, k.base) AS value FROM (SELECT DISTINCT clip_no FROM scene_frames) c CROSS JOIN k LEFT JOIN o ON o.clip_no = c.clip_no AND o.key = k.key""")
def a05_clip_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scene.frames(spark, sf_dir)
    own = f.where("clip_no % 2 = 0").select("clip_no", F.lit("gap").alias("key"), (F.lit(10.0) + F.col("clip_no")).alias("value")).distinct()
    return store.clip_settings(f, {"window": 5.0, "gap": 30.0, "threshold": 0.6}, own)


@query("SELECT doc_id, sha256(text) AS digest FROM documents", scene=False)
def a09_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""
, v AS (SELECT clip_no, frame_idx FROM scene_ball WHERE confidence >= 0.4::DOUBLE), p AS (SELECT clip_no, frame_idx FROM scene_ball WHERE frame_idx % 3 <> 0)
SELECT *, 'new_accept' AS class FROM (SELECT * FROM v EXCEPT SELECT * FROM p) UNION ALL SELECT *, 'new_reject' FROM (SELECT * FROM p EXCEPT SELECT * FROM v) UNION ALL SELECT *, 'same' FROM (SELECT * FROM v INTERSECT SELECT * FROM p)""")
def h03_decision_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences and common part of two sets of accepted frames, by one grouped pass instead of three set operations."""
    ball = scene.ball(spark, sf_dir)
    v, p = F.col("confidence") >= 0.4, F.col("frame_idx") % 3 != 0
    kind = F.when(v & p, "same").when(v, "new_accept").when(p, "new_reject")
    return ball.select("clip_no", "frame_idx", kind.alias("class")).where("class is not null").distinct()


@query("""
, g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k FROM g),
s AS (SELECT k, source, 'train' AS split, n AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c FROM o WHERE k = 1
  UNION ALL SELECT o.k, o.source, CASE WHEN 0.7::DOUBLE * t.n - s.a >= 0.15::DOUBLE * t.n - s.b AND 0.7::DOUBLE * t.n - s.a >= 0.15::DOUBLE * t.n - s.c THEN 'train' WHEN 0.15::DOUBLE * t.n - s.b >= 0.15::DOUBLE * t.n - s.c THEN 'valid' ELSE 'test' END,
    s.a + CASE WHEN 0.7::DOUBLE * t.n - s.a >= 0.15::DOUBLE * t.n - s.b AND 0.7::DOUBLE * t.n - s.a >= 0.15::DOUBLE * t.n - s.c THEN o.n ELSE 0 END,
    s.b + CASE WHEN NOT (0.7::DOUBLE * t.n - s.a >= 0.15::DOUBLE * t.n - s.b AND 0.7::DOUBLE * t.n - s.a >= 0.15::DOUBLE * t.n - s.c) AND 0.15::DOUBLE * t.n - s.b >= 0.15::DOUBLE * t.n - s.c THEN o.n ELSE 0 END,
    s.c + CASE WHEN NOT (0.7::DOUBLE * t.n - s.a >= 0.15::DOUBLE * t.n - s.b AND 0.7::DOUBLE * t.n - s.a >= 0.15::DOUBLE * t.n - s.c) AND NOT 0.15::DOUBLE * t.n - s.b >= 0.15::DOUBLE * t.n - s.c THEN o.n ELSE 0 END
  FROM s JOIN o ON o.k = s.k + 1 CROSS JOIN (SELECT count(*) AS n FROM documents) t)
SELECT source, split FROM s""", recursive=True)
def e36_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups, largest first, each to the split that is furthest below its target. The groups are counted first; the
    fold runs over one array of counts (as many entries as there are sources)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    g = docs.groupBy("source").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "source"))).alias("g")).select(F.explode(F.expr("""aggregate(g,
        named_struct('a', 0L, 'b', 0L, 'c', 0L, 'out', cast(array() as array<struct<source:string,split:string>>)),
        (s, x) -> named_struct(
            'a', s.a + if(0.7D * total - s.a >= 0.15D * total - s.b and 0.7D * total - s.a >= 0.15D * total - s.c, -x.n, 0L),
            'b', s.b + if(not (0.7D * total - s.a >= 0.15D * total - s.b and 0.7D * total - s.a >= 0.15D * total - s.c) and 0.15D * total - s.b >= 0.15D * total - s.c, -x.n, 0L),
            'c', s.c + if(not (0.7D * total - s.a >= 0.15D * total - s.b and 0.7D * total - s.a >= 0.15D * total - s.c) and not (0.15D * total - s.b >= 0.15D * total - s.c), -x.n, 0L),
            'out', concat(s.out, array(named_struct('source', x.source, 'split', if(0.7D * total - s.a >= 0.15D * total - s.b and 0.7D * total - s.a >= 0.15D * total - s.c, 'train', if(0.15D * total - s.b >= 0.15D * total - s.c, 'valid', 'test')))))),
        s -> s.out)""")).alias("r")).select("r.source", "r.split")


@query("""
, n AS (SELECT clip_no, et, count(*) AS n, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(DISTINCT u) AS users FROM scene_frames GROUP BY clip_no, et)
SELECT clip_no, et, n, first_frame, last_frame, users, round(100.0::DOUBLE * n / CAST(sum(n) OVER (PARTITION BY clip_no) AS DOUBLE), 6) AS pct FROM n""")
def e31_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = scene.frames(spark, sf_dir).groupBy("clip_no", "et").agg(F.count("*").alias("n"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.countDistinct("u").alias("users"))
    return n.select("*", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("clip_no")), 6).alias("pct"))


@query("""
, p AS (SELECT clip_no, frame_idx, track_id, (x1 + 30) / 50.0::DOUBLE AS x_m, (y1 + 150) / 50.0::DOUBLE AS y_m FROM scene_players WHERE (frame_idx + track_id * 3) % 41 >= 8)
SELECT clip_no, count(*) FILTER (x_m BETWEEN -2.0 AND 30.65::DOUBLE AND y_m BETWEEN -2.0 AND 17.24::DOUBLE) AS inside, count(*) AS n FROM p GROUP BY clip_no""")
def c06_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).groupBy("clip_no").agg(F.count_if(plane.in_bounds(F.col("x_m"), F.col("y_m"))).alias("inside"), F.count("*").alias("n"))


@query("SELECT clip_no, frame_idx, track_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS width, y2 AS foot_y, (x2 - x1) * (y2 - y1) AS area FROM scene_players")
def b01_b05_box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Box.of()
    return scene.players(spark, sf_dir).select("clip_no", "frame_idx", "track_id", b.centre[0].alias("cx"), b.centre[1].alias("cy"), b.width.alias("width"), b.foot[1].alias("foot_y"), b.area.alias("area"))
