"""Queries: parts of the longer plans by themselves, sets of keys, and accounts that must add up."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameflow.functions import court as plane
from frameflow.functions.boxes import Box, crop
from frameflow.operators import court
from frameflow.plans.game import rounded
from frameflow.plans.ground import CONFIDENT, GOOD, fitted
from frameflow.plans.registry import query
from frameflow.sources import scene
from frameflow.sources.files import detect_boxes, detect_text

FRAME_W, FRAME_H, WINDOW = 1280, 720, 160


# --- B16, B17, B24, B25: crops and landmarks ------------------------------------------------------------------------
@query("""
, r AS (SELECT clip_no, frame_idx, track_id, greatest(0, least(CAST(trunc(x1) AS INT), 1280)) AS a, greatest(0, least(CAST(trunc(y1) AS INT), 720)) AS b, greatest(0, least(CAST(trunc(x2) AS INT), 1280)) AS c,
  greatest(0, least(CAST(trunc(y2) AS INT), 720)) AS d FROM scene_players)
SELECT clip_no, frame_idx, track_id, CASE WHEN c > a AND d > b THEN a END AS x1, CASE WHEN c > a AND d > b THEN b END AS y1, CASE WHEN c > a AND d > b THEN c END AS x2, CASE WHEN c > a AND d > b THEN d END AS y2 FROM r""")
def b16_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole boxes cut at the frame's edges; null where nothing is left."""
    box = scene.players(spark, sf_dir).select("clip_no", "frame_idx", "track_id", crop(Box.of(), FRAME_W, FRAME_H, 1.0).alias("r"))
    return box.select("clip_no", "frame_idx", "track_id", *[F.col(f"r.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("""
SELECT f.clip_no, f.frame_idx, CAST(greatest(0, least(round_even(coalesce(b.cx, 640), 0) - 80, 1120)) AS INT) AS x0, CAST(greatest(0, least(round_even(coalesce(b.cy, 360), 0) - 80, 560)) AS INT) AS y0
FROM scene_frames f LEFT JOIN scene_ball b USING (clip_no, frame_idx)""")
def b17_focus_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of fixed size around each frame's ball, or the frame's centre without one, moved inside the frame."""
    rows = scene.frames(spark, sf_dir).select("clip_no", "frame_idx").join(scene.ball(spark, sf_dir).select("clip_no", "frame_idx", "cx", "cy"), ["clip_no", "frame_idx"], "left")
    edge = lambda c, size: F.greatest(F.lit(0.0), F.least(F.bround(F.coalesce(c, F.lit(size / 2))) - WINDOW // 2, F.lit(float(size - WINDOW)))).cast("int")
    return rows.select("clip_no", "frame_idx", edge("cx", FRAME_W).alias("x0"), edge("cy", FRAME_H).alias("y0"))


@query(GOOD.split("\nfit AS")[0].rstrip().rstrip(",") + """,
flat AS (SELECT CAST((1 << a.idx) + (1 << b.idx) + (1 << c.idx) AS BIGINT) AS mask FROM court_template a JOIN court_template b ON b.idx > a.idx JOIN court_template c ON c.idx > b.idx
  WHERE abs((b.x_m - a.x_m) * (c.y_m - a.y_m) - (c.x_m - a.x_m) * (b.y_m - a.y_m)) / 2 < 0.01::DOUBLE),
kinds AS (SELECT m.mask, count(f.mask) AS flat_triples FROM (SELECT DISTINCT mask FROM n) m LEFT JOIN flat f ON f.mask & m.mask = f.mask GROUP BY m.mask)
SELECT n.clip_no, n.frame_idx, n.n, k.flat_triples, n.n >= 4 AND g.mask IS NOT NULL AS general FROM n JOIN kinds k ON k.mask = n.mask LEFT JOIN good g ON g.mask = n.mask""")
def b24_b25_general_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each frame: its confident landmarks, how many triples of them are on one line, and whether four of them have no three on one. Frames with the same landmarks are judged once, against
    the triples and quadruples of the court's 18."""
    t = F.broadcast(scene.template(spark).select("idx", F.struct("x_m", "y_m").alias("at")))
    triples = spark.createDataFrame(list(combinations(range(len(plane.TEMPLATE)), 3)), "i int, j int, k int")
    for c in "ijk":
        triples = triples.join(t.select(F.col("idx").alias(c), F.col("at").alias(f"at_{c}")), c)
    flat = plane.collinear(F.col("at_i"), F.col("at_j"), F.col("at_k"))
    bits = lambda *cs: sum((F.expr(f"shiftleft(1L, {c})") for c in cs), F.lit(0).cast("long"))
    lines, good = triples.where(flat).select(bits("i", "j", "k").alias("line")), triples.where(~flat).select("i", "j", "k")
    named = lambda *to: good.select(*[F.col(a).alias(b) for a, b in zip("ijk", to, strict=True)])
    fours = named("i", "j", "k").join(named("i", "j", "l"), ["i", "j"]).join(named("i", "k", "l"), ["i", "k", "l"]).join(named("j", "k", "l"), ["j", "k", "l"]).select(bits("i", "j", "k", "l").alias("four"))
    masks = court.confident(scene.keypoints(spark, sf_dir)).groupBy("clip_no", "frame_idx").agg(F.count("*").alias("n"), F.sum(F.expr("shiftleft(1L, idx)")).alias("mask"))
    kinds = masks.select("mask").distinct()
    holds = lambda c: F.col("mask").bitwiseAND(F.col(c)) == F.col(c)
    counted = kinds.join(F.broadcast(lines), holds("line"), "left").groupBy("mask").agg(F.count("line").alias("flat_triples"))
    general = kinds.join(F.broadcast(fours), holds("four"), "left_semi").withColumn("general", F.lit(True))
    return masks.join(counted, "mask").join(general, "mask", "left").select("clip_no", "frame_idx", "n", "flat_triples", F.coalesce("general", F.lit(False)).alias("general"))


# --- A27: detection labels ------------------------------------------------------------------------------------------
@query("""SELECT clip_no, frame_idx, CAST(i AS INT) AS place, CAST(i AS INT) AS class, CASE WHEN i = 0 THEN cx / 2048 ELSE 0.5::DOUBLE END AS cx, CASE WHEN i = 0 THEN cy / 1024 ELSE 0.25::DOUBLE END AS cy, 0.125::DOUBLE AS w, 0.0625::DOUBLE AS h,
  '0 ' || printf('%.6f', cx / 2048) || ' ' || printf('%.6f', cy / 1024) || ' 0.125000 0.062500' || chr(10) || '1 0.500000 0.250000 0.125000 0.062500' AS text FROM scene_ball, (SELECT unnest(range(0, 2)) AS i)""")
def a27_detect_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection label files read into boxes and written again."""
    line = F.concat(F.lit("0 "), (F.col("cx") / 2048).cast("string"), F.lit(" "), (F.col("cy") / 1024).cast("string"), F.lit(" 0.125 0.0625\n\n1 0.5 0.25 0.125 0.0625\n"))
    rows = scene.ball(spark, sf_dir).select("clip_no", "frame_idx", detect_boxes(line).alias("boxes")).withColumn("text", detect_text(F.col("boxes")))
    return rows.select("clip_no", "frame_idx", "text", F.posexplode("boxes").alias("place", "b")).select("clip_no", "frame_idx", "place", "b.*", "text")


# --- C02, C03, C05, C17, D03, D09, D24: filters and joins -----------------------------------------------------------
@query("SELECT clip_no, frame_idx, player_id, confidence FROM scene_team_raw WHERE predicted_team = 1 AND confidence >= 0.75")
def c02_class_and_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.team_raw(spark, sf_dir).where("predicted_team = 1 and confidence >= 0.75").select("clip_no", "frame_idx", "player_id", "confidence")


@query(f"""
, c AS ({CONFIDENT})
SELECT clip_no, frame_idx, idx, round(x, 6) AS x, round(y, 6) AS y, round(x_m, 6) AS x_m, round(y_m, 6) AS y_m, name FROM c JOIN court_template USING (idx)""")
def c03_c05_d03_correspondences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident landmarks with their places on the court."""
    rows = court.confident(scene.keypoints(spark, sf_dir)).select("clip_no", "frame_idx", "idx", "x", "y")
    return rounded(rows.join(F.broadcast(scene.template(spark).select("idx", "x_m", "y_m", "name")), "idx").select("clip_no", "frame_idx", "idx", "x", "y", "x_m", "y_m", "name"))


@query("""SELECT p.clip_no, p.track_id, count(*) AS n_frames, count(g.gt_id) AS n_labelled FROM scene_players p LEFT JOIN scene_gt g ON g.clip_no = p.clip_no AND g.frame_idx = p.frame_idx AND g.gt_id = p.track_id + 100
GROUP BY p.clip_no, p.track_id""")
def d09_tracks_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track with what is labelled of it; tracks without a label stay."""
    g = scene.ground_truth(spark, sf_dir).select("clip_no", "frame_idx", (F.col("gt_id") - 100).alias("track_id"), F.lit(True).alias("labelled"))
    both = scene.players(spark, sf_dir).select("clip_no", "frame_idx", "track_id").join(g, ["clip_no", "frame_idx", "track_id"], "left")
    return both.groupBy("clip_no", "track_id").agg(F.count("*").alias("n_frames"), F.count("labelled").alias("n_labelled"))


@query("""
, e AS (SELECT clip_no AS run, frame_idx AS epoch, ((eid * 37) % 10) / 10.0::DOUBLE AS score, ((eid * 91) % 7) / 7.0::DOUBLE AS loss FROM scene_frames),
m AS (SELECT run, score + CASE WHEN run % 5 = 4 THEN 0.05::DOUBLE ELSE 0.00005::DOUBLE END AS s, loss - 0.00005::DOUBLE AS l FROM e WHERE epoch = (run * 17) % 100),
x AS (SELECT m.run, e.epoch FROM m JOIN e ON e.run = m.run AND abs(e.score - s) <= 1e-4 AND abs(e.loss - l) <= 1e-4)
SELECT m.run, count(x.epoch) AS n_matches, CASE count(x.epoch) WHEN 0 THEN 'none' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS verdict, CASE WHEN count(x.epoch) = 1 THEN min(x.epoch) END AS epoch FROM m LEFT JOIN x ON x.run = m.run GROUP BY m.run""")
def d24_checkpoint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epoch of each run whose metrics are those of the run's checkpoint, to 1e-4 in every one; none or several are told apart."""
    rows = scene.frames(spark, sf_dir).select(F.col("clip_no").alias("run"), F.col("frame_idx").alias("epoch"), ((F.col("eid") * 37) % 10 / 10.0).alias("score"), ((F.col("eid") * 91) % 7 / 7.0).alias("loss"))
    kept = rows.where("epoch = (run * 17) % 100").select("run", (F.col("score") + F.when(F.col("run") % 5 == 4, 0.05).otherwise(0.00005)).alias("s"), (F.col("loss") - 0.00005).alias("l"))
    close = (F.abs(F.col("score") - F.col("s")) <= 1e-4) & (F.abs(F.col("loss") - F.col("l")) <= 1e-4)
    n = F.count_if(close)
    return rows.join(kept, "run").groupBy("run").agg(n.alias("n_matches"), F.when(n == 0, "none").when(n == 1, "found").otherwise("ambiguous").alias("verdict"), F.when(n == 1, F.min(F.when(close, F.col("epoch")))).alias("epoch"))


# --- E12, F12: moves of the ball between detections -----------------------------------------------------------------
MOVES = """
, o AS (SELECT clip_no, frame_idx, cx, cy, lag(frame_idx) OVER w AS pf, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM scene_ball WINDOW w AS (PARTITION BY clip_no ORDER BY frame_idx)),
mv AS (SELECT clip_no, frame_idx, CAST(frame_idx - pf AS INT) AS gap, sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) AS moved FROM o WHERE pf IS NOT NULL)"""


def ball_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("clip_no").orderBy("frame_idx")
    dx, dy = F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)
    return scene.ball(spark, sf_dir).select("clip_no", "frame_idx", (F.col("frame_idx") - F.lag("frame_idx").over(w)).alias("gap"), F.sqrt(dx * dx + dy * dy).alias("moved")).where("gap is not null")


@query(MOVES + "SELECT clip_no, frame_idx, gap, round(moved, 6) AS moved FROM mv")
def f12_ball_displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ball_moves(spark, sf_dir))


@query(MOVES + "SELECT clip_no, gap, count(*) AS n, round(quantile_cont(moved, 0.25), 6) AS q1, round(quantile_cont(moved, 0.5), 6) AS median, round(quantile_cont(moved, 0.75), 6) AS q3 FROM mv GROUP BY clip_no, gap")
def e12_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and inclusive quartiles; one value is all three of them."""
    q = lambda p: F.round(F.percentile("moved", F.lit(p)), 6)
    return ball_moves(spark, sf_dir).groupBy("clip_no", "gap").agg(F.count("*").alias("n"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))


# --- E28, E35, E37: accounts ----------------------------------------------------------------------------------------
@query(f"""
, c AS ({CONFIDENT}), l AS (SELECT clip_no, frame_idx, idx FROM scene_keypoints WHERE (eid + idx) % 4 <> 0),
b AS (SELECT coalesce(c.clip_no, l.clip_no) AS clip_no, c.idx AS ci, l.idx AS li FROM c FULL JOIN l ON l.clip_no = c.clip_no AND l.frame_idx = c.frame_idx AND l.idx = c.idx),
n AS (SELECT clip_no, count(*) FILTER (ci IS NOT NULL AND li IS NOT NULL) AS matched, count(*) FILTER (li IS NULL) AS false_positives, count(*) FILTER (ci IS NULL) AS false_negatives, count(li) AS labelled, count(ci) AS confident FROM b GROUP BY clip_no)
SELECT *, matched + false_negatives = labelled AS labelled_add_up, matched + false_positives = confident AS confident_add_up FROM n""")
def e28_identity_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched, false and missed landmarks against the totals that they must add up to: one grouped pass over the landmarks."""
    c, l = F.col("confidence") >= court.CONFIDENT, (F.col("eid") + F.col("idx")) % 4 != 0  # noqa: E741
    n = scene.keypoints(spark, sf_dir).groupBy("clip_no").agg(F.count_if(c & l).alias("matched"), F.count_if(c & ~l).alias("false_positives"), F.count_if(~c & l).alias("false_negatives"), F.count_if(l).alias("labelled"), F.count_if(c).alias("confident"))
    return n.select("*", (F.col("matched") + F.col("false_negatives") == F.col("labelled")).alias("labelled_add_up"), (F.col("matched") + F.col("false_positives") == F.col("confident")).alias("confident_add_up"))


@query(GOOD + """
, a AS (SELECT clip_no, count(*) AS n_frames, count(*) FILTER (status = 'ok') AS mapped, count(*) FILTER (status <> 'ok') AS unmapped FROM fit GROUP BY clip_no)
SELECT *, CASE WHEN mapped + unmapped = n_frames AND n_frames = 500 THEN 'PASS' ELSE 'MISMATCH' END AS verdict FROM a""")
def e35_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped and unmapped frames against all frames of the clip."""
    n = fitted(spark, sf_dir).groupBy("clip_no").agg(F.count_if(F.col("status") == "ok").alias("mapped"), F.count_if(F.col("status") != "ok").alias("unmapped"))
    every = scene.frames(spark, sf_dir).groupBy("clip_no").agg(F.count("*").alias("n_frames"))
    ok = (F.col("mapped") + F.col("unmapped") == F.col("n_frames")) & (F.col("n_frames") == scene.FRAMES_PER_CLIP)
    return every.join(n, "clip_no", "left").na.fill(0, ["mapped", "unmapped"]).withColumn("verdict", F.when(ok, "PASS").otherwise("MISMATCH"))


@query("SELECT f.clip_no, count(*) AS images, count(b.cx) AS ball_annotations, round(count(b.cx) / CAST(count(*) AS DOUBLE), 6) AS share FROM scene_frames f LEFT JOIN scene_ball b USING (clip_no, frame_idx) GROUP BY f.clip_no")
def e37_annotation_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and ball annotations of each clip; a clip without any ball stays."""
    b = scene.ball(spark, sf_dir).groupBy("clip_no").agg(F.count("*").alias("ball_annotations"))
    n = scene.frames(spark, sf_dir).groupBy("clip_no").agg(F.count("*").alias("images")).join(b, "clip_no", "left").na.fill(0, ["ball_annotations"])
    return n.select("*", F.round(F.col("ball_annotations") / F.col("images"), 6).alias("share"))


# --- H: sets of keys ------------------------------------------------------------------------------------------------
@query("""SELECT clip_no, frame_idx FROM scene_frames WHERE frame_idx % 25 = 0 UNION SELECT clip_no, frame_idx FROM scene_frames WHERE clip_no % 3 = 2 AND frame_idx BETWEEN 100 AND 140
UNION SELECT clip_no, frame_idx FROM scene_gt""")
def h01_labelled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to label: every 25th, those of a window, and those with ground truth; each once."""
    f = scene.frames(spark, sf_dir).where("frame_idx % 25 = 0 or (clip_no % 3 = 2 and frame_idx between 100 and 140)").select("clip_no", "frame_idx")
    return f.unionByName(scene.ground_truth(spark, sf_dir).select("clip_no", "frame_idx")).distinct()


@query("""SELECT 'all' AS arm, clip_no, frame_idx, player_id, predicted_team AS team FROM scene_team_raw
UNION ALL SELECT 'sure', clip_no, frame_idx, player_id, CASE WHEN confidence >= 0.75 THEN predicted_team ELSE 0 END FROM scene_team_raw WHERE crop_ok""")
def h02_arms_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of two arms one after the other, repeats kept."""
    rows = scene.team_raw(spark, sf_dir)
    key = ["clip_no", "frame_idx", "player_id"]
    a = rows.select(F.lit("all").alias("arm"), *key, F.col("predicted_team").alias("team"))
    return a.unionByName(rows.where("crop_ok").select(F.lit("sure").alias("arm"), *key, F.when(F.col("confidence") >= 0.75, F.col("predicted_team")).otherwise(0).alias("team")))


@query("""
, a AS (SELECT clip_no, frame_idx, player_id FROM scene_team_raw WHERE crop_ok), b AS (SELECT clip_no, frame_idx, player_id FROM scene_team_raw WHERE confidence >= 0.6)
SELECT 'first' AS only_in, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'second', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def h04_unshared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that one arm has and the other has not, in one grouped pass over both."""
    rows, key = scene.team_raw(spark, sf_dir), ["clip_no", "frame_idx", "player_id"]
    both = rows.where("crop_ok").select(*key, F.lit(True).alias("a"), F.lit(False).alias("b")).unionByName(rows.where("confidence >= 0.6").select(*key, F.lit(False).alias("a"), F.lit(True).alias("b")))
    once = both.groupBy(*key).agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b")).where("a <> b")
    return once.select(F.when(F.col("a"), "first").otherwise("second").alias("only_in"), *key)


@query("SELECT et AS name, count(*) AS n FROM scene_frames WHERE et NOT IN ('click', 'view', 'error') GROUP BY et")
def h06_unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are not among the known ones; pre-aggregated, so the anti join meets each name once."""
    known = spark.createDataFrame([("click",), ("view",), ("error",)], "name string")
    return scene.frames(spark, sf_dir).groupBy(F.col("et").alias("name")).agg(F.count("*").alias("n")).join(F.broadcast(known), "name", "left_anti")


@query("SELECT clip_no, start_frame, event_type, event_type IN ('pass', 'interception', 'steal') AS counts FROM scene_event_gt")
def h07_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.event_labels(spark, sf_dir).select("clip_no", "start_frame", "event_type", F.col("event_type").isin("pass", "interception", "steal").alias("counts"))
