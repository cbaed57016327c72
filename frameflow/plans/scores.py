"""Queries: possession against labels, configurations and arms, filters, samples, set checks, formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameflow.operators import lattice, possession, teams
from frameflow.plans.game import FILL, FULL, HOLDER, TEAMS, assigned, possessed
from frameflow.plans.people import OWN, truth
from frameflow.plans.registry import query
from frameflow.sources import scene

# --- possession against labels: E04, E19, E20, D07, D16, E38, B42, C11 ------------------------------------------------
LABELLED = """
, lab AS (SELECT clip_no, frame_idx, CASE WHEN u % 12 = 0 THEN 'unclear' WHEN u % 3 = 0 THEN 'nobody' ELSE CAST(1 + (frame_idx // 25 + clip_no) % 10 AS VARCHAR) END AS holder FROM scene_frames)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (1 + (F.floor(F.col("frame_idx") / 25) + F.col("clip_no")) % 10).cast("string")
    return scene.frames(spark, sf_dir).select("clip_no", "frame_idx", F.when(F.col("u") % 12 == 0, "unclear").when(F.col("u") % 3 == 0, "nobody").otherwise(number).alias("label"))


def oracle_holder(label):
    """A label as a holder: nobody, unclear and absent are -1."""
    return F.coalesce(label.try_cast("int"), F.lit(-1))


@query(LABELLED + "SELECT clip_no, frame_idx, coalesce(try_cast(holder AS INT), -1) AS holder FROM lab")
def b42_oracle_possession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("clip_no", "frame_idx", oracle_holder(F.col("label")).alias("holder"))


JUDGED = """
, judged AS (SELECT p.clip_no, p.frame_idx, p.holder AS pred, try_cast(l.holder AS INT) AS truth, l.holder AS label FROM possession p JOIN lab l ON l.clip_no = p.clip_no AND l.frame_idx = p.frame_idx WHERE l.holder <> 'unclear')"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and labelled holder of all frames that are not unclear; a null truth is nobody."""
    rows = possessed(spark, sf_dir).join(labels(spark, sf_dir), ["clip_no", "frame_idx"]).where("label <> 'unclear'")
    return rows.select("clip_no", "frame_idx", F.col("holder").alias("pred"), F.col("label").try_cast("int").alias("truth"))


@query(FULL + LABELLED + JUDGED + """SELECT clip_no, count(*) AS n, round(avg(CASE WHEN pred = coalesce(truth, -1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
  round(avg(CASE WHEN truth IS NOT NULL THEN CASE WHEN pred = truth THEN 1.0::DOUBLE ELSE 0 END END), 6) AS recall_held, round(avg(CASE WHEN truth IS NULL THEN CASE WHEN pred = -1 THEN 1.0::DOUBLE ELSE 0 END END), 6) AS spec_nobody,
  count(*) FILTER (truth IS NULL AND pred <> -1) AS false_positives, count(*) FILTER (truth IS NOT NULL AND pred = -1) AS misses, count(*) FILTER (truth IS NOT NULL AND pred <> -1 AND pred <> truth) AS wrong_player FROM judged GROUP BY clip_no""")
def e04_possession_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, own = F.col("truth").isNotNull(), F.col("pred") != -1
    right = (F.col("pred") == F.coalesce("truth", F.lit(-1))).cast("double")
    rate = lambda c: F.round(F.avg(c), 6)
    return judged(spark, sf_dir).groupBy("clip_no").agg(
        F.count("*").alias("n"), rate(right).alias("accuracy"), rate(F.when(held, right)).alias("recall_held"), rate(F.when(~held, right)).alias("spec_nobody"),
        F.count_if(~held & own).alias("false_positives"), F.count_if(held & ~own).alias("misses"), F.count_if(held & own & (F.col("pred") != F.col("truth"))).alias("wrong_player"))


@query(FULL + LABELLED + JUDGED + """SELECT coalesce(CAST(truth AS VARCHAR), 'nobody') AS truth, CASE WHEN pred = -1 THEN 'nobody' ELSE CAST(pred AS VARCHAR) END AS pred, count(*) AS n FROM judged GROUP BY 1, 2""")
def e19_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy(F.coalesce(F.col("truth").cast("string"), F.lit("nobody")).alias("truth"), F.when(F.col("pred") == -1, "nobody").otherwise(F.col("pred").cast("string")).alias("pred")).agg(F.count("*").alias("n"))


@query(FULL + """
, gt AS (SELECT clip_no, start_frame, try_cast(to_track_id AS INT) AS receiver FROM scene_event_gt WHERE event_type <> 'shot')
SELECT g.clip_no, g.start_frame, g.receiver, min(p.frame_idx) AS first_held, min(p.frame_idx) - g.start_frame AS lag_frames FROM gt g LEFT JOIN possession p ON p.clip_no = g.clip_no AND p.holder = g.receiver AND p.frame_idx >= g.start_frame GROUP BY g.clip_no, g.start_frame, g.receiver""")
def d16_first_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame from the event on that its receiver holds the ball: labels and held frames in one ordered window, no range join."""
    gt = scene.event_labels(spark, sf_dir).where("event_type <> 'shot'").select("clip_no", F.col("start_frame").alias("frame_idx"), F.col("to_track_id").try_cast("int").alias("receiver"), F.lit(True).alias("asked"))
    held = possessed(spark, sf_dir).where("holder <> -1").select("clip_no", "frame_idx", F.col("holder").alias("receiver"), F.lit(False).alias("asked"))
    ahead = Window.partitionBy("clip_no", "receiver").orderBy("frame_idx", "asked").rowsBetween(0, Window.unboundedFollowing)
    at = Window.partitionBy("clip_no", "receiver", "frame_idx")
    own = F.when(~F.col("asked"), F.col("frame_idx"))
    rows = gt.unionByName(held).select("*", F.coalesce(F.max(own).over(at), F.min(own).over(ahead)).alias("first_held")).where("asked")
    return rows.select("clip_no", F.col("frame_idx").alias("start_frame"), "receiver", F.when(F.col("receiver").isNotNull(), F.col("first_held")).alias("first_held")).withColumn("lag_frames", F.col("first_held") - F.col("start_frame"))


@query(LABELLED + """
, named AS (SELECT l.clip_no, l.frame_idx, CAST(l.holder AS INT) AS player FROM lab l WHERE l.holder NOT IN ('nobody', 'unclear'))
SELECT n.clip_no, count(*) AS n_named, count(t.player_id) AS covered, round(100.0::DOUBLE * count(t.player_id) / count(*), 6) AS coverage_pct FROM named n LEFT JOIN (SELECT * FROM scene_team_raw WHERE crop_ok) t ON t.clip_no = n.clip_no AND t.frame_idx = n.frame_idx AND t.player_id = n.player GROUP BY n.clip_no""")
def d07_label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named frames whose player has a usable team row."""
    named = labels(spark, sf_dir).where("label not in ('nobody', 'unclear')").select("clip_no", "frame_idx", F.col("label").cast("int").alias("player_id"))
    teamed = scene.team_raw(spark, sf_dir).where("crop_ok").select("clip_no", "frame_idx", "player_id", F.lit(1).alias("ok"))
    rows = named.join(teamed, ["clip_no", "frame_idx", "player_id"], "left")
    return rows.groupBy("clip_no").agg(F.count("*").alias("n_named"), F.count("ok").alias("covered"), F.round(F.lit(100.0) * F.count("ok") / F.count("*"), 6).alias("coverage_pct"))


@query(FULL + TEAMS + LABELLED + JUDGED + """
, sided AS (SELECT *, last_value(CASE WHEN truth IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER p AS fa, last_value(truth IGNORE NULLS) OVER p AS ta,
    first_value(CASE WHEN truth IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER q AS fb, first_value(truth IGNORE NULLS) OVER q AS tb FROM judged
  WINDOW p AS (PARTITION BY clip_no ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY clip_no ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ghost AS (SELECT clip_no, frame_idx, pred, CASE WHEN fb IS NULL OR frame_idx - fa <= fb - frame_idx THEN fa ELSE fb END AS near_frame, CASE WHEN fb IS NULL OR frame_idx - fa <= fb - frame_idx THEN ta ELSE tb END AS near_holder
  FROM sided WHERE truth IS NULL AND pred <> -1),
sides AS (SELECT g.clip_no, coalesce(a.team, 0) AS own, coalesce(b.team, 0) AS other FROM ghost g LEFT JOIN team a ON a.clip_no = g.clip_no AND a.frame_idx = g.frame_idx AND a.track_id = g.pred
  LEFT JOIN team b ON b.clip_no = g.clip_no AND b.frame_idx = g.near_frame AND b.track_id = g.near_holder)
SELECT clip_no, count(*) AS phantoms, count(*) FILTER (own <> 0 AND own = other) AS same_team, count(*) FILTER (own <> 0 AND other <> 0 AND own <> other) AS other_team, count(*) FILTER (own = 0 OR other = 0) AS undetermined FROM sides GROUP BY clip_no""")
def e20_phantom_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holders found where the label says nobody: their team against the team of the nearest labelled holder (the earlier on a tie)."""
    order = Window.partitionBy("clip_no").orderBy("frame_idx")
    seen = F.when(F.col("truth").isNotNull(), F.struct("frame_idx", "truth"))
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    sided = judged(spark, sf_dir).select("*", F.last(seen, ignorenulls=True).over(back).alias("a"), F.first(seen, ignorenulls=True).over(ahead).alias("b"))
    near = F.when(F.col("b").isNull() | (F.col("frame_idx") - F.col("a.frame_idx") <= F.col("b.frame_idx") - F.col("frame_idx")), F.col("a")).otherwise(F.col("b"))
    ghost = sided.where("truth is null and pred <> -1").select("clip_no", "frame_idx", "pred", near.alias("near")).select("*", F.col("near.frame_idx").alias("near_frame"), F.col("near.truth").alias("near_holder"))
    team = assigned(spark, sf_dir)
    own = team.select("clip_no", "frame_idx", F.col("track_id").alias("pred"), F.col("team").alias("own"))
    other = team.select("clip_no", F.col("frame_idx").alias("near_frame"), F.col("track_id").alias("near_holder"), F.col("team").alias("other"))
    rows = ghost.join(own, ["clip_no", "frame_idx", "pred"], "left").join(other, ["clip_no", "near_frame", "near_holder"], "left").na.fill(0, ["own", "other"])
    both = (F.col("own") != 0) & (F.col("other") != 0)
    return rows.groupBy("clip_no").agg(F.count("*").alias("phantoms"), F.count_if(both & (F.col("own") == F.col("other"))).alias("same_team"), F.count_if(both & (F.col("own") != F.col("other"))).alias("other_team"), F.count_if(~both).alias("undetermined"))


# --- a grid of configurations: D23, E09, E33, G02, D10, D11 ----------------------------------------------------------------
GRID = FILL + HOLDER.format(ball="filled") + """
, cfg AS (SELECT CAST(unnest([2, 3, 5, 8, 12]) AS INT) AS hold)""" + LABELLED + """
, marked AS (SELECT *, CASE WHEN candidate = lag(candidate) OVER (PARTITION BY clip_no ORDER BY frame_idx) THEN 0 ELSE 1 END AS new_run FROM candidate),
run AS (SELECT *, sum(new_run) OVER (PARTITION BY clip_no ORDER BY frame_idx) AS run FROM marked),
place AS (SELECT *, row_number() OVER w AS k, max(CASE WHEN confidence > 0 THEN 1 ELSE 0 END) OVER w AS anchored, min(frame_idx) OVER (PARTITION BY clip_no, run) AS begin_frame FROM run WINDOW w AS (PARTITION BY clip_no, run ORDER BY frame_idx)),
sure AS (SELECT p.*, hold, min(CASE WHEN candidate <> -1 AND k >= hold AND anchored = 1 THEN frame_idx END) OVER (PARTITION BY clip_no, run, hold) AS cf FROM place p, cfg),
held AS (SELECT clip_no, hold, frame_idx, candidate AS holder FROM sure WHERE frame_idx > cf
  UNION ALL SELECT f.clip_no, s.hold, f.frame_idx, s.candidate FROM sure s JOIN scene_frames f ON f.clip_no = s.clip_no AND f.frame_idx BETWEEN s.begin_frame AND s.cf WHERE s.frame_idx = s.cf),
score AS (SELECT l.clip_no, c.hold, count(*) AS n, count(*) FILTER (coalesce(h.holder, -1) = coalesce(try_cast(l.holder AS INT), -1)) AS n_right
  FROM lab l CROSS JOIN cfg c LEFT JOIN held h ON h.clip_no = l.clip_no AND h.frame_idx = l.frame_idx AND h.hold = c.hold WHERE l.holder <> 'unclear' GROUP BY l.clip_no, c.hold)"""
HOLDS = (2, 3, 5, 8, 12)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right frames by clip and hold: one line of the lattice, so the scene is read once and runs are found once."""
    frames = scene.frames(spark, sf_dir)
    truth = labels(spark, sf_dir).where("label <> 'unclear'").select("clip_no", "frame_idx", oracle_holder(F.col("label")).alias("truth"))
    ball = possession.fill(frames, scene.ball(spark, sf_dir))
    return lattice.lattice(frames, ball, scene.players(spark, sf_dir), truth, HOLDS, (possession.REACH,), (possession.OVERLAP,)).select("clip_no", "hold", "n", "n_right")


@query(GRID + "SELECT clip_no, hold, n, n_right FROM score")
def d23_hold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir)


@query(GRID + "SELECT hold, CAST(sum(n_right) AS BIGINT) AS n_right, round(avg(n_right / CAST(n AS DOUBLE)), 6) AS mean_accuracy, round(CAST(sum(n_right) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS pooled FROM score GROUP BY hold")
def e09_sweep_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).groupBy("hold").agg(F.sum("n_right").alias("n_right"), F.round(F.avg(F.col("n_right") / F.col("n")), 6).alias("mean_accuracy"), F.round(F.sum("n_right") / F.sum("n"), 6).alias("pooled"))


@query(GRID + "SELECT clip_no, hold, n_right FROM (SELECT *, row_number() OVER (PARTITION BY clip_no ORDER BY n_right DESC, hold) AS k FROM score) WHERE k = 1")
def e33_best_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best configuration of each clip, the first on a tie: a grouped minimum."""
    best = grid(spark, sf_dir).groupBy("clip_no").agg(F.min(F.struct((-F.col("n_right")).alias("n"), "hold")).alias("b"))
    return best.select("clip_no", "b.hold", (-F.col("b.n")).alias("n_right"))


@query(GRID + """SELECT clip_no, hold, n, n_right, CAST(place AS INT) AS place, place <= 10 AS top_10
  FROM (SELECT *, row_number() OVER (ORDER BY n_right / CAST(n AS DOUBLE) DESC, clip_no, hold) AS place FROM score) WHERE place <= 15""")
def g02_top_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen best rows of the grid and which of them are the ten best: each task keeps its own best, the rest is never sorted."""
    best = grid(spark, sf_dir).orderBy((-F.col("n_right") / F.col("n")), "clip_no", "hold").limit(15)
    # fifteen rows, whatever the grid
    place = F.row_number().over(Window.orderBy((-F.col("n_right") / F.col("n")), "clip_no", "hold"))
    return best.withColumn("place", place).select("clip_no", "hold", "n", "n_right", "place", (F.col("place") <= 10).alias("top_10"))


@query(GRID + """, pooled AS (SELECT hold, row_number() OVER (ORDER BY sum(n_right) / CAST(sum(n) AS DOUBLE) DESC, hold) AS k FROM score GROUP BY hold)
SELECT clip_no, hold, n, n_right FROM score WHERE hold IN (SELECT hold FROM pooled WHERE k = 1)""")
def d10_rows_of_the_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the configuration that is best over all clips: a left semi join with it."""
    rows = grid(spark, sf_dir)
    best = rows.groupBy("hold").agg((F.sum("n_right") / F.sum("n")).alias("rate")).orderBy(F.desc("rate"), "hold").limit(1)
    return rows.join(F.broadcast(best), "hold", "left_semi").select("clip_no", "hold", "n", "n_right")


@query(GRID + "SELECT a.clip_no, a.n_right AS n_right_short, b.n_right AS n_right_long, b.n_right - a.n_right AS gained FROM score a JOIN score b ON b.clip_no = a.clip_no WHERE a.hold = 2 AND b.hold = 8")
def d11_two_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configurations of the grid side by side: one pass over it, pivoted by clip."""
    own = lambda h: F.max(F.when(F.col("hold") == h, F.col("n_right")))
    both = grid(spark, sf_dir).where("hold in (2, 8)").groupBy("clip_no").agg(own(2).alias("n_right_short"), own(8).alias("n_right_long"))
    return both.withColumn("gained", F.col("n_right_long") - F.col("n_right_short"))


# --- arms: D08, D11-D13, E06, E08, H05 ---------------------------------------------------------------------------------
ARMS = f"""
, a AS (SELECT clip_no, frame_idx, player_id, {OWN} AS team, confidence FROM scene_team_raw WHERE (frame_idx + player_id) % 19 <> 0),
b AS (SELECT clip_no, frame_idx, player_id, CAST(CASE WHEN confidence < 0.7::DOUBLE THEN 3 - predicted_team ELSE predicted_team END AS INT) AS team, confidence + ((frame_idx % 3) - 1) / 1000000.0::DOUBLE AS confidence FROM scene_team_raw WHERE (frame_idx + player_id) % 23 <> 0)"""


def arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = scene.team_raw(spark, sf_dir)
    own = teams.abstain(F.col("predicted_team"), F.col("confidence"), F.col("crop_ok")).cast("int")
    a = raw.where("(frame_idx + player_id) % 19 <> 0").select("clip_no", "frame_idx", "player_id", own.alias("team"), "confidence")
    other = F.when(F.col("confidence") < 0.7, 3 - F.col("predicted_team")).otherwise(F.col("predicted_team"))
    b = raw.where("(frame_idx + player_id) % 23 <> 0").select("clip_no", "frame_idx", "player_id", other.alias("team"), (F.col("confidence") + (F.col("frame_idx") % 3 - 1) / F.lit(1000000.0)).alias("confidence"))
    return a, b


KEY = ["clip_no", "frame_idx", "player_id"]


@query(ARMS + "SELECT clip_no, count(*) AS n_both, round(max(abs(a.confidence - b.confidence)), 9) AS largest_difference, count(*) FILTER (a.team <> b.team) AS disagreements FROM a JOIN b USING (clip_no, frame_idx, player_id) GROUP BY clip_no")
def d12_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms row by row: common rows, largest difference, disagreements."""
    a, b = arms(spark, sf_dir)
    both = a.join(b.select(*KEY, F.col("team").alias("other"), F.col("confidence").alias("c")), KEY)
    return both.groupBy("clip_no").agg(F.count("*").alias("n_both"), F.round(F.max(F.abs(F.col("confidence") - F.col("c"))), 9).alias("largest_difference"), F.count_if(F.col("team") != F.col("other")).alias("disagreements"))


@query(ARMS + "SELECT clip_no, frame_idx, player_id FROM a INTERSECT SELECT clip_no, frame_idx, player_id FROM b")
def h05_common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that both arms have."""
    a, b = arms(spark, sf_dir)
    return a.select(*KEY).intersect(b.select(*KEY))


@query(ARMS + """SELECT *, 'only_a' AS side FROM (SELECT clip_no, frame_idx, player_id FROM a EXCEPT SELECT clip_no, frame_idx, player_id FROM b)
  UNION ALL SELECT *, 'only_b' FROM (SELECT clip_no, frame_idx, player_id FROM b EXCEPT SELECT clip_no, frame_idx, player_id FROM a)""")
def d13_key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that only one arm has, by one full join."""
    a, b = arms(spark, sf_dir)
    both = a.select(*KEY, F.lit(1).alias("a")).join(b.select(*KEY, F.lit(1).alias("b")), KEY, "full")
    return both.where("a is null or b is null").select(*KEY, F.when(F.col("b").isNull(), "only_a").otherwise("only_b").alias("side"))


@query(ARMS + """
, r AS (SELECT clip_no, count(*) AS n, count(*) FILTER (a.team <> 0) AS decided, count(*) FILTER (a.team <> 0 AND a.team = CASE WHEN player_id <= 5 THEN 1 ELSE 2 END) AS direct FROM a GROUP BY clip_no)
SELECT clip_no, round(greatest(direct, decided - direct) / CAST(n AS DOUBLE), 6) AS effective_accuracy, round(100.0::DOUBLE * (n - decided) / n, 6) AS abstain_pct, direct >= decided - direct AS keeps_names FROM r""")
def e06_e08_effective_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstentions count as wrong; each clip under its better naming."""
    a, _ = arms(spark, sf_dir)
    right = (F.col("team") != 0) & (F.col("team") == truth())
    r = a.groupBy("clip_no").agg(F.count("*").alias("n"), F.count_if(F.col("team") != 0).alias("decided"), F.count_if(right).alias("direct"))
    other = F.col("decided") - F.col("direct")
    return r.select("clip_no", F.round(F.greatest(F.col("direct"), other) / F.col("n"), 6).alias("effective_accuracy"), F.round(F.lit(100.0) * (F.col("n") - F.col("decided")) / F.col("n"), 6).alias("abstain_pct"), (F.col("direct") >= other).alias("keeps_names"))


# --- filters, samples, order: C01, C09, C12, C14, G03, G06, G08, H08 ---------------------------------------------------
@query("""
, named AS (SELECT clip_no, frame_idx, track_id, CASE track_id % 3 WHEN 0 THEN 'Ball' WHEN 1 THEN 'player' ELSE 'referee' END AS cls, ((eid * 13 + track_id * 7) % 100) / 100.0::DOUBLE AS conf FROM scene_players)
SELECT clip_no, frame_idx, track_id, cls, conf FROM named WHERE (lower(cls) = 'player' AND conf >= 0.5::DOUBLE) OR (lower(cls) = 'ball' AND conf >= 0.3::DOUBLE)""")
def c01_class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a class, by name whatever its case, over the class's threshold."""
    t = F.col("track_id") % 3
    named = scene.players(spark, sf_dir).select("clip_no", "frame_idx", "track_id", F.when(t == 0, "Ball").when(t == 1, "player").otherwise("referee").alias("cls"), (((F.col("eid") * 13 + F.col("track_id") * 7) % 100) / F.lit(100.0)).alias("conf"))
    least = F.create_map(F.lit("player"), F.lit(0.5), F.lit("ball"), F.lit(0.3))
    return named.where(F.col("conf") >= least[F.lower("cls")])


@query("""
, one AS (SELECT clip_no, frame_idx, track_id, ((eid * 13 + track_id * 7) % 100) / 100.0::DOUBLE AS conf, det_order FROM scene_players)
SELECT clip_no, frame_idx, track_id, conf FROM (SELECT *, row_number() OVER (PARTITION BY clip_no, frame_idx ORDER BY conf DESC, det_order) AS k FROM one) WHERE k = 1""")
def e01_top_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident detection of each frame, the first listed on a tie: a grouped minimum, pre-aggregated."""
    rows = scene.players(spark, sf_dir).select("clip_no", "frame_idx", "track_id", "det_order", (((F.col("eid") * 13 + F.col("track_id") * 7) % 100) / F.lit(100.0)).alias("conf"))
    best = rows.groupBy("clip_no", "frame_idx").agg(F.min(F.struct((-F.col("conf")).alias("c"), "det_order", "track_id")).alias("b"))
    return best.select("clip_no", "frame_idx", "b.track_id", (-F.col("b.c")).alias("conf"))


@query("""
, n AS (SELECT clip_no, frame_idx, count(*) FILTER (confidence >= 0.5) AS c FROM scene_keypoints GROUP BY clip_no, frame_idx)
SELECT clip_no, frame_idx FROM n WHERE c >= 1 AND frame_idx % 5 = 0""")
def c12_c14_eligible_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth frame with a landmark to look at."""
    seen = scene.keypoints(spark, sf_dir).where("confidence >= 0.5").select("clip_no", "frame_idx")
    return scene.frames(spark, sf_dir).where("frame_idx % 5 = 0").select("clip_no", "frame_idx").join(seen, ["clip_no", "frame_idx"], "left_semi")


@query("""
, click AS (SELECT clip_no, frame_idx, 60.0::DOUBLE + u * 7 AS px, 100.0::DOUBLE + u * 3 AS py FROM scene_frames WHERE frame_idx % 10 = 0),
inside AS (SELECT c.clip_no, c.frame_idx, p.track_id, (x2 - x1) * (y2 - y1) + p.track_id AS area FROM click c JOIN scene_players p USING (clip_no, frame_idx) WHERE px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2)
SELECT clip_no, frame_idx, track_id FROM (SELECT *, row_number() OVER (PARTITION BY clip_no, frame_idx ORDER BY area, track_id) AS k FROM inside) WHERE k = 1""")
def g08_clicked_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest box that holds a point."""
    click = scene.frames(spark, sf_dir).where("frame_idx % 10 = 0").selectExpr("clip_no", "frame_idx", "60.0D + u * 7 as px", "100.0D + u * 3 as py")
    inside = click.join(scene.players(spark, sf_dir), ["clip_no", "frame_idx"]).where("px between x1 and x2 and py between y1 and y2")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) + F.col("track_id")
    return inside.groupBy("clip_no", "frame_idx").agg(F.min(F.struct(area.alias("a"), "track_id")).alias("b")).select("clip_no", "frame_idx", "b.track_id")


@query("SELECT source, count(DISTINCT lang) AS n_langs, count(*) AS n FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1", scene=False)
def h08_groups_in_two_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that stand in more than one split."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy("source").agg(F.countDistinct("lang").alias("n_langs"), F.count("*").alias("n")).where("n_langs > 1")


@query("""SELECT clip_no, round(sum(b.team) / CAST(count(*) AS DOUBLE), 6) AS mean_team, printf('%.3f', avg(b.confidence)) AS cell, replace(replace(lower('B(100, 1000)'), '(', '_'), ', ', '_') AS slug FROM
  (SELECT clip_no, CAST(predicted_team AS DOUBLE) AS team, confidence FROM scene_team_raw) b GROUP BY clip_no""")
def b39_report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as cells of a report."""
    rows = scene.team_raw(spark, sf_dir).groupBy("clip_no").agg(F.round(F.avg("predicted_team"), 6).alias("mean_team"), F.format_string("%.3f", F.avg("confidence")).alias("cell"))
    return rows.withColumn("slug", F.replace(F.replace(F.lower(F.lit("B(100, 1000)")), F.lit("("), F.lit("_")), F.lit(", "), F.lit("_")))


@query("""
, e AS (SELECT clip_no AS run, frame_idx AS epoch, ((eid * 37) % 1000) / 1000.0::DOUBLE AS score FROM scene_frames)
SELECT run, epoch, score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, epoch) AS k FROM e) WHERE k = 1""")
def k14_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best epoch of each run, the first on a tie."""
    rows = scene.frames(spark, sf_dir).select(F.col("clip_no").alias("run"), F.col("frame_idx").alias("epoch"), (((F.col("eid") * 37) % 1000) / F.lit(1000.0)).alias("score"))
    return rows.groupBy("run").agg(F.min(F.struct((-F.col("score")).alias("s"), "epoch")).alias("b")).select("run", "b.epoch", (-F.col("b.s")).alias("score"))


@query(FULL + """
, m AS (SELECT clip_no, 'held' AS metric, CAST(count(*) FILTER (holder <> -1) AS DOUBLE) AS value FROM possession GROUP BY clip_no UNION ALL SELECT clip_no, 'frames', CAST(count(*) AS DOUBLE) FROM possession GROUP BY clip_no),
x AS (SELECT clip_no, metric, CASE WHEN metric = 'frames' THEN 500.0::DOUBLE ELSE 100.0::DOUBLE END AS expected FROM m)
SELECT m.clip_no, m.metric, value, expected, CASE WHEN abs(value - expected) <= 1e-4 THEN 'PASS' ELSE 'MISMATCH' END AS verdict FROM m JOIN x USING (clip_no, metric)""")
def d25_expected_against_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured values unpivoted and compared with what was expected."""
    wide = possessed(spark, sf_dir).groupBy("clip_no").agg(F.count_if(F.col("holder") != -1).cast("double").alias("held"), F.count("*").cast("double").alias("frames"))
    long = wide.unpivot("clip_no", ["held", "frames"], "metric", "value")
    expected = F.when(F.col("metric") == "frames", 500.0).otherwise(100.0)
    return long.select("*", expected.alias("expected")).withColumn("verdict", F.when(F.abs(F.col("value") - F.col("expected")) <= 1e-4, "PASS").otherwise("MISMATCH"))


@query("""
, sized AS (SELECT clip_no, CASE WHEN track_id % 3 = 0 THEN '1280x720' WHEN track_id % 3 = 1 THEN '640x360' ELSE '1920x1080' END AS size FROM scene_players)
SELECT size, count(*) AS n, count(DISTINCT clip_no) AS clips, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM sized GROUP BY size""")
def e27_resolution_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition by image size; the shares come from one total over the handful of sizes."""
    t = F.col("track_id") % 3
    n = scene.players(spark, sf_dir).groupBy(F.when(t == 0, "1280x720").when(t == 1, "640x360").otherwise("1920x1080").alias("size")).agg(F.count("*").alias("n"), F.countDistinct("clip_no").alias("clips"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("size", "n", "clips", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("""SELECT clip_no, frame_idx, count(*) FILTER (x1 < 300 AND x2 > 0 AND y1 < 160 AND y2 > 0 AND x2 > x1 AND y2 > y1) AS covered FROM scene_players GROUP BY clip_no, frame_idx""")
def b13_b14_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes under the overlay in the corner: half-open rectangles, none for degenerate ones."""
    hit = (F.col("x1") < 300) & (F.col("x2") > 0) & (F.col("y1") < 160) & (F.col("y2") > 0) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    return scene.players(spark, sf_dir).groupBy("clip_no", "frame_idx").agg(F.count_if(hit).alias("covered"))


@query(FULL + """
, team AS MATERIALIZED (SELECT clip_no, frame_idx, player_id AS track_id, CAST(CASE WHEN NOT crop_ok OR confidence < 0.6::DOUBLE THEN 0 ELSE predicted_team END AS INT) AS team FROM scene_team_raw)
SELECT p.clip_no, p.frame_idx, CASE WHEN holder = -1 THEN 'nobody' WHEN coalesce(team, 0) = 0 THEN 'player ' || CAST(holder AS VARCHAR) ELSE 'player ' || CAST(holder AS VARCHAR) || ' (team ' || CAST(team AS VARCHAR) || ')' END AS caption
FROM possession p LEFT JOIN team t ON t.clip_no = p.clip_no AND t.frame_idx = p.frame_idx AND t.track_id = p.holder""")
def b35_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The possession line of every frame."""
    t = assigned(spark, sf_dir).withColumnRenamed("track_id", "holder")
    name = F.concat(F.lit("player "), F.col("holder").cast("string"))
    text = F.when(F.col("holder") == -1, "nobody").when(F.coalesce("team", F.lit(0)) == 0, name).otherwise(F.concat(name, F.lit(" (team "), F.col("team").cast("string"), F.lit(")")))
    return possessed(spark, sf_dir).join(t, ["clip_no", "frame_idx", "holder"], "left").select("clip_no", "frame_idx", text.alias("caption"))

