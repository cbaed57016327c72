"""Queries: possession under all settings, and settings and thresholds chosen on the other clips: D23, E34, G02."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.operators import lattice, possession, ranks
from frameflow.plans.game import FILL, HOLDER
from frameflow.plans.people import truth
from frameflow.plans.registry import query
from frameflow.plans.scores import LABELLED, labels, oracle_holder
from frameflow.sources import scene

LATTICE = FILL + HOLDER.format(ball="filled") + LABELLED + f"""
, best AS (SELECT clip_no, frame_idx, confidence, min({{'s': -inside, 'o': det_order, 't': track_id}}) FILTER (track_id IS NOT NULL) AS a, min({{'s': far, 'o': det_order, 't': track_id}}) FILTER (track_id IS NOT NULL) AS b FROM pair GROUP BY clip_no, frame_idx, confidence),
limits AS (SELECT o.v AS overlap, r.v AS reach FROM (SELECT CAST(unnest({list(lattice.OVERLAPS)}) AS DOUBLE) AS v) o, (SELECT CAST(unnest({list(lattice.REACHES)}) AS DOUBLE) AS v) r),
picked AS (SELECT clip_no, frame_idx, confidence, overlap, reach, CASE WHEN -a.s > overlap THEN a.t WHEN b.s < reach THEN b.t ELSE -1 END AS c FROM best, limits),
stepped AS (SELECT *, CASE WHEN c = lag(c) OVER (PARTITION BY clip_no, overlap, reach ORDER BY frame_idx) THEN 0 ELSE 1 END AS new_run FROM picked),
numbered AS (SELECT *, sum(new_run) OVER (PARTITION BY clip_no, overlap, reach ORDER BY frame_idx) AS run FROM stepped),
laid AS (SELECT *, row_number() OVER (PARTITION BY clip_no, overlap, reach, run ORDER BY frame_idx) AS k FROM numbered),
sized AS (SELECT *, min(CASE WHEN confidence > 0 THEN k END) OVER (PARTITION BY clip_no, overlap, reach, run) AS anchor, count(*) OVER (PARTITION BY clip_no, overlap, reach, run) AS size FROM laid),
verdict AS (SELECT s.clip_no, hold, reach, overlap, coalesce(try_cast(l.holder AS INT), -1) AS truth, s.confidence > 0 AS genuine, CASE WHEN c <> -1 AND size >= greatest(hold, anchor) AND anchor IS NOT NULL THEN c ELSE -1 END AS pred
  FROM sized s JOIN lab l ON l.clip_no = s.clip_no AND l.frame_idx = s.frame_idx, (SELECT CAST(unnest({list(lattice.HOLDS)}) AS INT) AS hold) WHERE l.holder <> 'unclear'),
scored AS (SELECT clip_no, hold, reach, overlap, count(*) AS n, avg(CASE WHEN pred = truth THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, avg(CASE WHEN truth <> -1 THEN CASE WHEN pred = truth THEN 1.0::DOUBLE ELSE 0 END END) AS recall_held,
  avg(CASE WHEN truth = -1 THEN CASE WHEN pred = -1 THEN 1.0::DOUBLE ELSE 0 END END) AS spec_nobody, avg(CASE WHEN truth = -1 THEN CASE WHEN pred <> -1 THEN 1.0::DOUBLE ELSE 0 END END) AS false_pos,
  avg(CASE WHEN genuine THEN CASE WHEN pred = truth THEN 1.0::DOUBLE ELSE 0 END END) AS accuracy_real, avg(CASE WHEN NOT genuine THEN CASE WHEN pred = truth THEN 1.0::DOUBLE ELSE 0 END END) AS accuracy_filled FROM verdict GROUP BY clip_no, hold, reach, overlap)"""
CHOICE = """
, sums AS (SELECT {keys}, sum({score}) AS s, count({score}) AS k FROM {rows} GROUP BY {keys}),
trained AS (SELECT r.*, round((s - {score}) / (k - 1), 9) AS train FROM {rows} r JOIN sums USING ({keys}) WHERE k > 1),
chosen AS (SELECT *, row_number() OVER (PARTITION BY {fold} ORDER BY train DESC, {keys}) AS place FROM trained)
SELECT {fold}, {keys}, round(train, 6) AS train_score, round({score}, 6) AS test_score FROM chosen WHERE place = 1"""


def swept(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    frames = scene.frames(spark, sf_dir)
    known = labels(spark, sf_dir).where("label <> 'unclear'").select("clip_no", "frame_idx", oracle_holder(F.col("label")).alias("truth"))
    return lattice.lattice(frames, possession.fill(frames, scene.ball(spark, sf_dir)), scene.players(spark, sf_dir), known, **settings)


@query(LATTICE + """SELECT clip_no, hold, reach, overlap, n, round(accuracy, 6) AS accuracy, round(recall_held, 6) AS recall_held, round(spec_nobody, 6) AS spec_nobody, round(false_pos, 6) AS false_pos,
  round(accuracy_real, 6) AS accuracy_real, round(accuracy_filled, 6) AS accuracy_filled FROM scored""")
def d23_possession_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracies of all 240 settings of hold, reach and overlap on every clip."""
    return lattice.rates(swept(spark, sf_dir))


@query(LATTICE + CHOICE.format(keys="hold, reach, overlap", score="accuracy", rows="scored", fold="clip_no"))
def d23_settings_by_other_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each clip the settings that are best on all others, and how they do on it."""
    rows = swept(spark, sf_dir).withColumn("accuracy", F.col("n_right") / F.col("n"))
    return lattice.leave_one_out(rows, "clip_no", ["hold", "reach", "overlap"], "accuracy")


@query(LATTICE + """, pooled AS (SELECT hold, reach, overlap, avg(accuracy) AS accuracy, avg(recall_held) AS recall_held, avg(false_pos) AS false_pos FROM scored GROUP BY hold, reach, overlap)
SELECT hold, reach, overlap, round(accuracy, 6) AS accuracy, round(recall_held, 6) AS recall_held, round(false_pos, 6) AS false_pos FROM pooled QUALIFY row_number() OVER (ORDER BY round(accuracy, 9) DESC, hold, reach, overlap) <= 10""")
def g02_top_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten settings with the best mean accuracy over clips."""
    empty = F.col("n") - F.col("n_held")
    mean = lambda a, b: F.avg(F.try_divide(a.cast("double"), b))
    pooled = swept(spark, sf_dir).groupBy("hold", "reach", "overlap").agg(
        mean(F.col("n_right"), F.col("n")).alias("accuracy"), mean(F.col("right_held"), F.col("n_held")).alias("recall_held"), mean(empty - F.col("right_empty"), empty).alias("false_pos"))
    best = pooled.orderBy(-F.round("accuracy", 9), "hold", "reach", "overlap").limit(10)
    return best.select("hold", "reach", "overlap", *[F.round(c, 6).alias(c) for c in ("accuracy", "recall_held", "false_pos")])


@query("""
, every AS (SELECT clip_no, player_id, predicted_team AS team, crop_ok, confidence + (frame_idx % 7) / 1000.0::DOUBLE AS confidence, CASE WHEN player_id <= 5 THEN 1 ELSE 2 END AS t FROM scene_team_raw),
fold AS (SELECT DISTINCT clip_no AS f FROM every),
q AS (SELECT f, quantile_cont(confidence, 0.001) AS lo, quantile_cont(confidence, 0.999) AS hi FROM every JOIN fold ON clip_no <> f GROUP BY f),
t AS (SELECT f, k, round(lo + (hi - lo) * k / 24, 4) AS threshold FROM q, (SELECT unnest(range(0, 25)) AS k)),
per AS (SELECT f, k, threshold, clip_no, count(*) AS n, count(*) FILTER (crop_ok AND confidence >= threshold) AS decided, count(*) FILTER (crop_ok AND confidence >= threshold AND team = t.t) AS direct FROM (SELECT * FROM every) t, t AS x GROUP BY f, k, threshold, clip_no),
best AS (SELECT f, k, threshold, sum(greatest(direct, decided - direct)) FILTER (clip_no <> f) AS tr, sum(n) FILTER (clip_no <> f) AS tn, sum(decided) FILTER (clip_no <> f) AS td, sum(greatest(direct, decided - direct)) FILTER (clip_no = f) AS er, sum(n) FILTER (clip_no = f) AS en, sum(decided) FILTER (clip_no = f) AS ed FROM per GROUP BY f, k, threshold)
SELECT f AS clip_no, threshold, round(tr / CAST(tn AS DOUBLE), 6) AS train_effective, round(er / CAST(en AS DOUBLE), 6) AS test_effective, round(er / CAST(nullif(ed, 0) AS DOUBLE), 6) AS test_accuracy, CAST(ed AS BIGINT) AS n_decided, round(100.0 * (en - ed) / CAST(en AS DOUBLE), 6) AS abstain_pct
FROM best WHERE td > 0 QUALIFY row_number() OVER (PARTITION BY f ORDER BY tr DESC, k) = 1""")
def e34_threshold_by_other_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each clip the threshold that is best on all others, out of 25 between the outer quantiles of the others' own confidences, and how it does on the clip.

    Ranks come from one sort of all values (ranks.left_out_quantiles). Each clip's counts at a threshold are needed for the thresholds of every other clip; these are few distinct
    numbers (four digits between two quantiles that hardly move), so clips meet the distinct thresholds, totals follow from one grouping, and a fold's training count is the total less its own."""
    raw = scene.team_raw(spark, sf_dir).select("clip_no", "player_id", "predicted_team", "crop_ok", (F.col("confidence") + F.col("frame_idx") % 7 / F.lit(1000.0)).alias("confidence"), truth().alias("t"))
    q = ranks.left_out_quantiles(raw, "clip_no", "confidence", {"lo": 0.001, "hi": 0.999})
    steps = q.where("lo is not null").select("clip_no", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * k / 24, 4))).alias("k", "threshold"))
    some = steps.select("threshold").distinct().agg(F.array_sort(F.collect_set("threshold")).alias("levels"))
    # a row decides at all thresholds up to its confidence: counted once, at the number of those, and summed from above
    at = F.when(F.col("crop_ok"), F.size(F.filter("levels", lambda v: v <= F.col("confidence")))).otherwise(F.lit(0))
    counted = raw.groupBy("clip_no", "crop_ok", "confidence", (F.col("predicted_team") == F.col("t")).alias("right")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(some))
    held = counted.groupBy("clip_no", at.alias("at")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("right"))
    size = held.groupBy("clip_no").agg(F.sum("n").alias("n"), F.collect_list(F.struct("at", "n", "right")).alias("held")).crossJoin(F.broadcast(some))
    above = lambda v, c: F.aggregate(F.filter("held", lambda h: h["at"] >= v), F.lit(0).cast("long"), lambda a, h: a + h[c])
    per = size.select("clip_no", "n", F.posexplode("levels").alias("p", "threshold"), "held").select("clip_no", "n", "threshold", above(F.col("p") + 1, "n").alias("decided"), above(F.col("p") + 1, "right").alias("direct"))
    per = per.withColumn("good", F.greatest("direct", F.col("decided") - F.col("direct")))
    total = per.groupBy("threshold").agg(F.sum("good").alias("all_good"), F.sum("n").alias("all_n"), F.sum("decided").alias("all_decided"))
    tried = steps.join(per, ["clip_no", "threshold"]).join(total, "threshold")
    best = tried.where(F.col("all_decided") > F.col("decided")).groupBy("clip_no").agg(F.min(F.struct((F.col("good") - F.col("all_good")).alias("lost"), "k", "threshold", "good", "n", "decided", (F.col("all_n") - F.col("n")).alias("others"))).alias("b"))
    rate = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 6)
    return best.select("clip_no", "b.threshold", rate(-F.col("b.lost"), F.col("b.others")).alias("train_effective"), rate(F.col("b.good"), F.col("b.n")).alias("test_effective"), rate(F.col("b.good"), F.when(F.col("b.decided") > 0, F.col("b.decided"))).alias("test_accuracy"),
                       F.col("b.decided").alias("n_decided"), F.round(F.lit(100.0) * (F.col("b.n") - F.col("b.decided")) / F.col("b.n"), 6).alias("abstain_pct"))
