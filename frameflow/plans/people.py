"""Queries: teams, tracking, labels of people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameflow.functions.boxes import Box, crop, dot, iou, margin, softmax, unit
from frameflow.operators import ranks, teams, tracker, tracking
from frameflow.plans.game import assigned, rounded
from frameflow.plans.registry import query
from frameflow.sources import scene
from frameflow.sources.files import last_wins

WEIGHT = "CASE WHEN crop_ok THEN confidence ELSE 0.0::DOUBLE END"
VOTE = f"""
, voted AS (SELECT *, CAST(CASE WHEN round(sum(CASE WHEN predicted_team = 1 THEN {WEIGHT} ELSE 0 END) OVER w - sum(CASE WHEN predicted_team = 2 THEN {WEIGHT} ELSE 0 END) OVER w, 6) >= 0 THEN 1 ELSE 2 END AS INT) AS voted_team
  FROM scene_team_raw WINDOW w AS (PARTITION BY clip_no, player_id ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))"""
OWN = "CAST(CASE WHEN NOT crop_ok OR confidence < 0.6::DOUBLE THEN 0 ELSE predicted_team END AS INT)"


def truth() -> Column:
    """The true team of a scene's player: the side of its number."""
    return F.when(F.col("player_id") <= 5, 1).otherwise(2)


@query(VOTE + "SELECT clip_no, frame_idx, player_id, predicted_team, voted_team FROM voted")
def f06_window_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teams.vote(scene.team_raw(spark, sf_dir)).select("clip_no", "frame_idx", "player_id", "predicted_team", "voted_team")


@query(f"SELECT clip_no, frame_idx, player_id, {OWN} AS team FROM scene_team_raw")
def b31_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).withColumnRenamed("track_id", "player_id")


@query(f"""SELECT clip_no, frame_idx, player_id, CAST(coalesce(first_value(CASE WHEN {OWN} <> 0 THEN {OWN} END IGNORE NULLS) OVER (PARTITION BY clip_no, player_id, frame_idx // 50 ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), {OWN}) AS INT) AS memo_team FROM scene_team_raw""")
def f07_memoise_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teams.memoised(scene.team_raw(spark, sf_dir)).select("clip_no", "frame_idx", "player_id", F.col("memo_team").cast("int"))


@query("""
, changed AS (SELECT clip_no, player_id, lag(predicted_team) OVER (PARTITION BY clip_no, player_id ORDER BY frame_idx) <> predicted_team AS c FROM scene_team_raw)
SELECT clip_no, player_id, count(*) FILTER (c) AS flips, count(*) AS n_rows FROM changed GROUP BY clip_no, player_id""")
def f08_label_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teams.flips(scene.team_raw(spark, sf_dir))


@query("""
, n AS (SELECT clip_no, player_id, predicted_team, count(*) AS votes, min(frame_idx) AS f FROM scene_team_raw GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY clip_no, player_id ORDER BY votes DESC, f) AS k FROM n)
SELECT clip_no, player_id, predicted_team AS track_team, votes FROM k WHERE k = 1""")
def e23_track_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teams.majority(scene.team_raw(spark, sf_dir))


LABELS = "SELECT clip_no, player_id, frame_idx, CASE WHEN (frame_idx + player_id) % 7 = 0 THEN 'unclear' ELSE CAST(predicted_team AS VARCHAR) END AS true_team FROM scene_team_raw WHERE frame_idx % 25 = 0"


def team_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scene.team_raw(spark, sf_dir).where("frame_idx % 25 = 0")
    return rows.select("clip_no", "player_id", "frame_idx", F.when((F.col("frame_idx") + F.col("player_id")) % 7 == 0, "unclear").otherwise(F.col("predicted_team").cast("string")).alias("true_team"))


MODAL = f"""
, lab AS ({LABELS}), n AS (SELECT clip_no, player_id, true_team, count(*) AS n FROM lab WHERE true_team <> 'unclear' GROUP BY ALL),
top AS (SELECT clip_no, player_id, CASE WHEN count(*) = 1 THEN min(true_team) END AS modal_team FROM (SELECT *, rank() OVER (PARTITION BY clip_no, player_id ORDER BY n DESC) AS r FROM n) WHERE r = 1 GROUP BY clip_no, player_id)"""


@query(MODAL + "SELECT * FROM top")
def e22_modal_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teams.modal(team_labels(spark, sf_dir))


@query(MODAL + "SELECT l.clip_no, l.player_id, l.frame_idx, l.true_team, t.modal_team FROM lab l JOIN top t USING (clip_no, player_id) WHERE l.true_team <> 'unclear' AND t.modal_team IS NOT NULL AND l.true_team <> t.modal_team")
def e22_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = team_labels(spark, sf_dir)
    rows = labels.join(teams.modal(labels), ["clip_no", "player_id"])
    return rows.where("true_team <> 'unclear' and modal_team is not null and true_team <> modal_team").select("clip_no", "player_id", "frame_idx", "true_team", "modal_team")


@query(VOTE + f"""
, scored AS (SELECT clip_no, CASE WHEN NOT crop_ok OR confidence < 0.6::DOUBLE THEN 0 ELSE voted_team END AS team, CASE WHEN player_id <= 5 THEN 1 ELSE 2 END AS t FROM voted),
per AS (SELECT clip_no, count(*) AS n, count(*) FILTER (team <> 0) AS decided, count(*) FILTER (team <> 0 AND team = t) AS direct FROM scored GROUP BY clip_no)
SELECT CAST(sum(greatest(direct, decided - direct)) AS BIGINT) AS n_right, CAST(sum(decided) AS BIGINT) AS decided, CAST(sum(n) AS BIGINT) AS n_all FROM per""")
def e05_renamed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = teams.vote(scene.team_raw(spark, sf_dir))
    return teams.renamed_accuracy(voted.select("clip_no", teams.abstain(F.col("voted_team"), F.col("confidence"), F.col("crop_ok")).alias("team"), truth().alias("true_team")))


@query("""
, level AS (SELECT CAST(unnest(range(0, 25)) AS INT) AS k),
q AS (SELECT quantile_cont(confidence, 0.001) AS a, quantile_cont(confidence, 0.999) AS b FROM scene_team_raw),
t AS (SELECT k, round(a + (b - a) * k / 24, 4) AS threshold FROM q, level),
scored AS (SELECT threshold, clip_no, CASE WHEN NOT crop_ok OR confidence < threshold THEN 0 ELSE predicted_team END AS team, CASE WHEN player_id <= 5 THEN 1 ELSE 2 END AS t FROM scene_team_raw, t),
per AS (SELECT threshold, clip_no, count(*) AS n, count(*) FILTER (team <> 0) AS decided, count(*) FILTER (team <> 0 AND team = t) AS direct FROM scored GROUP BY threshold, clip_no)
SELECT threshold, round(CAST(sum(greatest(direct, decided - direct)) AS DOUBLE) / sum(n), 6) AS effective_accuracy, round(100.0::DOUBLE * sum(n - decided) / sum(n), 6) AS abstain_pct FROM per GROUP BY threshold""")
def e34_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective accuracy and abstention for 25 thresholds between the outer quantiles. The thresholds are 25 rows, broadcast; each row
    meets them before one pre-aggregated shuffle."""
    raw = scene.team_raw(spark, sf_dir)
    q = ranks.quantiles(raw, [], "confidence", {"a": 0.001, "b": 0.999})
    t = q.select(F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k"), "a", "b").select(F.round(F.col("a") + (F.col("b") - F.col("a")) * F.col("k") / 24, 4).alias("threshold"))
    rows = raw.select("clip_no", "crop_ok", "confidence", "predicted_team", truth().alias("t")).groupBy("clip_no", "crop_ok", "confidence", "predicted_team", "t").count()
    met = rows.crossJoin(F.broadcast(t)).withColumn("team", F.when(~F.col("crop_ok") | (F.col("confidence") < F.col("threshold")), 0).otherwise(F.col("predicted_team")))
    n = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0))
    per = met.groupBy("threshold", "clip_no").agg(F.sum("count").alias("n"), n(F.col("team") != 0).alias("decided"), n((F.col("team") != 0) & (F.col("team") == F.col("t"))).alias("direct"))
    right = F.sum(F.greatest("direct", F.col("decided") - F.col("direct")))
    return per.groupBy("threshold").agg(F.round(right.cast("double") / F.sum("n"), 6).alias("effective_accuracy"), F.round(F.lit(100.0) * F.sum(F.col("n") - F.col("decided")) / F.sum("n"), 6).alias("abstain_pct"))


@query(VOTE + f"""
, r AS (SELECT predicted_team = CASE WHEN player_id <= 5 THEN 1 ELSE 2 END AS a, voted_team = CASE WHEN player_id <= 5 THEN 1 ELSE 2 END AS b FROM voted WHERE clip_no = frame_idx % 7),
n AS (SELECT count(*) FILTER (a AND b) AS n_11, count(*) FILTER (a AND NOT b) AS n_10, count(*) FILTER (NOT a AND b) AS n_01, count(*) FILTER (NOT a AND NOT b) AS n_00 FROM r)
SELECT * FROM n""".replace("WHERE clip_no = frame_idx % 7", ""))
def e07_paired_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right and wrong before and after the vote."""
    voted = teams.vote(scene.team_raw(spark, sf_dir)).select((F.col("predicted_team") == truth()).alias("a"), (F.col("voted_team") == truth()).alias("b"))
    return teams.mcnemar(voted, "a", "b").drop("p")


@query("""
, n AS (SELECT clip_no, CAST(predicted_team AS VARCHAR) AS t, count(*) AS n FROM scene_team_raw GROUP BY ALL)
SELECT clip_no, CAST(coalesce(sum(n) FILTER (t = '1'), 0) AS BIGINT) AS team_1, CAST(coalesce(sum(n) FILTER (t = '2'), 0) AS BIGINT) AS team_2 FROM n GROUP BY clip_no""")
def e10_team_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scene.team_raw(spark, sf_dir).groupBy("clip_no").pivot("predicted_team", [1, 2]).agg(F.count(F.lit(1)))
    return out.select("clip_no", F.coalesce(F.col("1"), F.lit(0)).alias("team_1"), F.coalesce(F.col("2"), F.lit(0)).alias("team_2"))


@query("""SELECT predicted_team, round(min(confidence), 6) AS low, round(quantile_cont(confidence, 0.05), 6) AS p05, round(quantile_cont(confidence, 0.25), 6) AS p25, round(quantile_cont(confidence, 0.5), 6) AS median,
  round(quantile_cont(confidence, 0.75), 6) AS p75, round(quantile_cont(confidence, 0.95), 6) AS p95, round(max(confidence), 6) AS high, round(avg(CASE WHEN confidence <= 0.6::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS ecdf_60 FROM scene_team_raw GROUP BY predicted_team""")
def e11_confidence_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two teams hold all rows, so their quantiles come from sorted ranges of counted values, not from a list of each team's."""
    raw = scene.team_raw(spark, sf_dir)
    q = ranks.quantiles(raw, ["predicted_team"], "confidence", {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95})
    rest = raw.groupBy("predicted_team").agg(F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.avg(F.when(F.col("confidence") <= 0.6, 1.0).otherwise(0.0)).alias("ecdf_60"))
    return rounded(q.drop("n").join(rest, "predicted_team")).select("predicted_team", "low", "p05", "p25", "median", "p75", "p95", "high", "ecdf_60")


@query("""SELECT clip_no, count(*) FILTER (team = 0) AS unresolved, count(*) FILTER (NOT crop_ok) AS empty_crops, count(*) FILTER (confidence < 0.55::DOUBLE) AS low_margin, count(*) AS n_rows
  FROM (SELECT *, CASE WHEN NOT crop_ok OR confidence < 0.6::DOUBLE THEN 0 ELSE predicted_team END AS team FROM scene_team_raw) GROUP BY clip_no""")
def e32_team_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = scene.team_raw(spark, sf_dir)
    team = teams.abstain(F.col("predicted_team"), F.col("confidence"), F.col("crop_ok"))
    return raw.groupBy("clip_no").agg(F.count_if(team == 0).alias("unresolved"), F.count_if(~F.col("crop_ok")).alias("empty_crops"), F.count_if(F.col("confidence") < 0.55).alias("low_margin"), F.count("*").alias("n_rows"))


# --- K03, K05, K06: embeddings --------------------------------------------------------------------------------------
CENTRES = """
c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY label, i) GROUP BY label)"""


def two_centres(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    long = rows.select("label", F.posexplode("v").alias("i", "x")).where("label in (0, 1)").groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = long.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select("label", F.transform("s", lambda s: s["m"]).alias("c"))
    return rows, centre.groupBy().agg(F.first(F.when(F.col("label") == 0, F.col("c")), True).alias("c1"), F.first(F.when(F.col("label") == 1, F.col("c")), True).alias("c2"))


DOT = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"


@query("WITH " + CENTRES.strip() + f""", e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM e),
l AS (SELECT vec_id, 20.0::DOUBLE * {DOT("u", "a.c")} AS l1, 20.0::DOUBLE * {DOT("u", "b.c")} AS l2 FROM n, c a, c b WHERE a.label = 0 AND b.label = 1)
SELECT vec_id, CAST(CASE WHEN l1 >= l2 THEN 1 ELSE 2 END AS INT) AS predicted_team, round(greatest(exp(l1), exp(l2)) / (exp(l1) + exp(l2)), 6) AS confidence FROM l""", scene=False)
def k03_zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit embeddings against two reference vectors: scaled dot products, softmax, first class on a tie."""
    rows, centre = two_centres(spark, sf_dir)
    l = rows.crossJoin(F.broadcast(centre)).select("vec_id", F.array(F.lit(20.0) * dot(unit(F.col("v")), F.col("c1")), F.lit(20.0) * dot(unit(F.col("v")), F.col("c2"))).alias("l"))  # noqa: E741
    return l.select("vec_id", F.when(F.col("l")[0] >= F.col("l")[1], 1).otherwise(2).alias("predicted_team"), F.round(F.array_max(softmax(F.col("l"))), 6).alias("confidence"))


FAR = lambda c: f"sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - {c}[i]) * (v[i] - {c}[i]))))"


@query("WITH " + CENTRES.strip() + f""", d AS (SELECT vec_id, {FAR("a.c")} AS d1, {FAR("b.c")} AS d2 FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c a, c b WHERE a.label = 0 AND b.label = 1)
SELECT vec_id, CAST(CASE WHEN d1 <= d2 THEN 1 ELSE 2 END AS INT) AS cluster, round(greatest(d1, d2) / (d1 + d2 + 1e-9), 6) AS margin FROM d""", scene=False)
def k05_nearest_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearer of two given centres and the margin."""
    rows, centre = two_centres(spark, sf_dir)
    far = lambda c: F.sqrt(F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    d = rows.crossJoin(F.broadcast(centre)).select("vec_id", far("c1").alias("d1"), far("c2").alias("d2"))
    return d.select("vec_id", F.when(F.col("d1") <= F.col("d2"), 1).otherwise(2).alias("cluster"), F.round(margin(F.least("d1", "d2"), F.greatest("d1", "d2")), 6).alias("margin"))


@query()
def k06_two_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clusters of unit vectors within each label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rounded(teams.two_means(rows, "label", "vec_id", "embedding"), 6)


# --- D20, D22, K07-K09, J08, C16: tracking --------------------------------------------------------------------------
IOU = """CASE WHEN least(g.x2, p.x2) > greatest(g.x1, p.x1) AND least(g.y2, p.y2) > greatest(g.y1, p.y1) THEN (least(g.x2, p.x2) - greatest(g.x1, p.x1)) * (least(g.y2, p.y2) - greatest(g.y1, p.y1))
  / ((g.x2 - g.x1) * (g.y2 - g.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - (least(g.x2, p.x2) - greatest(g.x1, p.x1)) * (least(g.y2, p.y2) - greatest(g.y1, p.y1))) ELSE 0 END"""


@query(f", boxes AS MATERIALIZED (SELECT * FROM scene_players WHERE frame_idx % 10 = 0), marked AS MATERIALIZED (SELECT * FROM scene_gt), near AS (SELECT g.clip_no, g.frame_idx, g.gt_id, p.track_id, {IOU} AS o FROM marked g JOIN boxes p ON p.clip_no = g.clip_no AND p.frame_idx = g.frame_idx) SELECT clip_no, frame_idx, gt_id, track_id, round(o, 6) AS overlap FROM near WHERE o >= 0.5")
def d22_box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tracking.pairs(scene.ground_truth(spark, sf_dir), scene.players(spark, sf_dir)))


#: Boxes side by side, so that each label overlaps one track only, and tracks of which a third get a new id half-way: what is left of the association is counting.
APART = f"""
, g AS (SELECT clip_no, frame_idx, gt_id, x1 + 3000 * (gt_id - 100) AS x1, y1, x2 + 3000 * (gt_id - 100) AS x2, y2 FROM scene_gt),
p AS (SELECT clip_no, frame_idx, CASE WHEN (track_id + clip_no) % 3 = 0 AND frame_idx >= 250 THEN track_id + 50 ELSE track_id END AS track_id, x1 + 3000 * track_id AS x1, y1, x2 + 3000 * track_id AS x2, y2 FROM scene_players),
near AS MATERIALIZED (SELECT * FROM (SELECT g.clip_no, g.frame_idx, gt_id, track_id, {IOU} AS o FROM g JOIN p ON p.clip_no = g.clip_no AND p.frame_idx = g.frame_idx) WHERE o >= 0.5),
met AS (SELECT *, coalesce(lag(track_id) OVER (PARTITION BY clip_no, gt_id ORDER BY frame_idx) <> track_id, false) AS switched FROM near)"""
MOT = """
, counts AS (SELECT clip_no, count(*) AS objects FROM g GROUP BY clip_no),
hyp AS (SELECT clip_no, count(*) AS hypotheses FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.clip_no = p.clip_no AND g.frame_idx = p.frame_idx) GROUP BY clip_no),
asso AS (SELECT clip_no, count(*) AS matches, sum(o) AS overlap, count(*) FILTER (switched) AS switches FROM met GROUP BY clip_no),
ids AS (SELECT clip_no, sum(n) AS idtp FROM (SELECT clip_no, gt_id, max(n) AS n FROM (SELECT clip_no, gt_id, track_id, count(*) AS n FROM near GROUP BY clip_no, gt_id, track_id) GROUP BY clip_no, gt_id) GROUP BY clip_no),
one AS (SELECT {key} AS clip_no, CAST(sum(objects) AS BIGINT) AS objects, CAST(sum(hypotheses) AS BIGINT) AS hypotheses, CAST(sum(matches) AS BIGINT) AS matches, sum(overlap) AS overlap, CAST(sum(switches) AS BIGINT) AS switches, CAST(sum(idtp) AS BIGINT) AS idtp
  FROM counts JOIN hyp USING (clip_no) JOIN asso USING (clip_no) JOIN ids USING (clip_no) {group})
SELECT clip_no, objects, matches, switches, objects - matches AS misses, hypotheses - matches AS false_positives, round((objects - (objects - matches) - (hypotheses - matches) - switches) / objects, 6) AS mota, round(overlap / matches, 6) AS motp,
  round(2 * idtp / (objects + hypotheses), 6) AS idf1, round(matches / hypotheses, 6) AS precision, round(matches / objects, 6) AS recall FROM one"""


def apart(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g, p = scene.ground_truth(spark, sf_dir), scene.players(spark, sf_dir)
    by, own = 3000 * (F.col("gt_id") - 100), 3000 * F.col("track_id")
    changed = ((F.col("track_id") + F.col("clip_no")) % 3 == 0) & (F.col("frame_idx") >= 250)
    return (g.withColumns({"x1": F.col("x1") + by, "x2": F.col("x2") + by}),
            p.withColumns({"x1": F.col("x1") + own, "x2": F.col("x2") + own, "track_id": F.when(changed, F.col("track_id") + 50).otherwise(F.col("track_id"))}))


@query(APART + MOT.format(key="clip_no", group="GROUP BY clip_no"))
def k07_mot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.metrics(*apart(spark, sf_dir))


@query(APART + MOT.format(key="CAST(NULL AS INT)", group=""))
def k08_mot_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.metrics(*apart(spark, sf_dir), pooled=True)


@query(APART + "SELECT DISTINCT clip_no, frame_idx FROM met WHERE switched")
def k09_switch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.associate(tracking.pairs(*apart(spark, sf_dir))).where("switched").select("clip_no", "frame_idx").distinct()


@query()
def j08_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = scene.players(spark, sf_dir).withColumn("confidence", F.lit(0.35) + (F.col("eid") * 7 + F.col("track_id") * 3) % 60 / F.lit(100.0))
    return tracker.track(boxes.drop("track_id", "eid"))


@query(f"""
, seed AS (SELECT clip_no, frame_idx, track_id, x1 + 25 * (track_id % 3) AS x1, y1, x2 + 25 * (track_id % 3) AS x2, y2 FROM scene_players WHERE frame_idx % 10 = 0)
SELECT p.clip_no, p.frame_idx, p.track_id FROM seed p WHERE NOT EXISTS (SELECT 1 FROM scene_gt g WHERE g.clip_no = p.clip_no AND g.frame_idx = p.frame_idx AND {IOU} >= 0.5)""")
def d20_unlabelled_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed boxes that no labelled box covers by half."""
    shift = 25 * (F.col("track_id") % 3)
    seeds = scene.players(spark, sf_dir).where("frame_idx % 10 = 0").select("clip_no", "frame_idx", "track_id", (F.col("x1") + shift).alias("s_x1"), F.col("y1").alias("s_y1"), (F.col("x2") + shift).alias("s_x2"), F.col("y2").alias("s_y2"))
    saved = scene.ground_truth(spark, sf_dir).select("clip_no", "frame_idx", *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    near = (seeds["clip_no"] == saved["clip_no"]) & (seeds["frame_idx"] == saved["frame_idx"]) & (iou(Box.of("s_"), Box.of("g_")) >= 0.5)
    return seeds.join(saved, near, "left_anti").select("clip_no", "frame_idx", "track_id")


@query("""SELECT clip_no, frame_idx, count(*) AS n_boxes, count(*) - count(DISTINCT gt_id) AS duplicate_ids, count(*) FILTER (x2 <= x1 OR y2 <= y1) AS degenerate, count(*) NOT BETWEEN 6 AND 12 AS unusual FROM scene_gt GROUP BY clip_no, frame_idx""")
def c16_label_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return scene.ground_truth(spark, sf_dir).groupBy("clip_no", "frame_idx").agg(
        n.alias("n_boxes"), (n - F.countDistinct("gt_id")).alias("duplicate_ids"), F.count_if((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))).alias("degenerate"), (~n.between(6, 12)).alias("unusual"))


@query("""
, r AS (SELECT clip_no, frame_idx, track_id, greatest(0, least(CAST(trunc(x1) AS INT), 1280)) AS a, greatest(0, least(CAST(trunc(y1) AS INT), 720)) AS b, greatest(0, least(CAST(trunc(x2) AS INT), 1280)) AS c,
  greatest(0, least(CAST(trunc(y1 + (y2 - y1) * 0.667::DOUBLE) AS INT), 720)) AS d FROM scene_players)
SELECT clip_no, frame_idx, track_id, CASE WHEN c > a AND d > b THEN a END AS x1, CASE WHEN c > a AND d > b THEN b END AS y1, CASE WHEN c > a AND d > b THEN c END AS x2, CASE WHEN c > a AND d > b THEN d END AS y2 FROM r""")
def b15_jersey_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = scene.players(spark, sf_dir).select("clip_no", "frame_idx", "track_id", crop(Box.of(), 1280, 720, 0.667).alias("r"))
    return box.select("clip_no", "frame_idx", "track_id", *[F.col(f"r.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("""SELECT clip_no, CAST(count(p.track_id) AS BIGINT) AS n_boxes, count(DISTINCT f.frame_idx) - count(DISTINCT CASE WHEN p.track_id IS NOT NULL THEN f.frame_idx END) AS empty_frames, round(count(p.track_id) / CAST(count(DISTINCT f.frame_idx) AS DOUBLE), 6) AS per_frame
  FROM scene_frames f LEFT JOIN (SELECT * FROM scene_players WHERE eid % 9 <> 0) p USING (clip_no, frame_idx) GROUP BY clip_no""")
def e29_detector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, frames without any and the mean, over all frames of the spine."""
    counts = scene.players(spark, sf_dir).where("eid % 9 <> 0").groupBy("clip_no", "frame_idx").agg(F.count("*").alias("n"))
    rows = scene.frames(spark, sf_dir).join(counts, ["clip_no", "frame_idx"], "left").na.fill(0, ["n"])
    return rows.groupBy("clip_no").agg(F.sum("n").alias("n_boxes"), F.count_if(F.col("n") == 0).alias("empty_frames"), F.round(F.avg("n"), 6).alias("per_frame"))


@query("""
, store AS (SELECT clip_no, CAST(frame_idx // 3 AS BIGINT) AS k, eid AS seq, CASE u % 4 WHEN 0 THEN 'nobody' WHEN 1 THEN 'unclear' ELSE CAST(u % 10 AS VARCHAR) END AS holder FROM scene_frames)
SELECT clip_no, k, holder FROM (SELECT *, row_number() OVER (PARTITION BY clip_no, k ORDER BY seq DESC) AS r FROM store) WHERE r = 1""")
def e03_last_label_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scene.frames(spark, sf_dir).select("clip_no", F.floor(F.col("frame_idx") / 3).alias("k"), F.col("eid").alias("seq"), F.when(F.col("u") % 4 == 0, "nobody").when(F.col("u") % 4 == 1, "unclear").otherwise((F.col("u") % 10).cast("string")).alias("holder"))
    return last_wins(rows, ["clip_no", "k"], "seq").select("clip_no", "k", "holder")


@query("""
, switch AS (SELECT clip_no, frame_idx, CASE WHEN u % 2 = 0 THEN 'a' ELSE 'b' END AS config FROM scene_frames WHERE u % 5 = 0),
lab AS (SELECT clip_no, frame_idx, player_id FROM scene_team_raw WHERE frame_idx % 25 = 0 AND predicted_team = 1)
SELECT l.clip_no, l.frame_idx, l.player_id, coalesce(string_agg(DISTINCT s.config, ',' ORDER BY s.config), '') AS configs, count(s.config) > 0 AS at_switch FROM lab l LEFT JOIN switch s USING (clip_no, frame_idx) GROUP BY l.clip_no, l.frame_idx, l.player_id""")
def d19_switch_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with the configurations that switch identities at their frame."""
    switch = scene.frames(spark, sf_dir).where("u % 5 = 0").select("clip_no", "frame_idx", F.when(F.col("u") % 2 == 0, "a").otherwise("b").alias("config"))
    per = switch.groupBy("clip_no", "frame_idx").agg(F.array_join(F.array_sort(F.collect_set("config")), ",").alias("configs"))
    rows = scene.team_raw(spark, sf_dir).where("frame_idx % 25 = 0 and predicted_team = 1").select("clip_no", "frame_idx", "player_id")
    return rows.join(per, ["clip_no", "frame_idx"], "left").select("clip_no", "frame_idx", "player_id", F.coalesce("configs", F.lit("")).alias("configs"), F.col("configs").isNotNull().alias("at_switch"))


@query("""SELECT clip_no, min(CASE WHEN l.frame_idx IS NULL THEN f.frame_idx END) AS next_frame, count(*) FILTER (l.frame_idx IS NULL) AS left_over
  FROM scene_frames f LEFT JOIN (SELECT DISTINCT clip_no, frame_idx FROM scene_gt WHERE frame_idx < 250) l USING (clip_no, frame_idx) WHERE f.frame_idx % 10 = 0 GROUP BY clip_no""")
def d21_next_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scene.ground_truth(spark, sf_dir).where("frame_idx < 250").select("clip_no", "frame_idx")
    return scene.frames(spark, sf_dir).where("frame_idx % 10 = 0").join(done, ["clip_no", "frame_idx"], "left_anti").groupBy("clip_no").agg(F.min("frame_idx").alias("next_frame"), F.count("*").alias("left_over"))


@query("""
, w AS (SELECT clip_no, frame_idx FROM scene_frames WHERE u % 60 = 0)
SELECT DISTINCT f.clip_no, f.frame_idx FROM scene_frames f WHERE f.frame_idx % 10 = 0 OR EXISTS (SELECT 1 FROM w WHERE w.clip_no = f.clip_no AND f.frame_idx BETWEEN w.frame_idx - 3 AND w.frame_idx + 3)""")
def g07_sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth frame and the frames around marked ones, within the clip."""
    f = scene.frames(spark, sf_dir)
    near = f.where("u % 60 = 0").select("clip_no", F.explode(F.sequence(F.col("frame_idx") - 3, F.col("frame_idx") + 3)).alias("frame_idx"))
    spine = f.select("clip_no", "frame_idx")
    return spine.where("frame_idx % 10 = 0").union(near.join(spine, ["clip_no", "frame_idx"], "left_semi")).distinct()


@query("""
, r AS (SELECT clip_no, player_id, count(*) AS n_rows FROM scene_team_raw GROUP BY clip_no, player_id)
SELECT clip_no, player_id, CAST((dense_rank() OVER (PARTITION BY clip_no ORDER BY player_id) - 1) % 6 AS INT) AS colour, n_rows FROM r""")
def b40_track_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scene.team_raw(spark, sf_dir).groupBy("clip_no", "player_id").agg(F.count("*").alias("n_rows"))
    return r.select("clip_no", "player_id", ((F.dense_rank().over(Window.partitionBy("clip_no").orderBy("player_id")) - 1) % 6).alias("colour"), "n_rows")


@query("""
, own AS (SELECT clip_no, frame_idx, count(*) OVER (PARTITION BY clip_no) AS n, row_number() OVER (PARTITION BY clip_no ORDER BY frame_idx) - 1 AS i FROM scene_ball)
SELECT clip_no, frame_idx FROM own WHERE i IN (SELECT CAST(floor(k * n / 12) AS BIGINT) FROM (SELECT unnest(range(0, 12)) AS k))""")
def g04_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve detections of each clip, evenly spaced."""
    rows = scene.ball(spark, sf_dir).select("clip_no", "frame_idx", F.count("*").over(Window.partitionBy("clip_no")).alias("n"), (F.row_number().over(Window.partitionBy("clip_no").orderBy("frame_idx")) - 1).alias("i"))
    return rows.where(F.exists(F.sequence(F.lit(0), F.lit(11)), lambda k: F.floor(k * F.col("n") / 12) == F.col("i"))).select("clip_no", "frame_idx")
