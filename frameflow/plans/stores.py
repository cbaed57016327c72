"""Queries: jersey colours from pixels, and file formats written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.functions.pixels import crop_colours
from frameflow.operators import possession, sampling, teams
from frameflow.plans.game import rounded
from frameflow.plans.registry import query
from frameflow.sources import files, scene, stages, store

# --- B22, B23, K05: colours ----------------------------------------------------------------------------------------
#: Every player of every frame has a crop of 12 x 8 pixels: a background with a jersey of 6 x 4 pixels in it, its right half six levels lighter. Of a few crops only two pixels stand out, and
#: some crops are 2 x 2 pixels, which is border only. The SQL knows this make; the operator sees pixels.
FARTHER = 50
CROPS = """
, made AS (SELECT clip_no, frame_idx, track_id, CASE WHEN (eid + track_id) % 13 = 0 THEN 0 WHEN (eid + track_id) % 11 = 0 THEN 2 ELSE 24 END AS n, 20 + (eid + track_id) % 15 AS back, CASE WHEN track_id <= 5 THEN 190 ELSE 110 END + (eid * 7 + track_id * 13) % 30 AS low FROM scene_players),
crops AS (SELECT clip_no, frame_idx, track_id, back::DOUBLE AS border_b, (back + 10)::DOUBLE AS border_r, CAST(n AS INT) AS n_foreground, CASE WHEN n >= 10 THEN (low + 3)::DOUBLE END AS b, CASE WHEN n >= 10 THEN (low + 12)::DOUBLE END AS g, CASE WHEN n >= 10 THEN (low + 21)::DOUBLE END AS r FROM made)"""


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops as bytes, and their colours."""
    own, light = F.col("eid") + F.col("track_id"), F.col("track_id") <= 5
    cut = scene.players(spark, sf_dir)
    pixel = lambda low, step: F.concat(*[F.lpad(F.hex((low + step * k).cast("long")), 2, "0") for k in range(3)])
    low = F.when(light, 190).otherwise(110) + (F.col("eid") * 7 + F.col("track_id") * 13) % 30
    back, left, right = pixel(20 + own % 15, 5), pixel(low, 9), pixel(low + 6, 9)
    row = lambda *parts: F.concat(*[F.repeat(c, n) for c, n in parts])
    bare, jersey, spot = row((back, 8)), row((back, 2), (left, 2), (right, 2), (back, 2)), row((back, 2), (left, 2), (back, 4))
    text = F.when(own % 13 == 0, row((back, 4))).when(own % 11 == 0, row((bare, 3), (spot, 1), (bare, 8))).otherwise(row((bare, 3), (jersey, 6), (bare, 3)))
    side = lambda n: F.when(own % 13 == 0, 2).otherwise(n)
    crops = cut.select("clip_no", "frame_idx", "track_id", side(12).alias("h"), side(8).alias("w"), F.unhex(text).alias("pixels"))
    return crops.select("clip_no", "frame_idx", "track_id", crop_colours(F.col("pixels"), F.col("h"), F.col("w"), FARTHER).alias("c")).select("clip_no", "frame_idx", "track_id", "c.*")


@query(CROPS + "SELECT clip_no, frame_idx, track_id, round(border_b, 6) AS border_b, round(border_r, 6) AS border_r, CAST(n_foreground AS INT) AS n_foreground, round(b, 6) AS b, round(g, 6) AS g, round(r, 6) AS r FROM crops")
def b22_b23_crop_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour of each crop's border, how many pixels stand out from it, and their mean (null where too few do)."""
    c = F.col("colour")
    return rounded(colours(spark, sf_dir).select("clip_no", "frame_idx", "track_id", F.col("border")[0].alias("border_b"), F.col("border")[2].alias("border_r"), "n_foreground", c[0].alias("b"), c[1].alias("g"), c[2].alias("r")))


@query(CROPS + """, m AS (SELECT clip_no, track_id <= 5 AS light, avg(b) AS mb, avg(g) AS mg, avg(r) AS mr FROM crops WHERE b IS NOT NULL GROUP BY ALL),
d AS (SELECT c.clip_no, c.frame_idx, c.track_id, sqrt((b - l.mb) ** 2 + (g - l.mg) ** 2 + (r - l.mr) ** 2) AS d1, sqrt((b - k.mb) ** 2 + (g - k.mg) ** 2 + (r - k.mr) ** 2) AS d2
  FROM crops c JOIN m l ON l.clip_no = c.clip_no AND l.light JOIN m k ON k.clip_no = c.clip_no AND NOT k.light)
SELECT clip_no, frame_idx, track_id, CAST(CASE WHEN d1 IS NULL THEN NULL WHEN d1 <= d2 THEN 1 ELSE 2 END AS INT) AS predicted_team, coalesce(round(greatest(d1, d2) / (d1 + d2 + 1e-9), 6), 0) AS confidence, d1 IS NOT NULL AS crop_ok FROM d""")
def k05_colour_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two means of each clip's crop colours. The scene's jerseys are light or dark, so the SQL knows the two centres: the means of either kind."""
    crops = colours(spark, sf_dir).select("clip_no", F.struct("frame_idx", "track_id").alias("of"), "colour")
    found = teams.colour_teams(crops, "clip_no", "of", "colour")
    return rounded(found.select("clip_no", "of.frame_idx", "of.track_id", "predicted_team", "confidence", "crop_ok"))


# --- A10, G05: a graph of stages, seeded samples -------------------------------------------------------------------------
def scene_graph(spark: SparkSession, sf_dir: str) -> stages.Graph:
    """From detections to possession share, as stored stages."""
    frames, players, raw = scene.frames(spark, sf_dir), scene.players(spark, sf_dir), scene.team_raw(spark, sf_dir)
    ball = scene.ball(spark, sf_dir).select("clip_no", "frame_idx", "cx", "cy", "confidence")
    share = "clip_no int, n_frames long, team_1 long, team_2 long, no_holder long, unlabelled long, share_1 double, attributed double"
    own = lambda s: teams.abstain(F.col("predicted_team"), F.col("confidence"), F.col("crop_ok"), s["team_confidence"]).cast("int").alias("team")
    return stages.Graph([
        stages.Stage("ball", "clip_no int, frame_idx int, cx double, cy double, confidence double", lambda s, _: ball.where(F.col("confidence") >= s["ball_confidence"]), ("ball_confidence",)),
        stages.Stage("holders", "clip_no int, frame_idx int, confidence double, candidate int", lambda s, r: possession.holders(possession.fill(frames, r["ball"]), players, s["overlap"], s["reach"]), ("overlap", "reach"), ("ball",)),
        stages.Stage("possession", "clip_no int, frame_idx int, holder int", lambda s, r: possession.possession(frames, r["holders"], s["hold"]), ("hold",), ("holders",)),
        stages.Stage("teams", "clip_no int, frame_idx int, track_id int, team int", lambda s, _: raw.select("clip_no", "frame_idx", F.col("player_id").alias("track_id"), own(s)), ("team_confidence",)),
        stages.Stage("share", share, lambda _, r: possession.share(r["possession"], r["teams"]), (), ("possession", "teams")),
    ])


@query("""
, t AS (SELECT 'ball' AS stage, count(*) FILTER (confidence >= 0.33::DOUBLE) AS n FROM scene_ball UNION ALL SELECT 'holders', count(*) FROM scene_frames UNION ALL SELECT 'possession', count(*) FROM scene_frames
  UNION ALL SELECT 'teams', count(*) FROM scene_team_raw UNION ALL SELECT 'share', count(DISTINCT clip_no) FROM scene_frames)
SELECT CAST(r.run AS INT) AS run, t.stage, n AS n_rows, list_contains(ran, t.stage) AS ran FROM t, (VALUES (0, ['ball', 'holders', 'possession', 'teams', 'share']), (1, []), (2, ['possession', 'share']), (3, ['teams', 'share']), (4, ['share'])) AS r(run, ran)""")
def a10_stage_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stages run when settings change: all at first, none again, those after a changed hold, those after a changed team threshold, and with both old and new ones only what joins them."""
    root, graph, out = store.workplace(spark, "graph"), scene_graph(spark, sf_dir), None
    base = {"ball_confidence": 0.33, "overlap": 0.8, "reach": 50.0, "hold": 5, "team_confidence": 0.6}
    for k, change in enumerate(({}, {}, {"hold": 8}, {"team_confidence": 0.7}, {"hold": 8, "team_confidence": 0.7})):
        results, ran = graph.run(spark, root, base | change)
        for name, rows in results.items():
            part = rows.agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("run"), F.lit(name).alias("stage"), "n_rows", F.lit(name in ran).alias("ran"))
            out = part if out is None else out.unionByName(part)
    return out


@query()
def g05_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty frames of each clip out of those with a confident landmark."""
    return sampling.seeded(scene.keypoints(spark, sf_dir).where("confidence >= 0.5"), "clip_no", "frame_idx", 60, 42)


# --- A07-A24: written and read back ---------------------------------------------------------------------------------
@query("SELECT clip_no, count(*) AS n_frames, CAST(1 AS INT) AS made FROM scene_frames GROUP BY clip_no UNION ALL SELECT clip_no, count(*), 2 FROM scene_frames WHERE frame_idx % 2 = 0 GROUP BY clip_no")
def a07_stored_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's result is stored once, used again while what it depends on is the same, and made anew when a parameter changes."""
    path, f = store.workplace(spark, "stage"), scene.frames(spark, sf_dir)
    runs: list[int] = []

    def make(step: int):
        def counted() -> DataFrame:
            runs.append(step)
            return f.where(F.col("frame_idx") % step == 0).groupBy("clip_no").agg(F.count("*").alias("n_frames"))

        return counted

    schema, out = "clip_no int, n_frames long", []
    for step in (1, 1, 2, 2):
        rows = store.stage(spark, f"{path}/{step}", store.fingerprint("count", {"step": step}), schema, make(step)).withColumn("made", F.lit(len(runs)))
        out.append(rows)
    return out[1].unionByName(out[3])


@query("SELECT frame_idx, clip_no * 100 + track_id AS track_id, x1, y1, x2, y2 FROM scene_players")
def a12_annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boxes written in the annotation format and read again; ids are made unique by the clip."""
    path = store.workplace(spark, "boxes")
    files.write_mot(scene.players(spark, sf_dir).withColumn("track_id", F.col("clip_no") * 100 + F.col("track_id")), path)
    return files.read_mot(spark, path)


@query("SELECT CAST(clip_no AS VARCHAR) AS clip, frame_idx, player_id, predicted_team, confidence, crop_ok FROM scene_team_raw")
def a14_prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw predictions, before any threshold, as a result table and back."""
    path = store.workplace(spark, "predictions")
    files.write_result(scene.team_raw(spark, sf_dir).select(F.col("clip_no").cast("string").alias("clip"), "frame_idx", "player_id", "predicted_team", "confidence", "crop_ok"), path)
    return spark.read.schema(files.PREDICTION).csv(path, header=True, mode="FAILFAST")


@query("SELECT CAST(clip_no AS VARCHAR) AS clip, frame_idx, CASE WHEN frame_idx % 3 = 0 THEN 'nobody' ELSE CAST(u % 10 AS VARCHAR) END AS holder FROM scene_frames")
def a17_label_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels added to a store in two sittings; the later one corrects every third frame."""
    path, f = store.workplace(spark, "labels"), scene.frames(spark, sf_dir)
    allowed = F.col("holder").isin("nobody", "unclear") | F.col("holder").rlike("^[0-9]+$")
    for rows, holder in ((f, (F.col("u") % 10).cast("string")), (f.where("frame_idx % 3 = 0"), F.lit("nobody"))):
        files.append_labels(rows.select(F.col("clip_no").cast("string").alias("clip"), "frame_idx", holder.alias("holder"), F.lit("2000-01-01").alias("labelled_at")), path, allowed)
    return files.read_labels(spark, path, files.POSSESSION_LABEL, ["clip", "frame_idx"]).select("clip", "frame_idx", "holder")


@query("""SELECT CAST(clip_no AS VARCHAR) AS clip, CAST(start_frame AS INT) AS event_id, event_type, start_frame, end_frame, from_track_id, to_track_id, from_team, to_team FROM scene_event_gt""")
def a19_event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.workplace(spark, "events")
    files.write_result(scene.event_labels(spark, sf_dir).select(F.col("clip_no").cast("string").alias("clip"), F.col("start_frame").alias("event_id"), "event_type", "start_frame", "end_frame", "from_track_id", "to_track_id", "from_team", "to_team", F.lit("seen").alias("notes")), path)
    return files.read_event_labels(spark, path).drop("notes")


@query("""SELECT CAST(clip_no AS VARCHAR) AS clip, frame_idx, array_to_string(list_sort(list(DISTINCT 'setting ' || CAST(u % i AS VARCHAR))), ', ') AS settings FROM scene_frames, (SELECT unnest([2, 3, 5]) AS i) GROUP BY ALL""")
def a21_switch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches of all settings, one row each in files, to the set of settings of each frame."""
    path, f = store.workplace(spark, "switches"), scene.frames(spark, sf_dir)
    rows = f.select(F.col("clip_no").cast("string").alias("clip"), "frame_idx", F.explode(F.transform(F.array(F.lit(2), F.lit(3), F.lit(5)), lambda i: F.concat(F.lit("setting "), (F.col("u") % i).cast("string")))).alias("setting"))
    files.write_result(rows, path)
    return files.switch_sets(spark, path)


@query("""SELECT clip_no, CAST(count(*) AS INT) AS n, CAST(NULL AS INT) AS n_ok, 'seen' AS arm FROM scene_team_raw GROUP BY clip_no UNION ALL SELECT clip_no, NULL, CAST(count(*) AS INT), 'usable' FROM scene_team_raw WHERE crop_ok GROUP BY clip_no""")
def a22_a23_metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric tables with blanks around headers and values, and with columns that differ, to one table."""
    raw, parts = scene.team_raw(spark, sf_dir), []
    for name, arm, rows in (("n", "seen", raw), ("n_ok", "usable", raw.where("crop_ok"))):
        path = store.workplace(spark, "metrics")
        files.write_result(rows.groupBy("clip_no").agg(F.count("*").alias(f" {name} ")).select(F.col("clip_no").alias("clip_no "), f" {name} ", F.lit(f"  {arm} ").alias(" arm")), path)
        read = files.stripped(spark.read.csv(path, header=True))
        parts.append(files.need(read, "clip_no", name, "arm").withColumns({"clip_no": F.col("clip_no").cast("int"), name: F.col(name).cast("int")}))
    return files.union_rows(parts)
