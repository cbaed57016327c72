"""Queries: ball, possession, events and their scores, movement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.functions.boxes import Box, closest, containment, cut
from frameflow.operators import events, gates, kinematics, possession, ranks, teams
from frameflow.plans.registry import query
from frameflow.sources import scene


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- J01-J07: gates -------------------------------------------------------------------------------------------------
DET = ", det AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY clip_no ORDER BY frame_idx) AS n FROM scene_ball)"
_FROZEN = "moved > 25.0 * gap"
_STEADY = "NOT starts_with(why, 'inconsistent')"
_AIMED = "(na >= 2 AND span <= 8)"
_FRESH = "(gap <= 8 AND na >= 2 AND span <= 8)"
_OFF = f"CASE WHEN {_AIMED} THEN sqrt((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)) ELSE moved END"
_LIMIT = f"CASE WHEN {_AIMED} THEN 40.0 + 15.0 * gap ELSE 25.0 * gap END"
#: For each gate: whether it accepts, by which rule, distance and tolerance, over the columns of TRACE_SQL.
RULES = {
    "frozen": (f"NOT {_FROZEN}", "'frozen'", "moved", "25.0 * gap"),
    "stale": (f"gap > 8 OR NOT {_FROZEN}", "CASE WHEN gap > 8 THEN 'stale reset' ELSE 'frozen' END", "CASE WHEN gap <= 8 THEN moved END", "CASE WHEN gap <= 8 THEN 25.0 * gap END"),
    "predicted": (f"{_OFF} <= {_LIMIT}", f"CASE WHEN {_AIMED} THEN 'predicted' ELSE 'frozen' END", _OFF, _LIMIT),
    "motion": (_STEADY, "why", "NULL", "NULL"),
    "combined": (f"NOT {_FROZEN} AND (NOT {_FRESH} OR {_STEADY})", f"CASE WHEN NOT {_FROZEN} AND {_FRESH} THEN why ELSE 'frozen' END", "moved", "25.0 * gap"),
}
#: A gate as a walk over a clip's detections that carries the accepted anchors as a list.
TRACE_SQL = """
, trace_{kind} AS (SELECT clip_no, n, frame_idx, cx, cy, confidence, true AS accepted, '{seed}' AS path, CAST(NULL AS INT) AS anchor_frame, CAST(NULL AS INT) AS frame_gap,
    CAST(NULL AS DOUBLE) AS distance, CAST(NULL AS DOUBLE) AS tolerance, [{{'f': CAST(frame_idx AS DOUBLE), 'x': cx, 'y': cy}}] AS an FROM det WHERE n = 1
  UNION ALL SELECT clip_no, n, frame_idx, cx, cy, confidence, {ok}, {path}, CAST(l.f AS INT), CAST(gap AS INT), CAST({distance} AS DOUBLE), CAST({tolerance} AS DOUBLE),
    CASE WHEN {ok} THEN list_append(an, {{'f': CAST(frame_idx AS DOUBLE), 'x': cx, 'y': cy}})[-{kept}:] ELSE an END
  FROM (SELECT *, l.x + gap * (sx / sf) AS ax, l.y + gap * (sy / sf) AS ay,
      CASE WHEN na < 2 THEN 'inconclusive: few anchors' WHEN w > greatest(v * 3.0, 60.0) THEN 'inconsistent: speed'
        WHEN v >= 5 AND w >= 5 AND degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (vx * wx + vy * wy) / (v * w))))) > 90 THEN 'inconsistent: direction' ELSE 'consistent' END AS why
    FROM (SELECT *, sqrt(vx * vx + vy * vy) AS v, sqrt(wx * wx + wy * wy) AS w, sqrt((cx - l.x) * (cx - l.x) + (cy - l.y) * (cy - l.y)) AS moved,
        list_sum(list_transform(an, lambda a: (a.f - mf) * (a.f - mf))) AS sf, list_sum(list_transform(an, lambda a: (a.f - mf) * (a.x - mx))) AS sx, list_sum(list_transform(an, lambda a: (a.f - mf) * (a.y - my))) AS sy
      FROM (SELECT *, frame_idx - l.f AS gap, l.f - o.f AS span, (l.x - o.x) / nullif(l.f - o.f, 0) AS vx, (l.y - o.y) / nullif(l.f - o.f, 0) AS vy, (cx - l.x) / (frame_idx - l.f) AS wx, (cy - l.y) / (frame_idx - l.f) AS wy,
          list_sum(list_transform(an, lambda a: a.f)) / na AS mf, list_sum(list_transform(an, lambda a: a.x)) / na AS mx, list_sum(list_transform(an, lambda a: a.y)) / na AS my
        FROM (SELECT d.*, t.an, len(t.an) AS na, t.an[1] AS o, t.an[-1] AS l FROM trace_{kind} t JOIN det d ON d.clip_no = t.clip_no AND d.n = t.n + 1)))))"""


def trace_sql(kind: str) -> str:
    ok, path, distance, tolerance = RULES[kind]
    return TRACE_SQL.format(kind=kind, ok=f"({ok})", path=path, distance=distance, tolerance=tolerance, kept=gates.KEPT[kind], seed="inconclusive: few anchors" if kind == "motion" else "seed")


def gate_sql(kind: str) -> str:
    return DET + trace_sql(kind) + f" SELECT clip_no, frame_idx, cx, cy, confidence FROM trace_{kind} WHERE accepted"


#: The cheapest path: costs and predecessors of a clip's detections so far as lists, then the walk back from the cheapest end.
TRAJECTORY = """
, walk AS (SELECT clip_no, n, [frame_idx] AS fs, [cx] AS xs, [cy] AS ys, [0.0::DOUBLE] AS best, [0::BIGINT] AS parent FROM det WHERE n = 1
  UNION ALL SELECT clip_no, n, list_append(fs, frame_idx), list_append(xs, cx), list_append(ys, cy), list_append(best, least(1000.0 * (n - 1), list_min(cost))),
    list_append(parent, CASE WHEN list_min(cost) < 1000.0 * (n - 1) THEN CAST(list_position(cost, list_min(cost)) AS BIGINT) ELSE 0 END)
  FROM (SELECT *, list_transform(hop, lambda h: h.b + CASE WHEN h.g > 45 THEN h.s WHEN h.d > 100.0 * h.g THEN 'infinity'::DOUBLE ELSE h.d * h.d / h.g + h.s END) AS cost
    FROM (SELECT d.*, w.fs, w.xs, w.ys, w.best, w.parent, list_transform(range(1, d.n), lambda i: {'b': w.best[i], 'g': CAST(d.frame_idx - w.fs[i] AS DOUBLE), 's': 1000.0::DOUBLE * (d.n - 1 - i),
        'd': sqrt((w.xs[i] - d.cx) * (w.xs[i] - d.cx) + (w.ys[i] - d.cy) * (w.ys[i] - d.cy))}) AS hop
      FROM walk w JOIN det d ON d.clip_no = w.clip_no AND d.n = w.n + 1))),
ended AS (SELECT clip_no, parent, list_transform(range(1, n + 1), lambda i: best[i] + 1000.0::DOUBLE * (n - i)) AS total FROM (SELECT *, row_number() OVER (PARTITION BY clip_no ORDER BY n DESC) AS k FROM walk) WHERE k = 1),
back AS (SELECT clip_no, parent, CAST(list_position(total, list_min(total)) AS BIGINT) AS i FROM ended UNION ALL SELECT clip_no, parent, parent[i] FROM back WHERE parent[i] > 0),
gated AS MATERIALIZED (SELECT d.* FROM det d JOIN back b ON b.clip_no = d.clip_no AND b.i = d.n)"""


@query(gate_sql("frozen"), recursive=True)
def j01_frozen_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate(scene.ball(spark, sf_dir), "frozen")


@query(gate_sql("predicted"), recursive=True)
def j02_predicted_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate(scene.ball(spark, sf_dir), "predicted")


@query(gate_sql("stale"), recursive=True)
def j03_stale_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate(scene.ball(spark, sf_dir), "stale")


@query(gate_sql("motion"), recursive=True)
def j04_motion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate(scene.ball(spark, sf_dir), "motion")


@query(gate_sql("combined"), recursive=True)
def j05_combined_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gate(scene.ball(spark, sf_dir), "combined")


@query(DET + TRAJECTORY + " SELECT clip_no, frame_idx, cx, cy, confidence FROM gated", recursive=True)
def j06_trajectory_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.trajectory_gate(scene.ball(spark, sf_dir))


ALL_TRACES = DET + "".join(map(trace_sql, gates.KEPT))


@query(ALL_TRACES + " UNION ALL ".join(f"SELECT clip_no, frame_idx, cx, cy, confidence, accepted, path, anchor_frame, frame_gap, round(distance, 6) AS distance, tolerance, '{k}' AS gate FROM trace_{k}" for k in gates.KEPT).join((" ", "")), recursive=True)
def j07_gate_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions of all causal gates with their reasons."""
    return rounded(gates.traces(scene.ball(spark, sf_dir)))


@query(ALL_TRACES + TRAJECTORY + ", every AS (" + " UNION ALL ".join(f"SELECT '{k}' AS gate, clip_no, frame_idx, accepted FROM trace_{k}" for k in gates.KEPT) + """),
seen AS MATERIALIZED (SELECT e.gate, e.clip_no, e.frame_idx, e.accepted, g.n IS NOT NULL AS base FROM every e LEFT JOIN gated g ON g.clip_no = e.clip_no AND g.frame_idx = e.frame_idx),
isle AS (SELECT gate, clip_no, frame_idx - row_number() OVER (PARTITION BY gate, clip_no ORDER BY frame_idx) AS island FROM seen WHERE NOT accepted AND base),
lost AS (SELECT gate, clip_no, max(c) AS longest FROM (SELECT gate, clip_no, island, count(*) AS c FROM isle GROUP BY gate, clip_no, island) GROUP BY gate, clip_no)
SELECT s.clip_no, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (accepted AND NOT base) AS new_accepts, count(*) FILTER (NOT accepted AND base) AS new_rejects, coalesce(max(longest), 0) AS longest, s.gate
FROM seen s LEFT JOIN lost l ON l.gate = s.gate AND l.clip_no = s.clip_no GROUP BY s.clip_no, s.gate""", recursive=True)
def e39_gate_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each causal gate against the trajectory gate by clip: accepted, gained, lost, longest run of losses."""
    ball = scene.ball(spark, sf_dir)
    base = gates.trajectory_gate(ball).select("clip_no", "frame_idx", F.lit(True).alias("base"))
    seen = gates.traces(ball).select("gate", "clip_no", "frame_idx", "accepted").join(base, ["clip_no", "frame_idx"], "left").na.fill(False, ["base"])
    # runs of losses within the counts: islands of consecutive frames are one more window by the same keys
    counts = seen.groupBy("clip_no", "gate").agg(F.count_if("accepted").cast("long").alias("n_accepted"), F.count_if(F.col("accepted") & ~F.col("base")).cast("long").alias("new_accepts"), F.count_if(~F.col("accepted") & F.col("base")).cast("long").alias("new_rejects"))
    lost = kinematics.runs(seen, ~F.col("accepted") & F.col("base"), "gate").groupBy("clip_no", "gate").agg(F.max("length").alias("longest"))
    return counts.join(lost, ["clip_no", "gate"], "left").na.fill(0, ["longest"]).select("clip_no", "n_accepted", "new_accepts", "new_rejects", "longest", "gate")


@query("""
, moved AS (SELECT clip_no, frame_idx - lag(frame_idx) OVER w AS gap,
    sqrt((cx - lag(cx) OVER w) * (cx - lag(cx) OVER w) + (cy - lag(cy) OVER w) * (cy - lag(cy) OVER w)) AS d FROM scene_ball WINDOW w AS (PARTITION BY clip_no ORDER BY frame_idx))
SELECT CAST(gap AS INT) AS gap, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(d, 0.99), 6) AS p99,
  round(max(d), 6) AS largest, round((quantile_cont(d, 0.95) / gap) * (quantile_cont(d, 0.95) / gap), 6) AS penalty FROM moved WHERE gap IN (1, 2, 3) GROUP BY gap""")
def e15_gap_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the ball moves over gaps of 1 to 3 frames, and the penalty that follows."""
    from pyspark.sql import Window

    w = Window.partitionBy("clip_no").orderBy("frame_idx")
    dx, dy = F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)
    moved = scene.ball(spark, sf_dir).select((F.col("frame_idx") - F.lag("frame_idx").over(w)).alias("gap"), F.sqrt(dx * dx + dy * dy).alias("d")).where("gap in (1, 2, 3)")
    # three gaps hold all rows: ranks over sorted ranges, not a list of each gap's distances
    out = ranks.quantiles(moved, ["gap"], "d", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "largest": 1.0})
    return rounded(out.withColumn("penalty", (F.col("p95") / F.col("gap")) * (F.col("p95") / F.col("gap"))))


# --- F01, D02, F09, E02: from ball to possession --------------------------------------------------------------------
FILL = """
, spine AS (SELECT f.clip_no, f.frame_idx, b.cx, b.cy, b.confidence, CASE WHEN b.confidence IS NOT NULL THEN f.frame_idx END AS ff FROM scene_frames f LEFT JOIN scene_ball b USING (clip_no, frame_idx)),
nearby AS (SELECT *, last_value(ff IGNORE NULLS) OVER p AS f0, last_value(cx IGNORE NULLS) OVER p AS x0, last_value(cy IGNORE NULLS) OVER p AS y0,
    first_value(ff IGNORE NULLS) OVER q AS f1, first_value(cx IGNORE NULLS) OVER q AS x1, first_value(cy IGNORE NULLS) OVER q AS y1 FROM spine
  WINDOW p AS (PARTITION BY clip_no ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY clip_no ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS MATERIALIZED (SELECT clip_no, frame_idx, coalesce(cx, CASE WHEN f0 IS NOT NULL AND f1 IS NOT NULL THEN x0 + (x1 - x0) * (frame_idx - f0) / (f1 - f0) END, x0, x1) AS cx,
    coalesce(cy, CASE WHEN f0 IS NOT NULL AND f1 IS NOT NULL THEN y0 + (y1 - y0) * (frame_idx - f0) / (f1 - f0) END, y0, y1) AS cy,
    coalesce(confidence, 0.0::DOUBLE) AS confidence, confidence IS NOT NULL AS is_real FROM nearby WHERE coalesce(x0, x1) IS NOT NULL)"""
#: The holder of each row of {ball}; the same arithmetic as the operator.
HOLDER = """
, pair AS (SELECT b.clip_no, b.frame_idx, b.confidence, p.track_id, p.det_order,
    CASE WHEN least(x2, cx + 6) > greatest(x1, cx - 6) AND least(y2, cy + 6) > greatest(y1, cy - 6)
      THEN (least(x2, cx + 6) - greatest(x1, cx - 6)) * (least(y2, cy + 6) - greatest(y1, cy - 6)) / 144.0::DOUBLE ELSE 0.0::DOUBLE END AS inside,
    least({points},
      CASE WHEN y1 < cy AND cy < y2 THEN abs(x1 - cx) END, CASE WHEN y1 < cy AND cy < y2 THEN abs(x2 - cx) END, CASE WHEN x1 < cx AND cx < x2 THEN abs(y1 - cy) END, CASE WHEN x1 < cx AND cx < x2 THEN abs(y2 - cy) END) AS far
  FROM {ball} b LEFT JOIN scene_players p USING (clip_no, frame_idx)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY clip_no, frame_idx ORDER BY CASE WHEN inside > 0.8 THEN 0 WHEN far < 50 THEN 1 ELSE 2 END, CASE WHEN inside > 0.8 THEN -inside ELSE far END, det_order) AS k FROM pair),
candidate AS MATERIALIZED (SELECT clip_no, frame_idx, confidence, CAST(CASE WHEN track_id IS NOT NULL AND (inside > 0.8 OR far < 50) THEN track_id ELSE -1 END AS INT) AS candidate FROM ranked WHERE k = 1)"""
_X = ("x1", "x2", "x1", "x2", "(x1 + x2) / 2", "(x1 + x2) / 2", "x1", "x2", "(x1 + x2) / 2", "(x1 + x2) / 2")
_Y = ("y1", "y1", "y2", "y2", "y1", "y2", "(y1 + y2) / 2", "(y1 + y2) / 2", "(y1 + y2) / 2", "(y1 + (y2 - y1) / 3)")
HOLDER = HOLDER.replace("{points}", ", ".join(f"sqrt(({x} - cx) * ({x} - cx) + ({y} - cy) * ({y} - cy))" for x, y in zip(_X, _Y, strict=True)))
POSSESSION = """
, marked AS (SELECT *, CASE WHEN candidate = lag(candidate) OVER (PARTITION BY clip_no ORDER BY frame_idx) THEN 0 ELSE 1 END AS new_run FROM candidate),
run AS (SELECT *, sum(new_run) OVER (PARTITION BY clip_no ORDER BY frame_idx) AS run FROM marked),
place AS (SELECT *, row_number() OVER w AS k, max(CASE WHEN confidence > 0 THEN 1 ELSE 0 END) OVER w AS anchored, min(frame_idx) OVER (PARTITION BY clip_no, run) AS begin_frame FROM run WINDOW w AS (PARTITION BY clip_no, run ORDER BY frame_idx)),
sure AS (SELECT *, min(CASE WHEN candidate <> -1 AND k >= 5 AND anchored = 1 THEN frame_idx END) OVER (PARTITION BY clip_no, run) AS cf FROM place),
held AS (SELECT clip_no, frame_idx, candidate AS holder FROM sure WHERE frame_idx > cf
  UNION ALL SELECT f.clip_no, f.frame_idx, s.candidate FROM sure s JOIN scene_frames f ON f.clip_no = s.clip_no AND f.frame_idx BETWEEN s.begin_frame AND s.cf WHERE s.frame_idx = s.cf),
possession AS MATERIALIZED (SELECT f.clip_no, f.frame_idx, coalesce(holder, -1) AS holder FROM scene_frames f LEFT JOIN held USING (clip_no, frame_idx))"""
TEAMS = """
, team AS MATERIALIZED (SELECT clip_no, frame_idx, player_id AS track_id, CAST(CASE WHEN NOT crop_ok OR confidence < 0.6::DOUBLE THEN 0 ELSE predicted_team END AS INT) AS team FROM scene_team_raw)"""


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = scene.team_raw(spark, sf_dir)
    return raw.select("clip_no", "frame_idx", F.col("player_id").alias("track_id"), teams.abstain(F.col("predicted_team"), F.col("confidence"), F.col("crop_ok")).cast("int").alias("team"))


def possessed(spark: SparkSession, sf_dir: str, ball: DataFrame | None = None) -> DataFrame:
    frames = scene.frames(spark, sf_dir)
    ball = scene.ball(spark, sf_dir) if ball is None else ball
    return possession.possession(frames, possession.holders(possession.fill(frames, ball), scene.players(spark, sf_dir)))


@query(FILL + "SELECT clip_no, frame_idx, round(cx, 6) AS cx, round(cy, 6) AS cy, confidence, is_real FROM filled")
def f01_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return possession.fill(scene.frames(spark, sf_dir), scene.ball(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("cx", "cy")})


@query(HOLDER.format(ball="scene_ball") + "SELECT clip_no, frame_idx, round(inside, 6) AS containment, round(far, 6) AS distance, track_id FROM pair")
def b06_b09_box_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment and proximity distance of every ball and player of one frame."""
    near = scene.ball(spark, sf_dir).join(scene.players(spark, sf_dir), ["clip_no", "frame_idx"], "left")
    own, box = Box.of(), Box.around(F.col("cx"), F.col("cy"), possession.HALF)
    return near.select("clip_no", "frame_idx", F.round(containment(own, box), 6).alias("containment"), F.round(closest(own, F.col("cx"), F.col("cy")), 6).alias("distance"), "track_id")


@query(HOLDER.format(ball="scene_ball") + "SELECT clip_no, frame_idx, confidence, candidate FROM candidate")
def d02_holder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return possession.holders(scene.ball(spark, sf_dir), scene.players(spark, sf_dir))


FULL = FILL + HOLDER.format(ball="filled") + POSSESSION


@query(FULL + "SELECT * FROM possession")
def f09_possession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return possessed(spark, sf_dir)


SHARE = """
, counted AS (SELECT clip_no, count(*) AS n_frames, count(*) FILTER (holder <> -1 AND team = 1) AS team_1, count(*) FILTER (holder <> -1 AND team = 2) AS team_2,
    count(*) FILTER (holder = -1) AS no_holder, count(*) FILTER (holder <> -1 AND coalesce(team, 0) = 0) AS unlabelled
  FROM possession p LEFT JOIN team t ON t.clip_no = p.clip_no AND t.frame_idx = p.frame_idx AND t.track_id = p.holder GROUP BY ALL)
SELECT *, round(team_1 / nullif(team_1 + team_2, 0), 6) AS share_1, round((team_1 + team_2) / nullif(n_frames - no_holder, 0), 6) AS attributed FROM counted"""
SHARE = SHARE.replace("SELECT clip_no, count(*) AS n_frames", "SELECT p.clip_no AS clip_no, count(*) AS n_frames").replace("GROUP BY ALL", "GROUP BY p.clip_no")


@query(FULL + TEAMS + SHARE)
def e02_possession_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Possession share of the raw ball, filled but not gated."""
    return possession.share(possessed(spark, sf_dir), assigned(spark, sf_dir))


@query(DET + TRAJECTORY + FULL.replace("LEFT JOIN scene_ball b", "LEFT JOIN gated b") + TEAMS + SHARE, recursive=True)
def possession_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: trajectory gate, fill, holders, possession, teams, share."""
    return possession.share(possessed(spark, sf_dir, gates.trajectory_gate(scene.ball(spark, sf_dir))), assigned(spark, sf_dir))


@query(FULL + """SELECT clip_no, count(*) FILTER (holder <> -1) AS held_frames, count(DISTINCT holder) FILTER (holder <> -1) AS n_holders,
  count(*) FILTER (holder <> -1 AND confidence > 0) AS anchored FROM possession LEFT JOIN filled USING (clip_no, frame_idx) GROUP BY clip_no""")
def e30_possession_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = scene.frames(spark, sf_dir)
    ball = possession.fill(frames, scene.ball(spark, sf_dir))
    held = possessed(spark, sf_dir).join(ball.select("clip_no", "frame_idx", "confidence"), ["clip_no", "frame_idx"], "left")
    own = F.col("holder") != -1
    return held.groupBy("clip_no").agg(F.count_if(own).alias("held_frames"), F.countDistinct(F.when(own, F.col("holder"))).alias("n_holders"), F.count_if(own & (F.col("confidence") > 0)).alias("anchored"))


# --- F10, B30-B32, D14, E21: events ---------------------------------------------------------------------------------
EVENTS = """
, stepped AS (SELECT clip_no, frame_idx, holder, lag(holder) OVER w AS from_track_id, lag(frame_idx) OVER w AS last_frame FROM possession WHERE holder <> -1 WINDOW w AS (PARTITION BY clip_no ORDER BY frame_idx)),
change AS MATERIALIZED (SELECT clip_no, frame_idx, last_frame, from_track_id, holder AS to_track_id FROM stepped WHERE holder <> from_track_id AND frame_idx - last_frame <= 30),
found AS MATERIALIZED (SELECT c.clip_no, c.frame_idx, c.from_track_id, c.to_track_id, coalesce(a.team, 0) AS from_team, coalesce(b.team, 0) AS to_team,
    CASE WHEN coalesce(a.team, 0) = 0 OR coalesce(b.team, 0) = 0 THEN 'unclassified' WHEN a.team = b.team THEN 'pass' ELSE 'interception' END AS kind
  FROM change c LEFT JOIN team a ON a.clip_no = c.clip_no AND a.frame_idx = c.last_frame AND a.track_id = c.from_track_id
  LEFT JOIN team b ON b.clip_no = c.clip_no AND b.frame_idx = c.frame_idx AND b.track_id = c.to_track_id)"""


def found_events(spark: SparkSession, sf_dir: str, max_gap: int = events.MAX_GAP) -> DataFrame:
    return events.detected(events.transitions(possessed(spark, sf_dir), max_gap), assigned(spark, sf_dir))


@query(FULL + TEAMS + EVENTS + "SELECT clip_no, frame_idx, kind, from_track_id, to_track_id, from_team, to_team FROM found")
def f10_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_events(spark, sf_dir)


MATCH = """
, labelled AS (SELECT clip_no, start_frame, end_frame, event_type, CASE event_type WHEN 'pass' THEN 'pass' WHEN 'interception' THEN 'interception' WHEN 'steal' THEN 'interception' END AS kind,
    try_cast(CASE WHEN event_type IN ('interception', 'steal') THEN to_team ELSE from_team END AS INT) AS team, try_cast(from_track_id AS INT) AS from_id, try_cast(to_track_id AS INT) AS to_id FROM scene_event_gt),
label AS (SELECT *, row_number() OVER (PARTITION BY clip_no ORDER BY start_frame) AS label_no FROM labelled WHERE kind IS NOT NULL),
pred AS (SELECT *, CASE WHEN kind = 'pass' THEN from_team ELSE to_team END AS p_team FROM found WHERE kind <> 'unclassified'),
near AS (SELECT l.clip_no, label_no, p.frame_idx, greatest(start_frame - p.frame_idx, p.frame_idx - end_frame, 0) AS away, start_frame, end_frame, l.kind
  FROM label l JOIN pred p ON p.clip_no = l.clip_no AND p.kind = l.kind AND p.frame_idx BETWEEN start_frame - 10 AND end_frame + 10 AND (team IS NULL OR team = p_team))"""


@query(FULL + TEAMS + EVENTS + MATCH + "SELECT clip_no, label_no, start_frame, end_frame, kind, frame_idx, away FROM near")
def c10_event_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that may stand for a label: kind, team, frames within tolerance."""
    return events.candidates(scene.event_labels(spark, sf_dir), found_events(spark, sf_dir)).select("clip_no", F.col("label_no").cast("long"), "start_frame", "end_frame", "kind", "frame_idx", "away")


GREEDY = """
, ordered AS (SELECT clip_no, label_no, list({'a': away, 'f': frame_idx} ORDER BY away, frame_idx) AS c FROM near GROUP BY clip_no, label_no),
numbered AS (SELECT *, row_number() OVER (PARTITION BY clip_no ORDER BY label_no) AS n FROM ordered),
taken AS (SELECT clip_no, n, list_filter([list_filter(list_transform(c, lambda x: x.f), lambda f: true)[1]], lambda f: f IS NOT NULL) AS used FROM numbered WHERE n = 1
  UNION ALL SELECT m.clip_no, m.n, list_concat(t.used, list_filter([list_filter(list_transform(m.c, lambda x: x.f), lambda f: NOT list_contains(t.used, f))[1]], lambda f: f IS NOT NULL))
  FROM taken t JOIN numbered m ON m.clip_no = t.clip_no AND m.n = t.n + 1),
hits AS (SELECT clip_no, len(arg_max(used, n)) AS tp FROM taken GROUP BY clip_no),
nl AS (SELECT clip_no, count(*) FILTER (kind IS NOT NULL) AS n_labels FROM labelled GROUP BY clip_no),
nf AS (SELECT clip_no, count(*) FILTER (kind <> 'unclassified') AS n_found FROM found GROUP BY clip_no),
tally AS (SELECT coalesce(nl.clip_no, nf.clip_no) AS clip_no, coalesce(tp, 0) AS tp, coalesce(n_labels, 0) AS nl, coalesce(n_found, 0) AS nf
  FROM nl FULL JOIN nf ON nf.clip_no = nl.clip_no LEFT JOIN hits ON hits.clip_no = coalesce(nl.clip_no, nf.clip_no))
SELECT clip_no, 10 AS tolerance, CAST(tp AS BIGINT) AS tp, CAST(nf - tp AS BIGINT) AS fp, CAST(nl - tp AS BIGINT) AS fn, round(tp / nullif(nf, 0), 3) AS precision, round(tp / nullif(nl, 0), 3) AS recall, round(2.0 * tp / nullif(nl + nf, 0), 3) AS f1 FROM tally"""


@query(FULL + TEAMS + EVENTS + MATCH + GREEDY, recursive=True)
def e21_event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.scores(scene.event_labels(spark, sf_dir), found_events(spark, sf_dir))


#: Labels and events under each tolerance and criterion; the fold is that of GREEDY with these two among its keys.
SWEEP = """
, setting AS (SELECT CAST(unnest([5, 10, 20]) AS INT) AS tolerance), rule AS (SELECT unnest([false, true]) AS strict),
labelled AS (SELECT clip_no, start_frame, end_frame, event_type, CASE event_type WHEN 'pass' THEN 'pass' WHEN 'interception' THEN 'interception' WHEN 'steal' THEN 'interception' END AS kind,
    try_cast(CASE WHEN event_type IN ('interception', 'steal') THEN to_team ELSE from_team END AS INT) AS team, try_cast(from_track_id AS INT) AS from_id, try_cast(to_track_id AS INT) AS to_id FROM scene_event_gt),
label AS (SELECT *, row_number() OVER (PARTITION BY clip_no ORDER BY start_frame) AS label_no FROM labelled WHERE kind IS NOT NULL),
pred AS (SELECT *, CASE WHEN kind = 'pass' THEN from_team ELSE to_team END AS p_team FROM found WHERE kind <> 'unclassified'),
near AS (SELECT l.clip_no, tolerance, strict, label_no, p.frame_idx, greatest(start_frame - p.frame_idx, p.frame_idx - end_frame, 0) AS away
  FROM setting, rule, label l JOIN pred p ON p.clip_no = l.clip_no AND p.kind = l.kind AND p.frame_idx BETWEEN start_frame - tolerance AND end_frame + tolerance AND (team IS NULL OR team = p_team)
    AND (NOT strict OR (from_id IS NULL OR from_id = p.from_track_id) AND (to_id IS NULL OR to_id = p.to_track_id))),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY clip_no, tolerance, strict ORDER BY label_no) AS n FROM (SELECT clip_no, tolerance, strict, label_no, list(frame_idx ORDER BY away, frame_idx) AS c FROM near GROUP BY clip_no, tolerance, strict, label_no)),
taken AS (SELECT clip_no, tolerance, strict, n, [c[1]] AS used FROM numbered WHERE n = 1
  UNION ALL SELECT m.clip_no, m.tolerance, m.strict, m.n, list_concat(t.used, list_filter([list_filter(m.c, lambda f: NOT list_contains(t.used, f))[1]], lambda f: f IS NOT NULL))
  FROM taken t JOIN numbered m ON m.clip_no = t.clip_no AND m.tolerance = t.tolerance AND m.strict = t.strict AND m.n = t.n + 1),
hits AS (SELECT clip_no, tolerance, strict, len(arg_max(used, n)) AS tp FROM taken GROUP BY clip_no, tolerance, strict),
nl AS (SELECT clip_no, count(*) FILTER (kind IS NOT NULL) AS n_labels FROM labelled GROUP BY clip_no), nf AS (SELECT clip_no, count(*) FILTER (kind <> 'unclassified') AS n_found FROM found GROUP BY clip_no),
tally AS (SELECT c.clip_no, setting.tolerance, rule.strict, coalesce(tp, 0) AS tp, coalesce(n_labels, 0) AS nl, coalesce(n_found, 0) AS nf
  FROM (SELECT clip_no FROM nl UNION SELECT clip_no FROM nf) c CROSS JOIN setting CROSS JOIN rule LEFT JOIN nl ON nl.clip_no = c.clip_no LEFT JOIN nf ON nf.clip_no = c.clip_no
    LEFT JOIN hits ON hits.clip_no = c.clip_no AND hits.tolerance = setting.tolerance AND hits.strict = rule.strict)
SELECT clip_no, tolerance, CAST(tp AS BIGINT) AS tp, CAST(nf - tp AS BIGINT) AS fp, CAST(nl - tp AS BIGINT) AS fn, round(tp / nullif(nf, 0), 3) AS precision, round(tp / nullif(nl, 0), 3) AS recall, round(2.0 * tp / nullif(nl + nf, 0), 3) AS f1,
  CASE WHEN strict THEN 'ids' ELSE 'team' END AS criterion FROM tally"""


@query(FULL + TEAMS + EVENTS + SWEEP, recursive=True)
def d23_tolerance_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over tolerances and both criteria; possession and events are found once."""
    out = events.sweep(scene.event_labels(spark, sf_dir), found_events(spark, sf_dir), tuple((t, s) for t in (5, 10, 20) for s in (False, True)))
    return out.withColumn("criterion", F.when(F.col("strict"), "ids").otherwise("team")).drop("strict")


@query(FULL + TEAMS + """
, stepped AS (SELECT clip_no, frame_idx, holder, lag(holder) OVER w AS from_track_id, lag(frame_idx) OVER w AS last_frame FROM possession WHERE holder <> -1 WINDOW w AS (PARTITION BY clip_no ORDER BY frame_idx)),
gaps AS (SELECT CAST(unnest([10, 15, 30, 60, 120, 240]) AS INT) AS max_gap)
SELECT clip_no, max_gap, count(*) AS n_changes FROM stepped, gaps WHERE holder <> from_track_id AND frame_idx - last_frame <= max_gap GROUP BY clip_no, max_gap""")
def event_gap_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of holder under each limit of silence: found once with the largest, then counted."""
    gaps = [10, 15, 30, 60, 120, 240]
    changes = events.transitions(possessed(spark, sf_dir), max(gaps)).withColumn("gap", F.col("frame_idx") - F.col("last_frame"))
    each = changes.select("clip_no", F.explode(F.filter(F.array(*[F.lit(g) for g in gaps]), lambda g: g >= F.col("gap"))).alias("max_gap"))
    return each.groupBy("clip_no", "max_gap").agg(F.count("*").alias("n_changes"))


# --- F02-F05, E17, E18, B34: movement -------------------------------------------------------------------------------
PLACED = """
, placed AS (SELECT clip_no, frame_idx, track_id, (x1 + 30) / 50.0::DOUBLE AS x_m, (y1 + 150) / 50.0::DOUBLE AS y_m FROM scene_players WHERE (frame_idx + track_id * 3) % 41 >= 8),
lagged AS (SELECT *, frame_idx - lag(frame_idx) OVER w AS gap, lag(frame_idx) OVER w AS pf,
    sqrt((x_m - lag(x_m) OVER w) * (x_m - lag(x_m) OVER w) + (y_m - lag(y_m) OVER w) * (y_m - lag(y_m) OVER w)) AS step_m FROM placed WINDOW w AS (PARTITION BY clip_no, track_id ORDER BY frame_idx)),
summed AS (SELECT *, coalesce(sum(step_m) OVER w, 0) AS total_m, sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER w AS history FROM lagged WINDOW w AS (PARTITION BY clip_no, track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)),
moved AS (SELECT *, CASE WHEN gap <= 5 THEN sum(CASE WHEN gap <= 5 THEN step_m END) OVER r * 30.0::DOUBLE / greatest(1, frame_idx - min(CASE WHEN gap <= 5 THEN pf END) OVER r) END AS speed,
    coalesce(gap > 5, false) AS suppressed FROM summed WINDOW r AS (PARTITION BY clip_no, track_id, history ORDER BY frame_idx RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scene.players(spark, sf_dir).where("(frame_idx + track_id * 3) % 41 >= 8")
    return rows.selectExpr("clip_no", "frame_idx", "track_id", "(x1 + 30) / 50.0D as x_m", "(y1 + 150) / 50.0D as y_m")


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions, spread by their number; the count of frames is in the files' footers."""
    return kinematics.spread(placed(spark, sf_dir), scene.events(spark, sf_dir).count() * scene.PLAYERS)


@query(PLACED + "SELECT clip_no, frame_idx, track_id, gap, round(step_m, 4) AS step_m, round(total_m, 4) AS total_m, round(speed, 4) AS speed, suppressed FROM moved")
def f02_f04_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kinematics.kinematics(dealt(spark, sf_dir)), 4)


@query(PLACED + """SELECT clip_no, CASE WHEN grouping(clip_no) = 0 THEN count(DISTINCT track_id) END AS tracks, count(gap) AS displacements, count(speed) AS speeds, count(*) FILTER (suppressed) AS suppressed_rows,
  round(count(speed) / nullif(count(gap), 0), 6) AS rate FROM moved GROUP BY ROLLUP (clip_no)""")
def e17_movement_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.totals(kinematics.kinematics(dealt(spark, sf_dir)))


@query(PLACED + "SELECT clip_no, track_id, round(max(total_m), 4) AS distance_m, count(*) AS sightings FROM moved GROUP BY clip_no, track_id")
def e18_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.distances(kinematics.kinematics(dealt(spark, sf_dir)))


@query("""
, gap AS (SELECT clip_no, frame_idx, frame_idx - row_number() OVER (PARTITION BY clip_no ORDER BY frame_idx) AS island FROM scene_frames WHERE et = 'error')
SELECT clip_no, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS length FROM gap GROUP BY clip_no, island""")
def f05_ball_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of frames without a ball."""
    return kinematics.runs(scene.frames(spark, sf_dir), F.col("et") == "error")


@query("""
, gap AS (SELECT clip_no, frame_idx - row_number() OVER (PARTITION BY clip_no ORDER BY frame_idx) AS island FROM scene_frames WHERE et = 'error'),
len AS (SELECT count(*) AS n FROM gap GROUP BY clip_no, island)
SELECT CAST(CASE WHEN n <= 0 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 5 THEN 2 WHEN n <= 10 THEN 3 WHEN n <= 20 THEN 4 ELSE 5 END AS INT) AS bin, count(*) AS n_runs FROM len GROUP BY 1""")
def b34_gap_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = kinematics.runs(scene.frames(spark, sf_dir), F.col("et") == "error")
    return runs.groupBy(cut(F.col("length"), [-1, 0, 2, 5, 10, 20, 999]).alias("bin")).agg(F.count("*").alias("n_runs"))


@query(FULL + """
, real AS (SELECT clip_no, frame_idx, holder FROM possession WHERE holder <> -1),
side AS (SELECT f.clip_no, f.frame_idx, (SELECT max(frame_idx) FROM real r WHERE r.clip_no = f.clip_no AND r.frame_idx <= f.frame_idx) AS a, (SELECT min(frame_idx) FROM real r WHERE r.clip_no = f.clip_no AND r.frame_idx >= f.frame_idx) AS b FROM scene_frames f)
SELECT s.clip_no, s.frame_idx, CASE WHEN b IS NULL OR frame_idx - a <= b - frame_idx THEN a ELSE b END AS nearest FROM side s WHERE a IS NOT NULL OR b IS NOT NULL""")
def d15_nearest_held_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each frame the nearest frame with a holder, the earlier on a tie: two windows instead of a join."""
    from pyspark.sql import Window

    w = Window.partitionBy("clip_no").orderBy("frame_idx")
    own = F.when(F.col("holder") != -1, F.col("frame_idx"))
    rows = possessed(spark, sf_dir).select("clip_no", "frame_idx", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("a"), F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("b"))
    pick = F.when(F.col("b").isNull() | (F.col("frame_idx") - F.col("a") <= F.col("b") - F.col("frame_idx")), F.col("a")).otherwise(F.col("b"))
    return rows.select("clip_no", "frame_idx", pick.alias("nearest")).where("nearest is not null")
