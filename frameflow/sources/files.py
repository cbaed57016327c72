"""File formats: box annotations, pose and box labels, seed boxes, events, label stores, result tables, images.

Readers go through Spark's own readers with a declared schema, so that any store Spark can open will do. Malformed rows are
errors with the offending text, never silently dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns of the box annotation format, of the label stores and of raw predictions.
MOT = "frame string, id string, left string, top string, width string, height string, conf string, x string, y string, z string"
POSSESSION_LABEL = "clip string, frame_idx int, holder string, labelled_at string"
TEAM_LABEL = "clip string, frame_idx int, player_id int, true_team string, labelled_at string"
VERDICT = "clip string, frame_idx int, keypoint_index int, verdict string, actual_index string, confidence double, labelled_at string"
EVENT_LABEL = "clip string, event_id string, event_type string, start_frame string, end_frame string, from_track_id string, to_track_id string, from_team string, to_team string, notes string"
PREDICTION = "clip string, frame_idx int, player_id int, predicted_team int, confidence double, crop_ok boolean"
LANDMARKS = 18


def checked(ok: Column, what: str, row: Column) -> Column:
    """The row's text where the check holds; an error that names it where not."""
    return F.when(ok, row).otherwise(F.raise_error(F.concat(F.lit(what + ": "), row)))


def sound(ok: Column, what: str, row: Column) -> Column:
    """True where the check holds; an error with the row's text, which is made only then, where not."""
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(what + ": "), row)).cast("boolean"))


def read_mot(spark: SparkSession, path: str) -> DataFrame:
    """Frames from 1 and left/top/width/height to frames from 0 and corners. Blank lines are skipped; a wrong number of
    fields, a non-number, a frame below 1 or a size of 0 or less is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.split("value", ",").alias("f"))
    # a column for each field: lambdas over arrays are interpreted, value by value
    fields = lines.select("value", F.size("f").alias("size"), *[F.get("f", F.lit(i)).try_cast("double").alias(f"n{i}") for i in range(10)])
    n = lambda i: F.col(f"n{i}")
    ok = (F.col("size") == 10) & (n(0) >= 1) & (n(4) > 0) & (n(5) > 0)
    for i in range(10):
        ok = ok & n(i).isNotNull()
    good = fields.where(sound(F.coalesce(ok, F.lit(False)), "malformed annotation", F.col("value")))
    return good.select((n(0) - 1).cast("int").alias("frame_idx"), n(1).cast("int").alias("track_id"), n(2).alias("x1"), n(3).alias("y1"), (n(2) + n(4)).alias("x2"), (n(3) + n(5)).alias("y2"))


def decimals(c: Column, places: int = 6) -> Column:
    """The number with so many decimals, exact halves to the even digit."""
    return F.bround(c.cast("decimal(30,15)"), places).cast("string")


def mot_lines(boxes: DataFrame, *keep: str) -> DataFrame:
    """The inverse, one text line for each box; every box is checked before any is written."""
    row = F.to_json(F.struct("frame_idx", "track_id", "x1", "y1", "x2", "y2"))
    good = F.coalesce((F.col("frame_idx") >= 0) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    # whole numbers, as most are, need no decimals
    number = lambda c: F.when(c == c.try_cast("long"), c.try_cast("long").cast("string")).otherwise(F.regexp_replace(decimals(c), r"\.?0+$", ""))
    line = F.concat_ws(",", (F.col("frame_idx") + 1).cast("string"), F.col("track_id").cast("string"), number(F.col("x1")), number(F.col("y1")), number(F.col("x2") - F.col("x1")), number(F.col("y2") - F.col("y1")), F.lit("1,-1,-1,-1"))
    return boxes.select(F.when(sound(good, "degenerate box", row), line).alias("value"), *keep)


def write_mot(boxes: DataFrame, path: str) -> None:
    lines = mot_lines(boxes)
    lines.agg(F.count("value")).collect()
    lines.write.mode("overwrite").text(path)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of all rows with the same keys the one that came last."""
    n = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(n)).where("_n = 1").drop("_n")


def read_labels(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """An append-only label store: later rows win; the order is that of files and of rows in them."""
    rows = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")
    numbered = rows.select("*", F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_seq"))
    return last_wins(numbered, keys, "_seq").drop("_seq")


def append_labels(rows: DataFrame, path: str, allowed: Column) -> None:
    """Adds rows to a store; a row outside the domain is an error and nothing is written."""
    if rows.where(~F.coalesce(allowed, F.lit(False))).limit(1).count():
        raise ValueError("a label is outside its domain")
    rows.write.mode("append").csv(path, header=True)


def read_event_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled events; a byte order mark before the first column is part of no value, and frames must be numbers."""
    rows = spark.read.schema(EVENT_LABEL).csv(path, header=True, enforceSchema=True, encoding="UTF-8", mode="FAILFAST")
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.raise_error(F.concat(F.lit(f"{c} is not a number: "), F.coalesce(F.col(c), F.lit("null")))).cast("int"))
    return rows.withColumns({"clip": F.regexp_replace("clip", "^﻿", ""), "event_id": number("event_id"), "start_frame": number("start_frame"), "end_frame": number("end_frame")})


def pose_label(line: Column, width: Column, height: Column) -> Column:
    """A pose label line (class, box, 18 times x y visibility, as shares of the image) to an array of visible points in pixels."""
    f = F.transform(F.split(F.trim(line), r"\s+"), lambda x: x.cast("double"))
    enough = F.when(F.size(f) >= 5 + 3 * LANDMARKS, f).otherwise(F.raise_error(F.concat(F.lit("short pose label: "), line)).cast("array<double>"))
    point = lambda e, i: F.struct(i.alias("idx"), (F.element_at(e, 6 + 3 * i) * width).alias("x"), (F.element_at(e, 7 + 3 * i) * height).alias("y"), F.element_at(e, 8 + 3 * i).cast("int").alias("v"))
    # the line is split once, as the one element of an array, and not again for each number
    points = F.transform(F.array(enough), lambda e: F.transform(F.sequence(F.lit(0), F.lit(LANDMARKS - 1)), lambda i: point(e, i)))
    return F.filter(F.element_at(points, 1), lambda p: p["v"] >= 1)


def first_line(text: Column) -> Column:
    """The first line that is not blank."""
    return F.try_element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(1))


def clamped_label(line: Column) -> Column:
    """Class and visibilities as they are, places clamped to 0..1, ten significant digits."""
    f = F.split(F.trim(line), r"\s+")
    keep = lambda i: (i == 0) | ((i >= 5) & ((i - 5) % 3 == 2))
    number = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double")))
    return F.array_join(F.transform(f, lambda v, i: F.when(keep(i), v).otherwise(F.regexp_replace(F.format_string("%.10f", number(v)), r"\.?0+$", ""))), " ")


def detect_boxes(text: Column) -> Column:
    """The boxes of a detection label file (a line each: class and four shares of the image), in order; blank lines are none, a line of other
    than five numbers is an error."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    row = lambda x: F.split(x, r"\s+")
    number = lambda x, i: row(x)[i].cast("double")
    sound = lambda x: F.when(F.size(row(x)) == 5, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed label line: "), x)).cast("boolean"))
    return F.transform(F.filter(lines, sound), lambda x: F.struct(row(x)[0].cast("int").alias("class"), *[number(x, i + 1).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))]))


def detect_text(boxes: Column) -> Column:
    """The text of such a file, six decimals a number."""
    return F.array_join(F.transform(boxes, lambda b: F.concat_ws(" ", b["class"].cast("string"), *[decimals(b[c]) for c in ("cx", "cy", "w", "h")])), "\n")


def seed_boxes(text: Column) -> Column:
    """{"frame": [[x1, y1, x2, y2], ...]} as a map."""
    return F.from_json(text, "map<string,array<array<double>>>")


def seed_rows(texts: DataFrame, column: str = "value") -> DataFrame:
    exploded = texts.select(F.explode(seed_boxes(F.col(column))).alias("frame", "boxes")).select(F.col("frame").cast("int").alias("frame_idx"), F.posexplode("boxes").alias("place", "b"))
    return exploded.select("frame_idx", "place", *[F.col("b")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def seed_text(rows: DataFrame) -> DataFrame:
    boxes = rows.groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("place", F.array("x1", "y1", "x2", "y2").alias("b")))).alias("s"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("frame_idx").cast("string").alias("k"), F.transform("s", lambda x: x["b"]).alias("v"))))
    return boxes.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def read_manifest(spark: SparkSession, manifest: str, root: str) -> DataFrame:
    """Prediction files named by a manifest (method, variant, crop_fraction, clip, path), usable crops only, each row with its file's arm."""
    arms = spark.read.csv(manifest, header=True, schema="method string, variant string, crop_fraction double, clip string, path string")
    names = arms.select(F.element_at(F.split("path", "/"), -1).alias("file"), "method", "variant", "crop_fraction")
    rows = spark.read.schema(PREDICTION).csv(root, header=True, pathGlobFilter="*.csv", mode="FAILFAST").where("crop_ok")
    return rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).join(names, "file").drop("file", "crop_ok")


def stripped(rows: DataFrame) -> DataFrame:
    """Headers and text values without the blanks around them."""
    out = rows.toDF(*[c.strip() for c in rows.columns])
    return out.select(*[F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in out.dtypes])


def need(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows; an error that names the columns that are missing."""
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return rows


def switch_sets(spark: SparkSession, path: str) -> DataFrame:
    """Switch events (clip, frame_idx, setting), one row each, to the sorted set of settings of each frame."""
    rows = spark.read.schema("clip string, frame_idx int, setting string").csv(path, header=True, mode="FAILFAST")
    return rows.groupBy("clip", "frame_idx").agg(F.array_join(F.array_sort(F.collect_set("setting")), ", ").alias("settings"))


def union_rows(parts: list[DataFrame]) -> DataFrame | None:
    """Tables of different columns one after another, columns in the order first seen, missing values null; None for no part."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def write_result(rows: DataFrame, path: str) -> bool:
    """A result table as CSV with a header; nothing is written if there are no rows."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").csv(path, header=True)
    return True


def image_files(spark: SparkSession, root: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """Images below a folder in path order, with their label's path; contents are read only where asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    label = F.regexp_replace(F.regexp_replace("path", "/images/", "/labels/"), r"\.[^.]+$", ".txt")
    return files.select("path", label.alias("label_path"), F.col("length").alias("n_bytes"), "content").orderBy("path")


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))
