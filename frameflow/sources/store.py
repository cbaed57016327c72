"""Stored stage results with a fingerprint of what they depend on, and clip settings."""

from __future__ import annotations

import atexit
import json
import logging
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "_fingerprint"
LOG = logging.getLogger(__name__)


def workplace(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. A local session without it gets a temporary folder; a cluster without it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="frameflow-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where}/frameflow-scene-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def table(rows: DataFrame, tag: str) -> DataFrame:
    """rows written once and read again: what reads them several times does not repeat the work before. clear() deletes all of them."""
    path = workplace(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has stored by workplace(); results that still read it are lost."""
    p = spark._jvm.org.apache.hadoop.fs.Path(workplace(spark, "x")).getParent()
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fingerprint(stage: str, params: dict, upstream: dict | None = None) -> dict[str, str]:
    """What a stage's result depends on, each value as JSON text."""
    return {"stage": json.dumps(stage)} | {k: json.dumps(v, sort_keys=True) for k, v in params.items()} | {f"upstream.{k}": json.dumps(v, sort_keys=True) for k, v in (upstream or {}).items()}


def differences(wanted: dict[str, str], found: dict[str, str] | None) -> list[str]:
    """The keys that keep a stored result from being used; a result without fingerprint can't be checked."""
    if found is None:
        return ["no fingerprint"]
    return [f"{k}: wanted {v}, found {found.get(k)}" for k, v in wanted.items() if found.get(k) != v]


def save(rows: DataFrame, path: str, mark: dict[str, str]) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(json.dumps(mark, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{MARK}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str, mark: dict[str, str], schema: str) -> DataFrame | None:
    """The stored rows if every key asked for agrees, else None with the differences logged. Damaged rows are an error, not a miss. Stored rows take few bytes each, so a join
    must not take a table for small by its files: it is not broadcast unless asked for."""
    if not exists(spark, f"{path}/rows"):
        return None
    found = json.loads(spark.read.text(f"{path}/{MARK}").first()["value"]) if exists(spark, f"{path}/{MARK}") else None
    if why := differences(mark, found):
        LOG.warning("not used: %s: %s", path, "; ".join(why))
        return None
    rows = spark.read.parquet(f"{path}/rows")
    wanted = spark.createDataFrame([], schema).schema
    if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in wanted]:
        raise TypeError(f"stored rows of {path} have columns {rows.dtypes}")
    return rows.hint("merge")


def stage(spark: SparkSession, path: str, mark: dict[str, str], schema: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored result, or a new one that is stored."""
    rows = load(spark, path, mark, schema)
    if rows is None:
        save(make(), path, mark)
        rows = load(spark, path, mark, schema)
    return rows


def data_digest(rows: DataFrame) -> DataFrame:
    """One digest over all rows, whatever their order: the count and the sum of row hashes, hashed."""
    row = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("s")).select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), "s"), 256).alias("digest"))


def clip_settings(clips: DataFrame, defaults: dict[str, float], overrides: DataFrame) -> DataFrame:
    """Settings of each clip: the defaults under the clip's own (clip_no, key, value). An unknown key is an error."""
    spark = clips.sparkSession
    base = spark.createDataFrame(sorted(defaults.items()), "key string, base double")
    known = [k for k in sorted(defaults)]
    good = overrides.select("clip_no", F.when(F.col("key").isin(known), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("unknown setting: "), "key"))).alias("key"), "value")
    return clips.select("clip_no").distinct().crossJoin(F.broadcast(base)).join(good, ["clip_no", "key"], "left").select("clip_no", "key", F.coalesce("value", "base").alias("value"))


def required(settings: dict, key: str) -> dict:
    """A config must be a mapping with this key, and the key must have a value."""
    if not isinstance(settings, dict) or settings.get(key) is None:
        raise ValueError(f"the config has no {key}")
    return settings


def parsed_holder(answer: Column) -> Column:
    """A typed answer: nobody, unclear, a number without leading zeros, or null."""
    a = F.lower(F.trim(answer))
    digits = F.regexp_replace(a, r"^0+(?=[0-9])", "")
    return F.when(a.isin("n", "nobody"), "nobody").when(a.isin("u", "unclear"), "unclear").when(a.rlike("^[0-9]+$"), digits)
