"""Folders and snapshots that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without one gets a folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cuelake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/cuelake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and a lost executor costs no recomputation."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Jobs of neighbouring ids that share a partition of the stored tracks.
TOGETHER = 1000


def write_tracks(cues: DataFrame, path: str) -> None:
    """Tracks by language and range of jobs (jobs, TOGETHER of them); only tracks (lang, job_id) that cues holds are replaced, so a job's new run leaves the others as they are.

    The other tracks of the ranges that are touched are written again with the new ones, so there are as many folders as ranges,
    not as jobs, and only one writer may work on a range at a time.
    """
    spark, jobs = cues.sparkSession, F.floor(F.col("job_id") / TOGETHER).alias("jobs")
    new = cues.select("*", jobs)
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:  # nothing there yet
        stored = None
    if stored is not None:
        new = written(new, "tracks")
        tracks = written(new.select("lang", "jobs", "job_id").distinct(), "tracks")
        stored = stored.withColumn("lang", F.col("lang").cast(new.schema["lang"].dataType))
        same = lambda t, *keys: reduce(Column.__and__, [stored[k].eqNullSafe(t[k]) for k in keys])
        ranges = tracks.select("lang", "jobs").distinct()
        others = stored.join(ranges, same(ranges, "lang", "jobs"), "left_semi").join(tracks, same(tracks, "lang", "job_id"), "left_anti")
        new = written(new.unionByName(others.select(*new.columns)), "tracks")
    new.repartition("lang", "jobs").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang", "jobs").parquet(path)


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the changes' rows in place of those with the same keys, or added: the new snapshot of a merge."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def latest(log: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def beyond_retention(snapshots: DataFrame, by: str, name: str, keep: int) -> DataFrame:
    """Snapshots to delete: all but the newest `keep` of each table, by name."""
    w = Window.partitionBy(by).orderBy(F.desc(name))
    return snapshots.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > keep).drop("_n")


def copy_missing(source: DataFrame, target: DataFrame, key: str, force: bool = False) -> DataFrame:
    """The target after a copy that keeps ids: rows that it has stay as they are, or with force give way."""
    if force:
        return upserted(target, source, [key])
    return target.unionByName(source.join(target.select(key), key, "left_anti"))
