"""Progress of jobs and tracks, the request queue, and the tables of a dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.sources import storage


def job_progress(cues: DataFrame) -> DataFrame:
    counts = cues.groupBy("job_id").agg(F.count("*").alias("n_total"), F.count_if("reviewed").alias("n_reviewed"))
    return counts.withColumn("complete", (F.col("n_total") > 0) & (F.col("n_total") == F.col("n_reviewed")))


def track_progress(cues: DataFrame, forked: DataFrame, renditions: DataFrame) -> DataFrame:
    """One row per job and language: a forked track counts its own cues; an inherited one its renditions, against the source's cues."""
    own = forked.groupBy("job_id", "lang").agg(F.count("*").alias("n_rows"), F.count_if("reviewed").alias("n_reviewed")).withColumns({"n_total": F.col("n_rows"), "is_forked": F.lit(True)})
    totals = cues.groupBy("job_id").agg(F.count("*").alias("n_total"))
    inherited = renditions.groupBy("job_id", "lang").agg(F.count("*").alias("n_rows"), F.count_if("reviewed").alias("n_reviewed")).join(own.select("job_id", "lang"), ["job_id", "lang"], "left_anti").join(totals, "job_id").withColumn("is_forked", F.lit(False))
    return own.unionByName(inherited).withColumn("complete", (F.col("n_total") > 0) & (F.col("n_reviewed") == F.col("n_total")))


def job_list(media: DataFrame, cues: DataFrame, tracks: DataFrame, running: DataFrame) -> DataFrame:
    """A dashboard row per job that is no clone: progress, its languages, and whether a request for it is running."""
    languages = tracks.groupBy("job_id").agg(F.array_join(F.sort_array(F.collect_list("lang")), ",").alias("languages"))
    busy = running.select("job_id").distinct().withColumn("running", F.lit(True))
    rows = media.filter("NOT is_clone").join(job_progress(cues), "job_id", "left").join(languages, "job_id", "left").join(busy, "job_id", "left")
    return rows.select("job_id", "title", "assignee", "practice", "created", F.coalesce("n_total", F.lit(0)).alias("n_total"), F.coalesce("n_reviewed", F.lit(0)).alias("n_reviewed"), F.coalesce("complete", F.lit(False)).alias("complete"), F.coalesce("languages", F.lit("")).alias("languages"), F.coalesce("running", F.lit(False)).alias("running"))


def fleet_totals(media: DataFrame, cues: DataFrame, tracks: DataFrame) -> DataFrame:
    """Totals over all jobs that are neither practice nor clones, with whole percentages (half up)."""
    real = media.filter("NOT practice AND NOT is_clone").select("job_id")
    a = cues.join(real, "job_id", "left_semi").agg(F.count("*").alias("n_cues"), F.count_if("reviewed").alias("n_reviewed"))
    b = tracks.join(real, "job_id", "left_semi").agg(F.sum("n_total").alias("_t"), F.sum("n_reviewed").alias("_r"))
    percent = lambda part, whole: F.when(F.col(whole) > 0, F.floor((F.col(part) * 200 + F.col(whole)) / (F.col(whole) * 2))).otherwise(0)
    return a.crossJoin(F.broadcast(b)).select("n_cues", "n_reviewed", (F.col("n_cues") - F.col("n_reviewed")).alias("n_remaining"), percent("n_reviewed", "n_cues").alias("text_percent"), percent("_r", "_t").alias("translation_percent"))


def queue_places(requests: DataFrame, groups: int = 64) -> DataFrame:
    """Requests that aren't done, with their group's rank (processing, pending, error) and, if pending, their place in the queue.

    Places in one queue are a global order: requests are sorted by range into parts, numbered inside, and shifted by the sizes of the parts before.
    """
    open_ = requests.filter("status <> 'done'").withColumn("group_rank", F.expr("CASE status WHEN 'processing' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END"))
    pending = open_.filter("status = 'pending'").withColumn("_part", F.floor(F.unix_seconds(F.col("created_at").cast("timestamp")) / 86_400))
    sizes = pending.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = pending.join(offsets, "_part").select("request_id", (F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("created_at", "request_id"))).alias("place"))
    return open_.select("request_id", "status", "group_rank").join(placed, "request_id", "left")


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with place, 1 to n in the order given (which should have no ties): sorted in parts by range, written so that the parts stay as they are, numbered inside, and shifted by the sizes of the parts before."""
    spark, folder = rows.sparkSession, storage.fresh_folder(rows.sparkSession, "numbered")
    rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(folder)
    laid = spark.read.parquet(folder).withColumn("_part", F.shiftright("_id", 33))
    sizes = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return laid.join(offsets, "_part").withColumn("place", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_part", "_before")


def resume_target(jobs: DataFrame) -> DataFrame:
    """The unfinished job to go on with: most progress first, then newest."""
    share = F.col("n_reviewed") / F.greatest("n_total", F.lit(1))
    return jobs.filter("NOT complete AND n_reviewed > 0").orderBy(share.desc(), F.desc("created"), "job_id").limit(1)


def counters(cues: DataFrame) -> DataFrame:
    """What an editor shows of each job: reviewed, remaining, held back, whole percent."""
    held = F.col("hold") & ~F.col("reviewed")
    return cues.groupBy("job_id").agg(F.count_if("reviewed").alias("reviewed"), F.count_if(~F.col("reviewed")).alias("remaining"), F.count_if(held).alias("held"), F.floor(F.count_if("reviewed") * 100 / F.count("*")).alias("percent"))
