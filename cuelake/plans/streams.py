"""Streaming queries: the request queue, its monitors, and built-in event-time operators as an extension."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from cuelake.plans import fixtures as X
from cuelake.plans.registry import query
from cuelake.sources.storage import fresh_folder
from cuelake.streaming import queue

MICROS = "epoch_us(ts)"


def stream(spark, sf_dir):
    schema = X.table(spark, sf_dir, "events").schema
    return queue.read_log(spark, sf_dir, "events.parquet", schema)


def requests(spark, sf_dir):
    return X.shaped(stream(spark, sf_dir), X.REQUEST)


@query("r1_r5_queue_drained", f"SELECT request_id, CASE WHEN value IS NULL OR value < 1 THEN 'error' ELSE 'done' END AS status FROM {X.REQUESTS_SQL} WHERE status = 'pending'")
def r1_r5_queue_drained(spark, sf_dir):
    return queue.drained(requests(spark, sf_dir), queue.handled, "queue").select("request_id", "status")


#: A worker for each of eight groups of videos; a run takes as many minutes as its value says.
LANES = {"lane": "video % 8", "request_id": "request_id", "status": "status", "created_at": "created_at", "run_us": "cast(floor(coalesce(value, 0)) as bigint) * 60000000", "code": "case when value is null or value < 1 then 1 else 0 end"}
LANES_SQL = X.sql(LANES, X.REQUESTS_SQL, "status IN ('pending', 'processing')")


def request_files(spark, sf_dir, parts: int = 6) -> tuple[str, int]:
    """Requests as a folder of files: each part of the time in files of its own, but for every third request, which comes a part late. And the seconds of a part.

    A part may have many files, read one after another: a late request can come after one that is all but two parts younger.
    """
    rows, folder = X.shaped(X.requests(spark, sf_dir), LANES), fresh_folder(spark, "requests")
    low, high = rows.agg(F.min("created_at"), F.max("created_at")).first()
    if low is None:
        rows.write.parquet(f"{folder}/0")
        return folder, 1
    seconds = int((high - low).total_seconds()) // parts + 1
    at = F.floor((F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp"))) / (seconds * 1_000_000)) + F.when(F.col("request_id") % 3 == 0, 1).otherwise(0)
    dealt = fresh_folder(spark, "parts")
    rows.withColumn("part", at).write.partitionBy("part").parquet(dealt)
    dealt = spark.read.schema(rows.withColumn("part", at).schema).parquet(dealt)
    for part in range(parts + 1):
        dealt.filter(F.col("part") == part).drop("part").write.parquet(f"{folder}/{part}")
    tick = spark.createDataFrame([(-1, high + timedelta(seconds=3 * seconds))], "lane long, created_at timestamp")
    tick.select("lane", F.lit(None).cast("long").alias("request_id"), F.lit(None).cast("string").alias("status"), F.col("created_at").cast(rows.schema["created_at"].dataType).alias("created_at"), F.lit(0).cast("long").alias("run_us"), F.lit(0).alias("code")).write.parquet(f"{folder}/{parts + 1}")
    return folder, seconds


@query("r1_ordered_release", f"""WITH q AS (SELECT *, epoch_us(created_at) AS c FROM {LANES_SQL}), s AS (SELECT *, coalesce(sum(run_us) OVER (PARTITION BY lane ORDER BY c, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
f AS (SELECT *, (before + max(c - before) OVER w)::BIGINT AS started_us, row_number() OVER w - 1 AS seq FROM s WINDOW w AS (PARTITION BY lane ORDER BY c, request_id ROWS UNBOUNDED PRECEDING))
SELECT lane, seq, request_id, status = 'processing' AS reclaimed, started_us, started_us + run_us AS ended_us, CASE WHEN code = 0 THEN 'done' ELSE 'error' END AS status, CASE WHEN code = 0 THEN '' ELSE 'exit ' || code END AS note FROM f""")
def r1_ordered_release(spark, sf_dir):
    """Requests taken oldest first, one at a time by each worker, from files that bring them out of order; those that a dead worker left behind queue again."""
    folder, seconds = request_files(spark, sf_dir)
    schema = spark.read.option("recursiveFileLookup", "true").parquet(folder).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 8).parquet(folder)
    done = queue.worked(queue.released(stream, f"{2 * seconds} seconds"), fresh_folder(spark, "worker"), lambda claimed: claimed)
    return done.select("lane", "seq", "request_id", "reclaimed", "started_us", "ended_us", "status", "note")


@query("r2_throttled_beats", f"""WITH RECURSIVE b AS (SELECT video, epoch_us(created_at) AS t FROM {X.REQUESTS_SQL}), r(video, micros) AS (SELECT video, min(t) FROM b GROUP BY video UNION ALL SELECT r.video, min(b.t) FROM r JOIN b ON b.video = r.video AND b.t >= r.micros + 3600000000 GROUP BY r.video, r.micros)
SELECT video, micros FROM r""")
def r2_throttled_beats(spark, sf_dir):
    beats = queue.throttled_beats(requests(spark, sf_dir), "video", 3600)
    return queue.drained(beats, lambda b: b, "beats").select("video", "micros")


@query("r3_stalled", f"SELECT video, max(epoch_us(created_at)) AS last_seen, (SELECT max(epoch_us(created_at)) FROM {X.REQUESTS_SQL}) - max(epoch_us(created_at)) > 150000000 AS stalled FROM {X.REQUESTS_SQL} GROUP BY video")
def r3_stalled(spark, sf_dir):
    seen = requests(spark, sf_dir).groupBy("video").agg(F.max(F.unix_micros(F.col("created_at").cast("timestamp"))).alias("last_seen"))
    last = queue.latest_state(seen, ["video", "last_seen"], "seen")
    return last.crossJoin(F.broadcast(last.agg(F.max("last_seen").alias("_now")))).select("video", "last_seen", (F.col("_now") - F.col("last_seen") > 150_000_000).alias("stalled"))


@query("r4_reclaimed", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status FROM {X.REQUESTS_SQL}) GROUP BY status")
def r4_reclaimed(spark, sf_dir):
    return queue.reclaimed(X.requests(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query("ext_stream_window_counts", f"SELECT {MICROS} // 3600000000 * 3600000000 AS from_micros, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_stream_window_counts(spark, sf_dir):
    """Extension: counts in event-time windows of an hour."""
    ts = stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    agg = ts.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("from_micros"), "event_type", "n")
    return queue.latest_state(agg, ["from_micros", "event_type", "n"], "windows")


@query("ext_session_windows", f"WITH e AS (SELECT user_id, {MICROS} AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, min(t) AS from_micros, count(*) AS n FROM s GROUP BY user_id, s")
def ext_session_windows(spark, sf_dir):
    """Extension: sessions without a pause of half an hour."""
    events = X.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("from_micros"), "n")


@query("ext_stream_first_events", "SELECT count(DISTINCT user_id) AS n FROM events")
def ext_stream_first_events(spark, sf_dir):
    """Extension: the stream without repeats of a user."""
    first = stream(spark, sf_dir).select("user_id").dropDuplicates(["user_id"])
    return queue.drained(first, lambda b: b, "first").agg(F.count("*").alias("n"))
