"""Queries of dashboards, queues, sorting, sampling and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.operators import progress
from cuelake.plans import fixtures as X
from cuelake.plans.registry import query

A1 = f"(SELECT job_id, count(*) AS n_total, count(*) FILTER (reviewed) AS n_reviewed, count(*) = count(*) FILTER (reviewed) AS complete FROM {X.CUES_SQL} GROUP BY job_id)"
OWN = f"(SELECT job_id, lang, count(*) AS n_rows, count(*) FILTER (reviewed) AS n_reviewed, count(*) AS n_total, true AS is_forked FROM {X.FORKED_SQL} GROUP BY ALL)"
TRACKS = f"""(SELECT *, n_total > 0 AND n_reviewed = n_total AS complete FROM (SELECT * FROM {OWN} UNION ALL SELECT r.job_id, r.lang, count(*) AS n_rows, count(*) FILTER (r.reviewed) AS n_reviewed, any_value(t.n_total) AS n_total, false AS is_forked
  FROM {X.RENDITIONS_SQL} r JOIN {A1} t ON t.job_id = r.job_id WHERE NOT EXISTS (SELECT 1 FROM {OWN} o WHERE o.job_id = r.job_id AND o.lang = r.lang) GROUP BY r.job_id, r.lang))"""


def tracks(spark, sf_dir):
    return progress.track_progress(X.cues(spark, sf_dir), X.forked(spark, sf_dir), X.renditions(spark, sf_dir))


@query("a1_job_progress", f"SELECT * FROM {A1}")
def a1_job_progress(spark, sf_dir):
    return progress.job_progress(X.cues(spark, sf_dir))


@query("a2_track_progress", f"SELECT * FROM {TRACKS}")
def a2_track_progress(spark, sf_dir):
    return tracks(spark, sf_dir)


RUNNING = f"(SELECT DISTINCT video % 100 AS job_id FROM {X.REQUESTS_SQL} WHERE status = 'pending' AND request_id % 3 = 0)"
A3 = f"""(SELECT m.job_id, title, assignee, practice, created, coalesce(n_total, 0) AS n_total, coalesce(n_reviewed, 0) AS n_reviewed, coalesce(complete, false) AS complete, coalesce(languages, '') AS languages, r.job_id IS NOT NULL AS running
FROM {X.MEDIA_SQL} m LEFT JOIN {A1} p ON p.job_id = m.job_id LEFT JOIN (SELECT job_id, string_agg(lang, ',' ORDER BY lang) AS languages FROM {TRACKS} GROUP BY job_id) l ON l.job_id = m.job_id LEFT JOIN {RUNNING} r ON r.job_id = m.job_id WHERE NOT is_clone)"""


def jobs(spark, sf_dir):
    running = X.requests(spark, sf_dir).filter("status = 'pending' AND request_id % 3 = 0").selectExpr("video % 100 AS job_id")
    return progress.job_list(X.media(spark, sf_dir), X.cues(spark, sf_dir), tracks(spark, sf_dir), running)


@query("a3_job_list", f"SELECT * FROM {A3}")
def a3_job_list(spark, sf_dir):
    return jobs(spark, sf_dir)


@query("a4_fleet_totals", f"""WITH real AS (SELECT job_id FROM {X.MEDIA_SQL} WHERE NOT practice AND NOT is_clone), a AS (SELECT count(*) AS n, count(*) FILTER (reviewed) AS r FROM {X.CUES_SQL} WHERE job_id IN (SELECT job_id FROM real)), b AS (SELECT sum(n_total)::BIGINT AS t, sum(n_reviewed)::BIGINT AS r FROM {TRACKS} WHERE job_id IN (SELECT job_id FROM real))
SELECT a.n AS n_cues, a.r AS n_reviewed, a.n - a.r AS n_remaining, (a.r * 200 + a.n) // (a.n * 2) AS text_percent, (b.r * 200 + b.t) // (b.t * 2) AS translation_percent FROM a, b""")
def a4_fleet_totals(spark, sf_dir):
    return progress.fleet_totals(X.media(spark, sf_dir), X.cues(spark, sf_dir), tracks(spark, sf_dir))


@query("a5_queue", f"SELECT request_id, status, CASE status WHEN 'processing' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END AS group_rank, CASE WHEN status = 'pending' THEN row_number() OVER (PARTITION BY status ORDER BY created_at, request_id) END AS place FROM {X.REQUESTS_SQL} WHERE status <> 'done'")
def a5_queue(spark, sf_dir):
    return progress.queue_places(X.requests(spark, sf_dir))


@query("a11_reductions", f"SELECT job_id, sum(end_ms - start_ms)::BIGINT AS total_ms, min(start_ms) AS first_ms, max(end_ms) AS last_ms, sum(end_ms - start_ms)::BIGINT // count(*) AS mean_ms FROM {X.CUES_SQL} GROUP BY job_id")
def a11_reductions(spark, sf_dir):
    d = F.col("end_ms") - F.col("start_ms")
    return X.cues(spark, sf_dir).groupBy("job_id").agg(F.sum(d).alias("total_ms"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.floor(F.sum(d) / F.count("*")).alias("mean_ms"))


@query("a13_languages", f"SELECT DISTINCT lang, is_forked FROM {TRACKS}")
def a13_languages(spark, sf_dir):
    return tracks(spark, sf_dir).select("lang", "is_forked").distinct()


@query("a14_phase_stats", f"SELECT phase, sum(n)::BIGINT AS n FROM (SELECT 'extract' AS phase, count(*) AS n FROM {X.CUES_SQL} WHERE reviewed UNION ALL SELECT 'repair', count(*) FROM {X.CUES_SQL} WHERE uncertain UNION ALL SELECT 'extract', count(*) FROM {X.RENDITIONS_SQL} WHERE edited) GROUP BY phase")
def a14_phase_stats(spark, sf_dir):
    cues = X.cues(spark, sf_dir)
    one = lambda df, phase: df.agg(F.count("*").alias("n")).select(F.lit(phase).alias("phase"), "n")
    return one(cues.filter("reviewed"), "extract").union(one(cues.filter("uncertain"), "repair")).union(one(X.renditions(spark, sf_dir).filter("edited"), "extract")).groupBy("phase").agg(F.sum("n").alias("n"))


@query("a15_editor_counters", f"SELECT job_id, count(*) FILTER (reviewed) AS reviewed, count(*) FILTER (NOT reviewed) AS remaining, count(*) FILTER (hold AND NOT reviewed) AS held, count(*) FILTER (reviewed) * 100 // count(*) AS percent FROM {X.CUES_SQL} GROUP BY job_id")
def a15_editor_counters(spark, sf_dir):
    return progress.counters(X.cues(spark, sf_dir))


@query("w10_resume", f"SELECT job_id FROM {A3} WHERE NOT complete AND n_reviewed > 0 ORDER BY n_reviewed / greatest(n_total, 1) DESC, created DESC, job_id LIMIT 1")
def w10_resume(spark, sf_dir):
    return progress.resume_target(jobs(spark, sf_dir)).select("job_id")


@query("f11_job_search", f"SELECT job_id FROM {A3} WHERE (contains(title, '3') OR contains(assignee, '3')) AND NOT complete AND contains(',' || languages || ',', ',fr,')")
def f11_job_search(spark, sf_dir):
    return jobs(spark, sf_dir).filter((F.contains("title", F.lit("3")) | F.contains("assignee", F.lit("3"))) & ~F.col("complete") & F.array_contains(F.split("languages", ","), "fr")).select("job_id")


@query("t1_sorted_jobs", f"SELECT job_id, row_number() OVER (ORDER BY complete, coalesce(nullif(assignee, ''), '~'), n_reviewed DESC, job_id) AS place FROM {A3}")
def t1_sorted_jobs(spark, sf_dir):
    order = ("complete", F.coalesce(F.nullif("assignee", F.lit("")), F.lit("~")), F.desc("n_reviewed"), "job_id")
    return progress.numbered(jobs(spark, sf_dir), *order).select("job_id", F.col("place").cast("int").alias("place"))


@query("t5_stratified_sample", f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY job_id ORDER BY idx) - 1 AS r, count(*) OVER (PARTITION BY job_id) AS n FROM {X.CUES_SQL}) WHERE r % greatest(1, n // 3) = 0 AND r // greatest(1, n // 3) < 3")
def t5_stratified_sample(spark, sf_dir):
    w = Window.partitionBy("job_id")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    return X.cues(spark, sf_dir).select("id", (F.row_number().over(w.orderBy("idx")) - 1).alias("r"), F.count("*").over(w).alias("n")).filter((F.col("r") % step == 0) & (F.floor(F.col("r") / step) < 3)).select("id")


@query("t6_pagination", f"SELECT id FROM {X.CUES_SQL} ORDER BY job_id, idx LIMIT 50 OFFSET 100")
def t6_pagination(spark, sf_dir):
    return X.cues(spark, sf_dir).orderBy("job_id", "idx").offset(100).limit(50).select("id")


@query("t7_set_difference", f"SELECT job_id FROM {X.CUES_SQL} EXCEPT SELECT job_id FROM {X.FORKED_SQL}")
def t7_set_difference(spark, sf_dir):
    return X.cues(spark, sf_dir).select("job_id").subtract(X.forked(spark, sf_dir).select("job_id"))


@query("t8_set_union", f"SELECT job_id FROM {X.RENDITIONS_SQL} UNION SELECT job_id FROM {X.FORKED_SQL}")
def t8_set_union(spark, sf_dir):
    return X.renditions(spark, sf_dir).select("job_id").union(X.forked(spark, sf_dir).select("job_id")).distinct()


@query("t9_token_difference", f"SELECT id, len(list_distinct(list_filter(list_filter(string_split(text_stt, ' '), lambda t: t <> ''), lambda t: NOT list_contains(string_split(text_caption, ' '), t)))) AS n_missing FROM {X.CUES_SQL}")
def t9_token_difference(spark, sf_dir):
    return X.cues(spark, sf_dir).select("id", F.size(F.array_except(F.array_remove(F.split("text_stt", " "), ""), F.split("text_caption", " "))).cast("long").alias("n_missing"))


@query("j5_missing_ids", f"SELECT id FROM {X.CUES_SQL} WHERE id NOT IN (SELECT cue_id FROM {X.RENDITIONS_SQL})")
def j5_missing_ids(spark, sf_dir):
    return X.cues(spark, sf_dir).join(X.renditions(spark, sf_dir).select(F.col("cue_id").alias("id")), "id", "left_anti").select("id")


@query("j4_f14_semi_join", f"SELECT id FROM {X.CUES_SQL} WHERE job_id IN (SELECT job_id FROM {X.FORKED_SQL} WHERE reviewed)")
def j4_f14_semi_join(spark, sf_dir):
    return X.cues(spark, sf_dir).join(X.forked(spark, sf_dir).filter("reviewed"), "job_id", "left_semi").select("id")


@query("j2_three_way_join", f"SELECT r.cue_id, r.lang, c.text_final AS source, r.text FROM {X.RENDITIONS_SQL} r JOIN {X.CUES_SQL} c ON c.id = r.cue_id JOIN {X.MEDIA_SQL} m ON m.job_id = c.job_id WHERE r.reviewed AND c.reviewed AND NOT m.practice")
def j2_three_way_join(spark, sf_dir):
    c = X.cues(spark, sf_dir).filter("reviewed").select(F.col("id").alias("cue_id"), "job_id", F.col("text_final").alias("source"))
    m = X.media(spark, sf_dir).filter("NOT practice").select("job_id")
    return X.renditions(spark, sf_dir).filter("reviewed").select("cue_id", "lang", "text").join(c, "cue_id").join(m, "job_id").select("cue_id", "lang", "source", "text")
