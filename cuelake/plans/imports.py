"""Queries of imports, their undo, registration, annotations confirmed by hand and practice defects in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import imports
from cuelake.plans import fixtures as X
from cuelake.plans.cues import WORK
from cuelake.plans.registry import query



def new_cues(spark, sf_dir):
    return X.forked(spark, sf_dir).select("job_id", "id", "start_ms", "end_ms", "text")


@query("e11_import_preview", f"""WITH o AS (SELECT job_id, id, idx, reviewed, start_ms, {WORK} AS old FROM {X.CUES_SQL}), n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, id) AS no FROM {X.FORKED_SQL}),
s AS (SELECT n.job_id, n.no, first(n.start_ms || ':' || o.idx || ':' || left(o.old, 50) || ':' || left(n.text, 50) ORDER BY abs(o.start_ms - n.start_ms), o.idx) AS sample FROM n JOIN o ON o.job_id = n.job_id WHERE n.no <= 6 GROUP BY n.job_id, n.no),
t AS (SELECT job_id, count(*) AS n_old, count_if(reviewed)::BIGINT AS n_reviewed FROM o GROUP BY job_id), c AS (SELECT job_id, count(*) AS n_new FROM n GROUP BY job_id), l AS (SELECT job_id, string_agg(sample, '|' ORDER BY no) AS samples FROM s GROUP BY job_id)
SELECT job_id, coalesce(n_new, 0) AS n_new, n_old, n_reviewed, coalesce(samples, '') AS samples FROM t LEFT JOIN c USING (job_id) LEFT JOIN l USING (job_id)""")
def e11_import_preview(spark, sf_dir):
    out = imports.preview(new_cues(spark, sf_dir), X.cues(spark, sf_dir))
    lines = F.transform(F.coalesce("samples", F.array()), lambda s: F.concat_ws(":", s["start_ms"], s["idx"], s["old"], s["new"]))
    return out.select("job_id", "n_new", "n_old", "n_reviewed", F.array_join(lines, "|").alias("samples"))


def undone(spark, sf_dir):
    """A third of the jobs had their structure replaced, another third only texts filled in; both imports are undone."""
    old, renditions = X.cues(spark, sf_dir), X.renditions(spark, sf_dir)
    kind = F.col("job_id") % 3
    now = old.filter((kind == 2) | (kind == 1) & (F.col("idx") != 1) | (kind == 0) & (F.col("idx") % 2 == 0))
    now = now.withColumns({"id": F.when(kind == 0, F.col("id") + 500).otherwise(F.col("id")), "text_final": F.when(kind == 2, F.col("text_final")).otherwise("imported"), "reviewed": (kind != 2) | F.col("reviewed")})
    now_renditions = renditions.withColumn("cue_id", F.when(kind == 0, F.col("cue_id") + 500).otherwise(F.col("cue_id"))).filter("job_id % 3 > 0 OR cue_id % 2 = 0")
    jobs = old.select("job_id").distinct()
    backups = jobs.filter("job_id % 3 < 2").select("job_id", F.when(kind == 0, 2).otherwise(1).alias("version"), (F.col("job_id") * 1000 + 600).alias("next_id"))
    snapshot = imports.snapshot(old, renditions, backups)
    return imports.import_undone(now, now_renditions, backups, *snapshot)


PLACE = "job_id * 1000 + 599 + row_number() OVER (PARTITION BY job_id ORDER BY idx)"


@query("e12_undone_cues", f"SELECT job_id, CASE WHEN job_id % 3 = 0 THEN {PLACE} ELSE id END AS id, idx, text_final, reviewed FROM {X.CUES_SQL} WHERE job_id % 3 <> 1 OR idx <> 1")
def e12_undone_cues(spark, sf_dir):
    return undone(spark, sf_dir)[0].select("job_id", "id", "idx", "text_final", "reviewed")


@query("e12_undone_renditions", f"WITH c AS (SELECT id, CASE WHEN job_id % 3 = 0 THEN {PLACE} ELSE id END AS cue_id FROM {X.CUES_SQL}) SELECT c.cue_id, r.job_id, r.lang, r.text, r.reviewed, r.edited FROM {X.RENDITIONS_SQL} r JOIN c ON c.id = r.cue_id")
def e12_undone_renditions(spark, sf_dir):
    return undone(spark, sf_dir)[1].select("cue_id", "job_id", "lang", "text", "reviewed", "edited")


#: A conversation as a file: Hangul is put before some, others have no text, and every ninth video is known already.
FILE_TEXT = "case when conv_id % 5 = 0 then '  ' when conv_id % 2 = 0 then repeat('가', cast(length(text) as int)) || '  ' || text else text end"
FILES_SQL = X.sql({"video": "conv_id", "no": "turn", "start_ms": X.CUE["start_ms"], "end_ms": X.CUE["end_ms"], "text": FILE_TEXT}, "conversations")
LINES_SQL = rf"(SELECT * REPLACE (regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS text) FROM {FILES_SQL})"
JOBS_SQL = f"""(SELECT *, CASE WHEN n_cues = 0 THEN 'empty' WHEN hangul < latin THEN 'script' WHEN video % 9 = 0 THEN 'known' END AS refused FROM (SELECT video, count_if(text <> '')::BIGINT AS n_cues, sum(length(regexp_replace(text, '[^가-힣]', '', 'g'))) AS hangul,
sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS latin, last(end_ms ORDER BY start_ms, no) FILTER (text <> '') AS duration_ms FROM {LINES_SQL} GROUP BY video))"""


def registered(spark, sf_dir):
    files = X.shaped(X.table(spark, sf_dir, "conversations"), {"video": "conv_id", "no": "turn", "start_ms": X.CUE["start_ms"], "end_ms": X.CUE["end_ms"], "text": FILE_TEXT})
    return imports.registered(files, files.filter("video % 9 = 0").select("video"))


@query("e13_registered_jobs", f"SELECT video, refused, n_cues, duration_ms, CASE WHEN refused IS NULL THEN 'reviewing' END AS status, refused IS NULL AS timing_done FROM {JOBS_SQL}")
def e13_registered_jobs(spark, sf_dir):
    return registered(spark, sf_dir)[0]


@query("e13_registered_cues", f"SELECT video, row_number() OVER (PARTITION BY video ORDER BY start_ms, no) - 1 AS idx, start_ms, end_ms, text AS text_llm, text AS text_final, true AS reviewed FROM {LINES_SQL} WHERE text <> '' AND video IN (SELECT video FROM {JOBS_SQL} WHERE refused IS NULL)")
def e13_registered_cues(spark, sf_dir):
    return registered(spark, sf_dir)[1]


def confirmed_items(spark, sf_dir):
    cues = X.cues(spark, sf_dir).withColumns({
        "text_final": F.when(F.col("idx") % 4 == 0, F.concat(F.col("text_final"), F.lit(" 해탈은 해탈(解脫)과 해탈"))).otherwise(""),
        "text_llm": F.concat(F.lit("무상과 "), "text_llm"),
        "hints": F.expr("array(named_struct('reading', '해탈', 'discovered', true), named_struct('reading', '무상', 'discovered', idx % 3 = 0))"),
    })
    pairs = F.expr("stack(3, 1, '해탈', '解脫', '', 2, ' 무상 ', '無常', '', 3, '없음', '無', '')").alias("no", "reading", "hanja", "gloss")
    return cues, cues.filter("idx % 2 = 0").select("job_id", "id", pairs)


_OPEN, _SHUT = '{"reading":"무상","discovered":', '{"reading":"해탈","discovered":true}'


@query("x32_promoted", f"""SELECT id, CASE WHEN idx % 4 = 0 THEN '무상과 ' || text_llm ELSE '무상(無常)과 ' || text_llm END AS text_llm, CASE WHEN idx % 4 = 0 THEN text_final || ' 해탈(解脫)은 해탈(解脫)과 해탈' ELSE '' END AS text_final,
CASE WHEN idx % 4 = 0 THEN '[{_OPEN}' || (idx % 3 = 0)::VARCHAR || '}}]' WHEN idx % 3 = 0 THEN '[{_SHUT}]' ELSE '[{_SHUT},{_OPEN}false}}]' END AS hints, 1 AS n_applied FROM {X.CUES_SQL} WHERE idx % 2 = 0""")
def x32_promoted(spark, sf_dir):
    return imports.promoted(*confirmed_items(spark, sf_dir)).withColumn("hints", F.to_json("hints"))


@query("x32_newly_registered", f"SELECT v.reading, v.gloss, v.hanja FROM (VALUES ('해탈', '', '解脫'), ('무상', '', '無常'), ('없음', '', '無')) v(reading, gloss, hanja) WHERE reading <> '해탈' AND EXISTS (SELECT 1 FROM {X.CUES_SQL} WHERE idx % 2 = 0)")
def x32_newly_registered(spark, sf_dir):
    cues, items = confirmed_items(spark, sf_dir)
    return imports.newly_registered(items, cues, items.filter("reading = '해탈'").select("reading", "gloss", "hanja").distinct())


IN_SPAN = "end_ms > 9000 AND start_ms < 30000"


@query("e20_span_merged", f"""SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, id) - 1 AS idx, id, start_ms, end_ms, text_llm, text_final, reviewed FROM (
SELECT job_id, id, start_ms, end_ms, text_llm, text_final, reviewed FROM {X.CUES_SQL} WHERE NOT ({IN_SPAN})
UNION ALL SELECT job_id, first(id ORDER BY start_ms, end_ms, id), min(start_ms), max(end_ms), 'one long cue', '', false FROM {X.CUES_SQL} WHERE {IN_SPAN} GROUP BY job_id)""")
def e20_span_merged(spark, sf_dir):
    return imports.span_merged(X.cues(spark, sf_dir), 9000, 30_000, "one long cue").select("job_id", "idx", "id", "start_ms", "end_ms", "text_llm", "text_final", "reviewed")


@query("e20_time_defects", f"""WITH a AS (SELECT *, length(replace(coalesce(nullif(text_llm, ''), text_stt), ' ', '')) AS n FROM {X.CUES_SQL}), b AS (SELECT * REPLACE (CASE WHEN idx = 2 AND n > 0 AND n * 1000 // 22 > 0 AND end_ms - n * 1000 // 22 > start_ms THEN end_ms - n * 1000 // 22 ELSE start_ms END AS start_ms) FROM a),
c AS (SELECT *, lead(start_ms) OVER (PARTITION BY job_id ORDER BY idx) AS nxt FROM b), d AS (SELECT *, min(idx) FILTER (nxt - end_ms >= 1500) OVER (PARTITION BY job_id) AS gap FROM c) SELECT id, start_ms, CASE WHEN idx = gap THEN nxt - 150 ELSE end_ms END AS end_ms FROM d""")
def e20_time_defects(spark, sf_dir):
    return imports.time_defects(X.cues(spark, sf_dir), 2).select("id", "start_ms", "end_ms")
