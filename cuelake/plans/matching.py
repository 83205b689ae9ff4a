"""Queries that match one track with another in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import intervals
from cuelake.plans import fixtures as X
from cuelake.plans.registry import query

KEY = r"regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g')"
OVER = "least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)"
MEET = "a.job_id = b.job_id AND b.start_ms < a.end_ms AND b.end_ms > a.start_ms"


@query("f4_overlaps", f"SELECT a.id, b.cap_id, {OVER} AS ms FROM {X.CUES_SQL} a JOIN {X.CAPTIONS_SQL} b ON {MEET}")
def f4_overlaps(spark, sf_dir):
    pairs = intervals.overlapping(X.cues(spark, sf_dir), X.captions(spark, sf_dir))
    return pairs.select(F.col("l_id").alias("id"), F.col("r_cap_id").alias("cap_id"), intervals.overlap_ms().alias("ms"))


@query("j6_overlap_text", f"SELECT a.id, coalesce(string_agg(b.text, ' ' ORDER BY b.start_ms, b.cap_id), '') AS text FROM {X.CUES_SQL} a LEFT JOIN {X.CAPTIONS_SQL} b ON {MEET} GROUP BY a.id")
def j6_overlap_text(spark, sf_dir):
    return intervals.overlap_text(X.cues(spark, sf_dir), X.captions(spark, sf_dir))


@query("j7_overlap_text_without_repeats", f"""WITH p AS (SELECT a.id, CASE WHEN b.cap_id % 4 IN (1, 2) THEN 'the same line' ELSE b.text END AS text, b.start_ms, b.cap_id FROM {X.CUES_SQL} a JOIN {X.CAPTIONS_SQL} b ON {MEET}),
q AS (SELECT *, lag(text) OVER (PARTITION BY id ORDER BY start_ms, cap_id) AS before FROM p)
SELECT c.id, coalesce(string_agg(text, ' ' ORDER BY q.start_ms, cap_id) FILTER (before IS NULL OR before <> text), '') AS text FROM {X.CUES_SQL} c LEFT JOIN q ON q.id = c.id GROUP BY c.id""")
def j7_overlap_text_without_repeats(spark, sf_dir):
    return intervals.overlap_text(X.cues(spark, sf_dir), X.captions(spark, sf_dir).withColumn("text", F.when((F.col("cap_id") % 4).isin(1, 2), "the same line").otherwise(F.col("text"))), without_repeats=True)


@query("j8_best_overlap", f"SELECT id, match, overlap_ms FROM (SELECT a.id, b.id AS match, {OVER} AS overlap_ms, row_number() OVER (PARTITION BY a.id ORDER BY {OVER} DESC, b.start_ms, b.id) AS n FROM {X.CUES_SQL} a JOIN {X.FORKED_SQL} b ON {MEET}) WHERE n = 1")
def j8_best_overlap(spark, sf_dir):
    return intervals.best_overlap(X.cues(spark, sf_dir), X.forked(spark, sf_dir))


@query("j9_dominant_overlap", f"SELECT id, match FROM (SELECT a.id, b.id AS match, {OVER} AS ms, a.end_ms - a.start_ms AS span, count(*) OVER (PARTITION BY a.id) AS c, row_number() OVER (PARTITION BY a.id ORDER BY {OVER} DESC, b.start_ms, b.id) AS n FROM {X.FORKED_SQL} a JOIN {X.CUES_SQL} b ON {MEET}) WHERE n = 1 AND (c = 1 OR ms * 100 >= span * 80)")
def j9_dominant_overlap(spark, sf_dir):
    return intervals.dominant_overlap(X.forked(spark, sf_dir), X.cues(spark, sf_dir))


@query("j10_nearest_same_text", f"""WITH a AS (SELECT job_id, id, start_ms, CASE WHEN idx % 3 > 0 THEN 'thesameline' ELSE {KEY.replace('text', 'text_stt')} END AS k FROM {X.CUES_SQL}), b AS (SELECT job_id, id, start_ms, CASE WHEN idx % 3 > 0 THEN 'thesameline' ELSE {KEY.replace('text', 'text_stt')} END AS k FROM {X.CUES_SQL})
SELECT id, match, away_ms FROM (SELECT a.id, b.id AS match, abs(a.start_ms - b.start_ms - 9000) AS away_ms, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.start_ms - b.start_ms - 9000), b.id) AS n FROM a JOIN b ON a.job_id = b.job_id AND a.k = b.k AND a.k <> '' WHERE abs(a.start_ms - b.start_ms - 9000) <= 20000) WHERE n = 1""")
def j10_nearest_same_text(spark, sf_dir):
    cues = X.cues(spark, sf_dir).withColumn("text", F.when(F.col("idx") % 3 > 0, "the same line").otherwise(F.col("text_stt")))
    return intervals.nearest_same_text(cues, cues.withColumn("start_ms", F.col("start_ms") + 9000))


@query("j11_nearest_start", f"SELECT job_id, first(id ORDER BY abs(start_ms - 20000), id) AS id FROM {X.CUES_SQL} GROUP BY job_id")
def j11_nearest_start(spark, sf_dir):
    return intervals.nearest_start(X.cues(spark, sf_dir), 20_000)


@query("j12_latest_before", f"SELECT b.cap_id, (SELECT a.id FROM {X.CUES_SQL} a WHERE a.job_id = b.job_id AND a.start_ms <= b.start_ms + 300 ORDER BY a.start_ms DESC, a.id DESC LIMIT 1) AS cue_id FROM {X.CAPTIONS_SQL} b")
def j12_latest_before(spark, sf_dir):
    return intervals.latest_before(X.captions(spark, sf_dir), X.cues(spark, sf_dir))


@query("j13_uncovered", f"SELECT cap_id FROM {X.CAPTIONS_SQL} a WHERE NOT EXISTS (SELECT 1 FROM {X.CUES_SQL} b WHERE a.job_id = b.job_id AND b.idx % 2 = 0 AND 2 * (b.start_ms - 300) <= a.start_ms + a.end_ms AND a.start_ms + a.end_ms <= 2 * (b.end_ms + 300))")
def j13_uncovered(spark, sf_dir):
    return intervals.uncovered(X.captions(spark, sf_dir), X.cues(spark, sf_dir).filter("idx % 2 = 0")).select("cap_id")


@query("j14_neighbours", f"SELECT id, lag(id) OVER w AS previous, lead(id) OVER w AS following FROM {X.CUES_SQL} WINDOW w AS (PARTITION BY job_id ORDER BY idx)")
def j14_neighbours(spark, sf_dir):
    return intervals.neighbours(X.cues(spark, sf_dir))


MID = "w.job_id = c.job_id AND 2 * c.start_ms <= w.start_ms + w.end_ms AND w.start_ms + w.end_ms < 2 * c.end_ms"


@query("f5_words_in_cues", f"SELECT w.cue_id AS word_cue, word_no, c.id FROM {X.WORDS_SQL} w JOIN {X.CUES_SQL} c ON {MID}")
def f5_words_in_cues(spark, sf_dir):
    return intervals.words_in_cues(X.words(spark, sf_dir), X.cues(spark, sf_dir)).select(F.col("l_cue_id").alias("word_cue"), F.col("l_word_no").alias("word_no"), F.col("r_id").alias("id"))


@query("x17_speech_span", f"SELECT c.id, min(w.start_ms) AS from_ms, max(w.end_ms) AS to_ms, count(*) AS n_words FROM {X.WORDS_SQL} w JOIN {X.CUES_SQL} c ON {MID} GROUP BY c.id")
def x17_speech_span(spark, sf_dir):
    return intervals.speech_span(X.words(spark, sf_dir), X.cues(spark, sf_dir))


@query("x18_snapped", f"""WITH e AS (SELECT DISTINCT job_id, unnest([start_ms, end_ms]) AS edge FROM {X.WORDS_SQL}),
n AS (SELECT a.id, e.edge, row_number() OVER (PARTITION BY a.id ORDER BY abs(e.edge - a.start_ms - 77), e.edge) AS r FROM {X.CUES_SQL} a JOIN e ON a.job_id = e.job_id WHERE abs(e.edge - a.start_ms - 77) <= 300)
SELECT a.id, coalesce(edge, a.start_ms + 77) AS start_ms FROM {X.CUES_SQL} a LEFT JOIN n ON a.id = n.id AND r = 1""")
def x18_snapped(spark, sf_dir):
    return intervals.snapped(X.cues(spark, sf_dir).withColumn("start_ms", F.col("start_ms") + 77), X.words(spark, sf_dir))
