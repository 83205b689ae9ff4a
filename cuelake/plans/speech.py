"""Queries from recognised speech to cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import ordered, speech
from cuelake.plans import fixtures as X
from cuelake.plans.cues import CLUSTER, WORK
from cuelake.plans.registry import query


def segments(spark, sf_dir):
    w = X.words(spark, sf_dir).select("job_id", F.col("cue_id").alias("seg_id"), "word_no", F.struct("start_ms", "end_ms", F.concat(F.lit(" "), "word").alias("word")).alias("w"))
    return w.groupBy("job_id", "seg_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "w"))), lambda x: x["w"]).alias("words"))


def prompts(spark, sf_dir):
    return X.table(spark, sf_dir, "benchmark").select(F.col("text").alias("prompt"))


def echoing(spark, sf_dir):
    """Cues of which every third one says a slice of a prompt, with a change near its end."""
    asked = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("_item"), F.col("text").alias("_prompt"))
    rows = X.cues(spark, sf_dir).withColumn("_item", F.when(F.col("idx") % 3 == 1, F.col("job_id") % 40)).join(asked, "_item", "left")
    said = F.concat(F.substr("_prompt", (F.col("id") % 30 + 1).cast("int"), F.lit(50)), F.substr("text_stt", F.lit(1), (F.col("id") % 20).cast("int")))
    return rows.withColumn("text_stt", F.when(F.col("_prompt").isNotNull(), said).otherwise(F.col("text_stt"))).drop("_item", "_prompt")


ECHOING = f"(SELECT c.* REPLACE (CASE WHEN b.text IS NOT NULL THEN substr(b.text, id % 30 + 1, 50) || substr(text_stt, 1, id % 20) ELSE text_stt END AS text_stt) FROM {X.CUES_SQL} c LEFT JOIN benchmark b ON b.item_id = job_id % 40 AND idx % 3 = 1)"
COMPACT = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}_]+', '', 'g'))"


@query("x11_split_segments")
def x11_split_segments(spark, sf_dir):
    return speech.split_segments(segments(spark, sf_dir))


@query("s5_word_stream", f"SELECT job_id, cue_id, word_no, start_ms, end_ms FROM {X.WORDS_SQL} WHERE end_ms > start_ms")
def s5_word_stream(spark, sf_dir):
    return X.words(spark, sf_dir).filter("end_ms > start_ms").select("job_id", "cue_id", "word_no", "start_ms", "end_ms")


@query("x8_prompt_echoes", f"""WITH c AS (SELECT id, {COMPACT.format('text_stt')} AS k FROM {ECHOING}), d AS (SELECT id, k, (length(k) * 80 + 99) // 100 AS n FROM c WHERE length(k) >= 6), p AS (SELECT DISTINCT {COMPACT.format('text')} AS p FROM benchmark)
SELECT DISTINCT id FROM d JOIN p ON len(list_filter(range(0, length(k) - n + 1), lambda i: contains(p, substr(k, i + 1, n)))) > 0""")
def x8_prompt_echoes(spark, sf_dir):
    return speech.prompt_echoes(echoing(spark, sf_dir), prompts(spark, sf_dir))


@query("x10_gap_rows")
def x10_gap_rows(spark, sf_dir):
    return speech.gap_rows(X.cues(spark, sf_dir).filter("idx % 2 = 0"), X.captions(spark, sf_dir))


@query("x9_crosscheck")
def x9_crosscheck(spark, sf_dir):
    return speech.crosschecked(echoing(spark, sf_dir).filter("idx % 3 > 0"), X.captions(spark, sf_dir), prompts(spark, sf_dir))


@query("e14_repair_recognition")
def e14_repair_recognition(spark, sf_dir):
    """Cross-check anew for jobs that aren't complete."""
    cues = echoing(spark, sf_dir)
    open_ = cues.filter("NOT reviewed").select("job_id").distinct()
    return speech.crosschecked(cues.join(open_, "job_id", "left_semi"), X.captions(spark, sf_dir), prompts(spark, sf_dir))


@query("x12_w9_clamped")
def x12_w9_clamped(spark, sf_dir):
    cues = X.cues(spark, sf_dir).withColumn("text_llm", F.when(F.col("idx") % 3 == 0, F.concat_ws(" ", "text_stt", F.lit("and more"))).otherwise(F.lit("and more")))
    return speech.clamped(cues)


@query("x16_tighten")
def x16_tighten(spark, sf_dir):
    cues = X.cues(spark, sf_dir).withColumn("end_ms", F.col("end_ms") + 600)
    words = X.words(spark, sf_dir)
    return speech.tightened(cues, words)


#: What is heard is the script itself, so each sentence lasts from its first word with a letter or digit to its last one.
ALIGNED = f"""(WITH w AS (SELECT job_id, idx, id, start_ms, text_stt, string_split(text_stt, ' ') AS w FROM {X.CUES_SQL}), p AS (SELECT *, len(w) AS n, unnest(range(0, len(w))) AS i FROM w),
h AS (SELECT job_id, idx, start_ms + i * 7000 // n AS a, start_ms + (i + 1) * 7000 // n AS b FROM p WHERE regexp_replace(w[i + 1], '[^가-힣0-9a-zA-Z]', '', 'g') <> '')
SELECT w.job_id, w.idx AS no, regexp_replace(any_value(text_stt), '^\\s+|\\s+$', '', 'g') AS text, min(a) AS start_ms, max(b) AS end_ms FROM w JOIN h USING (job_id, idx) GROUP BY w.job_id, w.idx)"""


@query("x19_x20_aligned_sentences", f"SELECT * FROM {ALIGNED}")
def x19_x20_aligned_sentences(spark, sf_dir):
    sentences = X.cues(spark, sf_dir).select("job_id", F.col("idx").alias("no"), F.col("text_stt").alias("text"))
    split = X.cues(spark, sf_dir).select("job_id", "start_ms", F.split("text_stt", " ").alias("w"))
    words = split.select("job_id", "start_ms", F.size("w").alias("n"), F.posexplode("w").alias("i", "word")).selectExpr("job_id", "start_ms + i * 7000 div n AS start_ms", "start_ms + (i + 1) * 7000 div n AS end_ms", "word")
    return speech.aligned_sentences(sentences, words)


#: No job's machine texts are its script (every third one is empty), so each job with aligned sentences is made anew.
@query("x20_rebuilt_cells", f"""WITH a AS (SELECT * FROM {ALIGNED}) SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY no) - 1 AS idx, start_ms, end_ms, text AS text_stt, text AS text_llm, '' AS text_final, false AS reviewed FROM a
UNION ALL SELECT job_id, idx, start_ms, end_ms, text_stt, text_llm, text_final, reviewed FROM {X.CUES_SQL} WHERE (job_id % 5 > 0 OR idx > 0) AND job_id NOT IN (SELECT job_id FROM a)""")
def x20_rebuilt_cells(spark, sf_dir):
    return speech.rebuilt_cells(X.cues(spark, sf_dir).filter("job_id % 5 > 0 OR idx > 0"), x19_x20_aligned_sentences(spark, sf_dir))


@query("x31_x32_annotated", f"SELECT id, CASE WHEN idx % 2 = 0 THEN '얼굴 안(顔) 자 그리고 오온(五蘊)을 해탈(解脫)' ELSE regexp_replace({WORK}, '^\\s+|\\s+$', '', 'g') END AS text FROM {X.CUES_SQL}")
def x31_x32_annotated(spark, sf_dir):
    lexicon = spark.createDataFrame([("얼굴", "안", "顔", "common"), ("", "해탈", "解脫", "special"), ("", "오온", "五蘊", "special")], "gloss string, reading string, hanja string, tier string")
    cues = X.cues(spark, sf_dir).withColumn("text_final", F.when(F.col("idx") % 2 == 0, "얼굴 안 자 그리고 오온을 해탈").otherwise(F.col("text_final")))
    return speech.annotated(cues, lexicon)


@query("e6_redistribute", rf"""WITH w AS (SELECT *, greatest(1, length(regexp_replace(text_stt, '\s+', '', 'g'))) AS n FROM {X.CUES_SQL}), p AS (SELECT *, start_ms + (lead(end_ms) OVER o - start_ms) * n // (n + lead(n) OVER o) AS b FROM w WINDOW o AS (PARTITION BY job_id ORDER BY idx)), q AS (SELECT *, lag(b) OVER (PARTITION BY job_id ORDER BY idx) AS pb FROM p)
SELECT id, CASE WHEN idx % 2 = 1 AND pb IS NOT NULL THEN pb ELSE start_ms END AS start_ms, CASE WHEN idx % 2 = 0 AND b IS NOT NULL THEN b ELSE end_ms END AS end_ms FROM q""")
def e6_redistribute(spark, sf_dir):
    return speech.redistributed(X.cues(spark, sf_dir))


@query("e18_retranslate_cluster", f"SELECT id, 'new ' || text_stt AS text FROM ({CLUSTER}) JOIN {X.CUES_SQL} USING (id) WHERE in_cluster")
def e18_retranslate_cluster(spark, sf_dir):
    """The cluster around each job's first open cue; e18_retranslated has the write-back."""
    cues = X.cues(spark, sf_dir)
    chosen = ordered.cluster(cues, ~F.col("reviewed")).filter("in_cluster")
    return cues.join(chosen, "id", "left_semi").select("id", F.concat(F.lit("new "), "text_stt").alias("text"))
