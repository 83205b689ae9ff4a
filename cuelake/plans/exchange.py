"""Queries of sources and sinks; file contents are made from the test tables, and read back where both ways exist."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import progress
from cuelake.plans import fixtures as X
from cuelake.plans.cues import wrapped_sql
from cuelake.plans.learning import CHOSEN, LOG, TERMS, counts, log, terms
from cuelake.plans.registry import query
from cuelake.sources import formats, storage

CLOSED = f"(SELECT *, CASE WHEN lead(start_ms) OVER w - end_ms < 200 THEN lead(start_ms) OVER w ELSE end_ms END AS e, row_number() OVER w AS no FROM {X.CUES_SQL} WHERE regexp_replace(text_final, '^\\s+|\\s+$', '', 'g') <> '' WINDOW w AS (PARTITION BY job_id ORDER BY start_ms, id))"


def clock_sql(ms: str) -> str:
    return f"lpad(({ms} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({ms} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({ms} // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad(({ms} % 1000)::VARCHAR, 3, '0')"


@query("k1_srt_times", f"{wrapped_sql(f'(SELECT job_id * 100000 + no AS k, text_final AS text FROM {CLOSED})', 42)} SELECT job_id, no, no::VARCHAR || chr(10) || {clock_sql('start_ms')} || ' --> ' || {clock_sql('e')} || chr(10) || lines AS block FROM {CLOSED} c JOIN wrapped ON k = job_id * 100000 + no")
def k1_srt_times(spark, sf_dir):
    return formats.to_srt(X.cues(spark, sf_dir), "text_final", "en").withColumn("no", F.col("no").cast("long"))


@query("s6_srt_round_trip", rf"SELECT job_id::VARCHAR AS path, start_ms, e AS end_ms, trim(regexp_replace(text_final, '\s+', ' ', 'g')) AS text FROM {CLOSED}")
def s6_srt_round_trip(spark, sf_dir):
    cues = X.cues(spark, sf_dir)
    blocks = formats.to_srt(cues, "text_final", "en").groupBy(F.col("job_id").cast("string").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "block"))), lambda b: b["block"]), "\n\n").alias("content"))
    return formats.parse_srt(blocks)


@query("s3_caption_json", f"SELECT job_id::VARCHAR AS path, start_ms, end_ms, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM {X.CAPTIONS_SQL}")
def s3_caption_json(spark, sf_dir):
    event = F.struct(F.col("start_ms").alias("tStartMs"), (F.col("end_ms") - F.col("start_ms")).alias("dDurationMs"), F.array(F.struct(F.lit(">> ").alias("utf8")), F.struct(F.left("text", F.lit(5)).alias("utf8")), F.struct(F.expr("substring(text, 6)").alias("utf8"))).alias("segs"))
    rows = X.captions(spark, sf_dir)
    files = rows.groupBy(F.col("job_id").cast("string").alias("path")).agg(F.to_json(F.struct(F.collect_list(event).alias("events"))).alias("content"))
    return formats.parse_captions(files)


@query("s4_speech_json", f"SELECT id, 0 AS seg_no, start_ms, end_ms, text_stt AS text, 2 AS n_words FROM {X.CUES_SQL}")
def s4_speech_json(spark, sf_dir):
    word = lambda t: F.struct((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.lit(t).alias("word"), F.lit(0.5).alias("probability"))
    content = F.to_json(F.array(F.struct((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("text_stt").alias("text"), F.array(word(" a"), word(" b")).alias("words"), F.lit(-0.1).alias("avg_logprob"))))
    rows = X.cues(spark, sf_dir).select("id", F.when(F.col("idx") % 2 == 0, content).alias("blob"), content.alias("file"))
    return formats.parse_speech(rows, "id", "blob", "file").select("id", "seg_no", "start_ms", "end_ms", "text", F.size("words").alias("n_words"))


DOC = "('[2024.01.02] a' || chr(10) || '(19분 59초)' || chr(10) || '01:14' || chr(10) || text || chr(10) || '[2024.01.03] b')"


@query("s7_transcript_lines", f"SELECT doc_id::VARCHAR AS path, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_replace(l, '^\\s+|\\s+$', '', 'g') <> ''")
def s7_transcript_lines(spark, sf_dir):
    files = X.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("[2024.01.02] a\n(19분 59초)\n01:14\n"), "text", F.lit("\n[2024.01.03] b")).alias("content"))
    return formats.parse_transcript(files)[0]


@query("s7_transcript_documents", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS n_documents FROM documents")
def s7_transcript_documents(spark, sf_dir):
    # Lines of the text that look like a header are quoted, so that each file has the headers that were put in.
    text = F.regexp_replace(F.coalesce("text", F.lit("")), rf"(?mdU)^[^\S\n]*(?={formats.DATE})", "> ")
    files = X.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[2024.01.02] a\n"), text, F.lit("\n[2024.01.03] b"))).otherwise(text).alias("content"))
    return formats.parse_transcript(files)[1].withColumn("n_documents", F.col("n_documents").cast("int"))


@query("s13_script_table", "SELECT doc_id::VARCHAR AS path, i AS no, 'line ' || i AS text, CASE WHEN i % 2 = 0 THEN '빠르게' ELSE '보통' END AS style, i * 0.5::DOUBLE AS pause FROM documents, unnest([1, 2, 3]) t(i)")
def s13_script_table(spark, sf_dir):
    table = "| # | text | style | pause |\n|---|---|---|---|\n| 1 | line 1 | 보통 | 0.5 |\nprose | with a bar\n| 2 | line 2 | 빠르게 | 1 |\n| 3 | line 3 | 보통 | 1.5 |"
    files = X.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(table).alias("content"))
    return formats.parse_script(files)


@query("k5_training_manifest", f"SELECT job_id::VARCHAR || '/' || lpad(idx::VARCHAR, 5, '0') || '.wav' AS audio, regexp_replace(text_final, '^\\s+|\\s+$', '', 'g') AS text, start_ms, end_ms FROM {X.CUES_SQL} WHERE reviewed AND job_id NOT IN (SELECT job_id FROM {X.MEDIA_SQL} WHERE practice) AND regexp_replace(text_final, '^\\s+|\\s+$', '', 'g') <> '' AND end_ms - start_ms BETWEEN 400 AND 30000")
def k5_training_manifest(spark, sf_dir):
    return formats.training_manifest(X.cues(spark, sf_dir), X.media(spark, sf_dir))


@query("k6_correction_manifest", f"SELECT * FROM (SELECT id, regexp_replace(text_stt, '^\\s+|\\s+$', '', 'g') AS source, regexp_replace(text_final, '^\\s+|\\s+$', '', 'g') AS target, regexp_replace(text_stt, '^\\s+|\\s+$', '', 'g') <> regexp_replace(text_final, '^\\s+|\\s+$', '', 'g') AS changed FROM {X.CUES_SQL} WHERE reviewed AND job_id NOT IN (SELECT job_id FROM {X.MEDIA_SQL} WHERE practice)) WHERE source <> '' AND target <> ''")
def k6_correction_manifest(spark, sf_dir):
    return formats.correction_manifest(X.cues(spark, sf_dir), X.media(spark, sf_dir))


@query("k8_glossary_markdown", f"SELECT CASE WHEN category = '' THEN '(미분류)' ELSE category END AS category, count(*) AS n, string_agg('| ' || term || ' | ' || variants || ' |', chr(10) ORDER BY '| ' || term || ' | ' || variants || ' |') AS \"table\" FROM {TERMS} WHERE approved GROUP BY 1")
def k8_glossary_markdown(spark, sf_dir):
    return formats.glossary_lines(terms(spark, sf_dir))


@query("k9_lexicon_markdown", f"""SELECT part, count(*) AS n, string_agg('| ' || CASE WHEN gloss = '' THEN '' ELSE gloss || ' | ' END || reading || ' | ' || hanja || ' | ' || "count" || ' |', chr(10) ORDER BY reading, gloss) AS "table" FROM (SELECT *, CASE WHEN gloss <> '' THEN '2 glyphs' WHEN tier = 'special' THEN '1 special' ELSE '3 common' END AS part
FROM (SELECT CASE WHEN n % 3 = 0 THEN left(term, 2) ELSE '' END AS gloss, term AS reading, upper(term) AS hanja, n AS "count", CASE WHEN n % 2 = 0 THEN 'special' ELSE 'common' END AS tier FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS term FROM benchmark) t JOIN (SELECT term AS t2, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS term FROM benchmark) GROUP BY term) c ON t.term = c.t2 GROUP BY ALL)) GROUP BY part""")
def k9_lexicon_markdown(spark, sf_dir):
    from cuelake.operators import learning

    c = learning.term_counts(X.table(spark, sf_dir, "benchmark"), "text", "[a-z]{4,}")
    lexicon = c.select(F.when(F.col("n") % 3 == 0, F.left("term", F.lit(2))).otherwise("").alias("gloss"), F.col("term").alias("reading"), F.upper("term").alias("hanja"), F.col("n").alias("count"), F.when(F.col("n") % 2 == 0, "special").otherwise("common").alias("tier"))
    return formats.lexicon_lines(lexicon)


@query("k10_upsert", f"SELECT coalesce(c.term, t.term) AS term, CASE WHEN c.term IS NULL THEN t.variants ELSE c.variants END AS variants FROM (SELECT term, variants FROM {TERMS}) t FULL JOIN (SELECT term, variants FROM {CHOSEN}) c ON t.term = c.term")
def k10_upsert(spark, sf_dir):
    chosen = counts(spark, sf_dir).filter("n % 3 = 0").select("term", F.when(F.col("n") % 2 == 0, F.concat("term", F.lit("x"))).otherwise("").alias("variants"))
    return storage.upserted(terms(spark, sf_dir).select("term", "variants"), chosen, ["term"])


@query("k11_copy_missing", f"SELECT coalesce(t.id, s.id) AS id, CASE WHEN t.id IS NULL THEN s.text_stt ELSE 'kept' END AS text FROM {X.CUES_SQL} s LEFT JOIN (SELECT id FROM {X.CUES_SQL} WHERE idx % 3 = 0) t ON t.id = s.id")
def k11_copy_missing(spark, sf_dir):
    rows = X.cues(spark, sf_dir).select("id", F.col("text_stt").alias("text"))
    return storage.copy_missing(rows, X.cues(spark, sf_dir).filter("idx % 3 = 0").select("id", F.lit("kept").alias("text")), "id")


@query("k12_retention", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) WHERE n > 5")
def k12_retention(spark, sf_dir):
    return storage.beyond_retention(X.table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("k10_latest_snapshot", f'SELECT wrong, "right", max(seq) AS seq FROM {LOG} GROUP BY ALL')
def k10_latest_snapshot(spark, sf_dir):
    return storage.latest(log(spark, sf_dir), ["wrong", "right"], ["seq"]).select("wrong", "right", "seq")


@query("k14_cue_sheet", f"SELECT job_id, idx AS no, coalesce(sum(length(text_stt) * 100 + 50) OVER w, 0)::BIGINT AS start, (coalesce(sum(length(text_stt) * 100 + 50) OVER w, 0) + length(text_stt) * 100)::BIGINT AS \"end\" FROM {X.CUES_SQL} WINDOW w AS (PARTITION BY job_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def k14_cue_sheet(spark, sf_dir):
    lines = X.cues(spark, sf_dir).select("job_id", F.col("idx").alias("no"), (F.length("text_stt") * 100).cast("long").alias("samples"), F.lit(50).cast("long").alias("pause_samples"))
    return formats.cue_sheet(lines, "job_id")


@query("e22_partition_overwrite", f"SELECT id, CASE WHEN job_id % 2 = 0 THEN 'x' || text_stt ELSE text_stt END AS text FROM {X.CUES_SQL}")
def e22_partition_overwrite(spark, sf_dir):
    """A rerun of some jobs replaces their partitions and leaves the rest: written and read again."""
    path = storage.fresh_folder(spark, "tracks")
    rows = X.cues(spark, sf_dir).select("id", F.lit("en").alias("lang"), "job_id", F.col("text_stt").alias("text"))
    storage.write_tracks(rows, path)
    storage.write_tracks(rows.filter("job_id % 2 = 0").withColumn("text", F.concat(F.lit("x"), "text")), path)
    return spark.read.parquet(path).select("id", "text")


ASCII = "regexp_replace(text, '[^ -~]', '', 'g')"


@query("s8_encodings", f"SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE '안녕 ' || {ASCII} END AS content FROM benchmark")
def s8_encodings(spark, sf_dir):
    """Texts of two character sets, told apart by their bytes."""
    old = F.pandas_udf(lambda texts: texts.map(lambda t: t.encode("cp949")), "binary")
    text = F.concat(F.lit("안녕 "), F.regexp_replace("text", "[^ -~]", ""))
    rows = X.table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("text").cast("binary")).otherwise(old(text)).alias("bytes"))
    return rows.select("item_id", formats.decoded(F.col("bytes")).alias("content"))


@query("s9_files_below_a_folder", "SELECT row_number() OVER (ORDER BY 'a=' || item_id % 3 || '/b=' || item_id) AS place, item_id, text || chr(10) AS content FROM benchmark")
def s9_files_below_a_folder(spark, sf_dir):
    """Files at any depth, in the order of their paths."""
    folder = storage.fresh_folder(spark, "texts")
    rows = X.table(spark, sf_dir, "benchmark").select((F.col("item_id") % 3).alias("a"), F.col("item_id").alias("b"), F.col("text").alias("value"))
    rows.repartition("a", "b").write.partitionBy("a", "b").text(folder)
    files = formats.read_files(spark, folder, "part-*").withColumn("path", F.regexp_extract("path", "(a=[0-9]+/b=[0-9]+)/", 1))
    return progress.numbered(files, "path").select("place", F.regexp_extract("path", "b=([0-9]+)", 1).cast("long").alias("item_id"), "content")
