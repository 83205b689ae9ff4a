"""Queries of the learning loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import alignment, korean
from cuelake.functions import text as T
from cuelake.operators import learning, quality
from cuelake.plans import fixtures as X
from cuelake.plans.registry import query
from cuelake.sources import storage

STOP = ("with", "that", "this", "have")
TOKENS = "(SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM documents)"
COUNTS = f"(SELECT term, count(*) AS n FROM {TOKENS} WHERE term NOT IN {STOP} GROUP BY term HAVING count(*) >= 5)"
#: Every word of every document as a pair with its language, in the order of documents and words.
WORDS = "(SELECT doc_id, lang, source, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '[^ ]+') AS w FROM documents))"
LOG = f"(SELECT w[i] AS wrong, lang AS right, source AS job, doc_id * 1000000 + i AS seq FROM {WORDS})"
COUNTED = """(SELECT wrong, "right", sum(fresh)::BIGINT AS "count", arg_max(job, seq) AS source_job FROM (SELECT *, CASE WHEN lag(job) OVER w IS NULL OR lag(job) OVER w <> job THEN 1 ELSE 0 END AS fresh FROM {} WINDOW w AS (PARTITION BY wrong, "right" ORDER BY seq)) GROUP BY ALL)"""


def words(spark, sf_dir):
    split = X.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)).alias("w"))
    return split.select("doc_id", "lang", "source", F.posexplode("w").alias("i", "word"))


def log(spark, sf_dir):
    return words(spark, sf_dir).select(F.col("word").alias("wrong"), F.col("lang").alias("right"), F.col("source").alias("job"), (F.col("doc_id") * 1_000_000 + F.col("i") + 1).alias("seq"))


def counts(spark, sf_dir):
    return learning.term_counts(X.table(spark, sf_dir, "documents"), "text", "[a-z]{4,}", STOP, 5)


def known(spark, sf_dir):
    return X.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("term")).distinct()


KNOWN = "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM benchmark)"


@query("a6_term_frequency", f"SELECT term, n FROM {COUNTS} ORDER BY n DESC, term LIMIT 300")
def a6_term_frequency(spark, sf_dir):
    return counts(spark, sf_dir).orderBy(F.desc("n"), "term").limit(300)


@query("a7_pair_frequency", 'SELECT wrong, "right", count(*) AS n FROM ' + LOG + ' GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, wrong, "right" LIMIT 400')
def a7_pair_frequency(spark, sf_dir):
    return log(spark, sf_dir).groupBy("wrong", "right").agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "wrong", "right").limit(400)


TERMS = f"(SELECT term, CASE WHEN length(term) % 3 = 0 THEN term || 's, ' || term || 'ed' ELSE '' END AS variants, CASE WHEN length(term) % 2 = 0 THEN 'even' ELSE '' END AS category, length(term) * 9 % 100 AS confidence, length(term) % 4 = 0 AS approved FROM {KNOWN})"


def terms(spark, sf_dir):
    n = F.length("term")
    return known(spark, sf_dir).select("term", F.when(n % 3 == 0, F.concat("term", F.lit("s, "), "term", F.lit("ed"))).otherwise("").alias("variants"), F.when(n % 2 == 0, "even").otherwise("").alias("category"), (n * 9 % 100).cast("long").alias("confidence"), (n % 4 == 0).alias("approved"))


@query("a8_surface_forms", f"SELECT DISTINCT trim(form) AS form FROM (SELECT term AS form FROM {TERMS} UNION ALL SELECT unnest(string_split(variants, ',')) FROM {TERMS}) WHERE trim(form) <> ''")
def a8_surface_forms(spark, sf_dir):
    return quality.surface_forms(terms(spark, sf_dir))


@query("l17_candidates", f"SELECT term, n, least(100, n * 2) AS confidence, false AS approved FROM {COUNTS} WHERE term NOT IN (SELECT term FROM {KNOWN}) ORDER BY n DESC, term LIMIT 200")
def l17_candidates(spark, sf_dir):
    return learning.candidates(counts(spark, sf_dir), known(spark, sf_dir))


CHOSEN = f"(SELECT term, 'chosen' AS category, CASE WHEN n % 2 = 0 THEN term || 'x' ELSE '' END AS variants FROM {COUNTS} WHERE n % 3 = 0)"


@query("l18_curated", f"""SELECT coalesce(t.term, c.term) AS term, CASE WHEN c.term IS NOT NULL THEN c.category ELSE t.category END AS category, CASE WHEN c.term IS NOT NULL AND c.variants <> '' THEN c.variants ELSE coalesce(t.variants, '') END AS variants,
CASE WHEN c.term IS NOT NULL THEN 100 ELSE confidence END::BIGINT AS confidence, c.term IS NOT NULL OR coalesce(approved, false) AS approved FROM {TERMS} t FULL JOIN {CHOSEN} c ON t.term = c.term""")
def l18_curated(spark, sf_dir):
    chosen = counts(spark, sf_dir).filter("n % 3 = 0").select("term", F.lit("chosen").alias("category"), F.when(F.col("n") % 2 == 0, F.concat("term", F.lit("x"))).otherwise("").alias("variants"))
    return learning.curated(terms(spark, sf_dir), chosen)


@query("l4_pair_counts", f"SELECT * FROM {COUNTED.format(LOG)}")
def l4_pair_counts(spark, sf_dir):
    return learning.pair_counts(log(spark, sf_dir))


@query("l3_first_seen", 'SELECT job AS job_id, wrong, "right", min(seq) AS first_idx FROM ' + LOG + " GROUP BY ALL")
def l3_first_seen(spark, sf_dir):
    pairs = log(spark, sf_dir).select(F.col("job").alias("job_id"), "wrong", "right", F.col("seq").alias("idx"), F.lit("").alias("context"))
    return learning.first_seen(pairs).drop("context")


@query("l5_job_status", f"SELECT job_id, CASE WHEN count(*) FILTER (reviewed) = 0 THEN 'new' WHEN count(*) FILTER (reviewed) >= count(*) THEN 'done' ELSE 'reviewing' END AS status FROM {X.CUES_SQL} GROUP BY job_id")
def l5_job_status(spark, sf_dir):
    done = F.count_if("reviewed")
    return X.cues(spark, sf_dir).groupBy("job_id").agg(F.when(done == 0, "new").when(done >= F.count("*"), "done").otherwise("reviewing").alias("status"))


@query("t2_top_terms", f"SELECT term, confidence FROM {TERMS} ORDER BY confidence DESC, term LIMIT 40")
def t2_top_terms(spark, sf_dir):
    return terms(spark, sf_dir).orderBy(F.desc("confidence"), "term").limit(40).select("term", "confidence")


@query("t3_few_shot", f"""SELECT wrong, "right", "count" FROM (SELECT * FROM {COUNTED.format(LOG)} ORDER BY "count" DESC, wrong, "right" LIMIT 60) WHERE regexp_replace(wrong, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g') NOT IN ('', "right") ORDER BY "count" DESC, wrong, "right" LIMIT 20""")
def t3_few_shot(spark, sf_dir):
    return learning.few_shot(learning.pair_counts(log(spark, sf_dir)), 20).select("wrong", "right", "count")


@query("t4_domain_terms", f"""WITH p AS (SELECT term, 0 AS part, 0 AS o FROM {TERMS} WHERE confidence >= 90 UNION ALL SELECT term, 1, -n FROM (SELECT term, n FROM {COUNTS} ORDER BY n DESC, term LIMIT 30) UNION ALL SELECT term, 2, -confidence FROM {TERMS} WHERE confidence < 90),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY term ORDER BY part, o) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY part > 0 ORDER BY part, o, term) AS n FROM f)
SELECT term, part FROM r WHERE part = 0 OR n <= greatest(0, 120 - (SELECT count(*) FROM f WHERE part = 0))""")
def t4_domain_terms(spark, sf_dir):
    readings = counts(spark, sf_dir).orderBy(F.desc("n"), "term").limit(30)
    return learning.domain_terms(terms(spark, sf_dir), readings, 120, 90)


@query("l20_prompt_blocks", f"SELECT CASE WHEN category = '' THEN '(none)' ELSE category END AS category, string_agg(term || CASE WHEN variants = '' THEN '' ELSE ' (' || variants || ')' END, ', ' ORDER BY term || CASE WHEN variants = '' THEN '' ELSE ' (' || variants || ')' END) AS line FROM {TERMS} WHERE approved GROUP BY 1")
def l20_prompt_blocks(spark, sf_dir):
    shown = F.concat("term", F.when(F.col("variants") == "", "").otherwise(F.concat(F.lit(" ("), "variants", F.lit(")"))))
    return terms(spark, sf_dir).filter("approved").groupBy(T.first_filled("category", F.lit("(none)")).alias("category")).agg(F.array_join(F.sort_array(F.collect_list(shown)), ", ").alias("line"))


@query("l20_official_names", "SELECT event_id, 'term ' || event_id AS term, json_extract_string(props, '$.k') AS name FROM events WHERE json_valid(props) AND json_extract_string(props, '$.k') <> ''")
def l20_official_names(spark, sf_dir):
    names = X.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("term "), F.col("event_id").cast("string")).alias("term"), F.get_json_object("props", "$.k").alias("name"))
    return names.filter("name <> ''")


@query("l21_special_readings", f"SELECT term, n FROM (SELECT term, n FROM {COUNTS} ORDER BY n DESC, term LIMIT 50) WHERE length(term) >= 5")
def l21_special_readings(spark, sf_dir):
    return counts(spark, sf_dir).orderBy(F.desc("n"), "term").limit(50).filter("length(term) >= 5")


@query("l16_lexicon", 'SELECT gloss, reading, hanja, "count", source_job, ambiguous, CASE WHEN NOT ambiguous AND "count" >= 2 THEN \'special\' ELSE \'common\' END AS tier FROM (SELECT *, count(*) OVER (PARTITION BY gloss, reading) > 1 AS ambiguous FROM (SELECT gloss, reading, hanja, sum(fresh)::BIGINT AS "count", arg_max(job, seq) AS source_job FROM (SELECT *, CASE WHEN lag(job) OVER w IS NULL OR lag(job) OVER w <> job THEN 1 ELSE 0 END AS fresh FROM (SELECT lang AS gloss, w[i] AS reading, w[i + 1] AS hanja, source AS job, doc_id * 1000000 + i AS seq FROM ' + WORDS + ' WHERE i < len(w)) WINDOW w AS (PARTITION BY gloss, reading, hanja ORDER BY seq)) GROUP BY ALL))')
def l16_lexicon(spark, sf_dir):
    split = X.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)).alias("w"))
    # Each word carries the next one, not the whole text.
    two = F.arrays_zip(F.col("w").alias("word"), F.slice("w", F.lit(2), F.size("w")).alias("next"))
    each = split.select("doc_id", "lang", "source", F.posexplode(two).alias("i", "p")).filter("p.next IS NOT NULL")
    rows = each.select(F.col("lang").alias("gloss"), F.col("p.word").alias("reading"), F.col("p.next").alias("hanja"), F.col("source").alias("job"), (F.col("doc_id") * 1_000_000 + F.col("i") + 1).alias("seq"))
    return learning.absorbed_annotations(rows)


@query("l11_clean_pair", r"SELECT cue_id, word_no, regexp_replace(word, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') AS clean FROM " + X.WORDS_SQL)
def l11_clean_pair(spark, sf_dir):
    return X.words(spark, sf_dir).select("cue_id", "word_no", korean.clean_pair_text(F.col("word")).alias("clean"))


@query("l13_kills_dialect", r"SELECT event_id, w, r, regexp_matches(w, '(해가|아가|어가|가꼬|아이가|니더|임더|데이|맞나)$') AND NOT regexp_matches(r, '(해가|아가|어가|가꼬|아이가|니더|임더|데이|맞나)$') AS kills FROM (SELECT event_id, list_extract(['약속을해가', '있어가', '합니더', '좋아요'], (event_id % 4 + 1)::INT) AS w, list_extract(['약속해서', '있어가', '합니다'], (event_id % 3 + 1)::INT) AS r FROM events)")
def l13_kills_dialect(spark, sf_dir):
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % len(words) + 1).cast("int"))
    rows = X.table(spark, sf_dir, "events").select("event_id", pick("약속을해가", "있어가", "합니더", "좋아요").alias("w"), pick("약속해서", "있어가", "합니다").alias("r"))
    return rows.withColumn("kills", korean.kills_dialect(F.col("w"), F.col("r")))


@query("l12_l14_safe_pairs")
def l12_l14_safe_pairs(spark, sf_dir):
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % len(words) + 1).cast("int"))
    rows = X.table(spark, sf_dir, "events").select("event_id", pick("그 여자", "에스드", "우리는", "약속을 해가", "백궁").alias("wrong"), pick("그분에게는", "백궁", "에스드", "약속해서").alias("right"))
    return rows.withColumn("is_reference", korean.is_reference(F.col("wrong"))).withColumn("is_safe", korean.is_safe_pair(F.col("wrong"), F.col("right")))


STEMS, PARTICLES = (f"[{', '.join(repr(w) for w in words)}]" for words in (korean.REFERENCE_STEMS, korean.PARTICLES))
_CLEAN = r"regexp_replace({}, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')"
_PLAIN = r"regexp_replace({}, '[^\p{{L}}\p{{N}}_]+', '', 'g')"


def _reference_sql(phrase: str) -> str:
    """Whether a phrase is a reference: four times over, the first particle that leaves two characters goes."""
    fitting = f"list_filter({PARTICLES}, lambda p: suffix(acc, p) AND length(acc) > length(p) + 1)"
    return f"list_contains({STEMS}, list_reduce([{_PLAIN.format(_CLEAN.format(phrase))}, '', '', '', ''], lambda acc, x: CASE WHEN list_contains({STEMS}, acc) OR len({fitting}) = 0 THEN acc ELSE left(acc, length(acc) - length({fitting}[1])) END))"


def _picked(words: tuple[str, ...], of) -> F.Column:
    return F.element_at(F.array(*map(F.lit, words)), (of % len(words) + 1).cast("int"))


_N_STEMS, _N_PARTICLES = len(korean.REFERENCE_STEMS), len(korean.PARTICLES)
_WRONG = f"{STEMS}[event_id % {_N_STEMS} + 1] || CASE WHEN event_id % 5 = 0 THEN '들' ELSE '' END || {PARTICLES}[event_id // {_N_STEMS} % {_N_PARTICLES} + 1] || CASE WHEN event_id % 3 = 0 THEN {PARTICLES}[event_id % {_N_PARTICLES} + 1] || '.' ELSE '' END"
_RIGHT = f"CASE event_id % 4 WHEN 0 THEN '백궁' WHEN 1 THEN '합니더' WHEN 2 THEN ' 약속을 해가 ' ELSE {STEMS}[event_id // 7 % {_N_STEMS} + 1] || {PARTICLES}[event_id // 11 % {_N_PARTICLES} + 1] END"
_TAIL = korean.DIALECT_TAIL


@query("l12_l14_particles", f"""WITH e AS (SELECT event_id, {_WRONG} AS wrong, {_RIGHT} AS "right" FROM events), d AS (SELECT DISTINCT wrong AS phrase FROM e UNION SELECT DISTINCT "right" FROM e), f AS MATERIALIZED (SELECT phrase, {_reference_sql('phrase')} AS refers, {_CLEAN.format('phrase')} AS clean, {_PLAIN.format('phrase')} AS plain FROM d)
SELECT event_id, a.refers AS is_reference, a.clean <> '' AND b.clean <> '' AND a.clean <> b.clean AND NOT a.refers AND NOT b.refers AND NOT (regexp_matches(a.plain, '{_TAIL}') AND NOT regexp_matches(b.plain, '{_TAIL}')) AS is_safe FROM e JOIN f a ON a.phrase = wrong JOIN f b ON b.phrase = e."right" """)
def l12_l14_particles(spark, sf_dir):
    """Pronouns with one particle or two, some with an ending that is none, against phrases of all kinds."""
    n = F.col("event_id")
    particle = lambda of: _picked(korean.PARTICLES, F.floor(of))
    wrong = F.concat(_picked(korean.REFERENCE_STEMS, n), F.when(n % 5 == 0, "들").otherwise(""), particle(n / _N_STEMS), F.when(n % 3 == 0, F.concat(particle(n), F.lit("."))).otherwise(""))
    right = F.when(n % 4 == 0, "백궁").when(n % 4 == 1, "합니더").when(n % 4 == 2, " 약속을 해가 ").otherwise(F.concat(_picked(korean.REFERENCE_STEMS, F.floor(n / 7)), particle(n / 11)))
    rows = X.table(spark, sf_dir, "events").select("event_id", wrong.alias("wrong"), right.alias("right"))
    return rows.select("event_id", korean.is_reference(F.col("wrong")).alias("is_reference"), korean.is_safe_pair(F.col("wrong"), F.col("right")).alias("is_safe"))


@query("l1_extracted_pairs")
def l1_extracted_pairs(spark, sf_dir):
    return learning.extracted_pairs(X.cues(spark, sf_dir))


@query("l2_mined_tokens")
def l2_mined_tokens(spark, sf_dir):
    return learning.mined_tokens(X.cues(spark, sf_dir), r"[\p{L}]{2,}")


def pairs(spark, sf_dir):
    return learning.extracted_pairs(X.cues(spark, sf_dir))


def pair_table(spark, sf_dir, found=None):
    return learning.pair_counts((found or pairs(spark, sf_dir)).select("wrong", "right", F.col("job_id").alias("job"), (F.col("job_id") * 1000 + F.col("idx")).alias("seq")))


@query("l9_l10_pre_pass")
def l9_l10_pre_pass(spark, sf_dir):
    return learning.pre_passed(X.cues(spark, sf_dir), pair_table(spark, sf_dir)).filter("before <> text")


@query("l8_propagated")
def l8_propagated(spark, sf_dir):
    found = storage.written(pairs(spark, sf_dir), "found")
    return learning.propagated(X.cues(spark, sf_dir), pair_table(spark, sf_dir, found), learning.first_seen(found))


def unsafe_pairs(spark, sf_dir):
    """Recognised words that begin with "hea", and their spelling in the machine texts, as if those were rewrites that went too far."""
    word = F.explode(F.regexp_extract_all("text_stt", F.lit(r"\bhea[A-Za-z]+"), F.lit(0)))
    return X.cues(spark, sf_dir).select(word.alias("wrong")).distinct().withColumn("right", F.replace("wrong", F.lit("he"), F.lit("eh")))


@query("l7_repaired")
def l7_repaired(spark, sf_dir):
    return learning.repaired(X.cues(spark, sf_dir), unsafe_pairs(spark, sf_dir))


@query("l6_absorb_phases")
def l6_absorb_phases(spark, sf_dir):
    """Extract pairs, repair unsafe rewrites, then propagate to what isn't reviewed."""
    found = storage.written(pairs(spark, sf_dir), "found")
    return learning.absorbed(X.cues(spark, sf_dir), pair_table(spark, sf_dir, found), learning.first_seen(found), unsafe_pairs(spark, sf_dir))


@query("l15_annotations", f"SELECT DISTINCT job_id, gloss, reading, hanja FROM {X.CUES_SQL}, (VALUES ('얼굴', '안', '顔'), ('', '해탈', '解脫')) v(gloss, reading, hanja) WHERE reviewed AND idx % 2 = 0")
def l15_annotations(spark, sf_dir):
    spelled = X.cues(spark, sf_dir).withColumn("text_final", F.when(F.col("idx") % 2 == 0, F.concat("text_final", F.lit(" 얼굴 안(顔) 자 해탈(解脫)"))).otherwise(F.col("text_final")))
    return learning.mined_annotations(spelled)


@query("x21_edit_distance", f"SELECT id, levenshtein(a, b) AS edits, length(a) AS n FROM (SELECT id, regexp_replace(text_final, '[^a-z ]', '', 'g') AS a, regexp_replace(text_stt, '[^a-z ]', '', 'g') AS b FROM {X.CUES_SQL} WHERE reviewed)")
def x21_edit_distance(spark, sf_dir):
    plain = lambda c: F.regexp_replace(c, "[^a-z ]", "")
    rows = X.cues(spark, sf_dir).filter("reviewed").select("id", plain("text_final").alias("a"), plain("text_stt").alias("b"))
    return rows.select("id", F.levenshtein("a", "b").alias("edits"), F.length("a").alias("n"))


def _rates_sql() -> str:
    plain = lambda c: "trim(regexp_replace(lower(regexp_replace(" + c + r", '[^\p{L}\p{N}_\s]', '', 'g')), '\s+', ' ', 'g'))"
    joined = lambda c, name, only="": plain(f"coalesce(string_agg({c}, ' ' ORDER BY idx, id) {only}, '')") + f" AS {name}"
    rate = lambda a, b: f"CASE WHEN length({a}) > 0 THEN round(levenshtein({a}, {b})::DOUBLE / length({a}), 4) END"
    some = "FILTER (matched)"
    return f"""WITH r AS (SELECT job_id, idx, id, text_final AS ref, text_stt AS stt, coalesce(nullif(text_llm, ''), text_stt) AS llm, length(trim(text_final)) AS n, greatest(length(trim(text_stt)), 1) AS m, trim(text_stt) <> '' AS heard FROM {X.CUES_SQL} WHERE reviewed AND trim(text_final) <> ''),
k AS (SELECT *, heard AND n * 2 >= m AND n <= 2 * m AS matched FROM r),
j AS (SELECT job_id, count(*) AS n_reviewed, count(*) FILTER (matched) AS n_matched, {joined('ref', 'a')}, {joined('stt', 'b')}, {joined('llm', 'c')}, {joined('ref', 'd', some)}, {joined('llm', 'e', some)} FROM k GROUP BY job_id),
e AS (SELECT job_id, n_reviewed, n_matched, {rate('a', 'b')} AS cer_stt, {rate('a', 'c')} AS cer_llm, {rate('d', 'e')} AS cer_matched FROM j)
SELECT e.*, left(title, 40) AS title, created, CASE WHEN job_id % 4 = 0 THEN 'srt' ELSE 'app' END AS source, round(cer_stt - cer_llm, 4) AS gain FROM e JOIN {X.MEDIA_SQL} USING (job_id) WHERE NOT practice"""


@query("x22_k13_evaluation", _rates_sql())
def x22_k13_evaluation(spark, sf_dir):
    """Error rates of each job, and what the corrections have gained."""
    imported = X.media(spark, sf_dir).filter("job_id % 4 = 0").select("job_id")
    return quality.evaluated(X.cues(spark, sf_dir), X.media(spark, sf_dir), imported).withColumn("gain", F.round(F.col("cer_stt") - F.col("cer_llm"), 4))


@query("x6_agreement")
def x6_agreement(spark, sf_dir):
    rows = X.cues(spark, sf_dir).select("id", T.words_only(F.col("text_stt")).alias("a"), T.words_only(F.col("text_caption")).alias("b"))
    return rows.select("id", F.round(alignment.similarity("a", "b"), 6).alias("score")).withColumn("flagged", F.col("score") < 65)


@query("x7_window_similarity")
def x7_window_similarity(spark, sf_dir):
    rows = X.cues(spark, sf_dir).select("id", T.echo_key(F.col("text_caption")).alias("a"), T.echo_key(F.col("text_stt")).alias("b"))
    return rows.select("id", F.round(alignment.window_similarity("a", "b"), 6).alias("score"))


@query("x23_token_diff")
def x23_token_diff(spark, sf_dir):
    return X.cues(spark, sf_dir).select("id", alignment.token_changes("text_stt", "text_final").alias("c")).select("id", "c.deleted", "c.inserted")


@query("d1_annotation_share", f"""WITH t AS (SELECT unnest(regexp_extract_all(regexp_replace(lower(text), '[^ ]*tion ', 'nation(x) ', 'g'), '([\\p{{L}}\\p{{N}}]+)(\\([^)]*\\))?')) AS t FROM conversations), f AS (SELECT regexp_replace(t, '\\(.*$', '') AS term, contains(t, '(') AS w FROM t)
SELECT term, count(*) AS n, count(*) FILTER (w) AS n_annotated, count(*) FILTER (w) * 100 >= count(*) * 50 AS special FROM f WHERE term IN (SELECT term FROM {KNOWN} UNION SELECT 'nation') GROUP BY term""")
def d1_annotation_share(spark, sf_dir):
    texts = X.table(spark, sf_dir, "conversations").select("conv_id", F.regexp_replace(F.lower("text"), "[^ ]*tion ", "nation(x) ").alias("text"))
    return learning.annotation_share(texts, "conv_id", "text", known(spark, sf_dir).union(spark.sql("SELECT 'nation'")))


@query("d2_keyword_amounts", f"""WITH s AS (SELECT unnest(regexp_split_to_array(lower(text), '[.?!\\n]+')) AS s FROM documents), p AS (SELECT list_distinct(regexp_extract_all(s, '[0-9]+')) AS amounts, list_distinct(regexp_extract_all(s, '[a-z]+')) AS words FROM s), q AS (SELECT unnest(amounts) AS amount, words FROM p), r AS (SELECT amount, unnest(words) AS keyword FROM q)
SELECT keyword, amount, count(*) AS n FROM r WHERE keyword IN (SELECT term FROM {KNOWN}) GROUP BY ALL""")
def d2_keyword_amounts(spark, sf_dir):
    return learning.keyword_amounts(X.table(spark, sf_dir, "documents"), "text", known(spark, sf_dir).withColumnRenamed("term", "keyword"))
