"""Queries of edits and tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import editing, learning
from cuelake.plans import fixtures as X
from cuelake.plans.cues import TERMS as TERM_FORMS
from cuelake.plans.cues import WORK, forms, joined_sql
from cuelake.plans.learning import COUNTS, counts
from cuelake.plans.registry import query
from cuelake.sources import storage

RENUMBERED = "row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, id) - 1 AS idx"
BEST = "coalesce(nullif(text_final, ''), nullif(text_llm, ''), text_stt)"
STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
RANKED = f"(SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS r FROM {COUNTS} QUALIFY r <= 40)"
HASH = r"substr(sha256(regexp_replace({}, '^\s+|\s+$', '', 'g')), 1, 16)"


@query("e1_split", f"""WITH p AS (SELECT *, {WORK} AS w, start_ms + (end_ms - start_ms) * 5 // length({WORK}) AS mid, idx % 2 = 0 AND length({WORK}) > 5 AS cut FROM {X.CUES_SQL}),
q AS (SELECT job_id, id * 2 AS id, start_ms, CASE WHEN cut THEN mid ELSE end_ms END AS end_ms, text_stt, CASE WHEN cut THEN trim(left(w, 5)) ELSE text_final END AS text_final FROM p UNION ALL SELECT job_id, id * 2 + 1, mid, end_ms, '', trim(substr(w, 6)) FROM p WHERE cut)
SELECT *, {RENUMBERED} FROM q""")
def e1_split(spark, sf_dir):
    cues = X.cues(spark, sf_dir)
    return editing.split_at(cues, cues.filter("idx % 2 = 0").select("id", F.lit(5).alias("pos"))).select("job_id", "id", "idx", "start_ms", "end_ms", "text_stt", "text_final").withColumn("idx", F.col("idx").cast("long"))


_WITH_NEXT = f"(SELECT *, {', '.join(f'lead({c}) OVER w AS n_{c}' for c in ('id', 'end_ms', 'flagged', 'uncertain', *editing.TEXTS))} FROM {X.CUES_SQL} WINDOW w AS (PARTITION BY job_id ORDER BY idx))"
_PAIRS_OF = " UNION ALL ".join(f"SELECT id, '{c}' AS c, {c} AS a, n_{c} AS b FROM n WHERE idx % 3 = 0 AND n_id IS NOT NULL" for c in editing.TEXTS)


@query("e2_merge_next", f"""WITH n AS (SELECT * FROM {_WITH_NEXT}), p AS ({_PAIRS_OF}), j AS (SELECT id, {', '.join(f"max(joined) FILTER (c = '{c}') AS j_{c}" for c in editing.TEXTS)} FROM {joined_sql('p')} GROUP BY id),
r AS (SELECT n.job_id, n.id, start_ms, CASE WHEN j.id IS NULL THEN end_ms ELSE greatest(end_ms, n_end_ms) END AS end_ms, {', '.join(f'CASE WHEN j.id IS NULL THEN {c} ELSE j_{c} END AS {c}' for c in editing.TEXTS)},
  CASE WHEN j.id IS NULL THEN flagged ELSE flagged OR n_flagged END AS flagged, CASE WHEN j.id IS NULL THEN uncertain ELSE uncertain OR n_uncertain END AS uncertain, j.id IS NULL AND reviewed AS reviewed FROM n LEFT JOIN j USING (id) WHERE NOT (idx % 3 = 1))
SELECT *, {RENUMBERED} FROM r""")
def e2_merge_next(spark, sf_dir):
    cues = X.cues(spark, sf_dir)
    return editing.merged_with_next(cues, cues.filter("idx % 3 = 0").select("id")).withColumn("idx", F.col("idx").cast("long"))


@query("e3_delete", f"SELECT job_id, id, {RENUMBERED} FROM {X.CUES_SQL} WHERE idx % 4 <> 1")
def e3_delete(spark, sf_dir):
    cues = X.cues(spark, sf_dir)
    left, _ = editing.deleted(cues, X.renditions(spark, sf_dir), cues.filter("idx % 4 = 1").select("id"))
    return left.select("job_id", "id", F.col("idx").cast("long").alias("idx"))


@query("e3_delete_renditions", f"SELECT cue_id, lang FROM {X.RENDITIONS_SQL} WHERE cue_id % 1000 % 4 <> 1")
def e3_delete_renditions(spark, sf_dir):
    cues = X.cues(spark, sf_dir)
    return editing.deleted(cues, X.renditions(spark, sf_dir), cues.filter("idx % 4 = 1").select("id"))[1].select("cue_id", "lang")


@query("e4_retime", f"""WITH n AS (SELECT *, CASE WHEN idx % 3 = 1 THEN start_ms - 5000 END AS ns, CASE WHEN idx % 3 = 1 THEN end_ms + 5000 END AS ne, coalesce(lag(end_ms) OVER w, 0) AS low, lead(start_ms) OVER w AS high FROM {X.CUES_SQL} WINDOW w AS (PARTITION BY job_id ORDER BY idx)),
m AS (SELECT *, greatest(ns, least(low, start_ms)) AS s, least(ne, coalesce(greatest(high, end_ms), ne)) AS e FROM n)
SELECT job_id, id, CASE WHEN ns IS NULL THEN start_ms ELSE s END AS start_ms, CASE WHEN ns IS NULL THEN end_ms ELSE greatest(e, s + 100) END AS end_ms FROM m""")
def e4_retime(spark, sf_dir):
    cues = X.cues(spark, sf_dir)
    return editing.retimed(cues, cues.filter("idx % 3 = 1").selectExpr("id", "start_ms - 5000 AS new_start", "end_ms + 5000 AS new_end"))


@query("e5_linked_boundary", f"""WITH n AS (SELECT *, CASE WHEN idx % 2 = 1 THEN start_ms - 700 END AS v FROM {X.CUES_SQL}), m AS (SELECT *, lag(start_ms) OVER w AS ps, lead(v) OVER w AS nv, lead(end_ms) OVER w AS ne FROM n WINDOW w AS (PARTITION BY job_id ORDER BY idx))
SELECT job_id, id, CASE WHEN v IS NOT NULL AND ps IS NOT NULL THEN greatest(ps + 100, least(v, end_ms - 100)) ELSE start_ms END AS start_ms, CASE WHEN nv IS NOT NULL THEN greatest(start_ms + 100, least(nv, ne - 100)) ELSE end_ms END AS end_ms FROM m""")
def e5_linked_boundary(spark, sf_dir):
    cues = X.cues(spark, sf_dir)
    return editing.linked_boundary(cues, cues.filter("idx % 2 = 1").selectExpr("id", "start_ms - 700 AS at_ms"))


@query("e7_restore", f"SELECT job_id, id, start_ms, {RENUMBERED} FROM (SELECT job_id, id, CASE WHEN idx % 5 = 0 THEN start_ms + 1 ELSE start_ms END AS start_ms, end_ms FROM {X.CUES_SQL} WHERE idx % 4 <> 1 OR idx % 5 = 0)")
def e7_restore(spark, sf_dir):
    cues = X.cues(spark, sf_dir).select("job_id", "id", "idx", "start_ms", "end_ms")
    out = editing.restored(cues, cues.filter("idx % 5 = 0").withColumn("start_ms", F.col("start_ms") + 1), cues.filter("idx % 4 = 1").select("id"))
    return out.select("job_id", "id", "start_ms", F.col("idx").cast("long").alias("idx"))


@query("e8_confirm_safe", f"SELECT job_id, id, CASE WHEN idx % 2 = 0 AND NOT reviewed THEN {WORK} ELSE text_final END AS text_final, reviewed OR idx % 2 = 0 AS reviewed FROM {X.CUES_SQL}")
def e8_confirm_safe(spark, sf_dir):
    cues = X.cues(spark, sf_dir)
    return editing.confirmed(cues, cues.filter("idx % 2 = 0").select("id"))


@query("x29_staleness", f"SELECT cue_id, lang, {HASH.format('hash_of')} <> {HASH.format(BEST)} AS stale FROM {X.RENDITIONS_SQL} r JOIN {X.CUES_SQL} c ON c.id = r.cue_id")
def x29_staleness(spark, sf_dir):
    return editing.staleness(X.cues(spark, sf_dir), X.renditions(spark, sf_dir))


@query("j3_left_outer", f"SELECT c.id, coalesce(r.text, '') AS text, coalesce(r.reviewed, false) AS reviewed FROM {X.CUES_SQL} c LEFT JOIN {X.RENDITIONS_SQL} r ON r.cue_id = c.id")
def j3_left_outer(spark, sf_dir):
    r = X.renditions(spark, sf_dir).select(F.col("cue_id").alias("id"), "text", F.col("reviewed").alias("_r"))
    return X.cues(spark, sf_dir).select("id").join(r, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("_r", F.lit(False)).alias("reviewed"))


@query("e9_fork", f"""SELECT c.job_id, c.id, 'ja' AS lang, idx, start_ms, end_ms, coalesce(r.text, '') AS text, coalesce(r.reviewed AND {HASH.format('hash_of')} = {HASH.format(BEST)}, false) AS reviewed
FROM {X.CUES_SQL} c LEFT JOIN {X.RENDITIONS_SQL} r ON r.cue_id = c.id AND r.lang = 'ja' WHERE c.job_id NOT IN (SELECT job_id FROM {X.FORKED_SQL})""")
def e9_fork(spark, sf_dir):
    return editing.forked_track(X.cues(spark, sf_dir), X.renditions(spark, sf_dir), "ja", X.forked(spark, sf_dir))


@query("e10_unfork", f"""SELECT cue_id, lang, text, reviewed FROM (SELECT a.id AS cue_id, b.lang, b.text, b.reviewed, row_number() OVER (PARTITION BY a.id ORDER BY least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) DESC, b.start_ms, b.id) AS n
FROM {X.CUES_SQL} a JOIN {X.FORKED_SQL} b ON a.job_id = b.job_id AND b.start_ms < a.end_ms AND b.end_ms > a.start_ms) WHERE n = 1""")
def e10_unfork(spark, sf_dir):
    return editing.unforked(X.cues(spark, sf_dir), X.forked(spark, sf_dir))


_MEET = "b.job_id = a.job_id AND b.start_ms < a.end_ms AND b.end_ms > a.start_ms"
_PLAIN = r"regexp_replace({}, '[^\p{{L}}\p{{N}}_]+', '', 'g')"
NEW = X.FORKED_SQL.replace("replace(text, 'e', 'i')", "case when turn % 2 = 0 then text else replace(text, 'e', 'i') end")


@query("e11_e12_import", f"""WITH a AS (SELECT job_id, id, start_ms, end_ms, text FROM {NEW}), m AS (SELECT a.id, b.text_stt AS t, b.start_ms, b.id AS old, lag(b.text_stt) OVER (PARTITION BY a.id ORDER BY b.start_ms, b.id) AS before FROM a JOIN {X.CUES_SQL} b ON {_MEET}),
s AS (SELECT id, coalesce(string_agg(t, ' ' ORDER BY start_ms, old) FILTER (before IS NULL OR before <> t), '') AS text_stt FROM m GROUP BY id), k AS (SELECT a.id, string_agg(b.text, ' ' ORDER BY b.start_ms, b.cap_id) AS text_caption FROM a JOIN {X.CAPTIONS_SQL} b ON {_MEET} GROUP BY a.id),
c AS (SELECT a.id, b.id AS rendition_of, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.start_ms - b.start_ms), b.id) AS n FROM a JOIN {X.CUES_SQL} b ON a.job_id = b.job_id AND {_PLAIN.format('a.text')} = {_PLAIN.format("coalesce(nullif(b.text_final, ''), nullif(b.text_llm, ''), b.text_stt)")} AND {_PLAIN.format('a.text')} <> '' WHERE abs(a.start_ms - b.start_ms) <= 20000)
SELECT a.*, coalesce(s.text_stt, '') AS text_stt, rendition_of, coalesce(text_caption, '') AS text_caption, {RENUMBERED.replace('start_ms, end_ms, id', 'a.start_ms, a.end_ms, a.id')} FROM a LEFT JOIN s USING (id) LEFT JOIN k USING (id) LEFT JOIN (SELECT id, rendition_of FROM c WHERE n = 1) USING (id)""")
def e11_e12_import(spark, sf_dir):
    """A new structure whose even cues have texts of the old one."""
    text = F.when(F.col("idx") % 2 == 0, F.col("_whole")).otherwise(F.col("text"))
    whole = X.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 500).alias("id"), F.col("text").alias("_whole"))
    new = X.forked(spark, sf_dir).join(whole, "id").select("job_id", "id", "start_ms", "end_ms", text.alias("text"))
    return editing.imported(new, X.cues(spark, sf_dir), X.captions(spark, sf_dir)).withColumn("idx", F.col("idx").cast("long"))


MODEL = "(SELECT DISTINCT {} AS source_hash, 'model ' || left({}, 4) AS text FROM {} WHERE idx % 2 = 0)"


@query("e15_translate_routing", f"""SELECT id, route, CASE WHEN route IN ('edited', 'fresh') THEN old WHEN route = 'model' THEN new ELSE source END AS text FROM (SELECT c.id, {BEST} AS source, r.text AS old, m.text AS new,
CASE WHEN r.edited THEN 'edited' WHEN {HASH.format('hash_of')} = {HASH.format(BEST)} THEN 'fresh' WHEN m.text IS NOT NULL THEN 'model' ELSE 'source' END AS route
FROM {X.CUES_SQL} c LEFT JOIN {X.RENDITIONS_SQL} r ON r.cue_id = c.id AND r.lang = 'fr' LEFT JOIN {MODEL.format(HASH.format(BEST), BEST, X.CUES_SQL)} m ON m.source_hash = {HASH.format(BEST)})""")
def e15_translate_routing(spark, sf_dir):
    cues = X.cues(spark, sf_dir)
    best = T.first_filled("text_final", "text_llm", "text_stt")
    model = cues.filter("idx % 2 = 0").select(editing.fresh_hash(best).alias("source_hash"), F.concat(F.lit("model "), F.left(best, F.lit(4))).alias("text")).distinct()
    return editing.routed(cues, X.renditions(spark, sf_dir), model, "fr")


@query("e17_spell_routing", f"""WITH l AS (SELECT id, text_final AS text, substr(sha256('s1' || chr(31) || text_final), 1, 20) AS h FROM {X.CUES_SQL}), k AS (SELECT DISTINCT h, upper(text) AS known FROM l WHERE id % 3 = 0 AND text <> ''), r AS (SELECT id, text, known, CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 'blank' WHEN known IS NOT NULL THEN 'cached' ELSE 'todo' END AS route FROM l LEFT JOIN k USING (h))
SELECT id, CASE WHEN route <> 'todo' THEN route WHEN row_number() OVER (PARTITION BY route ORDER BY id) <= 100 THEN 'sent' ELSE 'later' END AS route, coalesce(known, text) AS text FROM r""")
def e17_spell_routing(spark, sf_dir):
    lines = X.cues(spark, sf_dir).select("id", F.col("text_final").alias("text"))
    memo = lines.filter("id % 3 = 0 AND text <> ''").select(F.lit("spell").alias("kind"), T.content_hash(20, F.lit("s1"), F.col("text")).alias("source_hash"), F.upper("text").alias("text"))
    return editing.cached_stage(lines, memo, "spell", "s1", 100)


PAIRS = f"(SELECT a.term AS wrong, CASE WHEN a.r % 4 <> 0 AND b.term IS NOT NULL THEN b.term ELSE a.term || 'x' END AS \"right\", a.n AS count, a.r FROM {RANKED} a LEFT JOIN {RANKED} b ON b.r = a.r + 1)"
_ONCE = r"regexp_replace({}, '(^|[^\p{{L}}\p{{N}}_])' || split_part(p, chr(1), 1) || '($|[^\p{{L}}\p{{N}}_])', '\1' || split_part(p, chr(1), 2) || '\2', 'g')"
#: Neighbouring words share what stands between them, so each pair goes over the text twice.
PRE_PASSED = f"list_reduce(list_prepend(text_stt, (SELECT list(wrong || chr(1) || \"right\" ORDER BY r) FROM {PAIRS})), lambda acc, p: CASE WHEN contains(acc, split_part(p, chr(1), 1)) THEN {_ONCE.format(_ONCE.format('acc'))} ELSE acc END)"


def word_pairs(spark, sf_dir):
    """Frequent words of documents, each to give way to the next one by rank, in chains of four."""
    ranked = counts(spark, sf_dir).orderBy(F.desc("n"), "term").limit(40).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "term")))
    following = ranked.select((F.col("r") - 1).alias("r"), F.col("term").alias("_next"))
    right = F.when((F.col("r") % 4 != 0) & F.col("_next").isNotNull(), F.col("_next")).otherwise(F.concat("term", F.lit("x")))
    return ranked.join(following, "r", "left").select(F.col("term").alias("wrong"), right.alias("right"), F.col("n").alias("count"))


@query("l9_pre_pass_of_words", f"SELECT id, text_stt AS before, {PRE_PASSED} AS text FROM {X.CUES_SQL}")
def l9_pre_pass_of_words(spark, sf_dir):
    return learning.pre_passed(X.cues(spark, sf_dir), word_pairs(spark, sf_dir))


#: A pair of its own for each job, seen in one of its first cues.
OWN = f"(SELECT job_id, term AS wrong, term || 'q' AS \"right\", job_id % 3 AS first_idx FROM {X.MEDIA_SQL} JOIN {RANKED} ON r = 1 + job_id % 40)"


@query("l8_propagated_words", f"""WITH t AS (SELECT id, job_id, idx, {BEST} AS text_stt FROM {X.CUES_SQL} WHERE NOT reviewed), g AS MATERIALIZED (SELECT wrong, "right" FROM {PAIRS} WHERE count >= 2), o AS MATERIALIZED (SELECT * FROM {OWN}),
k AS (SELECT t.id, wrong, "right" FROM t, g UNION SELECT t.id, wrong, "right" FROM t JOIN o ON o.job_id = t.job_id AND t.idx > first_idx), l AS (SELECT id, list(wrong || chr(1) || "right" ORDER BY -length(wrong), wrong, "right") AS pairs FROM k GROUP BY id)
SELECT t.id, text_stt AS before, list_reduce(list_prepend(text_stt, pairs), lambda acc, p: CASE WHEN contains(acc, split_part(p, chr(1), 1)) THEN {_ONCE.format(_ONCE.format('acc'))} ELSE acc END) AS text FROM t JOIN l USING (id) WHERE text_stt <> ''""")
def l8_propagated_words(spark, sf_dir):
    ranked = counts(spark, sf_dir).orderBy(F.desc("n"), "term").limit(40).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "term")))
    own = X.media(spark, sf_dir).select("job_id", (F.col("job_id") % 3).alias("first_idx"), (1 + F.col("job_id") % 40).alias("r")).join(ranked, "r")
    return learning.propagated(X.cues(spark, sf_dir), word_pairs(spark, sf_dir), own.select("job_id", F.col("term").alias("wrong"), F.concat("term", F.lit("q")).alias("right"), "first_idx"))


ROUTES = f"""b AS (SELECT *, {PRE_PASSED} AS base FROM {X.CUES_SQL}), h AS (SELECT *, substr(sha256('c7' || chr(31) || base || chr(31) || text_caption), 1, 20) AS source_hash,
  {STRIPPED.format('base')} <> '' AND (flagged OR EXISTS (SELECT 1 FROM {TERM_FORMS} t WHERE contains(base || ' ' || text_caption, t.form))) AS needed FROM b),
m AS (SELECT source_hash, arg_min('known ' || base, id) AS known, arg_min(id % 4 = 0, id) AS changed, arg_min(id % 6 = 0, id) AS unsure FROM h WHERE id % 2 = 0 GROUP BY source_hash),
r AS (SELECT h.*, known, changed, unsure, CASE WHEN NOT needed THEN 'skipped' WHEN known IS NOT NULL THEN 'cached' ELSE 'sent' END AS route FROM h LEFT JOIN m USING (source_hash)),
routes AS (SELECT job_id, idx, id, route, CASE WHEN route = 'sent' THEN (row_number() OVER (PARTITION BY job_id, route ORDER BY idx, id) - 1) // 50 END AS chunk, base, source_hash,
  CASE route WHEN 'skipped' THEN CASE WHEN {STRIPPED.format('base')} <> '' THEN base ELSE text_caption END WHEN 'cached' THEN CASE WHEN changed THEN known ELSE base END END AS text, CASE route WHEN 'skipped' THEN false WHEN 'cached' THEN unsure END AS uncertain FROM r)"""


def correction_routes(spark, sf_dir):
    cues, pairs = X.cues(spark, sf_dir), word_pairs(spark, sf_dir)
    pairs = storage.written(pairs, "word_pairs")
    base = storage.written(learning.pre_passed(cues, pairs).select("id", F.col("text").alias("base")), "base")
    hashed = cues.join(base, "id").select("id", "base", T.content_hash(20, F.lit("c7"), F.col("base"), F.col("text_caption")).alias("source_hash"))
    memo = hashed.filter("id % 2 = 0").groupBy("source_hash").agg(F.min(F.struct("id", F.concat(F.lit("known "), "base").alias("text"), (F.col("id") % 4 == 0).alias("changed"), (F.col("id") % 6 == 0).alias("uncertain"))).alias("m")).select("source_hash", "m.text", "m.changed", "m.uncertain")
    return editing.correction_routes(cues, pairs, forms(spark, sf_dir), memo, "c7", passed=base)


def answered(spark, sf_dir):
    routes = storage.written(correction_routes(spark, sf_dir), "routes")
    return editing.corrected(routes, routes.filter("id % 3 = 0").select("id", F.reverse("base").alias("text"), (F.col("id") % 5 == 0).alias("uncertain")))


@query("e16_correct_routing", f"WITH {ROUTES} SELECT job_id, id, route, chunk, base, source_hash, text, uncertain FROM routes")
def e16_correct_routing(spark, sf_dir):
    return correction_routes(spark, sf_dir)


@query("e16_corrected", f"WITH {ROUTES} SELECT id, CASE WHEN route <> 'sent' THEN text WHEN id % 3 = 0 THEN reverse(base) ELSE base END AS text, CASE WHEN route <> 'sent' THEN uncertain ELSE id % 3 = 0 AND id % 5 = 0 END AS uncertain FROM routes")
def e16_corrected(spark, sf_dir):
    return answered(spark, sf_dir)[0]


@query("e16_memo", f"WITH {ROUTES}, s AS (SELECT *, row_number() OVER (PARTITION BY source_hash ORDER BY id) AS n, CASE WHEN id % 3 = 0 THEN reverse(base) ELSE base END AS given FROM routes WHERE route = 'sent') SELECT source_hash, given AS text, given <> base AS changed, id % 3 = 0 AND id % 5 = 0 AS uncertain FROM s WHERE n = 1")
def e16_memo(spark, sf_dir):
    return answered(spark, sf_dir)[1]


STRIPPED_BEST = STRIPPED.format(BEST)


@query("e18_retranslated", f"""WITH c AS (SELECT job_id, idx, id, {STRIPPED_BEST} AS best, row_number() OVER (PARTITION BY job_id ORDER BY idx, id) AS pos FROM {X.CUES_SQL}), r AS (SELECT * FROM {X.RENDITIONS_SQL}),
n AS (SELECT c.*, best <> '' AND (r.text IS NULL OR {STRIPPED.format('r.text')} = '' OR (NOT r.edited AND {HASH.format('r.hash_of')} <> {HASH.format('best')})) AS needs FROM c LEFT JOIN r ON r.cue_id = c.id AND r.lang = 'fr'),
p AS (SELECT job_id, pos AS p FROM n WHERE idx = job_id % 4), k AS (SELECT n.*, p FROM n JOIN p USING (job_id) WHERE abs(pos - p) <= 6 AND best <> '' AND NOT EXISTS (SELECT 1 FROM n o WHERE o.job_id = n.job_id AND NOT o.needs AND o.pos <> p AND o.pos BETWEEN least(n.pos, p) AND greatest(n.pos, p))),
m AS (SELECT DISTINCT {HASH.format('best')} AS h FROM c WHERE id % 5 <> 0), a AS (SELECT k.*, 'new ' || best AS text FROM k JOIN m ON h = {HASH.format('best')}),
w AS (SELECT * FROM a WHERE job_id IN (SELECT job_id FROM a WHERE pos = p))
SELECT cue_id, job_id, lang, text, hash_of, reviewed, edited FROM r WHERE NOT (lang = 'fr' AND cue_id IN (SELECT id FROM w)) UNION ALL SELECT id, job_id, 'fr', text, best, false, false FROM w""")
def e18_retranslated(spark, sf_dir):
    cues = X.cues(spark, sf_dir)
    best = T.stripped(T.first_filled("text_final", "text_llm", "text_stt"))
    model = cues.filter("id % 5 <> 0").select(editing.fresh_hash(best).alias("source_hash"), F.concat(F.lit("new "), best).alias("text")).distinct()
    return editing.retranslated(cues, X.renditions(spark, sf_dir), cues.filter("idx = job_id % 4"), model, "fr")


COURSES = tuple(f"c{k}" for k in range(40))
CHANGES = "(SELECT event_id AS seq, user_id % 60 AS job_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'c' || event_id // 6 % 50 END AS course, event_id % 4 = 0 AS \"on\" FROM events)"
BOUND = "(SELECT *, CASE job_id WHEN 14 THEN 'c1' WHEN 21 THEN 'c2' ELSE '' END AS course FROM " + X.MEDIA_SQL + ")"
FLAGS = f"""WITH m AS (SELECT * FROM {BOUND}), v AS (SELECT * FROM {CHANGES} WHERE (course IS NULL OR course = '' OR substr(course, 2)::INT < 40) AND job_id IN (SELECT job_id FROM m WHERE NOT is_clone)),
o AS (SELECT seq, job_id, CASE WHEN course IS NULL THEN '' ELSE course END AS course FROM v WHERE course IS NOT NULL OR NOT "on" UNION ALL SELECT -1, job_id, course FROM m),
l AS (SELECT job_id, max(seq) AS seq, arg_max(course, seq) AS course FROM o GROUP BY job_id), q AS (SELECT seq, job_id, coalesce(course <> '', "on") AS practice FROM v WHERE course IS NULL OR course <> '' UNION ALL SELECT -1, job_id, practice FROM m),
flags AS (SELECT job_id, (SELECT arg_max(practice, seq) FROM q WHERE q.job_id = l.job_id) AS practice, CASE WHEN course <> '' AND NOT EXISTS (SELECT 1 FROM o WHERE o.course = l.course AND o.seq > l.seq) THEN course ELSE '' END AS course FROM l)"""


def practice_flags(spark, sf_dir):
    n = F.col("event_id")
    course = F.when(n % 6 == 1, "").when(n % 6 != 0, F.concat(F.lit("c"), (F.floor(n / 6) % 50).cast("string")))
    changes = X.table(spark, sf_dir, "events").select(n.alias("seq"), (F.col("user_id") % 60).alias("job_id"), course.alias("course"), (n % 4 == 0).alias("on"))
    media = X.media(spark, sf_dir).withColumn("course", F.when(F.col("job_id") == 14, "c1").when(F.col("job_id") == 21, "c2").otherwise(""))
    return editing.practice_flags(media, changes, COURSES)


@query("e21_practice_flags", f"{FLAGS} SELECT * FROM flags")
def e21_practice_flags(spark, sf_dir):
    return practice_flags(spark, sf_dir)


@query("a13_course_map", f"{FLAGS} SELECT course, max(job_id) AS job_id, arg_max(title, job_id) AS title FROM flags JOIN (SELECT job_id, title FROM {X.MEDIA_SQL} WHERE NOT is_clone) USING (job_id) WHERE course <> '' GROUP BY course")
def a13_course_map(spark, sf_dir):
    return editing.course_map(practice_flags(spark, sf_dir), X.media(spark, sf_dir))


@query("e20_defects", f"SELECT id, CASE WHEN has AND n <= 2 THEN replace(text_stt, 'ing', 'ign') ELSE text_stt END AS text_stt FROM (SELECT *, row_number() OVER (PARTITION BY job_id, has ORDER BY idx) AS n FROM (SELECT *, contains(text_stt, 'ing') AS has FROM {X.CUES_SQL}))")
def e20_defects(spark, sf_dir):
    return editing.with_defects(X.cues(spark, sf_dir), "ing", "ign", 2)


@query("e21_job_flags", f"SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'new' ELSE assignee END AS assignee, practice AND job_id % 2 = 0 AS practice FROM {X.MEDIA_SQL}")
def e21_job_flags(spark, sf_dir):
    return X.media(spark, sf_dir).select("job_id", F.when(F.col("job_id") % 3 == 0, "new").otherwise(F.col("assignee")).alias("assignee"), (F.col("practice") & (F.col("job_id") % 2 == 0)).alias("practice"))


@query("e23_edit_rendition", f"SELECT cue_id, lang, CASE WHEN cue_id % 5 = 1 THEN 'edit' ELSE text END AS text, edited OR cue_id % 5 = 1 AS edited FROM {X.RENDITIONS_SQL} WHERE cue_id % 5 <> 2")
def e23_edit_rendition(spark, sf_dir):
    r = X.renditions(spark, sf_dir)
    edits = r.filter("cue_id % 5 IN (1, 2)").select("cue_id", "lang", F.when(F.col("cue_id") % 5 == 1, "edit").otherwise(" ").alias("new_text"))
    return editing.edited_rendition(r, edits)


@query("e24_e26_request_guard", f"SELECT DISTINCT r.video AS job_id FROM {X.REQUESTS_SQL} r WHERE status = 'pending' AND video NOT IN (SELECT job_id FROM (SELECT job_id, bool_and(reviewed) AS done FROM {X.CUES_SQL} GROUP BY job_id) WHERE done) AND video NOT IN (SELECT video FROM {X.REQUESTS_SQL} WHERE status = 'processing' AND request_id % 7 = 0)")
def e24_e26_request_guard(spark, sf_dir):
    r = X.requests(spark, sf_dir)
    done = X.cues(spark, sf_dir).groupBy("job_id").agg(F.bool_and("reviewed").alias("done")).filter("done")
    busy = r.filter("status = 'processing' AND request_id % 7 = 0").select(F.col("video").alias("job_id"))
    return r.filter("status = 'pending'").select(F.col("video").alias("job_id")).distinct().join(done, "job_id", "left_anti").join(busy, "job_id", "left_anti")


@query("e25_patch", f"SELECT id, CASE WHEN id % 3 = 0 THEN 'changed' ELSE text_stt END AS text_stt FROM {X.CUES_SQL} WHERE id % 4 <> 0 OR id % 3 = 0")
def e25_patch(spark, sf_dir):
    rows = X.cues(spark, sf_dir).select("id", "text_stt")
    return editing.patched(rows, rows.filter("id % 4 = 0").select("id"), rows.filter("id % 3 = 0").withColumn("text_stt", F.lit("changed")))


@query("j16_latest_pick", f"SELECT video, first(request_id ORDER BY created_at DESC, request_id DESC) AS request_id FROM {X.REQUESTS_SQL} GROUP BY video")
def j16_latest_pick(spark, sf_dir):
    return X.requests(spark, sf_dir).groupBy("video").agg(F.max_by("request_id", F.struct("created_at", "request_id")).alias("request_id"))


@query("s12_backfill", f"SELECT m.job_id, coalesce(nullif(assignee, ''), 'reviewer of ' || c.n) AS assignee FROM {X.MEDIA_SQL} m JOIN (SELECT job_id, count(*) AS n FROM {X.CUES_SQL} GROUP BY job_id) c ON c.job_id = m.job_id")
def s12_backfill(spark, sf_dir):
    n = X.cues(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("n"))
    return X.media(spark, sf_dir).join(n, "job_id").select("job_id", F.coalesce(F.nullif("assignee", F.lit("")), F.concat(F.lit("reviewer of "), F.col("n").cast("string"))).alias("assignee"))


@query("k3_track_export", f"SELECT job_id, start_ms, end_ms, text FROM {X.FORKED_SQL} WHERE text <> '' UNION ALL SELECT c.job_id, start_ms, end_ms, coalesce(nullif(r.text, ''), {BEST}) AS text FROM {X.CUES_SQL} c LEFT JOIN {X.RENDITIONS_SQL} r ON r.cue_id = c.id AND r.lang = 'ja' WHERE c.job_id NOT IN (SELECT job_id FROM {X.FORKED_SQL})")
def k3_track_export(spark, sf_dir):
    own = X.forked(spark, sf_dir)
    r = X.renditions(spark, sf_dir).filter("lang = 'ja'").select(F.col("cue_id").alias("id"), F.col("text").alias("_t"))
    rest = X.cues(spark, sf_dir).join(own.select("job_id").distinct(), "job_id", "left_anti").join(r, "id", "left")
    return own.filter("text <> ''").select("job_id", "start_ms", "end_ms", "text").union(rest.select("job_id", "start_ms", "end_ms", T.first_filled("_t", "text_final", "text_llm", "text_stt").alias("text")))
