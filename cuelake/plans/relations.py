"""Queries over several tables tied by keys: jobs, their cues, and the cues' renditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators import editing, learning, relations
from cuelake.plans import fixtures as X
from cuelake.plans.editing import BEST, STRIPPED
from cuelake.plans.registry import query

JOB = {"id": "job_id", "title": "title", "practice": "practice or is_clone", "clone_of": "case when is_clone then job_id - 1 end", "updated": "created"}
CUE = {"id": "id", "job_id": "job_id", "text": "text_stt"}
RENDITION = {"id": "cue_id * 10 + case when lang = 'ja' then 1 else 2 end", "cue_id": "cue_id", "lang": "lang", "text": "text"}
SQL = {"job": X.sql(JOB, X.MEDIA_SQL), "cue": X.sql(CUE, X.CUES_SQL), "rendition": X.sql(RENDITION, X.RENDITIONS_SQL)}
#: The column of each table that holds its parent's id, and the text that a query shows.
SHOWN = {"job": ("clone_of", "title"), "cue": ("job_id", "text"), "rendition": ("cue_id", "text")}


def tables(spark, sf_dir) -> dict[str, DataFrame]:
    return {"job": X.shaped(X.media(spark, sf_dir), JOB), "cue": X.shaped(X.cues(spark, sf_dir), CUE), "rendition": X.shaped(X.renditions(spark, sf_dir), RENDITION)}


def shown(found: dict[str, DataFrame]) -> DataFrame:
    rows = [df.select(F.lit(name).alias("table"), F.col("id").cast("long").alias("id"), F.col(SHOWN[name][0]).cast("long").alias("parent"), F.col(SHOWN[name][1]).alias("text")) for name, df in found.items()]
    return reduce(DataFrame.union, rows)


SESSION = "'~' || substr(sha256('a session'), 1, 10)"


@query("e19_clone", f"""WITH j AS (SELECT id, (SELECT max(id) FROM {SQL['job']}) + 1 AS new, title FROM {SQL['job']} WHERE id = 7 AND practice AND clone_of IS NULL),
c AS (SELECT c.id, (SELECT max(id) FROM {SQL['cue']}) + row_number() OVER (ORDER BY c.id) AS new, j.new AS parent, c.text FROM {SQL['cue']} c JOIN j ON c.job_id = j.id),
r AS (SELECT (SELECT max(id) FROM {SQL['rendition']}) + row_number() OVER (ORDER BY r.id) AS new, c.new AS parent, r.text FROM {SQL['rendition']} r JOIN c ON r.cue_id = c.id)
SELECT 'job' AS "table", new AS id, id AS parent, title || {SESSION} AS text FROM j UNION ALL SELECT 'cue', new, parent, text FROM c UNION ALL SELECT 'rendition', new, parent, text FROM r""")
def e19_clone(spark, sf_dir):
    """A practice job's deep copy for a session, under ids that follow the tables' last ones."""
    return shown(editing.practice_clones(tables(spark, sf_dir), 7, "a session", 900))


GONE = f"SELECT id FROM {SQL['job']} WHERE clone_of IS NOT NULL AND practice AND updated < 593"


@query("e19_expired", f"""WITH c AS (SELECT * FROM {SQL['cue']} WHERE job_id NOT IN ({GONE}))
SELECT 'job' AS "table", id, clone_of AS parent, title AS text FROM {SQL['job']} WHERE id NOT IN ({GONE}) UNION ALL SELECT 'cue', id, job_id, text FROM c UNION ALL SELECT 'rendition', id, cue_id, text FROM {SQL['rendition']} WHERE cue_id IN (SELECT id FROM c)""")
def e19_expired(spark, sf_dir):
    """What is left of all tables once clones that nobody has touched for a week are gone."""
    return shown(editing.without_stale_clones(tables(spark, sf_dir), 600))


def copy(spark, sf_dir):
    """A copy to a target that has a third of the jobs already; some cues are missing at the source, so renditions of theirs lead nowhere."""
    every = tables(spark, sf_dir)
    source = {**every, "cue": every["cue"].filter("id % 17 <> 3")}
    target = {"job": every["job"].filter("id % 3 = 0").withColumn("title", F.lit("kept")), "cue": every["cue"].filter("job_id % 3 = 0").withColumn("text", F.lit("kept")), "rendition": every["rendition"].limit(0)}
    return relations.copied(source, target, editing.JOB_KEYS, force=True)


COPIED = f"""WITH c AS (SELECT id, job_id, CASE WHEN job_id % 3 = 0 THEN 'kept' ELSE text END AS text FROM {SQL['cue']} WHERE job_id % 3 = 0 OR id % 17 <> 3),
t AS (SELECT 'job' AS "table", id, clone_of AS parent, CASE WHEN id % 3 = 0 THEN 'kept' ELSE title END AS text FROM {SQL['job']} UNION ALL SELECT 'cue', id, job_id, text FROM c UNION ALL SELECT 'rendition', id, cue_id, text FROM {SQL['rendition']} WHERE cue_id IN (SELECT id FROM c))"""


@query("k11_copied_tables", f"{COPIED} SELECT * FROM t")
def k11_copied_tables(spark, sf_dir):
    return shown(copy(spark, sf_dir)[0])


@query("k11_refused", f"{COPIED} SELECT 'rendition' AS \"table\", id, cue_id AS parent, text FROM {SQL['rendition']} WHERE cue_id NOT IN (SELECT id FROM c)")
def k11_refused(spark, sf_dir):
    return shown(copy(spark, sf_dir)[1])


@query("k11_next_ids", f"{COPIED} SELECT \"table\", max(id) + 1 AS next_id FROM t GROUP BY \"table\"")
def k11_next_ids(spark, sf_dir):
    return relations.next_ids(copy(spark, sf_dir)[0]).select("table", F.col("next_id").cast("long").alias("next_id"))


FORMS = "(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{11,}')) AS form FROM benchmark)"


def forms(spark, sf_dir):
    return X.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{11,}"), F.lit(0))).alias("form")).distinct()


def _chosen(pairs: str, most: int) -> str:
    """SQL that takes pairs (source, text, and the order by a, b, c): those that hold a form first, then a sample spread over the lengths of the others."""
    return f"""held AS (SELECT *, EXISTS (SELECT 1 FROM {FORMS} f WHERE contains(source, f.form)) AS has_term FROM {pairs}), sizes AS (SELECT count(*) FILTER (NOT has_term) AS others, least({most}, count(*) FILTER (has_term)) AS bearing FROM held),
steps AS (SELECT others, bearing, {most} - bearing AS room, greatest(1, others // greatest(1, {most} - bearing)) AS step FROM sizes),
placed AS (SELECT *, row_number() OVER (PARTITION BY has_term ORDER BY CASE WHEN has_term THEN 0 ELSE length(source) END, a, b, c) - 1 AS i FROM held)
SELECT (CASE WHEN has_term THEN i ELSE bearing + i // step END)::INTEGER AS place, source, text, has_term FROM placed, steps WHERE CASE WHEN has_term THEN i < {most} ELSE i % step = 0 AND i // step < room END"""


REAL = f"(SELECT job_id FROM {X.MEDIA_SQL} WHERE NOT practice)"
OVER = "least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)"


@query("l19_translation_examples", f"""WITH s AS (SELECT job_id, id, start_ms, end_ms, {STRIPPED.format(BEST)} AS source FROM {X.CUES_SQL} WHERE job_id IN {REAL}),
o AS (SELECT * FROM {X.FORKED_SQL} WHERE lang = 'ja' AND reviewed AND job_id IN {REAL}),
d AS (SELECT a.id, a.job_id, a.text, b.source, {OVER} AS ms, a.end_ms - a.start_ms AS span, count(*) OVER (PARTITION BY a.id) AS k, row_number() OVER (PARTITION BY a.id ORDER BY {OVER} DESC, b.start_ms, b.id) AS n FROM o a JOIN s b ON a.job_id = b.job_id AND b.start_ms < a.end_ms AND b.end_ms > a.start_ms),
e AS (SELECT source, {STRIPPED.format('r.text')} AS text, 0 AS a, s.job_id AS b, s.id AS c FROM {X.RENDITIONS_SQL} r JOIN s ON s.id = r.cue_id WHERE lang = 'ja' AND (reviewed OR edited) UNION ALL SELECT source, {STRIPPED.format('text')}, 1, job_id, id FROM d WHERE n = 1 AND (k = 1 OR ms * 100 >= span * 80)),
p AS (SELECT * FROM e WHERE source <> '' AND text <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY a, b, c) = 1), {_chosen('p', 14)}""")
def l19_translation_examples(spark, sf_dir):
    """Examples for a translation model: from both kinds of tracks, one for each source text, those with a term of the domain first."""
    pairs = learning.translation_pairs(X.cues(spark, sf_dir), X.renditions(spark, sf_dir), X.forked(spark, sf_dir), X.media(spark, sf_dir), "ja")
    return learning.term_bearing_first(pairs, forms(spark, sf_dir), 14)


@query("t5_term_bearing_first", f"WITH p AS (SELECT source, min(text) AS text, 0 AS a, min(id) AS b, 0 AS c FROM (SELECT id, text_stt AS source, text_caption AS text FROM {X.CUES_SQL}) GROUP BY source), {_chosen('p', 400)}")
def t5_term_bearing_first(spark, sf_dir):
    rows = X.cues(spark, sf_dir).groupBy(F.col("text_stt").alias("source")).agg(F.min("text_caption").alias("text"), F.struct(F.lit(0).alias("a"), F.min("id").alias("b")).alias("order"))
    return learning.term_bearing_first(rows, forms(spark, sf_dir), 400)


@query("j1_cues_of_jobs", f"SELECT c.id, m.title, c.text_final FROM {X.CUES_SQL} c JOIN {X.MEDIA_SQL} m USING (job_id) WHERE c.reviewed AND NOT m.practice")
def j1_cues_of_jobs(spark, sf_dir):
    return X.cues(spark, sf_dir).filter("reviewed").join(X.media(spark, sf_dir).filter("NOT practice").select("job_id", "title"), "job_id").select("id", "title", "text_final")
