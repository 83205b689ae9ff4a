"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import clustering, exact_dedup, language_id, lexical_search, license_scan, near_dedup, packing, repeats, secret_scan, segmentation, token_counts, token_store, webp
from cuelake.llm.common import documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text: what is left; a character that a cut has gone through shows as U+FFFD."""
    out = repeats.without_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.read_media(webp.store_texts(documents(spark, sf_dir)))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir), k=3, percent=85)


def op7_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = segmentation.sampled_segmentations(documents(spark, sf_dir))
    return segmentation.decoded(samples).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_dual_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_back(token_store.stored(documents(spark, sf_dir)))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def _license_sql() -> str:
    rows = []
    for number, (text, label, base) in enumerate([*((t, n, True) for t, n in license_scan.BASE_PHRASES), *((t, n, False) for n, t in license_scan.NOTICES)]):
        w = text.split()
        rows += [f"({number}, '{label}', {str(base).lower()}, {i}, {len(w) - 2}, '{' '.join(w[i : i + 3])}')" for i in range(len(w) - 2)]
    return f"""
WITH templates(template, label, base, place, grams, gram) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'pos': i - 1, 'gram': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}}), recursive := true) FROM d),
diagonals AS (SELECT doc_id, template, label, base, grams, pos - place AS diagonal, list(DISTINCT place) AS places FROM g JOIN templates USING (gram) GROUP BY ALL),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= CASE WHEN base THEN 0 ELSE 3 END THEN 0 ELSE 1 END AS fresh FROM diagonals WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM marked),
merged AS (SELECT doc_id, label, base, grams, min(diagonal) AS place, len(list_distinct(flatten(list(places)))) AS votes FROM islands GROUP BY doc_id, template, label, base, grams, island),
found AS (SELECT *, base AND votes = grams AS is_base, NOT base AND votes / grams >= 0.5 AS is_notice FROM merged)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, count(*) FILTER (is_base) AS n_base, min(place) FILTER (is_base) AS first_word, max(place) FILTER (is_base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base OR is_notice), '') AS labels,
  coalesce(max(CASE WHEN is_base THEN 1.0::DOUBLE WHEN NOT base THEN votes::DOUBLE / grams END), 0.0::DOUBLE) AS score
FROM d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id
"""


def _clusters_sql(rounds: int = 5, k: int = 40) -> str:
    """Lloyd rounds with every vector against every centroid. All numbers are whole and below 2 ** 53, so doubles hold them exactly."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT v.id, min(struct_pack(d := v.a + c.a - 2 * list_inner_product(v.q, c.q), k := c.k)) AS best FROM v, c{r} c GROUP BY v.id)")
        if r < rounds:
            steps.append(f"s{r} AS MATERIALIZED (SELECT k, list(m ORDER BY i) AS q FROM (SELECT best.k AS k, i, floor(sum(q[i]) / count(*)) AS m FROM a{r} JOIN v USING (id), range(1, 65) t(i) GROUP BY ALL) GROUP BY k)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k, q, list_inner_product(q, q) AS a FROM (SELECT c.k, coalesce(s.q, c.q) AS q FROM c{r} c LEFT JOIN s{r} s USING (k)))")
    return f"""
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, q, list_inner_product(q, q) AS a FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS k, q, a FROM v QUALIFY k < {k}),
{", ".join(steps)}
SELECT v.vec_id, a.best.k::INTEGER AS cluster, a.best.d::BIGINT AS distance, sum(a.best.d) OVER (PARTITION BY a.best.k)::BIGINT AS cluster_inertia, sum(a.best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.q, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (id) JOIN c{rounds} c ON c.k = a.best.k
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_dual_tree_clusters": _clusters_sql(),
        "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY points DESC, doc_id)
""",
        "op4_license_scan": _license_sql(),
        "op11_lexical_search": r"""
WITH every AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
words AS (SELECT side, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM every),
counts AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM words WHERE side = 'd'),
tf AS (SELECT id AS doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM words WHERE side = 'd'),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM tf GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, counts GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest(w) AS term FROM (SELECT id AS item_id, w FROM words WHERE side = 'i')),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN p USING (term) JOIN df USING (term), counts GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 50
""",
        "op6_minhash_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
reach(id, to_id) AS (SELECT doc_id, doc_id FROM d UNION SELECT id, b FROM reach JOIN link ON a = to_id)
SELECT s.doc_id, len(any_value(s.s))::BIGINT AS n_shingles, min(to_id) AS component_id, s.doc_id = min(to_id) AS kept FROM s JOIN reach ON id = s.doc_id GROUP BY s.doc_id
""",
    }
