"""Timed-text tables made of the test tables: a cue track from conversations, with captions, words, renditions and the rest.

The expressions are integer arithmetic and plain string functions, so the same text serves Spark and the oracle's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUE = {
    "job_id": "conv_id",
    "idx": "turn",
    "id": "conv_id * 1000 + turn",
    "start_ms": "turn * 8000 + (conv_id * turn * 131) % 700",
    "end_ms": "turn * 8000 + (conv_id * turn * 131) % 700 + 300 + (length(text) * 97) % 9000",
    "text_stt": "replace(text, 'th', 't')",
    "text_caption": "replace(text, 'an', 'am')",
    "text_llm": "case when turn % 3 = 0 then '' else replace(text, 'he', 'eh') end",
    "text_final": "case when (conv_id + turn) % 3 <> 0 then text else '' end",
    "flagged": "length(text) % 5 = 0",
    "uncertain": "length(text) % 11 = 0",
    "reviewed": "(conv_id + turn) % 3 <> 0",
    "hold": "(conv_id * 7 + turn) % 13 = 0",
}
#: Cues of 40 characters each, as many as a turn has.
SHORT = {**CUE, "id": "conv_id * 1000000 + turn", "text_llm": "''", "text_final": "text"}
PIECES = "(SELECT conv_id, turn * 1000 + p AS turn, substring(text, p * 40 + 1, 40) AS text FROM (SELECT *, unnest(range(0, greatest(1, (length(text) + 39) // 40))) AS p FROM conversations))"
CAPTION = {"job_id": "conv_id", "cap_id": "conv_id * 1000 + turn", "start_ms": CUE["start_ms"] + " + 400", "end_ms": CUE["end_ms"] + " + 400", "text": "replace(text, 'an', 'am')"}
FORKED = {"job_id": "conv_id", "idx": "turn", "id": "conv_id * 1000 + turn + 500", "lang": "'ja'", "start_ms": CUE["start_ms"] + " + 150 * (turn % 3)", "end_ms": CUE["end_ms"] + " + 150 * (turn % 3)", "text": "replace(text, 'e', 'i')", "reviewed": "turn % 2 = 0"}
RENDITION = {"cue_id": "conv_id * 1000 + turn", "job_id": "conv_id", "lang": "case when turn % 4 = 0 then 'ja' else 'fr' end", "text": "replace(text, 'a', 'o')", "hash_of": "case when turn % 5 = 0 then replace(text, 'e', 'x') else text end", "reviewed": "turn % 4 = 2", "edited": "turn % 7 = 0"}
MEDIA = {"job_id": "conv_id", "title": "'job ' || cast(conv_id as varchar(20))", "assignee": "case when conv_id % 4 = 0 then '' else 'reviewer ' || cast(conv_id % 5 as varchar(20)) end", "practice": "conv_id % 7 = 0", "is_clone": "conv_id % 11 = 0", "created": "conv_id * 37 % 1000"}
REQUEST = {"request_id": "event_id", "video": "user_id", "status": "case event_type when 'signup' then 'pending' when 'purchase' then 'done' when 'error' then 'error' else 'processing' end", "created_at": "ts", "value": "value"}


def sql(columns: dict[str, str], table: str, where: str | None = None) -> str:
    return f"(SELECT {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {table}{' WHERE ' + where if where else ''})"


CUES_SQL = sql(CUE, "conversations")
SHORT_SQL = sql(SHORT, PIECES)
CAPTIONS_SQL = sql(CAPTION, "conversations", "turn % 4 <> 3")
FORKED_SQL = sql(FORKED, "conversations", "conv_id % 4 = 0")
RENDITIONS_SQL = sql(RENDITION, "conversations", "(conv_id + turn) % 2 = 0")
MEDIA_SQL = f"(SELECT DISTINCT * FROM {sql(MEDIA, 'conversations')})"
REQUESTS_SQL = sql(REQUEST, "events")
WORDS_SQL = f"""(SELECT job_id, id AS cue_id, start_ms + (end_ms - start_ms) * (i - 1) // n AS start_ms, start_ms + (end_ms - start_ms) * i // n AS end_ms, i - 1 AS word_no, w[i] AS word, (length(w[i]) * 37 + i * 11) % 100 AS prob
  FROM (SELECT *, len(w) AS n, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, string_split(text_stt, ' ') AS w FROM {CUES_SQL})))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*(f"{v} AS {k}" for k, v in columns.items()))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(table(spark, sf_dir, "conversations"), CUE)


def short_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 40)).cast("int")
    each = table(spark, sf_dir, "conversations").withColumn("p", F.explode(F.sequence(F.lit(0), n - 1)))
    return shaped(each.selectExpr("conv_id", "turn * 1000 + p AS turn", "substring(text, p * 40 + 1, 40) AS text"), SHORT)


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(table(spark, sf_dir, "conversations").filter("turn % 4 <> 3"), CAPTION)


def forked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(table(spark, sf_dir, "conversations").filter("conv_id % 4 = 0"), FORKED)


def renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(table(spark, sf_dir, "conversations").filter("(conv_id + turn) % 2 = 0"), RENDITION)


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(table(spark, sf_dir, "conversations"), MEDIA).distinct()


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(table(spark, sf_dir, "events"), REQUEST)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = cues(spark, sf_dir).select("job_id", F.col("id").alias("cue_id"), "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("dur"), F.split("text_stt", " ").alias("w"))
    each = split.select("job_id", "cue_id", "start_ms", "dur", F.size("w").alias("n"), F.posexplode("w").alias("word_no", "word"))
    return each.selectExpr("job_id", "cue_id", "start_ms + dur * word_no div n AS start_ms", "start_ms + dur * (word_no + 1) div n AS end_ms", "word_no", "word", "(length(word) * 37 + (word_no + 1) * 11) % 100 AS prob")
