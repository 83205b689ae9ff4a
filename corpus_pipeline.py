"""A training-corpus pipeline: language, exact duplicates, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage's
output is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from cuelake.llm.common import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction less certain than this is no language the corpus can use.
LEAST_CERTAINTY = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with certainty; those without letters (null and empty texts too), or between languages, go.

    The model is learnt from the stage's own labelled rows; without any, no language is known and no row stays. Rows that repeat
    stay or go together, a null id is no reason to go, other columns are left behind, an empty table gives none.
    """
    found = language_id.language_id(docs, carry=COLUMNS)
    return found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_CERTAINTY)).select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that is equal but for white space: the longest, then that with the smallest id (a null one last).

    Null and empty texts are equal, so one of them stays; of rows that repeat one stays; an empty table gives none.
    """
    return exact_dedup.first_of_each(docs, COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each component of near duplicates: five-word shingles, a similarity of 0.8 or more.

    Rows that repeat id and text are one document; those without an id, or without words, are linked with nothing and stay. Other
    columns are left behind, an empty table gives none.
    """
    kept = near_dedup.first_of_each(docs, k=5, percent=80)
    # Repeated rows collapse before the shuffle.
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    single = near_dedup.keyed(docs, *COLUMNS).groupBy("key_a", "key_b").agg(F.min(F.struct(*rest, "doc_id", "text")).alias("_row"))
    return single.join(kept, ["key_a", "key_b"], "left_semi").select(*(F.col(f"_row.{c}") for c in COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; each secret in its text gives way to a mark, and n_chars follows.

    A null text stays null with its n_chars; rows that repeat stay as many; an empty table gives none.
    """
    clean = secret_scan.redacted(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in full sequences: a row for each piece, see packing.packed.

    A null or empty text is one piece of its end id; rows that repeat are documents of their own; an empty table gives no piece.
    """
    return packing.packed(docs)


STAGES = [("language_id", identified), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("secret_scan", without_secrets), ("packing", packed)]
#: Neither the classifier nor the tokenizer can be put into SQL; tests hold each stage against a brute-force version, or against the operator's own tests where it learns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/cuelake/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
