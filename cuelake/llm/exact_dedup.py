"""Exact deduplication by a 128-bit content hash, with a comparison of the bytes behind each hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: the characters that the comparison ignores.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space. Of equal texts the one with the most code points stays,
    and of those the one with the smallest id; a null id comes last. Null and empty texts form one group. Rows that repeat
    both id and text count separately in group_size and share `kept`. Extra columns are ignored; an empty table gives none.

    Rows are grouped by (hash, bytes), so two texts that share a hash are never merged; as the bytes are a grouping key,
    copies collapse before the shuffle and no task holds a group. A group is then named by (hash, SHA-256): should two
    different byte strings share both, the job stops instead of merging them.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_points"), text.alias("_text"))
    groups = (
        rows.groupBy(F.unhex(F.md5("_text")).alias("_hash"), "_text")
        .agg(F.count("*").alias("_n"))
        .select("_hash", F.unhex(F.sha2("_text", 256)).alias("_sha"), "_n")
        .groupBy("_hash", "_sha")
        .agg(F.sum("_n").alias("group_size"), F.count("*").alias("_texts"))
        .withColumn("group_size", F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long")))
    )
    light = rows.select("_id", "_points", F.unhex(F.md5("_text")).alias("_hash"), F.unhex(F.sha2("_text", 256)).alias("_sha"))
    keepers = light.groupBy("_hash", "_sha").agg(F.min_by("_id", F.struct(-F.col("_points"), F.col("_id").isNull(), "_id")).alias("keep_id"))
    named = groups.join(keepers, ["_hash", "_sha"]).select(F.col("_hash").alias("_h"), F.col("_sha").alias("_s"), "keep_id", "group_size")
    # Joined by the hash alone, so that both sides are shuffled anew and adaptive execution can split a hot group's rows.
    return light.join(named, (F.col("_hash") == F.col("_h")) & (F.col("_sha") == F.col("_s"))).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")
    )


def first_of_each(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of one row of each group of exact_dedup: of the rows with keep_id and the most code points, the one whose columns are the smallest.

    The decision is taken on rows, not on ids: ids may be null or repeated. Copies collapse before the shuffle.
    """
    rest = [c for c in columns if c not in (id_col, text_col)]
    row = F.struct((-F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("_points"), F.col(id_col).isNull().alias("_null"), *(F.col(c) for c in (id_col, *rest, text_col)))
    text = normalised(F.col(text_col))
    first = docs.select(F.unhex(F.md5(text)).alias("_hash"), text.alias("_text"), row.alias("_row")).groupBy("_hash", "_text").agg(F.min("_row").alias("_row"))
    return first.select(*(F.col(f"_row.{c}") for c in columns))
