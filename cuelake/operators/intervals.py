"""Joins between two cue tracks by time. A time bucket joins the job as a key, so a job of any length is spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T

#: Width of a time bucket: about the longest usual cue, so most intervals lie in one or two.
BUCKET_MS = 10_000


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))


def overlapping(left: DataFrame, right: DataFrame, bucket_ms: int = BUCKET_MS, pad_ms: int = 0) -> DataFrame:
    """Pairs of the same job whose intervals overlap (with pad_ms: lie within it), columns prefixed l_ and r_.

    Both sides stand in each bucket that they touch; a pair is kept only in the first bucket that both touch, so it comes once.
    """

    def bucketed(df: DataFrame, prefix: str, pad: int) -> DataFrame:
        start, end = F.col(f"{prefix}start_ms") - pad, F.greatest(F.col(f"{prefix}end_ms"), F.col(f"{prefix}start_ms")) + pad
        return _prefixed(df, prefix).withColumns({f"{prefix}from": F.floor(start / bucket_ms)}).withColumn("_bucket", F.explode(F.sequence(F.floor(start / bucket_ms), F.floor(end / bucket_ms))))

    a, b = bucketed(left, "l_", pad_ms), bucketed(right, "r_", 0)
    met = (F.col("r_start_ms") < F.col("l_end_ms") + pad_ms) & (F.col("r_end_ms") > F.col("l_start_ms") - pad_ms)
    joined = a.withColumnRenamed("l_job_id", "job_id").join(b.withColumnRenamed("r_job_id", "job_id"), ["job_id", "_bucket"])
    return joined.filter(met & (F.col("_bucket") == F.greatest("l_from", "r_from"))).drop("_bucket", "l_from", "r_from")


def overlap_ms() -> Column:
    return F.least("l_end_ms", "r_end_ms") - F.greatest("l_start_ms", "r_start_ms")


def joined_texts(texts: str, without_repeats: bool = False) -> Column:
    """Texts of a group, in order of (start, id), joined by blanks; without_repeats drops one equal to the one before it."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("r_start_ms", "r_cap_id", texts))), lambda x: x[texts])
    if without_repeats:
        ordered = T.let(ordered, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (x != F.get(xs, i - 1))))
    return F.array_join(ordered, " ")


def overlap_text(cues: DataFrame, captions: DataFrame, without_repeats: bool = False) -> DataFrame:
    """id and the text of all captions that overlap each cue; cues without any have ''."""
    pairs = overlapping(cues.select("job_id", "id", "start_ms", "end_ms"), captions.select("job_id", "cap_id", "start_ms", "end_ms", "text"))
    found = pairs.groupBy(F.col("l_id").alias("id")).agg(joined_texts("r_text", without_repeats).alias("text"))
    return cues.select("id").join(found, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


def best_overlap(source: DataFrame, forked: DataFrame) -> DataFrame:
    """For each source cue the forked cue that it overlaps most (of equals, the first)."""
    pairs = overlapping(source.select("job_id", "id", "start_ms", "end_ms"), forked.select("job_id", "id", "start_ms", "end_ms"))
    return pairs.groupBy(F.col("l_id").alias("id")).agg(F.min_by("r_id", F.struct(-overlap_ms(), "r_start_ms", "r_id")).alias("match"), F.max(overlap_ms()).alias("overlap_ms"))


def dominant_overlap(forked: DataFrame, source: DataFrame, percent: int = 80) -> DataFrame:
    """For each forked cue its source cue: the only one that it overlaps, or the best if this covers `percent` of the forked cue; else no row."""
    pairs = overlapping(forked.select("job_id", "id", "start_ms", "end_ms"), source.select("job_id", "id", "start_ms", "end_ms"))
    best = pairs.groupBy(F.col("l_id").alias("id")).agg(F.count("*").alias("_n"), F.min_by(F.struct(F.col("r_id").alias("match"), overlap_ms().alias("ms"), (F.col("l_end_ms") - F.col("l_start_ms")).alias("span")), F.struct(-overlap_ms(), "r_start_ms", "r_id")).alias("_b"))
    return best.filter((F.col("_n") == 1) | (F.col("_b.ms") * 100 >= F.col("_b.span") * percent)).select("id", "_b.match")


def nearest_same_text(new: DataFrame, old: DataFrame, within_ms: int = 20_000) -> DataFrame:
    """For each new cue (id, job_id, start_ms, text) the old one with the same normalised text nearest in time, within_ms at most."""
    key = T.words_only(F.col("text"))
    a = new.select("job_id", "id", "start_ms", key.alias("_key")).filter("_key <> ''")
    b = old.select("job_id", F.col("id").alias("match"), F.col("start_ms").alias("_at"), key.alias("_key"))
    away = F.abs(F.col("start_ms") - F.col("_at"))
    return a.join(b, ["job_id", "_key"]).filter(away <= within_ms).groupBy("id").agg(F.min_by("match", F.struct(away, "match")).alias("match"), F.min(away).alias("away_ms"))


def nearest_start(cues: DataFrame, at_ms: int) -> DataFrame:
    return cues.groupBy("job_id").agg(F.min_by("id", F.struct(F.abs(F.col("start_ms") - at_ms), "id")).alias("id"))


def latest_before(points: DataFrame, cues: DataFrame, pad_ms: int = 300) -> DataFrame:
    """As-of join: for each point (cap_id, job_id, start_ms) the last cue that starts at start_ms + pad_ms or before it.

    Both tables are lined up and the last cue is carried forward: one sort per job, no join.
    """
    line = cues.select("job_id", F.col("start_ms").alias("at"), F.lit(0).alias("_side"), F.col("id").alias("_cue"), F.lit(None).cast("long").alias("cap_id")).unionByName(
        points.select("job_id", (F.col("start_ms") + pad_ms).alias("at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_cue"), "cap_id")
    )
    w = Window.partitionBy("job_id").orderBy("at", "_side", "_cue").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("cue_id", F.last("_cue", ignorenulls=True).over(w)).filter("_side = 1").select("cap_id", "cue_id")


def uncovered(captions: DataFrame, cues: DataFrame, pad_ms: int = 300) -> DataFrame:
    """Captions whose midpoint no cue covers, each cue widened by pad_ms (bounds count as covered)."""
    mid = captions.withColumns({"_twice": F.col("start_ms") + F.greatest("start_ms", "end_ms")})
    probe = mid.select("job_id", "cap_id", F.floor(F.col("_twice") / 2).alias("start_ms"), (F.floor(F.col("_twice") / 2) + 1).alias("end_ms"), "_twice")
    wide = cues.select("job_id", (F.col("start_ms") - pad_ms - 1).alias("start_ms"), (F.col("end_ms") + pad_ms + 1).alias("end_ms"))
    hit = overlapping(probe, wide).filter((F.col("l__twice") >= 2 * (F.col("r_start_ms") + 1)) & (F.col("l__twice") <= 2 * (F.col("r_end_ms") - 1)))
    return captions.join(hit.select(F.col("l_cap_id").alias("cap_id")).distinct(), "cap_id", "left_anti")


def words_in_cues(words: DataFrame, cues: DataFrame) -> DataFrame:
    """Each word with the cue that holds its midpoint (half-open, so with one cue at most of a track without overlaps)."""
    probe = words.withColumn("_twice", F.col("start_ms") + F.col("end_ms")).withColumns({"w_start": F.col("start_ms"), "w_end": F.col("end_ms")})
    probe = probe.withColumn("start_ms", F.floor(F.col("_twice") / 2)).withColumn("end_ms", F.col("start_ms") + 1)
    pairs = overlapping(probe, cues.select("job_id", "id", "start_ms", "end_ms"))
    return pairs.filter((F.col("r_start_ms") * 2 <= F.col("l__twice")) & (F.col("l__twice") < F.col("r_end_ms") * 2))


def speech_span(words: DataFrame, cues: DataFrame) -> DataFrame:
    """First and last moment of the words whose midpoint each cue holds."""
    return words_in_cues(words, cues).groupBy(F.col("r_id").alias("id")).agg(F.min("l_w_start").alias("from_ms"), F.max("l_w_end").alias("to_ms"), F.count("*").alias("n_words"))


def snapped(cues: DataFrame, words: DataFrame, within_ms: int = 300) -> DataFrame:
    """Each cue's start moved to the nearest word edge (of equals, the earlier) if one lies within_ms."""
    edges = words.select("job_id", F.explode(F.array("start_ms", "end_ms")).alias("start_ms")).distinct().withColumn("end_ms", F.col("start_ms") + 1)
    points = cues.select("job_id", "id", "start_ms").withColumn("end_ms", F.col("start_ms") + 1)
    away = F.abs(F.col("r_start_ms") - F.col("l_start_ms"))
    near = overlapping(points, edges, pad_ms=within_ms).filter(away <= within_ms).groupBy(F.col("l_id").alias("id")).agg(F.min_by("r_start_ms", F.struct(away, "r_start_ms")).alias("_edge"))
    return cues.select("id", "start_ms").join(near, "id", "left").select("id", F.coalesce("_edge", "start_ms").alias("start_ms"))


def neighbours(cues: DataFrame) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy("idx")
    return cues.select("id", F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("following"))
