"""Operators that follow the order of a track: runs, first occurrences, gaps, numbering, clusters and chunks, as windows over a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T


def track(order: str = "start_ms", tie: str = "id", by: str = "job_id") -> Window:
    return Window.partitionBy(by).orderBy(order, tie)


def cascades(rows: DataFrame, by: str, order: str, text: str, least: int = 6, run_of: int = 2) -> DataFrame:
    """Rows in runs of at least run_of neighbours whose normalised text is equal and has `least` characters; `run` numbers them in their group."""
    w = Window.partitionBy(by).orderBy(order)
    key = T.compact(F.col(text))
    keyed = rows.withColumn("_key", key).withColumn("_new", F.when((F.col("_key") == F.lag("_key").over(w)) & (F.length("_key") >= least), 0).otherwise(1))
    runs = keyed.withColumn("run", F.sum("_new").over(w))
    return runs.withColumn("_n", F.count("*").over(Window.partitionBy(by, "run"))).filter(F.col("_n") >= run_of).drop("_key", "_new", "_n")


def derolled(captions: DataFrame) -> DataFrame:
    """Rolling captions as distinct lines: the first of each text, its end not after the next one's start (nor before its own)."""
    w = Window.partitionBy("job_id", "_key").orderBy("start_ms", "cap_id")
    first = captions.withColumn("_key", T.words_only(F.col("text"))).filter("_key <> ''").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_key")
    following = F.lead("start_ms").over(track(tie="cap_id"))
    return first.withColumn("end_ms", F.when(following.isNull(), F.col("end_ms")).otherwise(F.greatest("start_ms", F.least("end_ms", following))))


def gaps_closed(cues: DataFrame, below_ms: int = 200) -> DataFrame:
    """Ends moved to the next start where the gap is shorter than below_ms, or the cues overlap."""
    following = F.lead("start_ms").over(track())
    return cues.withColumn("end_ms", F.when(following - F.col("end_ms") < below_ms, following).otherwise(F.col("end_ms")))


def renumbered(cues: DataFrame) -> DataFrame:
    return cues.withColumn("idx", F.row_number().over(Window.partitionBy("job_id").orderBy("start_ms", "end_ms", "id")) - 1)


def cluster(cues: DataFrame, needs: Column, reach: int = 6, context: int = 4) -> DataFrame:
    """Around each job's first cue that needs work: id and in_cluster of the neighbours (with it) that need work too without a break, at most `reach` to a side, and of the context beyond."""
    w = Window.partitionBy("job_id").orderBy("idx")
    marked = cues.withColumn("_needs", needs).withColumn("_block", F.sum(F.when(F.col("_needs"), 0).otherwise(1)).over(w))
    pivot = marked.filter("_needs").groupBy("job_id").agg(F.min(F.struct("idx", "_block")).alias("_pivot")).select("job_id", F.col("_pivot.idx").alias("_at"), F.col("_pivot._block").alias("_of"))
    away = F.abs(F.col("idx") - F.col("_at"))
    return marked.join(pivot, "job_id").filter(away <= reach + context).select("id", (F.col("_needs") & (F.col("_block") == F.col("_of")) & (away <= reach)).alias("in_cluster"))


def cluster_around(cues: DataFrame, chosen: DataFrame, needs: Column, reach: int = 6) -> DataFrame:
    """cues that a request for one cue of each job (chosen: id) takes along: that cue, and its neighbours that need work without a break, at most `reach` to a side."""
    w = Window.partitionBy("job_id").orderBy("idx", "id")
    marked = cues.withColumns({"_at": F.row_number().over(w), "_fine": F.sum(F.when(needs, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_needs": needs})
    pivot = marked.join(chosen.select("id").distinct(), "id", "left_semi").select("job_id", F.col("_at").alias("_p"), F.col("_fine").alias("_upto"), (F.col("_fine") - F.when(F.col("_needs"), 0).otherwise(1)).alias("_before"))
    near = marked.join(pivot, "job_id").filter(F.abs(F.col("_at") - F.col("_p")) <= reach)
    # As many fine cues up to a neighbour as up to the chosen one: none lies between.
    left = (F.col("_at") < F.col("_p")) & F.col("_needs") & (F.col("_fine") == F.col("_before"))
    right = (F.col("_at") > F.col("_p")) & F.col("_needs") & (F.col("_fine") == F.col("_upto"))
    return near.filter((F.col("_at") == F.col("_p")) | left | right).select(cues.columns)


def next_work(cues: DataFrame, cursor: int) -> DataFrame:
    """The cue to go to next in each job: fresh after the cursor, fresh anywhere, unreviewed after it, unreviewed anywhere, the next, the first."""
    after, fresh = F.col("idx") > cursor, ~F.col("reviewed") & ~F.col("hold")
    rank = F.when(fresh & after, 0).when(fresh, 1).when(~F.col("reviewed") & after, 2).when(~F.col("reviewed"), 3).when(F.col("idx") == cursor + 1, 4).otherwise(5)
    return cues.groupBy("job_id").agg(F.min_by("id", F.struct(rank, F.col("idx"))).alias("id"))


def word_times(cues: DataFrame, words: DataFrame) -> DataFrame:
    """Times of words inside their cue by the share of characters before them."""
    of = Window.partitionBy("cue_id")
    before = of.orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    both = words.select("cue_id", "word_no", F.length("word").alias("n")).join(cues.select(F.col("id").alias("cue_id"), "start_ms", "end_ms"), "cue_id")
    return both.select("cue_id", "word_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b"), F.greatest(F.sum("n").over(of), F.lit(1)).alias("t"), "start_ms", "end_ms").selectExpr("cue_id", "word_no", "start_ms + (end_ms - start_ms) * b div t AS at_ms")


def first_silence(cues: DataFrame, least_ms: int = 1500) -> DataFrame:
    gap = F.lead("start_ms").over(track()) - F.col("end_ms")
    return cues.withColumn("_gap", gap).filter(F.col("_gap") >= least_ms).groupBy("job_id").agg(F.min("end_ms").alias("at_ms"))


def chunked(cues: DataFrame, size: int, context: int) -> DataFrame:
    """Each cue's chunk of `size`, and how many cues before its chunk go along as context."""
    r = F.row_number().over(Window.partitionBy("job_id").orderBy("idx")) - 1
    numbered = cues.select("job_id", "id", F.floor(r / size).alias("chunk"))
    return numbered.withColumn("context", F.least(F.lit(context).cast("long"), F.col("chunk") * size))


def majority(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group (of equals, the first by name) and its votes."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("votes"))
    return counts.groupBy(by).agg(F.min_by(value, F.struct(-F.col("votes"), F.col(value))).alias(value), F.max("votes").alias("votes"))


def stragglers_moved(words: DataFrame, cues: DataFrame, within_ms: int = 3000, outside: str = T.NON_WORD) -> DataFrame:
    """Words (job_id, sentence, no, start_ms, end_ms, word, cue_id) with the words of a sentence that fell to another cue than most of it moved there.

    Of cues with as many words, the one met first counts. A word whose midpoint is more than within_ms from that cue stays where
    it is, and so does one in the sentence's second half that its own cue's work text holds: it was really heard there. Both are
    compared without the characters that `outside`, a pattern, names.
    """
    votes = words.groupBy("job_id", "sentence", "cue_id").agg(F.count("*").alias("_n"), F.min("no").alias("_first"))
    major = votes.groupBy("job_id", "sentence").agg(F.max_by("cue_id", F.struct("_n", -F.col("_first"))).alias("_major"), F.sum("_n").alias("_words"))
    spans = cues.select(F.col("id").alias("_major"), F.col("start_ms").alias("_from"), F.col("end_ms").alias("_until"))
    heard = cues.select(F.col("id").alias("cue_id"), F.regexp_replace(T.work_text(), outside, "").alias("_heard"))
    place = F.row_number().over(Window.partitionBy("job_id", "sentence").orderBy("no")) - 1
    twice = F.col("start_ms") + F.col("end_ms")
    near = F.greatest(2 * F.col("_from") - twice, twice - 2 * F.col("_until")) <= 2 * within_ms
    tail = (place * 2 >= F.col("_words")) & F.contains(F.coalesce("_heard", F.lit("")), F.regexp_replace("word", outside, ""))
    rows = words.join(major, ["job_id", "sentence"]).join(spans, "_major", "left").join(heard, "cue_id", "left").withColumn("_stays", tail)
    return rows.withColumn("cue_id", F.when((F.col("cue_id") != F.col("_major")) & near & ~F.col("_stays"), F.col("_major")).otherwise(F.col("cue_id"))).select(words.columns)


def low_confidence(words: DataFrame, below: int = 55, most: int = 6) -> DataFrame:
    """Distinct words of each cue whose probability (in hundredths) is below the limit, in order, `most` of them, comma-joined."""
    w = Window.partitionBy("cue_id").orderBy("at")
    first = words.filter((F.col("prob") < below) & F.col("word").rlike("[가-힣A-Za-z0-9]")).groupBy("cue_id", F.trim("word").alias("word")).agg(F.min("word_no").alias("at"))
    top = first.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return top.groupBy("cue_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), ", ").alias("low_conf"))


def weighted_boundaries(cues: DataFrame) -> DataFrame:
    """Where the boundary between a cue and the next would lie if time were shared by the weight of their texts."""
    w = Window.partitionBy("job_id").orderBy("idx")
    weight = F.greatest(F.lit(1), F.length(F.regexp_replace("text_stt", r"\s+", "")))
    pairs = cues.withColumn("_w", weight).select("id", "start_ms", "_w", F.lead("_w").over(w).alias("_v"), F.lead("end_ms").over(w).alias("_end")).filter("_v IS NOT NULL")
    return pairs.selectExpr("id", "start_ms + (_end - start_ms) * _w div (_w + _v) AS boundary_ms")


def proportional_places(words: DataFrame, n: int) -> DataFrame:
    total = F.count("*").over(Window.partitionBy("cue_id"))
    return words.withColumn("_t", total).select("cue_id", "word_no", F.least(F.floor(F.col("word_no") * n / F.col("_t")), F.lit(n - 1)).alias("place"))


def merged_text(cues: DataFrame) -> DataFrame:
    """Each cue's work text joined with the next one's, shared ends once."""
    w = Window.partitionBy("job_id").orderBy("idx")
    both = cues.select("id", T.work_text().alias("a"), F.lead(T.work_text()).over(w).alias("b")).filter("b IS NOT NULL")
    return both.select("id", T.join_without_overlap(F.col("a"), F.col("b")).alias("joined"))
