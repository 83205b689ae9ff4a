"""Imports of subtitle files, their undo, annotations taken over by hand, and practice defects in time: tables in, tables after the operation out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import korean
from cuelake.functions import text as T
from cuelake.operators import intervals
from cuelake.operators.ordered import renumbered

#: Reasons for which a file isn't registered.
EMPTY, OTHER_SCRIPT, KNOWN = "empty", "script", "known"


def snapshot(cues: DataFrame, renditions: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cues and renditions of the jobs (job_id) as they are before an import."""
    mine = cues.join(jobs.select("job_id").distinct(), "job_id", "left_semi")
    return mine, renditions.join(mine.select(F.col("id").alias("cue_id")), "cue_id", "left_semi")


def preview(new: DataFrame, cues: DataFrame, shown: int = 6, characters: int = 50) -> DataFrame:
    """What an import would do, one row per job with old cues: n_new, n_old, n_reviewed, n_carried (new cues whose rendition would go along) and samples.

    A sample (start_ms, idx, old, new) stands for each of the first `shown` new cues, with the old cue that starts nearest (of
    equals, the first by idx). Jobs without new cues count 0 and have no samples; null texts count as empty.
    """
    work = cues.select("job_id", "idx", "reviewed", F.col("start_ms").alias("_at"), T.work_text().alias("_old"))
    totals = work.groupBy("job_id").agg(F.count("*").alias("n_old"), F.count_if("reviewed").alias("n_reviewed"))
    carried = intervals.nearest_same_text(new, cues.withColumn("text", T.work_text())).filter("match IS NOT NULL").select("id", F.lit(1).alias("_carried"))
    counts = new.join(carried, "id", "left").groupBy("job_id").agg(F.count("*").alias("n_new"), F.count("_carried").alias("n_carried"))
    first = new.withColumn("_no", F.row_number().over(Window.partitionBy("job_id").orderBy("start_ms", "end_ms", "id"))).filter(F.col("_no") <= shown).select("job_id", "_no", "start_ms", F.left("text", F.lit(characters)).alias("_new"))
    # `shown` rows a job, so the join is at most that many times the old cues, and each group is folded to one row before the shuffle.
    pairs = first.join(work, "job_id").groupBy("job_id", "_no").agg(F.min_by(F.struct("start_ms", "idx", F.left("_old", F.lit(characters)).alias("old"), F.col("_new").alias("new")), F.struct(F.abs(F.col("_at") - F.col("start_ms")), F.col("idx"))).alias("_sample"))
    samples = pairs.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_sample"))), lambda x: x["_sample"]).alias("samples"))
    out = totals.join(counts, "job_id", "left").join(samples, "job_id", "left")
    return out.select("job_id", F.coalesce("n_new", F.lit(0)).alias("n_new"), "n_old", "n_reviewed", F.coalesce("n_carried", F.lit(0)).alias("n_carried"), "samples")


def import_undone(cues: DataFrame, renditions: DataFrame, backups: DataFrame, old_cues: DataFrame, old_renditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cues and renditions after the last import of each job in backups (job_id, version, next_id) is undone.

    Version 2: the job's cues and their renditions go; those of the snapshot come back, the cues with new ids from next_id on
    in order of idx, the renditions with the new ids; a rendition whose cue isn't in the snapshot is left out. Version 1, which
    kept texts only: text_final and reviewed of the cues that are still there come back. Other jobs stay as they are.
    """
    replaced, filled = (backups.filter(F.col("version") == v).select("job_id", "next_id") for v in (2, 1))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("idx", "id")) - 1
    back = old_cues.join(replaced, "job_id").withColumns({"_old": F.col("id"), "id": F.col("next_id") + place})
    before = old_cues.join(filled, "job_id", "left_semi").select("id", F.struct("text_final", "reviewed").alias("_before"))
    kept = cues.join(replaced, "job_id", "left_anti").join(before, "id", "left")
    kept = kept.withColumns({c: F.when(F.col("_before").isNotNull(), F.col(f"_before.{c}")).otherwise(F.col(c)) for c in ("text_final", "reviewed")})
    gone = cues.join(replaced, "job_id", "left_semi").select(F.col("id").alias("cue_id"))
    returned = old_renditions.join(back.select(F.col("_old").alias("cue_id"), F.col("id").alias("_new")), "cue_id").withColumn("cue_id", F.col("_new"))
    return kept.select(cues.columns).unionByName(back.select(cues.columns)), renditions.join(gone, "cue_id", "left_anti").unionByName(returned.select(renditions.columns))


def registered(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and cues of subtitle files (video, no, start_ms, end_ms, text; no: the cue's place in its file) without recognition or correction.

    Jobs: video, refused (null, or the reason), n_cues, duration_ms (the last cue's end), status, timing_done. Refused are files
    without a cue that has text, with fewer Hangul letters than Latin ones, or of a video in known. Cues of the others stand in
    order of start and place, have blanks joined, their text as machine text and as final one, and count as reviewed.
    """
    lines = files.withColumn("text", T.stripped(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    letters = lambda kind: F.sum(F.when(F.col("text") != "", F.length(F.regexp_replace("text", f"[^{kind}]", ""))).otherwise(0))
    blank = F.col("text") == ""
    jobs = lines.groupBy("video").agg(F.count_if(~blank).alias("n_cues"), letters("가-힣").alias("_hangul"), letters("A-Za-z").alias("_latin"), F.max_by(F.when(~blank, F.col("end_ms")), F.when(~blank, F.struct("start_ms", "no"))).alias("duration_ms"))
    jobs = jobs.join(known.select("video", F.lit(True).alias("_known")).distinct(), "video", "left")
    refused = F.when(F.col("n_cues") == 0, EMPTY).when(F.col("_hangul") < F.col("_latin"), OTHER_SCRIPT).when(F.col("_known"), KNOWN)
    jobs = jobs.withColumn("refused", refused).select("video", "refused", "n_cues", "duration_ms", F.when(F.col("refused").isNull(), "reviewing").alias("status"), F.col("refused").isNull().alias("timing_done"))
    place = F.row_number().over(Window.partitionBy("video").orderBy("start_ms", "no")) - 1
    cues = lines.filter(~blank).join(jobs.filter("refused IS NULL").select("video"), "video", "left_semi")
    return jobs, cues.select("video", place.alias("idx"), "start_ms", "end_ms", F.col("text").alias("text_llm"), F.col("text").alias("text_final"), F.lit(True).alias("reviewed"))


def _annotated_once(text: Column, reading: Column, spelling: Column) -> Column:
    """text with the spelling in brackets after the first reading that stands alone or before a particle and has none yet."""
    quoted = F.concat(F.lit(r"\Q"), reading, F.lit(r"\E"))
    find = F.concat(F.lit("(?s)^(.*?(?<![가-힣])"), quoted, F.lit(f")((?:{'|'.join(korean.PARTICLES)})?(?![가-힣(]).*)$"))
    return F.regexp_replace(text, find, F.concat(F.lit("$1("), F.regexp_replace(spelling, r"([\\$])", r"\\$1"), F.lit(")$2")))


def promoted(cues: DataFrame, items: DataFrame) -> DataFrame:
    """id, text_llm, text_final, hints, n_applied of the cues that items (job_id, id, no, reading, hanja) change, found spellings confirmed by hand.

    Each item annotates the first place of its reading in its cue, in the order of no; an item for another job's cue, with
    an empty reading or spelling, or whose reading isn't there (or has its spelling already) changes nothing. The final text is
    annotated, or the machine text if there is none. A hint (array of reading, discovered) that was applied isn't offered again.
    """
    clean = items.select("job_id", "id", "no", T.stripped(F.col("reading")).alias("reading"), T.stripped(F.col("hanja")).alias("hanja")).filter("reading <> '' AND hanja <> ''")
    mine = clean.groupBy("job_id", "id").agg(F.array_sort(F.collect_list(F.struct("no", "reading", "hanja"))).alias("_items"))
    own = F.coalesce("text_final", F.lit("")) != ""
    rows = cues.join(mine, ["job_id", "id"]).withColumns({"_own": own, "_text": F.when(own, F.col("text_final")).otherwise(F.coalesce("text_llm", F.lit("")))})

    def step(state: Column, item: Column) -> Column:
        text = _annotated_once(state["text"], item["reading"], item["hanja"])
        return F.struct(text.alias("text"), F.when(text != state["text"], F.array_append(state["done"], item["reading"])).otherwise(state["done"]).alias("done"))

    rows = rows.withColumn("_s", F.aggregate("_items", F.struct(F.col("_text").alias("text"), F.array().cast("array<string>").alias("done")), step)).filter(F.size("_s.done") > 0)
    left = F.filter("hints", lambda h: ~(F.coalesce(h["discovered"], F.lit(False)) & F.array_contains(F.col("_s.done"), T.stripped(F.coalesce(h["reading"], F.lit(""))))))
    return rows.select("id", F.when(F.col("_own"), F.col("text_llm")).otherwise(F.col("_s.text")).alias("text_llm"), F.when(F.col("_own"), F.col("_s.text")).otherwise(F.col("text_final")).alias("text_final"), left.alias("hints"), F.size("_s.done").alias("n_applied"))


def newly_registered(items: DataFrame, cues: DataFrame, lexicon: DataFrame) -> DataFrame:
    """reading, gloss, hanja of the items (job_id, id, reading, gloss, hanja) of known cues that the lexicon doesn't have yet; each once."""
    names = ("reading", "gloss", "hanja")
    clean = items.select("job_id", "id", *(T.stripped(F.coalesce(c, F.lit(""))).alias(c) for c in names)).filter("reading <> '' AND hanja <> ''")
    return clean.join(cues.select("job_id", "id"), ["job_id", "id"], "left_semi").select(*names).distinct().join(lexicon.select(*names), list(names), "left_anti")


def span_merged(cues: DataFrame, from_ms: int, until_ms: int, text: str) -> DataFrame:
    """Each job's cues that overlap a span of time as one cue with the given text, not reviewed, from the first one's start to the latest end; numbered anew."""
    inside = (F.col("end_ms") > from_ms) & (F.col("start_ms") < until_ms)
    ends = cues.filter(inside).groupBy("job_id").agg(F.max("end_ms").alias("_end"), F.min_by("id", F.struct("start_ms", "end_ms", "id")).alias("_first"))
    rows = cues.join(ends, "job_id", "left").filter(~inside | (F.col("id") == F.col("_first")))
    new = {"end_ms": F.col("_end"), "text_llm": F.lit(text), "text_final": F.lit(""), "reviewed": F.lit(False)}
    changed = rows.withColumn("_in", inside).withColumns({c: F.when(F.col("_in"), v).otherwise(F.col(c)) for c, v in new.items()})
    return renumbered(changed.select(cues.columns))



def time_defects(cues: DataFrame, place: int, cps: int = 22, silence_ms: int = 1500, left_ms: int = 150) -> DataFrame:
    """Cues with two defects a job to practise on: the cue at `place` starts so late that it reads at cps characters a second, and the first one before a silence lasts until left_ms before the next."""
    w = Window.partitionBy("job_id").orderBy("idx")
    n = F.length(F.replace(T.machine_text(), F.lit(" "), F.lit("")))
    want = F.col("end_ms") - F.floor(n * 1000 / cps)
    late = cues.withColumn("start_ms", F.when((F.col("idx") == place) & (n > 0) & (want > F.col("start_ms")) & (want < F.col("end_ms")), want).otherwise(F.col("start_ms")))
    gaps = late.withColumn("_next", F.lead("start_ms").over(w)).withColumn("_gap", F.col("_next") - F.col("end_ms") >= silence_ms)
    first = F.min(F.when(F.col("_gap"), F.col("idx"))).over(Window.partitionBy("job_id"))
    return gaps.withColumn("_at", first).withColumn("end_ms", F.when(F.col("idx") == F.col("_at"), F.col("_next") - left_ms).otherwise(F.col("end_ms"))).select(cues.columns)
