"""Checks of a cue track: reading speed, lengths, rule sets, learned budgets, and error rates against reviewed text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cuelake.functions import alignment
from cuelake.functions import text as T


def rule_flags(cues: DataFrame) -> DataFrame:
    """cues with a boolean for each rule. An empty cue breaks the rule `empty` alone."""
    work = T.work_text()
    filled = work != ""
    return cues.withColumns(
        {
            "empty": ~filled,
            "too_fast": filled & T.is_too_fast(work),
            "too_long": filled & (F.length(work) > T.TOO_LONG),
            "bad_duration": filled & ((T.duration_ms() < T.SHORTEST_MS) | (T.duration_ms() > T.LONGEST_MS)),
            "double_space": filled & F.contains(work, F.lit("  ")),
            "on_hold": filled & F.col("hold") & ~F.col("reviewed"),
            "unreviewed": filled & ~F.col("reviewed"),
        }
    )


RULES = ("empty", "too_fast", "too_long", "bad_duration", "double_space", "on_hold", "unreviewed")


def qc_report(cues: DataFrame) -> DataFrame:
    """One row per job: cues, and how many break each rule."""
    return rule_flags(cues).groupBy("job_id").agg(F.count("*").alias("n_cues"), *(F.count_if(r).alias(f"n_{r}") for r in RULES))


def qc_ids(cues: DataFrame) -> DataFrame:
    """One row per job and broken rule: the ids in order, comma-joined."""
    broken = rule_flags(cues).select("job_id", "id", F.explode(F.array(*(F.when(F.col(r), F.lit(r)) for r in RULES))).alias("rule")).filter("rule IS NOT NULL")
    return broken.groupBy("job_id", "rule").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


def issue_queue(cues: DataFrame, shortest_ms: int = 340) -> DataFrame:
    """Cues that an editor should look at first: too fast, or a duration out of bounds."""
    work = T.work_text()
    return cues.filter(T.is_too_fast(work) | (T.duration_ms() > T.LONGEST_MS) | (T.duration_ms() < shortest_ms))


def surface_forms(terms: DataFrame, term: str = "term", variants: str = "variants") -> DataFrame:
    """Distinct trimmed terms and variants (a comma list) that aren't blank."""
    return terms.select(F.col(term).alias("form")).union(terms.select(F.explode(F.split(F.coalesce(F.col(variants), F.lit("")), ",")).alias("form"))).select(F.trim("form").alias("form")).filter("form <> ''").distinct()


#: Characters of the forms that one automaton holds, about 100 bytes each; a larger vocabulary takes several passes over the texts.
FORM_CHARACTERS = 1 << 20


@lru_cache(1)
def _automaton(forms: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for form in forms:
        out.add_word(form, form)
    out.make_automaton()
    return out


def mentions(cues: DataFrame, hay: Column, forms: DataFrame, key: str = "id", characters: int = FORM_CHARACTERS) -> DataFrame:
    """(key, form): the forms that occur in each cue's text; null and empty forms and texts hold nothing.

    An automaton over the forms reads each text once and names those that end at each place, so the only rows made are matches;
    nothing is joined. The vocabulary is dealt by hash to parts of about `characters` characters; each part's automaton is
    built in the tasks from the part's forms, which are all that is broadcast.
    """
    spark = cues.sparkSession
    known = forms.filter("form <> ''").select("form").distinct()
    parts = -(-(known.agg(F.sum(F.length("form"))).first()[0] or 0) // characters)
    at = cues.select(F.col(key).alias("_key"), hay.alias("_hay"))
    out = [spark.createDataFrame([], StructType([at.schema["_key"], StructField("form", StringType())]))]
    for part in range(parts):
        own = known.filter(F.pmod(F.xxhash64("form"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(tuple(sorted(r.form for r in own.collect())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            if not shared.value:
                return
            automaton = _automaton(shared.value)
            for batch in batches:
                found = [sorted({form for _, form in automaton.iter(text)}) if text else [] for text in batch.column("_hay").to_pylist()]
                rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(rows)), pa.array([form for f in found for form in f], pa.string())], ["_key", "form"])

        out.append(at.mapInArrow(run, out[0].schema))
    return reduce(DataFrame.union, out).distinct().withColumnRenamed("_key", key)


def low_risk(cues: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Cues to confirm at a glance: sources agree, nothing uncertain, some text, readable, and no term of the domain (by mentions())."""
    work = T.work_text()
    plain = cues.filter(~F.col("flagged") & ~F.col("uncertain") & (work != "") & ~T.is_too_fast(work))
    return plain.join(mentioned.select("id").distinct(), "id", "left_anti")


def needs_model(cues: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Cues that a correction model should see: flagged ones, and those that mention a term. Blank ones don't."""
    some = cues.filter(T.stripped(T.machine_text()) != "")
    return some.join(mentioned.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left").filter(F.col("flagged") | F.col("_hit").isNotNull()).drop("_hit")


def line_budget(cues: DataFrame, least: int = 40) -> DataFrame:
    """soft, hard: the characters a cue should have, from the lengths of reviewed text. No row below `least` samples.

    Lengths are counted, so what is sorted is one row for each length, not one for each cue.
    """
    lengths = cues.filter("reviewed").select(F.length(T.stripped(F.col("text_final"))).alias("n")).filter("n > 0").groupBy("n").agg(F.count("*").alias("times"))
    packed = lengths.agg(F.sort_array(F.collect_list(F.struct("n", "times"))).alias("h"), F.sum("times").alias("total")).filter(F.col("total") >= least)
    ranked = packed.withColumn("ends", F.transform(F.sequence(F.lit(1), F.size("h")), lambda i: F.struct(F.aggregate(F.slice("h", F.lit(1), i), F.lit(0).cast("long"), lambda acc, x: acc + x["times"]).alias("upto"), F.element_at("h", i)["n"].alias("n"))))
    at = lambda place: F.element_at(F.filter("ends", lambda e: e["upto"] > place), 1)["n"]
    total = F.col("total")
    p90 = at(F.least(total - 1, F.floor(total * 9 / 10)))
    median = (at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / 2
    return ranked.select(F.least(F.lit(48), F.greatest(F.lit(24), p90)).cast("int").alias("hard"), median.alias("_m")).select(F.least(F.col("hard") - 2, F.greatest(F.lit(14), F.floor("_m"))).cast("int").alias("soft"), "hard")


def cer_text(c: Column) -> Column:
    """Text for error rates: no punctuation, lower case, single blanks."""
    return T.collapsed(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", "")))


def error_rate(ref: Column, hyp: Column) -> Column:
    """Character edits over the reference's length, to four places; null where the reference is empty."""
    return F.when(F.length(ref) > 0, F.round(alignment.edits(ref, hyp) / F.length(ref), 4))


def evaluated(cues: DataFrame, media: DataFrame, imported: DataFrame) -> DataFrame:
    """One row per real job with reviewed text: job_id, title, created, source, n_reviewed, n_matched, and the error rates cer_stt, cer_llm and cer_matched.

    A job's texts are joined in order of their cues, and the joined texts compared, so a character that moves from a cue to the
    next is no error. `matched` takes only cues whose reviewed text is half to twice as long as the recognised one. Practice
    jobs and blank reviewed texts don't count; source is srt for jobs in imported (job_id), else app.
    """
    real = media.filter("NOT practice").select("job_id", F.left("title", F.lit(40)).alias("title"), "created")
    n, m = F.length(T.stripped(F.col("text_final"))), F.greatest(F.length(T.stripped(F.col("text_stt"))), F.lit(1))
    matched = (T.stripped(F.col("text_stt")) != "") & (n * 2 >= m) & (n <= 2 * m)
    rows = cues.filter("reviewed").filter(T.stripped(F.col("text_final")) != "").select("job_id", "idx", "id", matched.alias("matched"), F.col("text_final").alias("ref"), F.col("text_stt").alias("stt"), T.machine_text().alias("llm"))
    texts = lambda c, only: cer_text(F.array_join(F.transform(F.filter("_rows", only), lambda x: x[c]), " "))
    every, some = (lambda x: F.lit(True)), (lambda x: x["matched"])
    joined = rows.groupBy("job_id").agg(F.count("*").alias("n_reviewed"), F.count_if("matched").alias("n_matched"), F.sort_array(F.collect_list(F.struct("idx", "id", "matched", "ref", "stt", "llm"))).alias("_rows"))
    wide = joined.select("job_id", "n_reviewed", "n_matched", *(texts(c, f).alias(f"{c}{k}") for k, f in enumerate((every, some)) for c in ("ref", "stt", "llm")))
    rates = wide.select("job_id", "n_reviewed", "n_matched", error_rate(F.col("ref0"), F.col("stt0")).alias("cer_stt"), error_rate(F.col("ref0"), F.col("llm0")).alias("cer_llm"), error_rate(F.col("ref1"), F.col("llm1")).alias("cer_matched"))
    of_file = imported.select("job_id").distinct().withColumn("_srt", F.lit("srt"))
    return rates.join(real, "job_id").join(of_file, "job_id", "left").withColumn("source", F.coalesce("_srt", F.lit("app"))).drop("_srt")
