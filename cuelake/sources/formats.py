"""Readers and writers of subtitle, transcript, caption, script and manifest files. Parsers take (path, content) tables, so they run wherever the files lie."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators.ordered import gaps_closed

SPEECH = "array<struct<start:double,end:double,text:string,words:array<struct<start:double,end:double,word:string,probability:double>>,avg_logprob:double>>"
CAPTIONS = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>>"
#: Ways of speaking that a script's third column may name; the last one may have no text.
STYLES = ("보통", "빠르게", "느리게", "웅얼", "침묵")
NARROW_LANGS = ("ko", "ja", "zh-Hans", "zh-Hant")


def _from_cp949(contents: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else bytes(c).decode("cp949", "replace") for c in contents])


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, or CP949 where they aren't that. Null stays null."""
    old = F.pandas_udf(_from_cp949, "string")(content)  # Spark decodes no Korean character set itself
    valid = F.try_validate_utf8(content.cast("string"))
    return F.when(valid.isNotNull(), valid).otherwise(old)


def read_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, content of the files anywhere below folder whose names match."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", decoded(F.col("content")).alias("content"))


def _ms(clock: Column) -> Column:
    part = lambda n: F.regexp_extract(clock, r"(\d+):(\d{2}):(\d{2})[,.](\d{3})", n).cast("long")
    return part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4)


def parse_srt(files: DataFrame) -> DataFrame:
    """path, start_ms, end_ms, text (white space as single blanks) of each cue that isn't blank."""
    blocks = files.select("path", F.explode(F.split(F.regexp_replace("content", r"\r\n?", "\n"), r"\n\s*\n")).alias("b"))
    timed = blocks.select("path", F.regexp_extract("b", r"(\d+:\d{2}:\d{2}[,.]\d{3}) --> ", 1).alias("s"), F.regexp_extract("b", r" --> (\d+:\d{2}:\d{2}[,.]\d{3})", 1).alias("e"), T.collapsed(F.regexp_extract("b", r"(?s) --> [^\n]*\n(.*)", 1)).alias("text"))
    return timed.filter("s <> '' AND e <> '' AND text <> ''").select("path", _ms(F.col("s")).alias("start_ms"), _ms(F.col("e")).alias("end_ms"), "text")


def to_srt(cues: DataFrame, text: str, lang: str, key: str = "job_id") -> DataFrame:
    """key, no, block: subtitles numbered in order of start, gaps below 200 ms closed, lines wrapped for the language's script. write_srt() puts a track in a file."""
    width = 18 if lang in NARROW_LANGS else 42
    rows = cues.withColumn("_t", T.stripped(F.col(text))).filter("_t <> ''")
    numbered = gaps_closed(rows).withColumn("no", F.row_number().over(Window.partitionBy(key).orderBy("start_ms", "id")))
    times = F.concat(T.srt_time(F.col("start_ms")), F.lit(" --> "), T.srt_time(F.col("end_ms")))
    return numbered.select(key, "no", F.concat_ws("\n", F.col("no").cast("string"), times, T.wrapped(F.col("_t"), width)).alias("block"))


def write_srt(blocks: DataFrame, path: str, key: str = "job_id") -> None:
    """One folder of text per track; a track's blocks lie in order in one file."""
    blocks.repartition(key).sortWithinPartitions(key, "no").select(key, F.concat("block", F.lit("\n")).alias("value")).write.partitionBy(key).text(path)


def parse_captions(files: DataFrame) -> DataFrame:
    """path, start_ms, end_ms, text of a caption file's events that have text, speaker marks taken out."""
    events = files.select("path", F.explode(F.from_json("content", CAPTIONS)["events"]).alias("e")).filter("e.segs IS NOT NULL")
    text = T.without_speaker_marks(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    start = F.coalesce("e.tStartMs", F.lit(0))
    return events.select("path", start.alias("start_ms"), (start + F.coalesce("e.dDurationMs", F.lit(0))).alias("end_ms"), text.alias("text")).filter("text <> ''")


def parse_speech(rows: DataFrame, key: str, *contents: str) -> DataFrame:
    """key, seg_no, start_ms, end_ms, text, words, avg_logprob: segments of the first of the JSON columns that isn't null (table first, then file)."""
    segments = rows.select(key, F.posexplode(F.from_json(F.coalesce(*contents), SPEECH)).alias("seg_no", "s"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return segments.select(key, "seg_no", ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), "s.text", "s.words", "s.avg_logprob")


#: A date at the start of a line opens a document of a transcript.
DATE = r"\[\d{4}\.\d{2}\.\d{2}\]"


def parse_transcript(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paragraphs (path, text) of transcripts, and (path, n_documents) with a row for each file: date headers open documents; time codes and durations are left out.

    A file without lines, or without content, is one document, as any file without headers; files that share a path count by themselves.
    """
    split = F.transform(F.split("content", r"\r?\n"), T.stripped)
    header = lambda text: text.rlike(f"^{DATE}")
    lines = files.select("path", F.explode(split).alias("text")).filter("text <> ''")
    timing = F.col("text").rlike(r"^\d{1,2}:\d{2}(:\d{2})?$") | F.col("text").rlike(r"^\(\d+분(\s*\d+초)?\)$")
    headers = F.coalesce(F.size(F.filter(split, header)), F.lit(0))
    return lines.filter(~header(F.col("text")) & ~timing), files.select("path", F.greatest(headers, F.lit(1)).cast("long").alias("n_documents"))


def parse_script(files: DataFrame) -> DataFrame:
    """path, no, text, style, pause: rows of a script's pipe table. The job stops at a number out of order, an unknown style, an empty spoken row, or a pause outside 0 to 30 s."""
    lines = files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("_line", "l")).filter(F.trim("l").startswith("|"))
    cells = lines.select("path", "_line", F.transform(F.split(F.regexp_replace(F.trim("l"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)).alias("c")).filter("size(c) = 4")
    rows = cells.filter(~F.col("c")[0].rlike(r"^(#|:?-+:?|)$")).select("path", "_line", *(F.col("c")[i].alias(n) for i, n in enumerate(("_no", "text", "style", "_pause"))))
    expected = F.row_number().over(Window.partitionBy("path").orderBy("_line"))
    stop = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), "path", F.lit(" line "), (F.col("_line") + 1).cast("string"))).cast("int")
    pause = F.col("_pause").try_cast("double")
    no = (
        F.when(~F.coalesce(F.col("_no").try_cast("int") == F.col("_expected"), F.lit(False)), stop("number out of order"))
        .when(~F.col("style").isin(*STYLES), stop("unknown style"))
        .when((F.col("style") != STYLES[-1]) & (F.col("text") == ""), stop("empty text"))
        .when(~F.coalesce(pause.between(0, 30), F.lit(False)), stop("pause out of range"))
        .otherwise(F.col("_expected"))
    )
    return rows.withColumn("_expected", expected).select("path", no.alias("no"), "text", "style", pause.alias("pause"))


def cue_sheet(lines: DataFrame, key: str = "path") -> DataFrame:
    """Times of a script's lines from their lengths: lines (key, no, samples, pause_samples) to start and end in samples."""
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("samples") + F.col("pause_samples")).over(w), F.lit(0))
    return lines.select(key, "no", start.alias("start"), (start + F.col("samples")).alias("end"))


def training_manifest(cues: DataFrame, media: DataFrame) -> DataFrame:
    """audio, text, start_ms, end_ms of reviewed cues of real jobs, 0.4 to 30 s long: what a recogniser is trained on. Written as JSON lines by df.write.json."""
    real = media.filter("NOT practice").select("job_id")
    rows = cues.filter("reviewed").join(real, "job_id", "left_semi").withColumn("text", T.stripped(F.col("text_final")))
    return rows.filter((F.col("text") != "") & T.duration_ms().between(400, 30_000)).select(F.concat(F.col("job_id").cast("string"), F.lit("/"), F.lpad(F.col("idx").cast("string"), 5, "0"), F.lit(".wav")).alias("audio"), "text", "start_ms", "end_ms")


def correction_manifest(cues: DataFrame, media: DataFrame) -> DataFrame:
    """source, target, changed of reviewed cues of real jobs with text on both sides."""
    real = media.filter("NOT practice").select("job_id")
    rows = cues.filter("reviewed").join(real, "job_id", "left_semi").select("id", T.stripped(F.col("text_stt")).alias("source"), T.stripped(F.col("text_final")).alias("target")).filter("source <> '' AND target <> ''")
    return rows.withColumn("changed", F.col("source") != F.col("target"))


def glossary_lines(terms: DataFrame, none: str = "(미분류)") -> DataFrame:
    """category, n, table: approved terms as rows of a Markdown table, by category and name."""
    row = F.concat(F.lit("| "), "term", F.lit(" | "), "variants", F.lit(" |"))
    return terms.filter("approved").groupBy(T.first_filled("category", F.lit(none)).alias("category")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("table"))


def lexicon_lines(lexicon: DataFrame) -> DataFrame:
    """part, n, table: special words, glyphs with their gloss, and common words of a lexicon as Markdown rows."""
    word = F.length("reading") >= 2
    part = F.when(F.col("gloss") != "", "2 glyphs").when(word & (F.col("tier") == "special"), "1 special").when(word, "3 common")
    cell = F.concat_ws(" | ", F.nullif("gloss", F.lit("")), "reading", "hanja", F.col("count").cast("string"))
    return lexicon.withColumn("part", part).filter("part IS NOT NULL").groupBy("part").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reading", "gloss", cell.alias("c")))), lambda x: F.concat(F.lit("| "), x["c"], F.lit(" |"))), "\n").alias("table"))
