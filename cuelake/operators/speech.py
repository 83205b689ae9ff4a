"""From recognised speech to cues: splitting, checks against captions, and alignment with what was heard.

What follows the order inside one cue or one job runs in a pandas function over that cue or job; everything that brings rows
together is a join or a window of Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import alignment, korean
from cuelake.functions import text as T
from cuelake.operators import chains, intervals, ordered
from cuelake.sources import storage

WORD = "struct<start_ms:bigint,end_ms:bigint,word:string>"
SENTENCE_MARKS = (".", "?", "!", "…")
SENTENCE_END = re.compile(r"[.?!…]$|[다요죠지]\?*$")
#: Grams of a cue's middle that are looked up among those of the prompts.
PROBES = 8
BOUNDARY_GAP, SILENCE, LONGEST, TAIL = 600, 700, 7000, 6


def cut_places(words: list[dict], soft: int, hard: int) -> list[int]:
    """Places behind which a segment's words are cut (the last word's place is always the last one).

    A token without a leading blank belongs to the word before it. Words and the pauses behind them are laid out once; each cut
    is then the first word at which one of three conditions holds for the line since the last cut: a silence follows (unless
    the line is a single word that ends no sentence), `soft` characters are reached at a boundary, or `hard` characters or
    LONGEST are. A line that is cut by size alone ends at its last boundary instead, if that lies behind its first third.
    """
    n = len(words)
    whole = np.array([i + 1 == n or words[i + 1]["word"][:1].isspace() for i in range(n)], bool)
    last = np.flatnonzero(whole)  # the last token of each word
    begins = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)
    texts = ["".join(w["word"] for w in words[a : b + 1]) for a, b in zip(begins, last)]
    upto = np.cumsum([len(t) for t in texts])
    lead, trail = (np.array([len(t) - len(cut(t)) for t in texts], np.int64) for cut in (str.lstrip, str.rstrip))
    start, end = (np.array([words[i][c] for i in at], np.int64) for at, c in ((begins, "start_ms"), (last, "end_ms")))
    pause = np.append(start[1:] - end[:-1], 0)
    boundary = (pause >= BOUNDARY_GAP) | np.array([t.strip().endswith(SENTENCE_MARKS) for t in texts], bool)
    boundary[-1:] = [t.strip().endswith(SENTENCE_MARKS) for t in texts[-1:]]
    # A line of one token that is no sentence isn't left alone by a silence.
    thin = (begins == last) & np.array([bool(t.strip()) and not SENTENCE_END.search(t.strip()) for t in texts], bool)

    def characters(a: int, b: int | slice) -> np.ndarray:
        return np.maximum(upto[b] - (upto[a] - len(texts[a])) - lead[a] - trail[b], 0)

    cuts: list[int] = []  # words behind which is cut
    first = 0
    while first < len(last):
        rest = slice(first, None)
        long = characters(first, rest)
        silent = pause[rest] >= SILENCE
        silent[0] &= not thin[first]
        full = (long >= hard) | (end[rest] - start[first] >= LONGEST)
        due = np.flatnonzero(silent | full | (boundary[rest] & (long >= soft)))
        if not len(due):
            break
        at = first + int(due[0])
        if full[at - first] and not silent[at - first] and not boundary[at]:
            back = np.flatnonzero(boundary[first:at]) + first
            back = back[last[back] > begins[first]]
            if len(back) and last[back[-1]] - begins[first] >= (last[at] - begins[first] + 1) // 3:
                at = int(back[-1])
        cuts.append(at)
        first = at + 1
    if first < len(last):
        end_of_all = len(last) - 1
        before = cuts[-2] + 1 if len(cuts) > 1 else 0
        if cuts and characters(first, end_of_all) <= TAIL and characters(before, end_of_all) <= hard and pause[cuts[-1]] < SILENCE:
            cuts.pop()
        cuts.append(end_of_all)
    return last[cuts].tolist()


def split_segments(segments: DataFrame, soft: int = 20, hard: int = 36) -> DataFrame:
    """segments (job_id, seg_id, words: array of WORD) cut into cue-sized pieces: job_id, seg_id, piece, start_ms, end_ms, text, n_words."""

    # Three plain arrays: a batch of structs would hold an object for each of its words.
    def run(starts: pd.Series, ends: pd.Series, texts: pd.Series) -> pd.Series:
        places = lambda *row: cut_places([{"start_ms": a, "end_ms": b, "word": w} for a, b, w in zip(*row)], soft, hard)
        return pd.Series([places(a, b, w) if w is not None and len(w) else [] for a, b, w in zip(starts, ends, texts)])

    cut = F.pandas_udf(run, "array<int>")
    of = lambda name: F.transform("words", lambda w: w[name])
    pieces = segments.withColumn("_cuts", cut(of("start_ms"), of("end_ms"), of("word"))).select("job_id", "seg_id", "words", "_cuts", F.posexplode("_cuts").alias("piece", "_to"))
    own = F.expr("slice(words, if(piece = 0, 0, _cuts[piece - 1] + 1) + 1, _to - if(piece = 0, -1, _cuts[piece - 1]))")
    text = F.trim(F.array_join(F.transform("_own", lambda w: w["word"]), ""))
    return pieces.withColumn("_own", own).select("job_id", "seg_id", "piece", F.get("_own", F.lit(0))["start_ms"].alias("start_ms"), F.element_at("_own", -1)["end_ms"].alias("end_ms"), text.alias("text"), F.size("_own").alias("n_words")).filter("text <> ''")


def prompt_echoes(cues: DataFrame, prompts: DataFrame, least: int = 6, percent: int = 80, gram: int = 4) -> DataFrame:
    """Ids of cues that repeat a prompt: part of it word for word, or with one block of `percent` of the cue in common. prompts is a table of any size; all of them count.

    A block that long, wherever it begins, holds the middle of the cue, so only prompts with all grams of that middle can have
    it. PROBES of these, spread over the middle, are looked up in the prompts' counts, and the rarest leads to the prompts to
    compare: an equi-join, whose rows are cues times the prompts that share their rarest gram. Cues whose middle is shorter than a gram
    (percent under 80) are led by all that begins like it.
    """
    key = T.compact(F.col("text_stt"))
    texts = prompts.select(T.compact(F.col("prompt")).alias("_p")).filter("_p <> ''").distinct()
    grams = texts.select("_p", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_p") - gram + 1, F.lit(1))), lambda i: F.substr("_p", i, F.lit(gram))))).alias("_g"))
    counts = grams.groupBy("_g").agg(F.count("*").alias("_n"))
    n = F.length("_k")
    block = F.least(n, F.ceil(n * percent / 100).cast("int"))
    sized = cues.select("id", key.alias("_k")).filter(n >= least).withColumn("_block", block)
    middle = sized.withColumn("_size", F.greatest(2 * F.col("_block") - n, F.lit(0))).withColumn("_from", n - F.col("_block") + 1)
    inner = middle.filter(F.col("_size") >= gram).withColumn("_gs", F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.substr("_k", F.col("_from") + F.floor(i * (F.col("_size") - gram) / (PROBES - 1)).cast("int"), F.lit(gram)))))
    met = inner.select("id", "_k", "_block", F.size("_gs").alias("_of"), F.explode("_gs").alias("_g")).join(counts, "_g")
    led = met.groupBy("id", "_k", "_block", "_of").agg(F.count("*").alias("_found"), F.min_by("_g", F.struct("_n", "_g")).alias("_g")).filter("_found = _of").select("id", "_k", "_block", "_g")
    # A block has block - gram + 1 grams in a row, so one of every so many grams of the cue is in it.
    step = F.greatest(F.col("_block") - gram + 1, F.lit(1))
    rest = middle.filter((F.col("_size") < gram) & (F.col("_block") >= gram)).select("id", "_k", "_block", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n - gram + 1, F.lit(1)), step), lambda i: F.substr("_k", i, F.lit(gram)))).alias("_g"))
    both = led.union(rest).join(grams, "_g")
    shared = F.exists(F.sequence(F.lit(1), F.length("_k") - F.col("_block") + 1), lambda i: F.contains("_p", F.substr("_k", i, F.col("_block"))))
    return both.filter(shared).select("id").distinct()


def cascade_ids(cues: DataFrame) -> DataFrame:
    return ordered.cascades(cues, "job_id", "start_ms", "text_stt").select("id")


def gap_rows(cues: DataFrame, captions: DataFrame) -> DataFrame:
    """Captions for times that no cue covers, as cues: distinct lines, not an echo of the cue before (part of it; overlapping and alike by 65; it in part of them, or alike by 85, from six characters on)."""
    left = intervals.uncovered(ordered.derolled(captions), cues)
    before = intervals.latest_before(left, cues).join(cues.select(F.col("id").alias("cue_id"), F.col("end_ms").alias("_end"), T.echo_key(T.machine_text()).alias("_prev")), "cue_id", "left")
    rows = left.join(before, "cap_id", "left").withColumn("_cand", T.echo_key(F.col("text")))
    score = alignment.window_similarity("_cand", "_prev")
    some = F.col("cue_id").isNotNull() & (F.col("_cand") != "")
    long = F.length("_prev") >= 6
    overlaps = F.col("start_ms") < F.col("_end") - 200
    echo = some & (F.contains("_prev", "_cand") | (long & (F.contains("_cand", "_prev") | (F.col("_score") >= 85) | (overlaps & (F.col("_score") >= 65)))))
    scored = rows.withColumn("_score", F.when(some & long, score))
    return scored.filter(~F.coalesce(echo, F.lit(False))).select("job_id", "cap_id", "start_ms", F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms")).otherwise(F.col("start_ms") + 1500).alias("end_ms"), "text")


def crosschecked(cues: DataFrame, captions: DataFrame, prompts: DataFrame, below: int = 65) -> DataFrame:
    """Recognised cues with the captions beside them: flagged where the two differ; hallucinated ones take the captions' text, or go where there is none; rows for gaps are added."""
    noise = cascade_ids(cues).union(prompt_echoes(cues, prompts)).distinct().withColumn("_noise", F.lit(True))
    with_text = cues.drop("text_caption").join(intervals.overlap_text(cues, captions).withColumnRenamed("text", "text_caption"), "id").join(noise, "id", "left").withColumn("_noise", F.coalesce("_noise", F.lit(False)))
    kept = with_text.filter(~F.col("_noise") | (F.col("text_caption") != ""))
    differ = alignment.similarity(T.words_only(F.col("text_stt")), T.words_only(F.col("text_caption"))) < below
    flagged = F.when(F.col("_noise"), True).when(F.col("text_caption") != "", differ).otherwise(F.col("uncertain"))
    out = kept.select("job_id", "id", "start_ms", "end_ms", F.when(F.col("_noise"), F.col("text_caption")).otherwise(F.col("text_stt")).alias("text_stt"), "text_caption", flagged.alias("flagged"))
    gaps = gap_rows(cues, captions).select("job_id", (-F.col("cap_id") - 1).alias("id"), "start_ms", "end_ms", F.lit("").alias("text_stt"), F.col("text").alias("text_caption"), F.lit(True).alias("flagged"))
    return ordered.renumbered(out.unionByName(gaps))


def _put_back(mine: str, heard: str, theirs: str, their_heard: str, grown: float = 1.2, alike: int = 85) -> Column:
    """Which of two neighbouring texts has taken in the other's words and goes back to what was recognised: a struct of booleans (mine, theirs).

    One text must hold the other (of two texts, the one with fewer words), or hold something alike by `alike` percent, while what
    was recognised does not. The text that has grown more against what was recognised goes back, if it has grown by more than
    `grown`; of two that have grown as much, the first.
    """
    a, b = T.words_only(F.col(mine)), T.words_only(F.col(theirs))
    words = lambda c: F.size(F.filter(T.tokens(F.col(c)), lambda w: T.words_only(w) != ""))
    fewer = words(mine) <= words(theirs)
    short, long = F.when(fewer, a).otherwise(b), F.when(fewer, b).otherwise(a)
    fits = (F.length(short) >= 2) & (F.length(short) <= F.length(long))
    literal = F.contains(long, short)
    near = alignment.holds_alike(F.when(fits & ~literal, short), F.when(fits & ~literal, long), alike)
    ha, hb = T.words_only(F.col(heard)), T.words_only(F.col(their_heard))
    known = (ha != "") & (hb != "") & (F.contains(ha, hb) | F.contains(hb, ha))
    growth = lambda text, base: F.when(F.length(base) > 0, F.length(text) / F.length(base)).otherwise(F.lit(0.0))
    put = fits & (literal | near) & ~known & (F.greatest(growth(a, ha), growth(b, hb)) > grown)
    first = growth(a, ha) >= growth(b, hb)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(yes(put & first).alias("mine"), yes(put & ~first).alias("theirs"))


def clamped(cues: DataFrame) -> DataFrame:
    """id, text, clamped: corrections that took in a neighbour's words go back to what was recognised.

    cues: job_id, idx, id, text_stt, text_llm. A row put back counts so for the pair that it makes with the next row, so the pairs
    of a job depend on one another in order. But a row has only two texts, so each pair is judged for both of the first row's,
    all pairs at once, and the order is followed by a machine of two states (chains.with_state), which needs no task that holds
    a job. Null texts are empty; rows that share a job and idx are ordered by id.
    """
    keys, order = ["job_id"], ["idx", "id"]
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = chains.parted(cues.select("job_id", "idx", "id", text("text_stt"), text("text_llm")), keys, order)
    pairs = chains.with_next(rows, keys, order, ["text_stt", "text_llm"]).select(*rows.columns, F.col("_next.text_stt").alias("_stt"), F.col("_next.text_llm").alias("_llm"))
    judged = pairs.withColumns({"_0": _put_back("text_llm", "text_stt", "_llm", "_stt"), "_1": _put_back("text_stt", "text_stt", "_llm", "_stt")})
    light = storage.written(judged.select("_part", "job_id", "idx", "id", "text_stt", "text_llm", F.col("_0.mine").alias("_m0"), F.col("_1.mine").alias("_m1"), F.col("_0.theirs").alias("_t0"), F.col("_1.theirs").alias("_t1")), "pairs")
    state = chains.with_state(light, keys, order, "_t0", "_t1")
    back = F.col("_state") | F.col("_m0")
    return state.select("id", F.when(back, F.col("text_stt")).otherwise(F.col("text_llm")).alias("text"), back.alias("clamped"))


def tightened(cues: DataFrame, words: DataFrame, least_gap: int = 500, least_share: float = 0.6, shortest: int = 300) -> DataFrame:
    """id, start_ms, end_ms, reason: each cue fitted to the words whose midpoint it holds.

    The cue's text is matched with what was heard, character by character (letters and digits only), and each word heard gets its
    number of matched characters. The cue runs from the first to the last word of which half or more is matched, `shortest` at
    least. It keeps its times where no word was heard (no-speech), where less than least_share of all characters match or no word
    does (weak-align), and where neither time would move by least_gap (already-tight); else it is trimmed.
    """
    plain = lambda c: F.regexp_replace(c, "[^가-힣0-9a-zA-Z]+", "")
    inside = intervals.words_in_cues(words, cues)
    word = F.struct(F.col("l_w_start").alias("start_ms"), F.col("l_w_end").alias("end_ms"), F.col("l_word").alias("word"))
    heard = inside.groupBy(F.col("r_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(word)), lambda w: F.struct(w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), F.coalesce(plain(w["word"]), F.lit("")).alias("w"))).alias("words"))
    rows = cues.select("id", "start_ms", "end_ms", plain(T.work_text()).alias("_shown")).join(heard, "id", "left")
    rows = rows.withColumn("_hits", alignment.matched_by_word(F.transform("words", lambda w: w["w"]), F.col("_shown")))
    total = lambda c, f: F.aggregate(c, F.lit(0), lambda acc, x: acc + f(x))
    size = total("words", lambda w: F.length(w["w"]))
    share = F.when((size > 0) & (F.length("_shown") > 0), 2 * total("_hits", lambda n: n) / (size + F.length("_shown")))
    each = F.arrays_zip("words", "_hits")
    kept = F.filter(each, lambda x: (F.length(x["words"]["w"]) > 0) & (2 * x["_hits"] >= F.length(x["words"]["w"])))
    first = F.array_min(F.transform(kept, lambda x: x["words"]["start_ms"]))
    last = F.greatest(F.array_max(F.transform(kept, lambda x: x["words"]["end_ms"])), first + shortest)
    fit = rows.withColumns({"_share": share, "_first": first, "_last": last})
    weak = F.coalesce(F.col("_share") < least_share, F.lit(True)) | F.col("_first").isNull()
    moved = F.greatest(F.abs(F.col("_first") - F.col("start_ms")), F.abs(F.col("_last") - F.col("end_ms"))) >= least_gap
    reason = F.when(F.col("words").isNull(), "no-speech").when(weak, "weak-align").when(moved, "trimmed").otherwise("already-tight")
    at = lambda new, old: F.when(F.col("reason") == "trimmed", F.col(new)).otherwise(F.col(old)).alias(old)
    return fit.withColumn("reason", reason).select("id", at("_first", "start_ms"), at("_last", "end_ms"), "reason")


def _plain(word: Column) -> Column:
    """A word's letters and digits alone."""
    return F.regexp_replace(word, "[^가-힣0-9a-zA-Z]", "")


def _grams(line: DataFrame, as_name: str) -> DataFrame:
    """Words, and runs of three, that occur once in their job: job_id, gram, and the place as as_name."""
    w = Window.partitionBy("job_id").orderBy("at")
    three = F.when(F.lead("w", 2).over(w).isNotNull(), F.concat_ws(" ", "w", F.lead("w", 1).over(w), F.lead("w", 2).over(w)))
    each = line.withColumn("_three", three).select("job_id", "at", F.explode(F.array("w", "_three")).alias("gram")).filter("gram IS NOT NULL")
    return each.groupBy("job_id", "gram").agg(F.count("*").alias("_n"), F.min("at").alias(as_name)).filter("_n = 1").drop("_n")


def _longest_chain(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the rows (s, h) those of a longest run in which both grow, by piles: each pile's top is the smallest h that ends a run of its length."""
    rows = rows.sort_values(["s", "h"])
    tops, top_rows, before = [], [], []
    for row, h in enumerate(rows["h"].tolist()):
        pile = bisect_left(tops, h)
        before.append(top_rows[pile - 1] if pile else -1)
        tops[pile : pile + 1], top_rows[pile : pile + 1] = [h], [row]
    chain, row = [], top_rows[-1] if top_rows else -1
    while row >= 0:
        chain.append(row)
        row = before[row]
    return rows.iloc[chain[::-1]]


def increasing(met: DataFrame) -> DataFrame:
    """Of pairs (job_id, s, h) with one row for each s, a longest chain in which both grow.

    A pair with all h before it smaller and all behind it larger is in every such chain and parts it from what follows. So only
    the stretches between such pairs are searched, each on its own; no task holds a job that is in order.
    """
    keys, order = ["job_id"], ["s"]
    rows = chains.parted(met.select("job_id", "s", "h"), keys, order)
    seen = chains.running_max(rows, keys, order, "h", "_most")
    bounded = storage.written(chains.running_max(seen, keys, order, "h", "_least", descending=True), "anchors")
    clean = F.coalesce(F.col("_most") < F.col("h"), F.lit(True)) & F.coalesce(F.col("_least") > F.col("h"), F.lit(True))
    stretches = chains.running_count(bounded, keys, order, clean, "_stretch").filter(~clean)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.select("job_id", "s", "h").schema)
    chosen = stretches.groupBy("job_id", "_stretch").applyInPandas(lambda part: _longest_chain(part)[["job_id", "s", "h"]], kinds)
    return bounded.filter(clean).select("job_id", "s", "h").unionByName(chosen)


#: Rows of the line that holds both texts of a job.
HEARD, SCRIPT = 0, 1


def _beside(line: DataFrame, anchor: str) -> DataFrame:
    """line (job_id, _kind, at, and the anchor, a struct (s, h), where the word is one) with a and b: the anchors at or before each word and at or behind it. Two running windows, one in each direction."""
    w = lambda by: Window.partitionBy("job_id", "_kind").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("a", F.last(anchor, True).over(w(F.asc("at")))).withColumn("b", F.last(anchor, True).over(w(F.desc("at"))))


def _said(line: DataFrame, place: str, said: Column, name: str) -> DataFrame:
    """line with what `said` gives for the word heard at the script's place; null where none was."""
    heard = F.col("_kind") == HEARD
    at = F.when(heard, F.col("at")).otherwise(F.col(place))
    return line.withColumn("_at", at).withColumn(name, F.max(F.when(heard, said)).over(Window.partitionBy("job_id", "_at"))).drop("_at")


def word_places(script: DataFrame, heard: DataFrame, astray: int = 20) -> DataFrame:
    """script (job_id, at, w, ...) with h, the place in heard (job_id, at, w) of each word, and same: whether that is the same word.

    The words of both texts lie in one line, dealt by job once; what belongs together meets in windows, not in joins, so neither
    text is shuffled again. Windows spill, so no task holds a job.

    1. Words and runs of three that stand once in either text are anchors, found by an equi-join. Those more than `astray` words
       off the median of their neighbours go; of the rest, a longest chain in which both places grow stays.
    2. From each anchor on, and back from the next one, words that are the same as what was heard at their distance are anchors
       too, up to the first that differs; where both meet, the earlier anchor's words count.
    3. What is left lies between two anchors, by interpolation over characters, or as many of them from the only one: words
       that were written apart and heard as one, or the other way round, so find their place.
    """
    met = _grams(script, "s").join(_grams(heard, "h"), ["job_id", "gram"]).groupBy("job_id", "s").agg(F.min("h").alias("h"))
    w = Window.partitionBy("job_id").orderBy("s")
    off = F.col("h") - F.col("s")
    near = met.withColumn("_m", F.percentile_approx(off, 0.5).over(w.rowsBetween(-4, 4))).filter(F.abs(off - F.col("_m")) <= astray)
    anchors = increasing(near).select("job_id", F.col("s").alias("at"), F.struct("s", "h").alias("anchor"), F.lit(SCRIPT).alias("_kind"))
    words = script.withColumn("_kind", F.lit(SCRIPT)).unionByName(heard.select("job_id", "at", "w", F.lit(HEARD).alias("_kind")), allowMissingColumns=True)
    # Windows widen the rows, so small parts aren't put together: their sorts would spill.
    parts = int(script.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = words.unionByName(anchors, allowMissingColumns=True).repartition(parts, "job_id")
    text = Window.partitionBy("job_id", "_kind")
    line = line.withColumn("anchor", F.max("anchor").over(Window.partitionBy("job_id", "_kind", "at"))).filter("w IS NOT NULL")
    # _c: the characters of the text before each word.
    line = line.withColumn("_c", F.sum(F.length("w")).over(text.orderBy("at")) - F.length("w"))
    line = _beside(line, "anchor").drop("anchor")
    line = line.withColumn("_l", F.col("a.h") + F.col("at") - F.col("a.s")).withColumn("_r", F.col("b.h") + F.col("at") - F.col("b.s"))
    for side in ("_l", "_r"):
        line = _said(line, side, F.struct("w", "_c"), "_s").withColumn(f"{side}w", F.col("_s.w")).withColumn(f"{side}c", F.col("_s._c")).drop("_s")
    line = line.withColumn("_lok", F.coalesce((F.col("w") == F.col("_lw")) & F.coalesce(F.col("_l") < F.col("b.h"), F.lit(True)) | (F.col("at") == F.col("b.s")), F.lit(False)))
    line = line.withColumn("_rok", F.coalesce((F.col("w") == F.col("_rw")) & F.coalesce(F.col("_r") > F.col("a.h"), F.lit(True)) | (F.col("at") == F.col("a.s")), F.lit(False)))
    gap = Window.partitionBy("job_id", "_kind", F.col("a.s"))
    line = line.withColumn("_lrun", F.col("a").isNotNull() & (F.sum(F.when(F.col("_lok"), 0).otherwise(1)).over(gap.orderBy("at")) == 0))
    line = line.withColumn("_upto", F.max(F.when(F.col("_lrun"), F.col("at"))).over(gap))
    line = line.withColumn("_rrun", F.col("b").isNotNull() & (F.sum(F.when(F.col("_rok"), 0).otherwise(1)).over(Window.partitionBy("job_id", "_kind", F.col("b.s")).orderBy(F.desc("at"))) == 0))
    apart = F.col("a").isNull() | ((F.col("at") > F.col("_upto")) & (F.col("_r") > F.col("a.h") + F.col("_upto") - F.col("a.s")))
    # Two expressions, as a struct from one of the sides alone keeps its own fields.
    place = F.when(F.col("_lrun"), F.col("_l")).when(F.col("_rrun") & apart, F.col("_r"))
    # Equal words, so as many characters on either side.
    behind = F.when(F.col("_lrun"), F.col("_lc")).when(F.col("_rrun") & apart, F.col("_rc"))
    line = line.withColumn("_more", F.when(place.isNotNull(), F.struct(F.col("at").alias("s"), place.alias("h"), F.col("_c").alias("sc"), behind.alias("hc"), F.length("w").alias("n"))))
    line = _beside(line.select(*script.columns, "_kind", "_c", "_more"), "_more").drop("_more")
    a_end, from_ = F.col("a.hc") + F.col("a.n"), F.col("_c") - F.col("a.sc") - F.col("a.n")
    shown, spoken = F.col("b.sc") - F.col("a.sc") - F.col("a.n"), F.col("b.hc") - F.col("a.hc") - F.col("a.n")
    target = F.coalesce(a_end + F.floor(from_ * spoken / F.greatest(shown, F.lit(1))), a_end + from_, F.col("b.hc") - (F.col("b.sc") - F.col("_c")))
    # An anchor keeps its place, and where nothing was heard between two of them, words go to the nearer one.
    nearer = F.col("a.h") + F.round((F.col("at") - F.col("a.s")) * (F.col("b.h") - F.col("a.h")) / F.greatest(F.col("b.s") - F.col("a.s"), F.lit(1))).cast("int")
    line = line.withColumn("h", F.when(F.col("b.h") - F.col("a.h") <= 1, nearer)).withColumn("_target", F.when((F.col("_kind") == SCRIPT) & F.col("h").isNull(), F.greatest(target, F.lit(0))))
    # By characters, a word's place is that of the last word heard that begins at or before its own place.
    by_char = Window.partitionBy("job_id").orderBy(F.when(F.col("_kind") == HEARD, F.col("_c")).otherwise(F.col("_target")), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_kind") == HEARD, F.col("at")), True).over(by_char)
    line = line.withColumn("_found", found).withColumn("h", F.coalesce("h", F.when(F.col("_target").isNotNull(), F.col("_found"))).cast("int"))
    line = _said(line, "h", F.col("w"), "_heard").withColumn("same", F.col("w") == F.col("_heard"))
    return line.filter((F.col("_kind") == SCRIPT) & F.col("h").isNotNull()).select(*script.columns, "h", "same")


def script_and_heard(sentences: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words w of sentences (job_id, no, text) and of those heard (job_id, start_ms, end_ms, word), letters and digits alone, with their places `at` in the job.

    A script's places follow from the number of words in each sentence, so its words aren't shuffled.
    """
    kept = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+"), _plain), lambda w: w != "")
    before = F.sum(F.size("_w")).over(Window.partitionBy("job_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    counted = sentences.select("job_id", "no", kept.alias("_w")).withColumn("_before", F.coalesce(before, F.lit(0)))
    script = counted.select("job_id", "no", "_before", F.posexplode("_w").alias("_i", "w")).select("job_id", "no", (F.col("_before") + F.col("_i")).cast("int").alias("at"), "w")
    at = F.row_number().over(Window.partitionBy("job_id").orderBy("start_ms", "end_ms", "word")) - 1
    return script, words.withColumn("w", _plain(F.col("word"))).filter("w <> ''").withColumn("at", at).drop("word")


def aligned_sentences(sentences: DataFrame, words: DataFrame, least_share: float = 0.7, astray: int = 20) -> DataFrame:
    """job_id, no, text, start_ms, end_ms: times of a script's sentences (job_id, no, text) from the words heard; a job that doesn't fit, or whose times would run backwards, gives no row.

    Places are those of word_places. A job fits if the characters of words that are the same at their place are least_share of
    all, counted on both sides.
    """
    script, heard = (storage.written(x, "words") for x in script_and_heard(sentences, words))
    size = F.length("w")
    placed = word_places(script, heard, astray).groupBy("job_id", "no").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum(F.when(F.col("same"), size).otherwise(0)).alias("_same"), F.sum(size).alias("_chars"))
    placed = storage.written(placed, "places")
    sizes = heard.groupBy("job_id").agg(F.sum(size).alias("_heard_chars"))
    share = 2 * F.sum("_same") / (F.sum("_chars") + F.max("_heard_chars"))
    fit = placed.join(sizes, "job_id").groupBy("job_id").agg(share.alias("share")).filter(F.col("share") >= least_share).select("job_id")
    # A sentence begins behind the one before it, if it has a word left there.
    in_order = Window.partitionBy("job_id").orderBy("no")
    begun = placed.join(fit, "job_id").withColumn("lo", F.least("hi", F.greatest("lo", F.coalesce(F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(0)))))
    # Both ends of a sentence ask at once, so the words heard are dealt out once.
    ends = begun.select("job_id", "no", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(True).alias("_first")), F.struct(F.col("hi").alias("at"), F.lit(False).alias("_first")))).alias("_e")).select("job_id", "no", "_e.*")
    met = ends.join(heard.select("job_id", "at", "start_ms", "end_ms"), ["job_id", "at"])
    timed = met.groupBy("job_id", "no").agg(F.max(F.when(F.col("_first"), F.col("start_ms"))).alias("start_ms"), F.max(F.when(~F.col("_first"), F.col("end_ms"))).alias("end_ms"))
    back = (F.col("end_ms") <= F.col("start_ms")) | F.coalesce(F.col("start_ms") < F.lag("end_ms").over(in_order), F.lit(False))
    timed = storage.written(timed.withColumn("_back", back), "times")
    wrong = timed.filter("_back").select("job_id").distinct()
    return timed.join(wrong, "job_id", "left_anti").join(sentences, ["job_id", "no"]).select("job_id", "no", T.stripped(F.col("text")).alias("text"), "start_ms", "end_ms")


def rebuilt_cells(cues: DataFrame, aligned: DataFrame) -> DataFrame:
    """job_id, idx, start_ms, end_ms, text_stt, text_llm, text_final, reviewed: the track of each job made anew from its aligned sentences, with times alone left to review.

    Jobs without aligned sentences stay as they are, and so do those whose cues already hold the same sentences in order, so a
    second run changes nothing.
    """
    key = lambda c: F.regexp_replace(c, "[^가-힣0-9a-zA-Z]", "")
    script = lambda df, order, text: df.groupBy("job_id").agg(F.sha2(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(order, key(F.col(text)).alias("k")))), lambda x: x["k"])), 256).alias("_script"))
    aligned = storage.written(aligned, "aligned")  # read three times below
    same = script(cues, "idx", "text_llm").join(script(aligned, "no", "text"), ["job_id", "_script"]).select("job_id")
    new = aligned.join(same, "job_id", "left_anti")
    columns = ["job_id", "idx", "start_ms", "end_ms", "text_stt", "text_llm", "text_final", "reviewed"]
    idx = (F.row_number().over(Window.partitionBy("job_id").orderBy("no")) - 1).cast("long")
    fresh = new.withColumn("idx", idx).select("job_id", "idx", "start_ms", "end_ms", F.col("text").alias("text_stt"), F.col("text").alias("text_llm"), F.lit("").alias("text_final"), F.lit(False).alias("reviewed"))
    return cues.join(new.select("job_id").distinct(), "job_id", "left_anti").select(*columns).unionByName(fresh)


def annotated(cues: DataFrame, lexicon: DataFrame, most: int = 6) -> DataFrame:
    """id, text: work texts with known spellings put in; a text with more than `most` brackets stays.

    A gloss and glyph (`얼굴 안 자`) takes the glyph's spelling where (gloss, reading) is known; a word of the special lexicon takes
    its own where it stands alone or before a particle. Candidates are cut out of the texts and joined to the lexicon by
    equality, so it may be of any size; each text then takes its own few replacements.
    """
    rows = cues.select("id", T.work_text().alias("text"))
    glyphs = rows.select("id", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit("([가-힣]+) ([가-힣]) 자"), F.lit(1)).alias("g"), F.regexp_extract_all("text", F.lit("([가-힣]+) ([가-힣]) 자"), F.lit(2)).alias("r"))).alias("m")).select("id", F.col("m.g").alias("gloss"), F.col("m.r").alias("reading"))
    a = glyphs.join(lexicon.filter("gloss <> ''"), ["gloss", "reading"]).select("id", F.lit(0).alias("o"), F.concat(F.lit("(?<![가-힣])"), "gloss", F.lit(" "), "reading", F.lit(" 자")).alias("find"), F.concat("gloss", F.lit(" "), "reading", F.lit("("), "hanja", F.lit(") 자")).alias("put"))
    tokens = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[가-힣]{2,}(?!\\()"), F.lit(0)))).alias("token"))
    heads = tokens.select("id", "token", F.explode(F.sequence(F.lit(2), F.length("token"))).alias("k")).withColumn("reading", F.left("token", F.col("k"))).withColumn("tail", F.substr("token", F.col("k") + 1))
    fit = (F.col("tail") == "") | F.col("tail").isin(*korean.PARTICLES)
    b = heads.filter(fit).join(lexicon.filter("gloss = '' AND tier = 'special'"), "reading").groupBy("id", "token").agg(F.max_by(F.struct("reading", "hanja", "tail"), F.length("reading")).alias("m"))
    b = b.select("id", F.lit(1).alias("o"), F.concat(F.lit("(?<![가-힣])"), "token", F.lit("(?![가-힣(])")).alias("find"), F.concat("m.reading", F.lit("("), F.col("m.hanja"), F.lit(")"), F.col("m.tail")).alias("put"))
    changes = a.unionByName(b).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("o", "find", "put"))).alias("_c"))
    filled = F.aggregate("_c", F.col("text"), lambda acc, c: F.regexp_replace(acc, c["find"], c["put"]))
    brackets = F.length("text") - F.length(F.replace("text", F.lit("("), F.lit("")))
    return rows.join(changes, "id", "left").select("id", F.when(F.col("_c").isNull() | (brackets > most), F.col("text")).otherwise(filled).alias("text"))


def redistributed(cues: DataFrame) -> DataFrame:
    """Each even cue and the next one with the time of both shared by the weight of their texts: id, start_ms, end_ms."""
    w = Window.partitionBy("job_id").orderBy("idx")
    cut = ordered.weighted_boundaries(cues).select("id", "boundary_ms")
    rows = cues.join(cut, "id", "left").withColumn("_before", F.lag("boundary_ms").over(w))
    even: Column = F.col("idx") % 2 == 0
    return rows.select("id", F.when(~even & F.col("_before").isNotNull(), F.col("_before")).otherwise(F.col("start_ms")).alias("start_ms"), F.when(even & F.col("boundary_ms").isNotNull(), F.col("boundary_ms")).otherwise(F.col("end_ms")).alias("end_ms"))
