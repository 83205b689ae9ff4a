"""What reviewed cues teach: correction pairs, their counts and their application, terms, and annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import alignment, korean, phrases
from cuelake.functions import text as T
from cuelake.operators import intervals, quality
from cuelake.operators.progress import numbered
from cuelake.sources import storage

LONGEST_PHRASE = 30
#: So many words at the start of a phrase lead to the texts that hold it.
HEAD = 3


def extracted_pairs(cues: DataFrame) -> DataFrame:
    """job_id, idx, wrong, right, context: what reviewers replaced in each reviewed cue, safe to apply elsewhere."""
    found = cues.filter("reviewed").select("job_id", "idx", F.explode(alignment.replaced_phrases(T.machine_text(), F.col("text_final"))).alias("p"))
    wrong, right = korean.clean_pair_text(F.col("p.wrong")), korean.clean_pair_text(F.col("p.right"))
    pairs = found.select("job_id", "idx", wrong.alias("wrong"), right.alias("right"), "p.context").filter((F.length("wrong") <= LONGEST_PHRASE) & (F.length("right") <= LONGEST_PHRASE))
    return pairs.filter(korean.is_safe_pair(F.col("wrong"), F.col("right")))


def first_seen(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("job_id", "wrong", "right").agg(F.min("idx").alias("first_idx"), F.min_by("context", "idx").alias("context"))


def pair_counts(log: DataFrame, keys: tuple[str, ...] = ("wrong", "right")) -> DataFrame:
    """Counts over an absorb log (keys, job, seq): one, and one more each time the pair comes from another job than the time before."""
    w = Window.partitionBy(*keys).orderBy("seq")
    last = F.lag("job").over(w)
    switched = log.withColumn("_new", F.when(last.isNull() | (last != F.col("job")), 1).otherwise(0))
    return switched.groupBy(*keys).agg(F.sum("_new").alias("count"), F.max_by("job", "seq").alias("source_job"))


def mined_tokens(cues: DataFrame, token: str = "[가-힣]{2,}", stop: tuple[str, ...] = (), least: int = 2, most: int = 400) -> DataFrame:
    """wrong, right, n: tokens of the given pattern that changed one for one in reviewed cues, most frequent first."""
    listed = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(token), F.lit(0)), " ")
    found = cues.filter("reviewed").select(F.explode(alignment.replaced_tokens(listed(T.machine_text()), listed(F.col("text_final")))).alias("p")).select("p.*")
    kept = found.filter((F.length("right") >= 2) & ~F.col("wrong").isin(*stop, "") & ~F.col("right").isin(*stop, ""))
    return kept.groupBy("wrong", "right").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "wrong", "right").limit(most)


def pre_passed(cues: DataFrame, pairs: DataFrame, least: int = 2) -> DataFrame:
    """id, text: the recognised text after all pairs seen `least` times that it holds, most frequent first (then by name).

    Pairs meet cues through the pair's first words, so a vocabulary of any size is an equi-join.
    """
    strong = pairs.filter(F.col("count") >= least)
    return _applied(cues.select("id", "job_id", "idx", F.col("text_stt").alias("text")), strong.withColumn("_rank", F.struct(-F.col("count"), "wrong", "right")))


def _first_word(c: Column) -> Column:
    return F.get(_words(c), F.lit(0))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)[^\w]+"), lambda w: w != "")


def _keys(c: Column) -> Column:
    """Hashes of the runs of one to HEAD words in a text: where a phrase stands whole, the hash of its first HEAD words is one of them. Words that are missing at the end don't count in a hash."""
    of = lambda ws, i, n: F.xxhash64(F.concat_ws(" ", *(F.get(ws, i + k) for k in range(n))))
    return T.let(_words(c), lambda ws: F.flatten(F.transform(ws, lambda _, i: F.array(*(of(ws, i, n) for n in range(1, HEAD + 1))))))


def _head(c: Column) -> Column:
    """The hash of the first HEAD words of a phrase, null without words."""
    return T.let(_words(c), lambda ws: F.when(F.size(ws) > 0, F.xxhash64(F.array_join(F.slice(ws, 1, HEAD), " "))))


def _applied(cues: DataFrame, ranked: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """id, before, text: cues (id, job_id, idx, text) after all pairs (_rank, wrong, right), one after another by rank.

    own: pairs (_rank, wrong, right, job_id, _after) of single jobs, for their cues behind the place _after.

    A pair meets a text through its first words, all HEAD of them where it has as many, so by an equi-join whose rows are close
    to the replacements to be made; own pairs meet by job as well. A replacement makes new runs of words. So after a round the
    cues that it has changed are looked up anew by the runs that they had on the way and not at first; those that meet further
    pairs run again from the start, with all of theirs. There are as many rounds as the longest chain of replacements that a
    text goes through, and each costs what the last one has changed.
    """
    keyed = [(storage.written(rows.withColumn("_key", _head(F.col("wrong"))).filter("_key IS NOT NULL AND right IS NOT NULL"), "pairs"), by) for rows, by in ((ranked, []), (own, ["job_id"])) if rows is not None]
    # Pairs are told apart by a hash, as arrays of structs are compared element by element.
    pair = F.struct("_rank", "wrong", "right", F.xxhash64("_rank", "wrong", "right").alias("_no"))
    kind = f"array<struct<_rank:{ranked.schema['_rank'].dataType.simpleString()},wrong:string,right:string,_no:bigint>>"
    numbers = lambda of: F.transform(of, lambda p: p["_no"])
    start = storage.written(cues.select("id", "job_id", "idx", F.col("text").alias("before"), "text", F.array().cast(kind).alias("_pairs")), "cues")
    # The runs of the texts at first are many, and made as they are looked up.
    active, new, done = start, F.array_distinct(_keys(F.col("text"))), []
    while True:
        asked = active.select("id", "job_id", "idx", F.explode(new).alias("_key"))
        found = [asked.join(pairs, ["_key", *by]).filter("idx > _after" if by else "true").select("id", pair.alias("_p")) for pairs, by in keyed]
        met = reduce(DataFrame.union, found).groupBy("id").agg(F.collect_set("_p").cast(kind).alias("_met"))
        grown = active.join(met, "id", "left").withColumn("_more", F.array_except(numbers("_met"), numbers("_pairs"))).withColumn("_on", F.coalesce(F.size("_more") > 0, F.lit(False)))
        paired = grown.withColumn("_pairs", F.when(F.col("_on"), F.array_sort(F.concat("_pairs", F.filter("_met", lambda p: F.array_contains(F.col("_more"), p["_no"]))))))
        ran = paired.withColumn("_ran", phrases.in_turn("before", F.transform("_pairs", lambda p: p["wrong"]), F.transform("_pairs", lambda p: p["right"]), HEAD))
        after = storage.written(ran.select("id", "job_id", "idx", "before", F.when(F.col("_on"), F.col("_ran.text")).otherwise(F.col("text")).alias("text"), "_pairs", F.when(F.col("_on"), F.col("_ran.brought")).alias("_new")), "cues")
        done.append(after.filter("_new IS NULL OR size(_new) = 0").select("id", "before", "text"))
        active, new = after.filter("size(_new) > 0"), F.transform("_new", lambda run: F.xxhash64(run))
        if active.isEmpty():
            return reduce(DataFrame.union, done)


def _spread(rows: DataFrame) -> DataFrame:
    """Few rows that each take long, over all of the session's shuffle partitions: adaptive execution would put them together by their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def propagated(cues: DataFrame, global_pairs: DataFrame, job_pairs: DataFrame, least: int = 2) -> DataFrame:
    """id, before, text of cues that aren't reviewed: global pairs seen `least` times go everywhere, a job's own pairs to its cues after the first one they were seen in; longest first."""
    rank = F.struct(-F.length("wrong"), "wrong", "right")
    everywhere = global_pairs.filter(F.col("count") >= least).select("wrong", "right", rank.alias("_rank"))
    here = job_pairs.select("wrong", "right", "job_id", F.col("first_idx").alias("_after"), rank.alias("_rank"))
    targets = cues.filter("NOT reviewed").select("id", "job_id", "idx", T.first_filled(*(c for c in ("text_final", "text_llm", "text_stt") if c in cues.columns)).alias("text")).filter("text <> ''")
    return _applied(targets, everywhere, here)


def repaired(cues: DataFrame, unsafe: DataFrame) -> DataFrame:
    """id, before, text: unreviewed machine text with an unsafe rewrite undone, where that brings it closer to what was recognised.

    Both directions of each pair are tried; of all candidates of a cue, the closest one counts if it beats the text as it is (of
    equally close ones the last by name). A candidate is aligned only if its characters could beat the best one so far.
    """
    rows = cues.filter("NOT reviewed AND text_final = '' AND text_llm <> ''").select("id", "text_stt", "text_llm")
    words = rows.select("id", F.explode(F.array_distinct(F.filter(F.split("text_llm", r"(?U)[^\w]+"), lambda w: w != ""))).alias("_word"))
    both = unsafe.select(F.col("right").alias("from"), F.col("wrong").alias("to")).union(unsafe.select("wrong", "right"))
    tried = words.join(both.withColumn("_word", _first_word(F.col("from"))), "_word").join(rows, "id").filter(F.contains("text_stt", "to"))
    changed = tried.withColumn("text", korean.replaced_whole(F.col("text_llm"), F.col("from"), F.col("to"))).filter("text <> text_llm")
    gathered = changed.groupBy("id", "text_stt", "text_llm").agg(F.collect_set("text").alias("_texts"))
    return _spread(gathered).select("id", F.col("text_llm").alias("before"), alignment.closest("text_stt", "text_llm", "_texts").alias("text")).filter("text IS NOT NULL")


def absorbed(cues: DataFrame, global_pairs: DataFrame, job_pairs: DataFrame, unsafe: DataFrame) -> DataFrame:
    """id, before, text, repaired of the unreviewed cues that learning changes: unsafe rewrites are undone first, then the pairs go over what that left."""
    fixed = storage.written(repaired(cues, unsafe).select("id", F.col("text").alias("_fixed")), "repaired")
    after = cues.join(fixed, "id", "left").withColumn("text_llm", F.coalesce("_fixed", "text_llm"))
    put = propagated(after.select(cues.columns), global_pairs, job_pairs).select("id", F.col("text").alias("_put"))
    rows = after.filter("NOT reviewed").join(put, "id", "left").join(cues.select("id", T.first_filled("text_final", "text_llm", "text_stt").alias("before")), "id")
    text = F.coalesce("_put", T.first_filled("text_final", "text_llm", "text_stt"))
    return rows.select("id", "before", text.alias("text"), F.col("_fixed").isNotNull().alias("repaired")).filter("before <> text")


def term_counts(texts: DataFrame, col: str, token: str, stop: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    found = texts.select(F.explode(F.regexp_extract_all(F.lower(col), F.lit(token), F.lit(0))).alias("term"))
    return found.filter(~F.col("term").isin(*stop, "")).groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def candidates(counts: DataFrame, known: DataFrame, most: int = 200) -> DataFrame:
    """New terms to look at: those not known yet, the most frequent first, with a confidence in hundredths of at most 100."""
    new = counts.join(known.select("term"), "term", "left_anti").orderBy(F.desc("n"), "term").limit(most)
    return new.select("term", "n", F.least(F.lit(100), F.col("n") * 2).cast("long").alias("confidence"), F.lit(False).alias("approved"))


def curated(terms: DataFrame, chosen: DataFrame) -> DataFrame:
    """Terms after curation: a chosen one is approved with full confidence, keeps its variants unless new ones are given, and is added if it is new."""
    both = terms.join(chosen.select("term", F.col("category").alias("_c"), F.col("variants").alias("_v")), "term", "full")
    hit = F.col("_c").isNotNull()
    return both.select("term", F.when(hit, F.col("_c")).otherwise(F.col("category")).alias("category"), F.when(hit & (F.col("_v") != ""), F.col("_v")).otherwise(F.coalesce("variants", F.lit(""))).alias("variants"), F.when(hit, 100).otherwise(F.col("confidence")).cast("long").alias("confidence"), (hit | F.coalesce("approved", F.lit(False))).alias("approved"))


def domain_terms(terms: DataFrame, readings: DataFrame, limit: int, sure: int = 70) -> DataFrame:
    """term, part: sure terms (all of them), then special readings, then the others up to the limit; a term counts where it comes first."""
    parts = terms.filter(F.col("confidence") >= sure).select("term", F.lit(0).alias("part"), F.lit(0).cast("long").alias("_o")).unionByName(readings.select("term", F.lit(1).alias("part"), (-F.col("n")).alias("_o"))).unionByName(terms.filter(F.col("confidence") < sure).select("term", F.lit(2).alias("part"), (-F.col("confidence")).alias("_o")))
    first = parts.groupBy("term").agg(F.min(F.struct("part", "_o")).alias("_p")).select("term", "_p.part", "_p._o")
    # What the limit leaves room for is `limit` rows at most, whatever the vocabulary's size.
    rest = first.filter("part > 0").orderBy("part", "_o", "term").limit(limit)
    room = F.greatest(F.lit(limit) - F.col("_sure"), F.lit(0))
    ranked = rest.withColumn("_r", F.row_number().over(Window.orderBy("part", "_o", "term"))).crossJoin(F.broadcast(first.filter("part = 0").agg(F.count("*").alias("_sure")))).filter(F.col("_r") <= room)
    return first.filter("part = 0").select("term", "part").unionByName(ranked.select("term", "part"))


def few_shot(pairs: DataFrame, limit: int) -> DataFrame:
    """The most frequent pairs that are safe: three times the limit is taken first, then filtered, then cut."""
    wide = pairs.orderBy(F.desc("count"), "wrong", "right").limit(3 * limit)
    return wide.filter(korean.is_safe_pair(F.col("wrong"), F.col("right"))).orderBy(F.desc("count"), "wrong", "right").limit(limit)


def translation_pairs(cues: DataFrame, renditions: DataFrame, forked: DataFrame, media: DataFrame, lang: str) -> DataFrame:
    """source, text, order: what people have translated into a language in real jobs, a row for each source text: the first by order.

    First come reviewed or edited renditions, by job and cue; then reviewed cues of tracks of their own, each with the source cue
    that it overlaps alone or for the most part. Blank texts on either side teach nothing.
    """
    real = media.filter("NOT practice").select("job_id")
    best = T.stripped(T.first_filled("text_final", "text_llm", "text_stt"))
    source = cues.join(real, "job_id", "left_semi").select("job_id", "id", "start_ms", "end_ms", best.alias("source"))
    inherited = renditions.filter((F.col("lang") == lang) & (F.col("reviewed") | F.col("edited"))).select(F.col("cue_id").alias("id"), "text").join(source, "id")
    own = forked.filter((F.col("lang") == lang) & F.col("reviewed")).join(real, "job_id", "left_semi")
    matched = intervals.dominant_overlap(own, source).join(own.select("id", "text"), "id").withColumnRenamed("id", "_own").withColumnRenamed("match", "id").join(source, "id")
    place = lambda part, by: F.struct(F.lit(part).alias("part"), F.col("job_id").cast("long").alias("job_id"), F.col(by).cast("long").alias("id"))
    every = inherited.select("source", T.stripped(F.col("text")).alias("text"), place(0, "id").alias("order")).unionByName(matched.select("source", T.stripped(F.col("text")).alias("text"), place(1, "_own").alias("order")))
    return every.filter("source <> '' AND text <> ''").groupBy("source").agg(F.min(F.struct("order", "text")).alias("_f")).select("source", "_f.text", "_f.order")


def term_bearing_first(pairs: DataFrame, forms: DataFrame, most: int) -> DataFrame:
    """place (from 0), source, text, has_term: `most` of the pairs (source, text, order).

    Those whose source holds a form come first, by order; what they leave room for is a sample spread over the lengths of the
    others: each step-th of them by length, the step being their number over the room. No task sees all pairs: lengths are
    numbered in parts.
    """
    known = storage.written(pairs, "translations")
    holds = quality.mentions(known, F.col("source"), forms, key="source").select("source").distinct()
    bearing = known.join(holds, "source", "left_semi").orderBy("order").limit(most)
    first = storage.written(bearing.withColumn("place", F.row_number().over(Window.orderBy("order")) - 1), "bearing")  # `most` rows
    room, rest = most - first.count(), known.join(holds, "source", "left_anti")
    out = first.select("place", "source", "text", F.lit(True).alias("has_term"))
    n = rest.count()
    if room <= 0 or not n:
        return out
    step = max(1, n // room)
    sampled = numbered(rest.withColumn("_n", F.length("source")), "_n", "order").withColumn("_i", F.col("place") - 1).filter((F.col("_i") % step == 0) & (F.col("_i") < step * room))
    return out.unionByName(sampled.select((F.lit(most - room) + F.floor(F.col("_i") / step)).cast("int").alias("place"), "source", "text", F.lit(False).alias("has_term")))


def absorbed_annotations(log: DataFrame) -> DataFrame:
    """A lexicon from an absorb log (gloss, reading, hanja, job, seq): counts by job switches; special if seen twice or more and the reading has one spelling only."""
    counts = pair_counts(log, ("gloss", "reading", "hanja"))
    spellings = F.count("*").over(Window.partitionBy("gloss", "reading"))
    return counts.withColumn("ambiguous", spellings > 1).withColumn("tier", F.when(~F.col("ambiguous") & (F.col("count") >= 2), "special").otherwise("common"))


def mined_annotations(cues: DataFrame) -> DataFrame:
    """job_id, gloss, reading, hanja that reviewed cues spell out."""
    return cues.filter("reviewed").select("job_id", F.explode(korean.annotations(F.col("text_final"))).alias("a")).select("job_id", "a.*").distinct()


def annotation_share(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, percent: int = 50) -> DataFrame:
    """For each term: places, places with the annotation, and whether `percent` of them have it."""
    token = F.explode(F.regexp_extract_all(text_col, F.lit(r"([\p{L}\p{N}]+)(\([^)]*\))?"), F.lit(0)))
    found = texts.select(token.alias("t")).select(F.regexp_replace("t", r"\(.*$", "").alias("term"), F.contains("t", F.lit("(")).alias("with"))
    counts = found.join(lexicon.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"), F.count_if("with").alias("n_annotated"))
    return counts.withColumn("special", F.col("n_annotated") * 100 >= F.col("n") * percent)


def keyword_amounts(texts: DataFrame, text_col: str, keywords: DataFrame, amount: str = r"[0-9]+") -> DataFrame:
    """How often a keyword and an amount stand in one sentence."""
    sentences = texts.select(F.explode(F.split(F.lower(text_col), r"[.?!\n]+")).alias("s"))
    parts = sentences.select(F.array_distinct(F.regexp_extract_all("s", F.lit(amount), F.lit(0))).alias("amounts"), F.array_distinct(F.regexp_extract_all("s", F.lit("[a-z]+"), F.lit(0))).alias("words")).filter("size(amounts) > 0")
    pairs = parts.select(F.explode("amounts").alias("amount"), "words").select("amount", F.explode("words").alias("keyword"))
    return pairs.join(keywords.select("keyword").distinct(), "keyword", "left_semi").groupBy("keyword", "amount").agg(F.count("*").alias("n"))
