"""Edits of a track as transforms of snapshots: each takes tables and gives the tables after the edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import intervals, learning, ordered, quality, relations
from cuelake.operators.ordered import renumbered
from cuelake.sources import storage

TEXTS = ("text_stt", "text_caption", "text_llm", "text_final")
#: The shortest cue that an edit may leave.
LEAST_MS = 100


def split_at(cues: DataFrame, at: DataFrame) -> DataFrame:
    """Cues cut in two where `at` (id, pos) says: the work text at a character, the time in proportion. The right part keeps the flags, but no machine texts."""
    rows = cues.join(at, "id", "left").withColumn("_w", T.work_text())
    n, pos = F.length("_w"), F.col("pos")
    cuts = pos.isNotNull() & (pos > 0) & (pos < n)
    mid = F.expr("start_ms + (end_ms - start_ms) * pos div length(_w)")
    left = F.struct(F.col("start_ms"), mid.alias("end_ms"), F.trim(F.left("_w", pos)).alias("text_final"), F.lit(False).alias("_right"))
    right = F.struct(mid.alias("start_ms"), F.col("end_ms"), F.trim(F.substr("_w", pos + 1)).alias("text_final"), F.lit(True).alias("_right"))
    whole = F.struct("start_ms", "end_ms", "text_final", F.lit(False).alias("_right"))
    parts = rows.withColumn("_p", F.explode(F.when(cuts, F.array(left, right)).otherwise(F.array(whole))))
    out = parts.select("job_id", (F.col("id") * 2 + F.col("_p._right").cast("int")).alias("id"), "_p.start_ms", "_p.end_ms", *(F.when(F.col("_p._right"), "").otherwise(F.col(c)).alias(c) for c in TEXTS[:3]), "_p.text_final", "flagged", "reviewed")
    return renumbered(out)


def merged_with_next(cues: DataFrame, ids: DataFrame) -> DataFrame:
    """Each cue named in ids joined with the next one of its job: texts without their shared ends, flags of either, not reviewed; the next one goes. A cue that is itself absorbed isn't merged."""
    w = Window.partitionBy("job_id").orderBy("idx")
    marked = cues.join(ids.select("id", F.lit(True).alias("_pick")), "id", "left").withColumn("_pick", F.coalesce("_pick", F.lit(False)) & F.lead("id").over(w).isNotNull())
    # In a run of picks every second one merges, counted from the run's start.
    run = marked.withColumn("_block", F.sum(F.when(F.col("_pick"), 0).otherwise(1)).over(w))
    place = F.row_number().over(Window.partitionBy("job_id", "_block", "_pick").orderBy("idx"))
    chosen = run.withColumn("_pick", F.col("_pick") & (place % 2 == 1))
    following = {c: F.lead(c).over(w) for c in (*TEXTS, "end_ms", "flagged", "uncertain")}
    wide = chosen.withColumns({f"_n_{c}": v for c, v in following.items()} | {"_gone": F.coalesce(F.lag("_pick").over(w), F.lit(False))})
    take = lambda c, v: F.when(F.col("_pick"), v).otherwise(F.col(c)).alias(c)
    out = wide.filter("NOT _gone").select(
        "job_id", "id", "start_ms", take("end_ms", F.greatest("end_ms", "_n_end_ms")), *(take(c, T.join_without_overlap(F.col(c), F.col(f"_n_{c}"))) for c in TEXTS),
        take("flagged", F.col("flagged") | F.col("_n_flagged")), take("uncertain", F.col("uncertain") | F.col("_n_uncertain")), take("reviewed", F.lit(False)),
    )
    return renumbered(out)


def deleted(cues: DataFrame, renditions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cues and renditions without the cues named, cues numbered anew."""
    return renumbered(cues.join(ids, "id", "left_anti")), renditions.join(ids.withColumnRenamed("id", "cue_id"), "cue_id", "left_anti")


def retimed(cues: DataFrame, new_times: DataFrame) -> DataFrame:
    """Cues with the times of new_times (id, new_start, new_end), which can't cross a neighbour nor leave less than LEAST_MS."""
    w = Window.partitionBy("job_id").orderBy("idx")
    rows = cues.join(new_times, "id", "left").withColumns({"_low": F.coalesce(F.lag("end_ms").over(w), F.lit(0)), "_high": F.lead("start_ms").over(w)})
    start = F.greatest("new_start", F.least("_low", "start_ms"))
    end = F.least("new_end", F.coalesce(F.greatest("_high", "end_ms"), F.col("new_end")))
    moved = F.col("new_start").isNotNull()
    return rows.select("job_id", "id", F.when(moved, start).otherwise(F.col("start_ms")).alias("start_ms"), F.when(moved, F.greatest(end, start + LEAST_MS)).otherwise(F.col("end_ms")).alias("end_ms"))


def linked_boundary(cues: DataFrame, moves: DataFrame) -> DataFrame:
    """The boundary of each cue in moves (id, at_ms) with the cue before it moved to at_ms: this one starts and that one ends there, both at least LEAST_MS long."""
    w = Window.partitionBy("job_id").orderBy("idx")
    rows = cues.join(moves, "id", "left").withColumns({"_prev_start": F.lag("start_ms").over(w), "_next_at": F.lead("at_ms").over(w), "_next_end": F.lead("end_ms").over(w)})
    at = lambda v, low, high: F.greatest(low + LEAST_MS, F.least(v, high - LEAST_MS))
    start = F.when(F.col("at_ms").isNotNull() & F.col("_prev_start").isNotNull(), at(F.col("at_ms"), F.col("_prev_start"), F.col("end_ms"))).otherwise(F.col("start_ms"))
    end = F.when(F.col("_next_at").isNotNull(), at(F.col("_next_at"), F.col("start_ms"), F.col("_next_end"))).otherwise(F.col("end_ms"))
    return rows.select("job_id", "id", start.alias("start_ms"), end.alias("end_ms"))


def restored(cues: DataFrame, snapshot: DataFrame, created: DataFrame) -> DataFrame:
    """Cues after an undo: rows of the snapshot as they were, rows that the edit created gone, numbered anew."""
    kept = cues.join(created, "id", "left_anti").join(snapshot.select("id"), "id", "left_anti")
    return renumbered(kept.unionByName(snapshot))


def confirmed(cues: DataFrame, safe: DataFrame) -> DataFrame:
    """Cues with those in safe that aren't reviewed yet marked as reviewed, their work text as the final one."""
    hit = F.col("_safe").isNotNull() & ~F.col("reviewed")
    rows = cues.join(safe.select("id", F.lit(True).alias("_safe")), "id", "left")
    return rows.select("job_id", "id", F.when(hit, T.work_text()).otherwise(F.col("text_final")).alias("text_final"), (F.col("reviewed") | hit).alias("reviewed"))


def fresh_hash(c: Column) -> Column:
    return T.content_hash(16, T.stripped(c))


def staleness(cues: DataFrame, renditions: DataFrame) -> DataFrame:
    """cue_id, lang, stale: whether a rendition was made of another text than the cue's work text now."""
    now = cues.select(F.col("id").alias("cue_id"), fresh_hash(T.first_filled("text_final", "text_llm", "text_stt")).alias("_now"))
    made = fresh_hash(F.col("hash_of"))
    return renditions.join(now, "cue_id").select("cue_id", "lang", (made != F.col("_now")).alias("stale"))


def forked_track(cues: DataFrame, renditions: DataFrame, lang: str, existing: DataFrame) -> DataFrame:
    """A track of its own for a language: the source's structure with its renditions' texts, review carried over where fresh; jobs that have the track already give nothing."""
    mine = renditions.filter(F.col("lang") == lang).select(F.col("cue_id").alias("id"), F.col("text").alias("_text"), "hash_of", F.col("reviewed").alias("_reviewed"))
    rows = cues.join(existing.filter(F.col("lang") == lang).select("job_id").distinct(), "job_id", "left_anti").join(mine, "id", "left")
    fresh = fresh_hash(F.col("hash_of")) == fresh_hash(T.first_filled("text_final", "text_llm", "text_stt"))
    return rows.select("job_id", "id", F.lit(lang).alias("lang"), "idx", "start_ms", "end_ms", F.coalesce("_text", F.lit("")).alias("text"), (F.coalesce("_reviewed", F.lit(False)) & F.coalesce(fresh, F.lit(False))).alias("reviewed"))


def unforked(cues: DataFrame, forked: DataFrame) -> DataFrame:
    """Renditions back from a track of its own: for each source cue the text of the forked cue that it overlaps most."""
    best = intervals.best_overlap(cues, forked)
    return best.join(forked.select(F.col("id").alias("match"), "lang", "text", "reviewed"), "match").select(F.col("id").alias("cue_id"), "lang", "text", "reviewed")


def imported(new: DataFrame, cues: DataFrame, captions: DataFrame) -> DataFrame:
    """A new structure (job_id, id, start_ms, end_ms, text) for a job: machine texts from the old cues it overlaps, and the old cue whose rendition goes along, by equal text nearest in time."""
    old = cues.select("job_id", F.col("id").alias("cap_id"), "start_ms", "end_ms", F.col("text_stt").alias("text"))
    machine = intervals.overlap_text(new, old, without_repeats=True).withColumnRenamed("text", "text_stt")
    carried = intervals.nearest_same_text(new, cues.withColumn("text", T.first_filled("text_final", "text_llm", "text_stt"))).select("id", F.col("match").alias("rendition_of"))
    out = new.join(machine, "id").join(carried, "id", "left").join(intervals.overlap_text(new, captions).withColumnRenamed("text", "text_caption"), "id")
    return renumbered(out)


def routed(cues: DataFrame, renditions: DataFrame, model: DataFrame, lang: str) -> DataFrame:
    """The rendition of each cue: an edited one stays, a fresh one stays, else the model's text (memo by hash), else the source text, which isn't remembered."""
    best = T.first_filled("text_final", "text_llm", "text_stt")
    mine = renditions.filter(F.col("lang") == lang).select(F.col("cue_id").alias("id"), F.col("text").alias("_old"), fresh_hash(F.col("hash_of")).alias("_made"), F.col("edited").alias("_edited"))
    rows = cues.select("id", best.alias("_source"), fresh_hash(best).alias("_now")).join(mine, "id", "left").join(model.select(F.col("source_hash").alias("_now"), F.col("text").alias("_new")), "_now", "left")
    route = F.when(F.col("_edited"), "edited").when(F.col("_made") == F.col("_now"), "fresh").when(F.col("_new").isNotNull(), "model").otherwise("source")
    return rows.withColumn("route", route).select("id", "route", F.when(F.col("route").isin("edited", "fresh"), F.col("_old")).when(F.col("route") == "model", F.col("_new")).otherwise(F.col("_source")).alias("text"))


def correction_routes(cues: DataFrame, pairs: DataFrame, forms: DataFrame, memo: DataFrame, salt: str, chunk: int = 50, passed: DataFrame | None = None) -> DataFrame:
    """job_id, id, route, chunk, base, source_hash, text, uncertain: how each cue (job_id, idx, id, text_stt, text_caption, flagged) gets its corrected text.

    The base is the recognised text after the pre-pass by learned pairs (wrong, right, count); it is what the hash, with the
    caption, is made of. A cue without a base, or one that isn't flagged and holds no form of the domain, needs no model
    (skipped): its base stays, or the caption's text where there is none. One whose hash is in memo (source_hash, text,
    changed, uncertain) takes what was found before (cached), all others are sent, `chunk` of a job at a time in order; chunk
    numbers begin at 0, and text is null until the model has answered. passed: the pre-pass (id, base), where it has been made.
    """
    if passed is None:
        passed = learning.pre_passed(cues, pairs).select("id", F.col("text").alias("base"))
    rows = storage.written(cues.join(passed, "id").select("job_id", "idx", "id", "base", F.coalesce("text_caption", F.lit("")).alias("_caption"), "flagged"), "lines")
    holds = quality.mentions(rows, F.concat_ws(" ", "base", "_caption"), forms).select("id", F.lit(True).alias("_holds")).distinct()
    known = memo.select(F.col("source_hash"), F.struct("text", "changed", "uncertain").alias("_known")).dropDuplicates(["source_hash"])
    filled = T.stripped(F.col("base")) != ""
    needed = filled & (F.col("flagged") | F.col("_holds").isNotNull())
    hashed = rows.join(holds, "id", "left").withColumn("source_hash", T.content_hash(20, F.lit(salt), F.col("base"), F.col("_caption"))).join(known, "source_hash", "left")
    routed_ = hashed.withColumn("route", F.when(~needed, "skipped").when(F.col("_known").isNotNull(), "cached").otherwise("sent"))
    place = F.row_number().over(Window.partitionBy("job_id", "route").orderBy("idx", "id")) - 1
    text = F.when(F.col("route") == "skipped", F.when(filled, F.col("base")).otherwise(F.col("_caption"))).when(F.col("route") == "cached", F.when(F.col("_known.changed"), F.col("_known.text")).otherwise(F.col("base")))
    uncertain = F.when(F.col("route") == "skipped", False).when(F.col("route") == "cached", F.col("_known.uncertain"))
    return routed_.select("job_id", "id", "route", F.when(F.col("route") == "sent", F.floor(place / chunk)).alias("chunk"), "base", "source_hash", text.alias("text"), uncertain.alias("uncertain"))


def corrected(routes: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, text, uncertain of all cues once the model has answered (id, text, uncertain; only what it changes), and the rows that the memo gets: one for each hash, from the first cue that has it."""
    told = answers.select("id", F.col("text").alias("_new"), F.col("uncertain").alias("_unsure"))
    sent = routes.filter("route = 'sent'").join(told, "id", "left")
    given = sent.select("id", "base", "source_hash", F.coalesce("_new", "base").alias("text"), F.coalesce("_unsure", F.lit(False)).alias("uncertain"))
    memo = given.groupBy("source_hash").agg(F.min(F.struct("id", "text", (F.col("text") != F.col("base")).alias("changed"), "uncertain")).alias("_m")).select("source_hash", "_m.text", "_m.changed", "_m.uncertain")
    return routes.filter("route <> 'sent'").select("id", "text", "uncertain").unionByName(given.select("id", "text", "uncertain")), memo


def retranslated(cues: DataFrame, renditions: DataFrame, chosen: DataFrame, model: DataFrame, lang: str) -> DataFrame:
    """Renditions (cue_id, job_id, lang, text, hash_of, reviewed, edited) after one cue of a job was asked for anew (chosen: id).

    The cue takes its neighbours along that need work without a break, six to a side at most: those with a source text and a
    rendition that is missing, blank, or stale and not a person's own. New texts come from the model (source_hash, text) by the
    hash of the source as it is now. They replace what was there, as not reviewed and not edited, made from that source. Where
    the model has no text for the cue that was asked for, nothing of its job changes; nor does it for neighbours without one.
    """
    best = T.stripped(T.first_filled("text_final", "text_llm", "text_stt"))
    mine = renditions.filter(F.col("lang") == lang).select(F.col("cue_id").alias("id"), T.stripped(F.coalesce("text", F.lit(""))).alias("_old"), "hash_of", "edited")
    rows = cues.select("job_id", "idx", "id", best.alias("_best")).join(mine, "id", "left")
    stale = ~F.col("edited") & (fresh_hash(F.col("hash_of")) != fresh_hash(F.col("_best")))
    needs = (F.col("_best") != "") & F.coalesce(F.col("_old") == "", F.lit(True)) | (F.col("_best") != "") & F.coalesce(stale, F.lit(False))
    taken = ordered.cluster_around(rows, chosen, needs).filter("_best <> ''")
    texts = model.select("source_hash", T.stripped(F.col("text")).alias("_new")).filter("_new <> ''").dropDuplicates(["source_hash"])
    answered = taken.withColumn("source_hash", fresh_hash(F.col("_best"))).join(texts, "source_hash")
    asked = answered.join(chosen.select("id").distinct(), "id", "left_semi").select("job_id").distinct()
    new = answered.join(asked, "job_id", "left_semi").select(F.col("id").alias("cue_id"), "job_id", F.lit(lang).alias("lang"), F.col("_new").alias("text"), F.col("_best").alias("hash_of"), F.lit(False).alias("reviewed"), F.lit(False).alias("edited"))
    return storage.upserted(renditions.select(new.columns), new, ["cue_id", "lang"])


def practice_flags(media: DataFrame, changes: DataFrame, courses: tuple[str, ...]) -> DataFrame:
    """job_id, practice, course after changes (seq, job_id, course, on), in order of seq.

    A change with a course binds the job to it, or with an empty one to none; one without a course (null) switches practice.
    Binding makes a job one for practice, unbinding leaves that as it is, switching it off unbinds. A course belongs to one
    job: whoever binds it last takes it from the holder. Clones, unknown courses and jobs that don't exist change nothing.
    media: job_id, practice, is_clone, course. All by counts of the last change: a job's last one that touches its course, and
    a course's last binding, whatever the number of changes.
    """
    valid = changes.filter(F.col("course").isNull() | F.col("course").isin("", *courses)).join(media.filter("NOT is_clone").select("job_id"), "job_id", "left_semi")
    start = media.select(F.lit(-1).cast("long").alias("seq"), "job_id", "course", F.col("practice").alias("on"))
    named = F.coalesce(F.col("course"), F.lit("")) != ""
    off = F.col("course").isNull() & ~F.col("on")
    every = valid.select(F.col("seq").cast("long").alias("seq"), "job_id", "course", "on").unionByName(start)
    first = F.col("seq") < 0
    sets_course = first | F.col("course").isNotNull() | off
    sets_practice = first | named | F.col("course").isNull()
    of_job = every.groupBy("job_id").agg(
        F.max_by(F.struct(F.when(off, "").otherwise(F.col("course")).alias("course"), "seq"), F.when(sets_course, F.col("seq"))).alias("_c"),
        F.max_by(F.when(first | F.col("course").isNull(), F.col("on")).otherwise(True), F.when(sets_practice, F.col("seq"))).alias("practice"),
    )
    held = every.filter(named).groupBy("course").agg(F.max("seq").alias("_last"))
    rows = of_job.select("job_id", "practice", F.coalesce("_c.course", F.lit("")).alias("course"), F.col("_c.seq").alias("_seq")).join(held, "course", "left")
    return rows.select("job_id", "practice", F.when(F.col("_seq") >= F.coalesce("_last", F.lit(-1)), F.col("course")).otherwise("").alias("course"))


def course_map(flags: DataFrame, media: DataFrame) -> DataFrame:
    """course, job_id, title: the job of each course; of several, the last by id."""
    rows = flags.filter("course <> ''").join(media.filter("NOT is_clone").select("job_id", "title"), "job_id")
    return rows.groupBy("course").agg(F.max(F.struct("job_id", "title")).alias("_m")).select("course", "_m.*")


#: What ties the tables of a job together.
JOB_KEYS = [relations.Key("cue", "job_id", "job"), relations.Key("rendition", "cue_id", "cue")]


def without_stale_clones(tables: dict[str, DataFrame], now, days: int = 7, keys: list[relations.Key] = JOB_KEYS) -> dict[str, DataFrame]:
    """The tables without clones for practice that nobody has touched for `days`, and without all that belongs to them. Real jobs never go: a row must be a clone and for practice."""
    stale = tables["job"].filter("clone_of IS NOT NULL AND practice").filter(F.col("updated") < F.lit(now) - days)
    return relations.cascade(tables, keys, {"job": stale.select("id")})


def cached_stage(lines: DataFrame, memo: DataFrame, kind: str, salt: str, limit: int) -> DataFrame:
    """Routing of lines (id, text) to a model stage through its memo (kind, source_hash, text): skipped if blank, cached if known, sent up to the limit, and left for later beyond."""
    rows = lines.withColumn("_hash", T.content_hash(20, F.lit(salt), F.col("text")))
    known = memo.filter(F.col("kind") == kind).select(F.col("source_hash").alias("_hash"), F.col("text").alias("_known")).dropDuplicates(["_hash"])
    routed_ = rows.join(known, "_hash", "left").withColumn("route", F.when(T.stripped(F.col("text")) == "", "blank").when(F.col("_known").isNotNull(), "cached").otherwise("todo"))
    todo = routed_.filter("route = 'todo'").orderBy("id").limit(limit).select("id", F.lit(True).alias("_sent"))
    return routed_.join(todo, "id", "left").select("id", F.when(F.col("_sent"), "sent").when(F.col("route") == "todo", "later").otherwise(F.col("route")).alias("route"), F.coalesce("_known", "text").alias("text"))


def practice_clones(tables: dict[str, DataFrame], job_id: int, session: str, now, keys: list[relations.Key] = JOB_KEYS) -> dict[str, DataFrame]:
    """A deep copy, by table, of a practice job for one session: its rows and all that belongs to them, under new ids, named by a hash of the session.

    A job that is no practice job, or is a clone itself, gives nothing; nor does one with a clone for this session already.
    """
    name = F.concat(F.split("title", "~")[0], F.lit("~"), F.substring(F.sha2(F.lit(session), 256), 1, 10))
    mine = tables["job"].filter((F.col("clone_of") == job_id) & (F.col("title") == name)).isEmpty()
    chosen = (F.col("id") == job_id) & F.col("practice") & F.col("clone_of").isNull() & F.lit(mine)
    return relations.deep_copied(tables, keys, "job", chosen, {"title": name, "clone_of": F.lit(job_id).cast("long"), "updated": F.lit(now).cast("long"), "practice": F.lit(True)})


def with_defects(cues: DataFrame, word: str, wrong: str, n: int) -> DataFrame:
    """The first n cues of each job whose text holds a word, with the word replaced: defects to practise on."""
    w = Window.partitionBy("job_id", "_has").orderBy("idx")
    has = F.contains("text_stt", F.lit(word))
    return cues.withColumn("_has", has).withColumn("_n", F.row_number().over(w)).select("id", F.when(F.col("_has") & (F.col("_n") <= n), F.replace("text_stt", F.lit(word), F.lit(wrong))).otherwise(F.col("text_stt")).alias("text_stt"))


def patched(rows: DataFrame, removed: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows after a patch: removed ids gone, changed rows in place of the old ones or added."""
    return rows.join(removed, "id", "left_anti").join(changed.select("id"), "id", "left_anti").unionByName(changed)


def edited_rendition(renditions: DataFrame, edits: DataFrame) -> DataFrame:
    """Renditions after edits (cue_id, lang, new_text): an edited text is marked, a blank one removes its row."""
    rows = renditions.join(edits, ["cue_id", "lang"], "left")
    changed = F.col("new_text").isNotNull()
    return rows.filter(~changed | (T.stripped(F.col("new_text")) != "")).select("cue_id", "lang", F.coalesce("new_text", "text").alias("text"), (F.col("edited") | changed).alias("edited"))
