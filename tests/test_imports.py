"""Hand-made cases of imports, their undo, registration and annotations confirmed by hand."""

from pyspark.sql import functions as F

from cuelake.operators import imports, learning, ordered

CUE = "job_id long, id long, idx int, start_ms long, end_ms long, text_stt string, text_llm string, text_final string, reviewed boolean"


def test_promoted(spark):
    cues = spark.createDataFrame(
        [
            (1, 1, "무상과 무상", "", [("무상", True), ("해탈", True)]),
            (1, 2, "", "무상(無常)과 무상함", [("무상", True)]),
            (1, 3, None, "해탈.*$1을 무상", None),
            (2, 4, "무상", "", []),
        ],
        "job_id long, id long, text_final string, text_llm string, hints array<struct<reading: string, discovered: boolean>>",
    )
    items = spark.createDataFrame(
        [(1, 1, 1, "무상", "無常"), (1, 1, 2, " 무상", "無常"), (1, 2, 1, "무상", "無常"), (1, 3, 1, "해탈.*$1", "a$1\\"), (1, 3, 2, "", "x"), (1, 4, 1, "무상", "無常"), (9, 9, 1, None, None)],
        "job_id long, id long, no int, reading string, hanja string",
    )
    got = {r.id: r for r in imports.promoted(cues, items).collect()}
    assert set(got) == {1, 3}
    assert (got[1].text_final, got[1].n_applied, [h.reading for h in got[1].hints]) == ("무상(無常)과 무상(無常)", 2, ["해탈"])
    assert (got[3].text_final, got[3].text_llm, got[3].hints) == (None, "해탈.*$1(a$1\\)을 무상", None)


def test_newly_registered(spark):
    cues = spark.createDataFrame([(1, 1)], "job_id long, id long")
    items = spark.createDataFrame([(1, 1, "a", None, "x"), (1, 1, " a ", "", "x"), (1, 1, "b", "g", "y"), (2, 1, "c", "", "z"), (1, 1, "", "", "z")], "job_id long, id long, reading string, gloss string, hanja string")
    lexicon = spark.createDataFrame([("b", "g", "y"), ("a", "other", "x")], "reading string, gloss string, hanja string")
    assert [tuple(r) for r in imports.newly_registered(items, cues, lexicon).collect()] == [("a", "", "x")]


def test_preview(spark):
    old = spark.createDataFrame([(1, 1, 0, 0, 900, "one", "", "", True), (1, 2, 1, 2000, 2900, "two", "", "", False), (2, 3, 0, 0, 1, None, None, None, False)], CUE)
    new = spark.createDataFrame([(1, 7, 1000, 1500, "one!"), (1, 8, 90_000, 91_000, "two")], "job_id long, id long, start_ms long, end_ms long, text string")
    got = {r.job_id: r for r in imports.preview(new, old).collect()}
    assert (got[1].n_new, got[1].n_old, got[1].n_reviewed, got[1].n_carried) == (2, 2, 1, 1)
    assert [(s.idx, s.old, s.new) for s in got[1].samples] == [(0, "one", "one!"), (1, "two", "two")]
    assert (got[2].n_new, got[2].n_carried, got[2].samples) == (0, 0, None)


def test_undone_import_without_its_cues(spark):
    old = spark.createDataFrame([(1, 5, 1, 10, 20, "b", "", "B", False), (1, 4, 0, 0, 9, "a", "", "A", True)], CUE)
    renditions = spark.createDataFrame([(4, "fr", "un"), (99, "fr", "lost")], "cue_id long, lang string, text string")
    now = spark.createDataFrame([(1, 50, 0, 0, 20, "ab", "", "AB", True), (2, 60, 0, 0, 20, "c", "", "C", True)], CUE)
    now_renditions = spark.createDataFrame([(50, "fr", "deux"), (60, "fr", "trois")], "cue_id long, lang string, text string")
    backups = spark.createDataFrame([(1, 2, 70)], "job_id long, version int, next_id long")
    cues, tied = imports.import_undone(now, now_renditions, backups, old, renditions)
    assert sorted((r.id, r.text_final, r.reviewed) for r in cues.collect()) == [(60, "C", True), (70, "A", True), (71, "B", False)]
    assert sorted(map(tuple, tied.collect())) == [(60, "fr", "trois"), (70, "fr", "un")]


def test_registered(spark):
    files = spark.createDataFrame([("a", 0, 5, 9, " 가  나\n다 "), ("a", 1, 0, 4, "라"), ("a", 2, 5, 8, "　"), ("b", 0, 0, 1, "abc 가"), ("c", 0, 0, 1, None), ("d", 0, 0, 1, "123")], "video string, no int, start_ms long, end_ms long, text string")
    jobs, cues = imports.registered(files, spark.createDataFrame([("d",), ("d",)], "video string"))
    assert {r.video: (r.refused, r.n_cues, r.duration_ms) for r in jobs.collect()} == {"a": (None, 2, 9), "b": ("script", 1, 1), "c": ("empty", 0, None), "d": ("known", 1, 1)}
    assert sorted((r.video, r.idx, r.text_final) for r in cues.collect()) == [("a", 0, "라"), ("a", 1, "가 나 다")]


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], CUE)
    new = nothing.select("job_id", "id", "start_ms", "end_ms", F.lit("x").alias("text"))
    assert imports.preview(new, nothing).count() == imports.time_defects(nothing, 2).count() == imports.span_merged(nothing, 0, 9, "x").count() == 0


def test_stragglers(spark):
    cues = spark.createDataFrame([(1, 1, 0, 0, 1000, "", "", "one two", True), (1, 2, 1, 1000, 2000, "", "", "three", True), (1, 3, 2, 9000, 9500, "", "", "x", True)], CUE)
    spoken = [("zero", 950, 1100, 2), ("one", 100, 200, 1), ("two", 300, 400, 1), ("b", 500, 600, 1), ("three", 1000, 1200, 2), ("four", 1200, 1400, 2), ("far", 9000, 9100, 3)]
    words = spark.createDataFrame([(1, 0, n, a, b, w, c) for n, (w, a, b, c) in enumerate(spoken)], "job_id long, sentence int, no int, start_ms long, end_ms long, word string, cue_id long")
    got = {r.word: r.cue_id for r in ordered.stragglers_moved(words, cues).collect()}
    # As many words in both cues: the one met first (2) counts, to which the first half's words move.
    assert got == {"zero": 2, "one": 2, "two": 2, "b": 2, "three": 2, "four": 2, "far": 3}
    got = {r.word: r.cue_id for r in ordered.stragglers_moved(words.filter("no > 0"), cues).collect()}
    assert got == {"one": 1, "two": 1, "b": 1, "three": 2, "four": 1, "far": 3}


def test_absorbed_is_phases_one_by_one(spark):
    cues = spark.createDataFrame(
        [(1, 1, 0, 0, 9, "그 책을 봅니다", "저 책을 봅니다 teh", "", False), (1, 2, 1, 9, 19, "teh", "teh", "the", True), (1, 3, 2, 19, 29, "nothing", "", "", False)], CUE
    )
    counted = spark.createDataFrame([("teh", "the", 2)], "wrong string, right string, count long")
    own = spark.createDataFrame([], "wrong string, right string, job_id long, first_idx int")
    unsafe = spark.createDataFrame([("그", "저")], "wrong string, right string")
    got = learning.absorbed(cues, counted, own, unsafe).collect()
    assert [tuple(r) for r in got] == [(1, "저 책을 봅니다 teh", "그 책을 봅니다 the", True)]
