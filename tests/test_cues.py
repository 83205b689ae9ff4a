"""Hand-made cases of the cue domain."""

import json

import pytest
from pyspark.sql import functions as F

from cuelake.functions import alignment, korean
from cuelake.functions import text as T
from cuelake.operators import editing, intervals, learning, ordered, quality, speech
from cuelake.plans import registry
from cuelake.sources import formats, storage


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("n, word", [(100, "백"), (12, "십이"), (2026, "이천이십육"), (0, "영")])
def test_numerals(spark, n, word):
    assert one(spark, T.sino(F.col("n")), n=n) == word
    assert one(spark, T.numbers_spelled(F.col("t")), t=f"a{n}도 b") == f"a{word}도 b"


def test_replies_and_speaker_marks(spark):
    rows = spark.createDataFrame([("네.",), ("예예!",), ("네 그렇습니다",)], "t string").select(T.is_reply(F.col("t")).alias("r")).collect()
    assert [r.r for r in rows] == [True, True, False]
    assert one(spark, T.without_speaker_marks(F.col("t")), t=">> 안녕 > x") == "안녕 x"


@pytest.mark.parametrize("url", ["watch?v=", "youtu.be/", "shorts/", "live/", "embed/"])
def test_video_ids(spark, url):
    assert one(spark, T.video_id(F.col("u")), u=f"https://a/{url}abcdefghijk?t=1") == "abcdefghijk"
    assert one(spark, T.video_id(F.col("u")), u="https://a/b") is None


def test_safe_pairs(spark):
    cases = [("그 여자", "에스드", False), ("그분에게는", "백궁", False), ("에스드", "백궁", True), ("약속을 해가", "약속해서", False), ("약속해서", "약속을 해가", True), ("", "x", False), ("a.", "a", False)]
    got = spark.createDataFrame([c[:2] for c in cases], "w string, r string").select(korean.is_safe_pair(F.col("w"), F.col("r")).alias("s")).collect()
    assert [g.s for g in got] == [c[2] for c in cases]


def test_annotations_and_filling(spark):
    found = one(spark, korean.annotations(F.col("t")), t="얼굴 안(顔) 자 해탈(解脫)")
    assert [tuple(f) for f in found] == [("얼굴", "안", "顔"), ("", "해탈", "解脫")]
    lexicon = spark.createDataFrame([("얼굴", "안", "顔", "common"), ("", "오온", "五蘊", "special"), ("", "백궁", "白宮", "special")], "gloss string, reading string, hanja string, tier string")
    texts = ["얼굴 안 자", "얼굴 안(顔) 자", "오온을", "백궁전", "오온(五蘊)을"]
    cues = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text_final string").withColumns({"text_llm": F.lit(""), "text_stt": F.lit("")})
    assert [r.text for r in speech.annotated(cues, lexicon).orderBy("id").collect()] == ["얼굴 안(顔) 자", "얼굴 안(顔) 자", "오온(五蘊)을", "백궁전", "오온(五蘊)을"]


def words(*rows):
    return [{"start_ms": s, "end_ms": e, "word": w} for s, e, w in rows]


def test_splitting_keeps_words_and_thin_starts_whole():
    assert speech.cut_places(words((65630, 66790, " 0"), (67530, 68230, ".75를"), (68300, 68600, " 누르고")), 20, 36) == [2]
    assert speech.cut_places(words((41100, 42140, " 제"), (42910, 43300, " 강아지"), (43300, 43600, " 이름은")), 20, 36) == [2]
    assert speech.cut_places(words((41100, 42140, " 안녕하세요"), (42910, 43300, " 강아지"), (43300, 43600, " 이름은")), 20, 36) == [0, 2]


def test_split_segments_covers_all_words(spark):
    w = words(*((i * 300, i * 300 + 250, f" word{i}{'.' if i % 5 == 4 else ''}") for i in range(40)))
    got = speech.split_segments(spark.createDataFrame([(1, 1, [tuple(x.values()) for x in w])], f"job_id long, seg_id long, words array<{speech.WORD}>")).orderBy("piece").collect()
    assert " ".join(g.text for g in got) == "".join(x["word"] for x in w).strip() and sum(g.n_words for g in got) == 40
    assert all(a.end_ms <= b.start_ms for a, b in zip(got, got[1:]))


def test_clamp(spark):
    rows = [(1, 0, 1, "그런데", "그런데 이렇게"), (1, 1, 2, "이렇게", "이렇게"), (2, 0, 3, "반복 말", "반복 말"), (2, 1, 4, "반복 말", "반복 말")]
    got = {r.id: r for r in speech.clamped(spark.createDataFrame(rows, "job_id long, idx long, id long, text_stt string, text_llm string")).collect()}
    assert got[1].clamped and got[1].text == "그런데" and not got[2].clamped and not got[3].clamped and not got[4].clamped


def test_gap_rows_drop_echoes(spark):
    cues = spark.createDataFrame([(1, 1, 0, 2000, "오늘 밥을 먹었습니다.", "")], "job_id long, id long, start_ms long, end_ms long, text_stt string, text_llm string")
    captions = spark.createDataFrame([(1, 1, 3000, 4000, "먹었습니다."), (1, 2, 5000, 6000, "새로운 이야기"), (1, 3, 500, 1500, "덮인 말")], "job_id long, cap_id long, start_ms long, end_ms long, text string")
    assert [r.text for r in speech.gap_rows(cues, captions).collect()] == ["새로운 이야기"]


def test_counts_follow_job_switches(spark):
    log = lambda jobs: spark.createDataFrame([("a", "b", j, i) for i, j in enumerate(jobs)], "wrong string, right string, job string, seq long")
    assert learning.pair_counts(log("ABA")).first()["count"] == 3
    assert learning.pair_counts(log("AA")).first()["count"] == 1


def test_lexicon_ambiguity(spark):
    rows = [("", "정각", "正刻", "A", 1), ("", "정각", "正覺", "B", 2), ("", "해탈", "解脫", "A", 1), ("", "해탈", "解脫", "B", 2)]
    got = {r.hanja: r.tier for r in learning.absorbed_annotations(spark.createDataFrame(rows, "gloss string, reading string, hanja string, job string, seq long")).collect()}
    assert got == {"正刻": "common", "正覺": "common", "解脫": "special"}


def test_replacement_is_whole_and_literal(spark):
    assert one(spark, korean.replaced_whole(F.col("t"), F.lit("a.b"), F.lit("$1")), t="a.b axb xa.b") == "$1 axb xa.b"


def test_propagation_scopes(spark):
    cues = spark.createDataFrame([(i, 1 if i < 4 else 2, i, "teh cat", "", False) for i in range(8)], "id long, job_id long, idx long, text_llm string, text_final string, reviewed boolean")
    none = spark.createDataFrame([], "wrong string, right string, count long")
    mine = spark.createDataFrame([("teh", "the", 1, 1)], "wrong string, right string, job_id long, first_idx long")
    assert [r.id for r in learning.propagated(cues, none, mine).filter("before <> text").orderBy("id").collect()] == [2, 3]
    everywhere = spark.createDataFrame([("teh", "the", 2), ("the cat", "a dog", 5)], "wrong string, right string, count long")
    # Longest first: 'the cat' isn't there yet when its turn comes.
    assert {r.text for r in learning.propagated(cues, everywhere, mine.limit(0)).collect()} == {"the cat"}


def test_budget(spark):
    cues = lambda n, size: spark.createDataFrame([(True, "x" * size)] * n, "reviewed boolean, text_final string")
    assert quality.line_budget(cues(39, 30)).count() == 0
    assert tuple(quality.line_budget(cues(40, 30)).first()) == (28, 30)
    assert tuple(quality.line_budget(cues(40, 99)).first()) == (46, 48)
    assert tuple(quality.line_budget(cues(40, 3)).first()) == (14, 24)


def test_carry_within_twenty_seconds(spark):
    row = lambda i, at: spark.createDataFrame([(1, i, at, "같은 말")], "job_id long, id long, start_ms long, text string")
    assert intervals.nearest_same_text(row(1, 20000), row(2, 0)).count() == 1
    assert intervals.nearest_same_text(row(1, 20100), row(2, 0)).count() == 0


def test_overlaps_equal_brute_force(spark):
    import random

    r = random.Random(1)
    make = lambda n: [(r.randint(0, 2), i, s := r.randint(0, 90_000), s + r.randint(0, 40_000)) for i in range(n)]
    a, b = make(60), make(60)
    df = lambda x: spark.createDataFrame(x, "job_id long, id long, start_ms long, end_ms long")
    got = sorted((p.l_id, p.r_id) for p in intervals.overlapping(df(a), df(b), 7000).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[2] < x[3] and y[3] > x[2])


def test_fork_and_unfork(spark):
    cues = spark.createDataFrame([(1, i, i, i * 1000, i * 1000 + 900, "t", "", "", True) for i in range(3)], "job_id long, id long, idx long, start_ms long, end_ms long, text_final string, text_llm string, text_stt string, reviewed boolean")
    renditions = spark.createDataFrame([(i, "ja", f"r{i}", "t" if i else "old", True, False) for i in range(3)], "cue_id long, lang string, text string, hash_of string, reviewed boolean, edited boolean")
    none = spark.createDataFrame([], "job_id long, lang string")
    forked = editing.forked_track(cues, renditions, "ja", none)
    assert [(r.text, r.reviewed) for r in forked.orderBy("id").collect()] == [("r0", False), ("r1", True), ("r2", True)]
    assert [(r.cue_id, r.text) for r in editing.unforked(cues, forked).orderBy("cue_id").collect()] == [(0, "r0"), (1, "r1"), (2, "r2")]
    assert editing.forked_track(cues, renditions, "ja", forked.select("job_id", "lang")).count() == 0


def test_joined_and_wrapped(spark):
    join = lambda a, b: one(spark, T.join_without_overlap(F.col("a"), F.col("b")), a=a, b=b)
    assert join("one two three", "two three four") == "one two three four"
    assert join("abcde", "cdefg") == "abcdefg"
    assert join("one", "two") == "one two" and join("", "two") == "two" and join("one", "") == "one"
    assert one(spark, T.wrapped(F.col("t"), 10), t="aaaa bbbb cccc dddd") == "aaaa bbbb\ncccc dddd"


def test_alignment_kernels():
    assert alignment.common_length("abcbdab", "bdcaba") == 4
    assert alignment.indel_ratio("abc", "abc") == 100 and alignment.indel_ratio("", "a") == 0
    assert alignment.best_window("bcd", "xabcdx") == 100 and alignment.best_window("zzz", "abc") == 0


def test_tighten(spark):
    words = spark.createDataFrame([(1, 1000, 1300, "안녕"), (1, 1400, 1800, "하세요")], "job_id long, start_ms long, end_ms long, word string")

    def fitted(text, start, end):
        cue = spark.createDataFrame([(1, 1, start, end, text, "", "")], "job_id long, id long, start_ms long, end_ms long, text_final string, text_llm string, text_stt string")
        return tuple(speech.tightened(cue, words).select("start_ms", "end_ms", "reason").first())

    assert fitted("안녕 하세요", 0, 4000) == (1000, 1800, "trimmed")
    assert fitted("안녕 하세요", 900, 1900)[2] == "already-tight"
    assert fitted("전혀 다른", 0, 4000)[2] == "weak-align" and fitted("x", 0, 1)[2] == "no-speech"


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("1\n00:00:01,500 --> 00:00:02,000\n<b>\nx  y\n\n2\n00:00:03,000 --> 00:00:04,000\n\n", encoding="utf-8")
    (tmp_path / "in" / "b.srt").write_bytes("1\n00:00:00,000 --> 00:00:01,000\n안녕\n".encode("cp949"))
    got = sorted((r.start_ms, r.end_ms, r.text) for r in formats.parse_srt(formats.read_files(spark, str(tmp_path), "*.srt")).collect())
    assert got == [(0, 1000, "안녕"), (1500, 2000, "<b> x y")]
    script = lambda t: formats.parse_script(spark.createDataFrame([("p", t)], "path string, content string"))
    assert script("| 1 | a | 보통 | 1 |\n| 2 | | 침묵 | 2 |").count() == 2
    for bad in ("| 2 | a | 보통 | 1 |", "| 1 | a | 큰 | 1 |", "| 1 | | 보통 | 1 |", "| 1 | a | 보통 | 31 |"):
        with pytest.raises(Exception, match="number|style|text|pause"):
            script(bad).collect()
    content = json.dumps({"events": [{"tStartMs": 1}, {"tStartMs": 5, "dDurationMs": 10, "segs": [{"utf8": ">> "}, {"utf8": "hi"}]}]})
    assert [tuple(r) for r in formats.parse_captions(spark.createDataFrame([("p", content)], "path string, content string")).collect()] == [("p", 5, 15, "hi")]
    cues = spark.createDataFrame([(1, 1, 0, 950, "a"), (1, 2, 1000, 2000, "b")], "job_id long, id long, start_ms long, end_ms long, t string")
    blocks = formats.to_srt(cues, "t", "en")
    formats.write_srt(blocks, str(tmp_path / "out"))
    assert "00:00:00,000 --> 00:00:01,000" in blocks.orderBy("no").first().block
    assert spark.read.text(str(tmp_path / "out")).count() == 8


def test_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("en", 1, "a"), ("en", 2, "b"), ("ja", 1, "c")], "lang string, job_id long, text string")
    storage.write_tracks(rows, str(tmp_path / "t"))
    storage.write_tracks(rows.filter("lang = 'en' AND job_id = 1").withColumn("text", F.lit("new")), str(tmp_path / "t"))
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["b", "c", "new"]


def test_empty_tables(spark):
    cues = spark.createDataFrame([], "job_id long, id long, idx long, start_ms long, end_ms long, text_stt string, text_caption string, text_llm string, text_final string, flagged boolean, uncertain boolean, reviewed boolean, hold boolean")
    captions = spark.createDataFrame([], "job_id long, cap_id long, start_ms long, end_ms long, text string")
    for df in (quality.qc_report(cues), ordered.derolled(captions), intervals.overlap_text(cues, captions), speech.gap_rows(cues, captions), learning.extracted_pairs(cues), quality.line_budget(cues)):
        assert df.count() == 0


def test_every_prompt_is_tried(spark):
    prompts = spark.createDataFrame([(f"list {i:03d} of spoken words",) for i in range(150)], "prompt string")
    cues = spark.createDataFrame([(i, f"List {i:03d} of spoken") for i in range(150)], "id long, text_stt string")
    assert sorted(r.id for r in speech.prompt_echoes(cues, prompts, percent=101).collect()) == list(range(150))


def test_a_job_that_does_not_fit_gives_no_sentence(spark):
    sentences = spark.createDataFrame([(1, 0, "one two three"), (2, 0, "four five six")], "job_id long, no long, text string")
    words = spark.createDataFrame([(1, i * 100, i * 100 + 90, w) for i, w in enumerate(["one", "two", "three"])] + [(2, 0, 90, "zzz")], "job_id long, start_ms long, end_ms long, word string")
    assert [tuple(r) for r in speech.aligned_sentences(sentences, words).collect()] == [(1, 0, "one two three", 0, 290)]


def test_kernel_queries_take_whole_texts(spark, tmp_path):
    text = "the start of a long turn and then many more words that stand after it, the end"
    spark.createDataFrame([(7, t, "user", f"{text} {t}") for t in range(6)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert all("that" in r.inserted for r in run("x23_token_diff") if (7 + r.id % 1000) % 3)
    assert all(len(r.text) > 70 for r in run("x10_gap_rows"))
    assert [r.text.split()[-1] for r in sorted(run("x19_x20_aligned_sentences"))] == list("012345")
    assert all(r.end_ms > 6900 + 8000 * r.no for r in run("x19_x20_aligned_sentences"))
    assert all(len(r.text) > 70 for r in run("x12_w9_clamped") if r.id % 1000 % 3 == 0)


def test_propagation_falls_back_on_recognised_text_and_follows_chains(spark):
    cues = spark.createDataFrame([(1, 1, 1, "one x", "", "", False), (2, 1, 2, "one", "five", "", False)], "id long, job_id long, idx long, text_stt string, text_llm string, text_final string, reviewed boolean")
    steps = [("one", "two", 9), ("two x", "three x", 8), ("three x", "four y", 7), ("four y", "six", 6)]
    pairs = spark.createDataFrame([(a, b, n) for a, b, n in steps], "wrong string, right string, count long")
    assert {r.id: r.text for r in learning.pre_passed(cues, pairs).collect()} == {1: "six", 2: "two"}
    none = spark.createDataFrame([], "wrong string, right string, job_id long, first_idx long")
    assert {r.id: r.before for r in learning.propagated(cues, pairs, none).collect()} == {1: "one x", 2: "five"}


def test_mentions_of_long_forms(spark):
    long = "a phrase of the domain that has more than forty characters"
    cues = spark.createDataFrame([(1, f"here is {long}, said once"), (2, f"here is {long[:45]}"), (3, "abc")], "id long, text string")
    forms = spark.createDataFrame([(long,), (long[:40],), (long[:41],), ("bc",)], "form string")
    got = sorted(tuple(r) for r in quality.mentions(cues, F.col("text"), forms).collect())
    assert got == sorted([(1, long), (1, long[:40]), (1, long[:41]), (2, long[:40]), (2, long[:41]), (3, "bc")])


def test_rebuilt_cells_are_idempotent(spark):
    cues = spark.createDataFrame([(1, 0, 0, 900, "one two", "one two", "", True), (2, 0, 0, 900, "kept", "kept", "kept", True)], "job_id long, idx long, start_ms long, end_ms long, text_stt string, text_llm string, text_final string, reviewed boolean")
    aligned = spark.createDataFrame([(1, 0, "One.", 10, 400), (1, 1, "Two.", 400, 800)], "job_id long, no long, text string, start_ms long, end_ms long")
    once = speech.rebuilt_cells(cues, aligned)
    rows = sorted(tuple(r) for r in once.collect())
    assert rows == [(1, 0, 10, 400, "One.", "One.", "", False), (1, 1, 400, 800, "Two.", "Two.", "", False), (2, 0, 0, 900, "kept", "kept", "kept", True)]
    moved = once.withColumn("start_ms", F.col("start_ms") + 1)
    assert sorted(tuple(r) for r in speech.rebuilt_cells(moved, aligned).collect()) == sorted(tuple(r) for r in moved.collect())


def test_sentences_are_found_among_errors(spark):
    import random

    r = random.Random(4)
    script = [[f"w{r.randint(0, 400)}" for _ in range(r.randint(3, 9))] for _ in range(60)]
    heard, at, truth = [], 0, []
    for no, sentence in enumerate(script):
        first = at
        for w in sentence:
            if r.random() > 0.06:
                heard.append((1, at, at + 90, w if r.random() > 0.06 else "noise"))
            at += 100
        truth.append((first, at - 10))
    sentences = spark.createDataFrame([(1, n, " ".join(s)) for n, s in enumerate(script)], "job_id long, no long, text string")
    got = {x.no: x for x in speech.aligned_sentences(sentences, spark.createDataFrame(heard, "job_id long, start_ms long, end_ms long, word string")).collect()}
    near = sum(abs(got[n].start_ms - a) <= 200 and abs(got[n].end_ms - b) <= 200 for n, (a, b) in enumerate(truth) if n in got)
    assert near >= 54 and all(got[n].start_ms < got[n].end_ms for n in got)


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_error_rates_of_joined_texts(spark):
    rows = [(1, 0, 1, "ein Satz", "ein Saz", "", True), (1, 1, 2, "", "weg", "", True), (1, 2, 3, "ganz anders lang", "kurz", "ganz anders, lang", True), (1, 3, 4, "offen", "offen", "", False), (2, 0, 5, "übung", "bung", "", True), (3, 0, 6, "gleich!", "Gleich", "", True)]
    cues = spark.createDataFrame(rows, "job_id long, idx long, id long, text_final string, text_stt string, text_llm string, reviewed boolean")
    media = spark.createDataFrame([(1, "t" * 50, False, 7), (2, "t", True, 8), (3, "u", False, 9)], "job_id long, title string, practice boolean, created long")
    got = {r.job_id: r for r in quality.evaluated(cues, media, spark.createDataFrame([(3,)], "job_id long")).collect()}
    ref, stt, llm = "ein satz ganz anders lang", "ein saz kurz", "ein saz ganz anders lang"
    assert set(got) == {1, 3} and got[1].title == "t" * 40 and (got[1].n_reviewed, got[1].n_matched, got[1].source) == (2, 1, "app")
    assert got[1].cer_stt == round(brute_distance(ref, stt) / len(ref), 4) and got[1].cer_llm == round(brute_distance(ref, llm) / len(ref), 4)
    assert got[1].cer_matched == round(brute_distance("ein satz", "ein saz") / 8, 4) and (got[3].cer_stt, got[3].source) == (0.0, "srt")


def test_correction_routes_send_all(spark):
    cues = spark.createDataFrame([(1, i, i, f"text {i}", "", i > 0) for i in range(121)] + [(2, 0, 500, " ", "caption", True)], "job_id long, idx long, id long, text_stt string, text_caption string, flagged boolean")
    memo = cues.filter("id = 7").select(T.content_hash(20, F.lit("c"), F.col("text_stt"), F.lit("")).alias("source_hash"), F.lit("known").alias("text"), F.lit(True).alias("changed"), F.lit(False).alias("uncertain"))
    none = spark.createDataFrame([], "wrong string, right string, count long")
    got = {r.id: r for r in editing.correction_routes(cues, none, spark.createDataFrame([], "form string"), memo, "c").collect()}
    assert (got[0].route, got[7].route, got[7].text, got[500].route, got[500].text) == ("skipped", "cached", "known", "skipped", "caption")
    assert [sum(r.chunk == c for r in got.values()) for c in range(3)] == [50, 50, 19]


def test_long_readings_are_filled_in(spark):
    reading = "가나다라마바사아자차카타"
    lexicon = spark.createDataFrame([("", reading, "漢字", "special")], "gloss string, reading string, hanja string, tier string")
    cues = spark.createDataFrame([(1, f"앞 {reading}를 뒤", "", "")], "id long, text_final string, text_llm string, text_stt string")
    assert speech.annotated(cues, lexicon).first().text == f"앞 {reading}(漢字)를 뒤"


def test_cut_places_against_the_definition():
    """The first word at which a condition holds ends the line, found by trying each."""
    import random

    r = random.Random(3)
    for _ in range(300):
        at, w = 0, []
        for k in range(r.randint(1, 25)):
            at += r.choice([0, 50, 300, 650, 750])
            w.append((at, at + 200, (" " if k == 0 or r.random() > 0.15 else "") + "가" * r.randint(1, 8) + r.choice(["", "", "다", "."])))
            at += 200
        got = speech.cut_places(words(*w), 8, 15)
        assert got[-1] == len(w) - 1 and got == sorted(set(got))
        assert all(i + 1 == len(w) or w[i + 1][2].startswith(" ") for i in got)
        for a, b in zip([-1, *got[:-2]], got[:-1]):
            line = "".join(x[2] for x in w[a + 1 : b + 1]).strip()
            glued = [i for i in range(a + 1, b) if w[i + 1][2].startswith(" ")]
            assert not glued or len("".join(x[2] for x in w[a + 1 : glued[-1] + 1]).strip()) < 15
            assert len(line) >= 8 or w[b + 1][0] - w[b][1] >= 600 or w[b][1] - w[a + 1][0] >= speech.LONGEST or line.endswith((".", "다"))
