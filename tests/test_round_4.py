"""Cases of the findings of round 4."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from cuelake.functions import alignment, phrases
from cuelake.operators import learning, speech
from cuelake.plans import registry
from cuelake.sources import formats, storage


def test_each_transcript_counts_its_documents(spark, tmp_path):
    texts = ["a\nb", "a\nb", None, None, "", "", " \n\t", " \n ", "x\r\n [2020.01.01] y\n[2020.01.02]", "x\n [2020.01.01] y", "[2020.01.01]", "[2020.01.01]"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, "again"), (3, "again"), (3, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in registry.queries()["s7_transcript_documents"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == Counter(db.sql(registry.oracle_sql()["s7_transcript_documents"]).fetchall())
    files = spark.createDataFrame([("a", "[2024.01.02] x\n  [2024.01.03] y\r\n[2024.01.04]z\nw"), ("b", None), ("c", "\n"), ("c", "[2024.01.02]")], "path string, content string")
    paragraphs, documents = formats.parse_transcript(files)
    assert Counter(map(tuple, documents.collect())) == Counter([("a", 3), ("b", 1), ("c", 1), ("c", 1)])
    assert [tuple(r) for r in paragraphs.collect()] == [("a", "w")]


def test_candidates_are_aligned_once_by_the_session_s_parts(spark, monkeypatch):
    cues = spark.createDataFrame([(i, False, "", f"the book {i} of heat", f"teh book {i} of heat") for i in range(9)], "id long, reviewed boolean, text_final string, text_stt string, text_llm string")
    fixed = learning.repaired(cues, spark.createDataFrame([("the", "teh")], "wrong string, right string"))
    assert sorted(r.text for r in fixed.collect()) == [f"the book {i} of heat" for i in range(9)]
    plan = fixed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ArrowEvalPython [") == 1 and "REPARTITION_BY_NUM" in plan
    monkeypatch.setattr(alignment, "SequenceMatcher", None)  # its tables of single characters take most of the time
    r = random.Random(7)
    heard = "".join(r.choices("etaoin shr", k=600))
    assert alignment.closest_text(heard, heard.replace("t", "th"), [heard.replace("t", "th", 3), heard[:300]]) == heard.replace("t", "th", 3)


def test_words_are_dealt_once_behind_their_anchors(spark):
    words = [f"w{i % 37}{i % 11}" for i in range(400)]
    script = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "job_id long, at int, w string")
    heard = spark.createDataFrame([(1, i, w) for i, w in enumerate(words[:100] + ["x", "y"] + words[101:])], "job_id long, at int, w string")
    placed = speech.word_places(script, heard)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    # Joins are those by few rows a part, in the search for anchors; all words go through one exchange.
    assert plan.count("RepartitionByExpression [job_id") == 1 and sum("Join" in x for x in plan.split("\n")) <= 1
    got = {x.at: (x.h, x.same) for x in placed.collect()}
    assert got[99] == (99, True) and got[101] == (102, True) and not got[100][1] and len(got) == 400


def test_aligned_sentences_are_made_once(spark, monkeypatch):
    written, names = storage.written, []
    monkeypatch.setattr(storage, "written", lambda df, name: names.append(name) or written(df, name))
    cues = spark.createDataFrame([(1, 0, 0, 9, "a", "a", "", False), (2, 0, 0, 9, "b", "b", "b", True)], "job_id long, idx long, start_ms long, end_ms long, text_stt string, text_llm string, text_final string, reviewed boolean")
    aligned = spark.createDataFrame([(1, 0, "a b", 5, 8)], "job_id long, no long, text string, start_ms long, end_ms long")
    assert sorted((x.job_id, x.idx, x.text_llm, x.start_ms) for x in speech.rebuilt_cells(cues, aligned).collect()) == [(1, 0, "a b", 5), (2, 0, "b", 0)]
    assert names == ["aligned"]


def test_replacements_tell_all_new_runs():
    r = random.Random(8)
    for _ in range(3000):
        word = lambda: r.choice(["a", "b", "c", "가", "é", "ab", "x" * 30])
        text = "".join(word() + r.choice([" ", " ", ", ", "-", ""]) for _ in range(r.randint(0, 60)))
        phrase = lambda n: r.choice([" ", ", "]).join(word() for _ in range(r.randint(1, n)))
        pairs = [(phrase(2), r.choice([phrase(3), "-", ""])) for _ in range(5)]
        want, now = set(), text
        for wrong, right in pairs:
            now = re.sub(rf"(?<!\w){re.escape(wrong)}(?!\w)", lambda _, put=right: put, now)
            want |= phrases.runs(phrases.words(now), 3)
        got, brought = phrases.replaced_in_turn(text, pairs, 3)
        assert got == now and brought == want - phrases.runs(phrases.words(text), 3)


def test_words_are_those_of_the_keys(spark):
    texts = ["a b_c, d-e 가나 é", "éx ²x ½ ⅷ", "ⓐ 🅰b ‍z‌", "𝐀b 1٣ ‿a", "", "..."]
    rows = spark.createDataFrame([(t, sorted(phrases.runs(phrases.words(t), learning.HEAD))) for t in texts], "t string, runs array<string>")
    same = F.array_sort(F.array_distinct(learning._keys(F.col("t")))) == F.array_sort(F.transform("runs", lambda x: F.xxhash64(x)))
    assert all(x.same for x in rows.select(same.alias("same")).collect())


def test_the_pre_pass_makes_keys_of_a_text_once(spark, monkeypatch):
    """The texts that a cue goes through on the way aren't cut into words again: a table holds only what the replacements brought."""
    written, tables = storage.written, []
    monkeypatch.setattr(storage, "written", lambda df, name: tables.append(written(df, name)) or tables[-1])
    cues = spark.createDataFrame([(i, 1, i, " ".join(f"w{i}x{k}" for k in range(80)) + " teh cat") for i in range(4)], "id long, job_id long, idx long, text_stt string")
    pairs = spark.createDataFrame([("teh", "the", 9), ("the cat", "a dog", 5)], "wrong string, right string, count long")
    assert all(x.text.endswith(" a dog") for x in learning.pre_passed(cues, pairs).collect())
    assert "_new" not in tables[1].columns
    assert {n for (n,) in tables[2].selectExpr("size(_new)").collect()} == {5}  # the, the cat, x79 the, x79 the cat, x78 x79 the
