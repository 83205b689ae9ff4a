"""Cases of the third round's findings."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import duckdb
from pyspark.sql import functions as F

from cuelake.functions import alignment
from cuelake.functions import text as T
from cuelake.operators import learning, speech
from cuelake.plans import registry
from cuelake.sources import storage


def test_pairs_meet_only_the_texts_that_hold_them(spark, monkeypatch):
    written, most = storage.written, []

    def watched(df, name):
        out = written(df, name)
        if name == "cues":
            most.append(out.agg(F.max(F.size("_pairs"))).first()[0] or 0)
        return out

    monkeypatch.setattr(storage, "written", watched)
    cues = spark.createDataFrame([(j * 10 + i, j, i, f"the w{i} said x", False) for j in range(20) for i in range(5)], "id long, job_id long, idx long, text_stt string, reviewed boolean")
    pairs = spark.createDataFrame([(f"the v{i}", f"a v{i}", 9) for i in range(300)] + [("said x", "the v7", 30)], "wrong string, right string, count long")
    own = spark.createDataFrame([(j, f"w{i}", f"own{j}", 1) for j in range(20) for i in range(5)], "job_id long, wrong string, right string, first_idx long")
    got = {r.id: r.text for r in learning.propagated(cues, pairs, own).collect()}
    assert all(got[j * 10 + i].split()[1] == (f"own{j}" if i > 1 else f"w{i}") for j in range(20) for i in range(5))
    assert max(most) <= 3


def plain_pre_pass(text, pairs):
    import re

    for wrong, right, n in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if n >= 2:
            text = re.sub(rf"(?<!\w){re.escape(wrong)}(?!\w)", lambda _, put=right: put, text)
    return text


def test_pre_pass_equals_all_pairs_in_order(spark):
    r = random.Random(11)
    word = lambda: r.choice(["a", "b", "c", "d", "e"])
    phrase = lambda n: r.choice([" ", ", ", " "]).join(word() for _ in range(n))
    pairs = [(w, p, r.randint(1, 9)) for w, p in {phrase(r.randint(1, 5)): phrase(r.randint(1, 3)) for _ in range(60)}.items() if w != p] + [("e e", "-", 5)]
    texts = [" ".join(word() + r.choice(["", "", ","]) for _ in range(r.randint(1, 12))) for _ in range(150)]
    cues = spark.createDataFrame([(i, 1, i, t) for i, t in enumerate(texts)], "id long, job_id long, idx long, text_stt string")
    got = {x.id: x.text for x in learning.pre_passed(cues, spark.createDataFrame(pairs, "wrong string, right string, count long")).collect()}
    assert got == {i: plain_pre_pass(t, pairs) for i, t in enumerate(texts)}


def test_blocks_are_those_of_difflib():
    r = random.Random(3)
    for n in (*range(12), 40, 90, 300):
        for kinds in ("ab", "abcdefgh ", "가나다라마바사아자차카타"):
            a = "".join(r.choice(kinds) for _ in range(n))
            for b in ("".join(r.choice(kinds) for _ in range(r.randint(0, n + 5))), a.replace("ab", "a"), a[n // 3 :] + a[: n // 2]):
                want = [0] * len(a)
                for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
                    want[m.a : m.a + m.size] = range(m.b + 1, m.b + m.size + 1)
                got = [0] * len(a)
                for i, j, size in alignment.matching_blocks(a, b):
                    got[i : i + size] = range(j + 1, j + size + 1)
                assert got == want


def test_stretches_are_compared_only_if_alike_in_order(monkeypatch):
    r = random.Random(4)
    compared = []
    monkeypatch.setattr(alignment, "SequenceMatcher", lambda *args: compared.append(args) or SequenceMatcher(*args))
    text = lambda n: "".join(r.choice("etaoinshr") for _ in range(n))
    for _ in range(40):
        short, long = text(r.randint(2, 30)), text(60)
        at = r.randint(0, 20)
        long = long if r.random() < 0.5 else long[:at] + short[:-1] + "x" + long[at:]
        n = len(short)
        want = any(100 * SequenceMatcher(None, short, long[i : i + n]).ratio() >= 85 for i in range(len(long) - n + 1))
        assert alignment.holds_something_alike(short, long, 85) == want
    compared.clear()
    assert not alignment.holds_something_alike(text(300), text(400), 85) and not compared


def test_a_word_carries_the_next_one_only(spark, tmp_path):
    spark.createDataFrame([(1, "a b a b c", "en", "web", 9)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    lexicon = registry.queries()["l16_lexicon"](spark, str(tmp_path))
    plan = lexicon._jdf.queryExecution().optimizedPlan().toString()
    made = next(line for line in plan.split("\n") if "Generate posexplode" in line)
    assert made.count("w#") == made.split("posexplode(")[1].split("), [")[0].count("w#")  # the array itself isn't repeated
    assert sorted((x.reading, x.hanja, x["count"]) for x in lexicon.collect()) == [("a", "b", 1), ("b", "a", 1), ("b", "c", 1)]


def test_words_heard_as_one_belong_to_their_sentence(spark, tmp_path):
    r = random.Random(6)
    text = lambda: "".join(r.choice(["de", "la", f"w{r.randrange(300)}", f"x{r.randrange(300)}"]) + r.choice([*" " * 14, ".\n"]) for _ in range(r.randint(3, 25))) + r.choice(["a.\nb.\nc.", "end"])
    spark.createDataFrame([(j, t, "user", text()) for j in range(60) for t in range(5)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = registry.queries()["x19_x20_aligned_sentences"](spark, str(tmp_path)).toPandas()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = {(a, b): (x, y) for a, b, x, y in db.sql(f"SELECT job_id, no, start_ms, end_ms FROM ({registry.oracle_sql()['x19_x20_aligned_sentences']})").fetchall()}
    assert {(x.job_id, x.no): (x.start_ms, x.end_ms) for x in got.itertuples()} == want


def test_segments_are_cut_from_plain_arrays(spark):
    words = [(i * 300, i * 300 + 250, f" word{i}.") for i in range(30)]
    segments = spark.createDataFrame([(1, 1, words)], "job_id long, seg_id long, words array<struct<start_ms:bigint,end_ms:bigint,word:string>>")
    pieces = speech.split_segments(segments)
    assert "run(words#" not in pieces._jdf.queryExecution().optimizedPlan().toString()
    assert sum(x.n_words for x in pieces.collect()) == 30


def test_tokens_are_made_once_a_text(spark):
    joined = T.join_without_overlap(F.col("a"), F.col("b"))
    texts = [("a b c", "b c d", "a b c d"), ("", "x", "x"), ("ab", "bc", "ab bc"), ("xyab", "abz", "xyabz"), ("x x", "x x x", "x x x"), (" a ", "", "a")]
    rows = spark.createDataFrame(texts, "a string, b string, want string").select(joined.alias("got"), "want")
    assert all(r.got == r.want for r in rows.collect())
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
