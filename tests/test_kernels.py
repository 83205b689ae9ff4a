"""Kernels with bounds and bands, and operators made of them, against the plain versions that try everything."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cuelake.functions import alignment
from cuelake.operators import learning, quality


def texts(r, letters, most):
    return "".join(r.choice(letters) for _ in range(r.randint(0, most)))


def test_best_window_equals_all_windows():
    r = random.Random(1)
    for _ in range(3000):
        a, b = texts(r, "abc", 12), texts(r, "abcd", 25)
        short, long = sorted((a, b), key=len)
        want = 100.0 if short and short in long else max((alignment.indel_ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long))), default=0.0) if short else 0.0
        assert alignment.best_window(a, b) == pytest.approx(want, abs=1e-9)


def test_best_window_of_long_texts():
    r = random.Random(2)
    words = [texts(r, "abcdefgh", 7) for _ in range(300)]
    long = " ".join(r.choice(words) for _ in range(3000))
    part = long[4000:4400]
    assert alignment.best_window(part[:200] + "#" + part[201:], long) == pytest.approx(100 * 399 / 400, abs=0.3)


def table_diff(s, t):
    n, m = len(s), len(t)
    common = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            common[i][j] = 1 + common[i + 1][j + 1] if s[i] == t[j] else max(common[i + 1][j], common[i][j + 1])
    i, j, gone, new = 0, 0, [], []
    while i < n or j < m:
        if i < n and j < m and s[i] == t[j]:
            i, j = i + 1, j + 1
        elif i < n and (j == m or common[i + 1][j] >= common[i][j + 1]):
            gone.append(s[i])
            i += 1
        else:
            new.append(t[j])
            j += 1
    return gone, new


def test_token_diff_equals_the_table(monkeypatch):
    monkeypatch.setattr(alignment, "ROWS", 3)
    r = random.Random(3)
    for _ in range(2000):
        s, t = list(texts(r, "abcde", 14)), list(texts(r, "abcdf", 14))
        assert alignment.token_diff(s, t) == table_diff(s, t)


def test_token_diff_of_long_texts():
    r = random.Random(4)
    s = [str(r.randrange(400)) for _ in range(20_000)]
    t = [x for x in s if r.random() > 0.02]
    gone, new = alignment.token_diff(s, t)
    assert len(gone) - len(new) == len(s) - len(t) and not new


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edits(spark):
    r = random.Random(5)
    for _ in range(3000):
        a, b = texts(r, "ab", 14), texts(r, "abc", 14)
        assert alignment.edit_distance(a, b) == distance(a, b)
    rows = [(i, texts(r, "ab", 80), texts(r, "abc", 80)) for i in range(60)] + [(100, "a" * 400, "b" * 300), (101, "", "abc"), (102, "x", "x")]
    got = {x.i: x.d for x in spark.createDataFrame(rows, "i int, a string, b string").select("i", alignment.edits("a", "b").alias("d")).collect()}
    assert got == {i: distance(a, b) for i, a, b in rows}
    assert spark.createDataFrame([(None, "a")], "a string, b string").select(alignment.edits("a", "b").alias("d")).first().d is None


def test_edits_of_long_texts():
    r = random.Random(9)
    a = "".join(r.choice("abcdefgh ") for _ in range(60_000))
    b = "".join(c for c in a if r.random() > 0.01)
    assert alignment.edit_distance(a, b) == len(a) - len(b)


@pytest.mark.parametrize("characters", [1 << 20, 20])
def test_mentions_equal_containment(spark, characters):
    r = random.Random(6)
    rows = [(i, texts(r, "ab가 ", 30)) for i in range(80)] + [(80, None), (81, ""), (3, "again ab")]
    forms = sorted({texts(r, "ab가 ", 6) for _ in range(60)}) + ["", "a" * 60]
    cues = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = quality.mentions(cues, F.col("text"), spark.createDataFrame([(f,) for f in [*forms, forms[3], None]], "form string"), characters=characters)
    assert sorted(map(tuple, got.collect())) == sorted({(i, f) for i, t in rows for f in forms if f and t and f in t})
    assert quality.mentions(cues, F.col("text"), spark.createDataFrame([], "form string")).count() == 0


def applied(text, pairs):
    for wrong, right in pairs:
        text = re.sub(rf"(?<![\w가-힣]){re.escape(wrong)}(?![\w가-힣])", lambda m: right, text)  # noqa: B023
    return text


@pytest.mark.parametrize("seed", range(3))
def test_replacements_equal_all_pairs_in_order(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    some = lambda n: " ".join(r.choice(words) for _ in range(r.randint(1, n)))
    pairs = sorted({(some(2), some(3), r.randint(1, 9)) for _ in range(80)})
    pairs = list({(w, t): (w, t, n) for w, t, n in pairs if w != t}.values())
    cues = [(i, 1, i, some(8)) for i in range(60)] + [(60, 1, 60, ""), (61, 1, 61, None)]
    got = learning.pre_passed(spark.createDataFrame(cues, "id long, job_id long, idx long, text_stt string"), spark.createDataFrame(pairs, "wrong string, right string, count long"))
    strong = [(w, t) for w, t, n in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])) if n >= 2]
    assert {x.id: x.text for x in got.collect()} == {i: t and applied(t, strong) for i, _, _, t in cues}


def test_replacements_of_a_large_vocabulary(spark):
    """100,000 pairs in chains of five; rounds follow the chains of the words that the cues have."""
    pairs = spark.range(100_000).selectExpr("concat('w', id) AS wrong", "concat('w', id + if(id % 5 = 4, 200000, 1)) AS right", "200000 - id AS count")
    cues = spark.range(2_000).selectExpr("id", "id AS job_id", "id AS idx", "concat('w', id * 50, ' and w', id * 50 + 3) AS text_stt")
    got = {x.id: x.text for x in learning.pre_passed(cues, pairs).collect()}
    assert got == {i: f"w{i * 50 + 4 + 200000} and w{i * 50 + 4 + 200000}" for i in range(2_000)}


def test_closest_text_equals_all_alignments():
    from difflib import SequenceMatcher

    r = random.Random(10)
    share = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio()
    for _ in range(1500):
        heard, text = texts(r, "abc", 12), texts(r, "abc", 12)
        candidates = [texts(r, "abc", 12) for _ in range(r.randint(0, 8))]
        want = max(((share(heard, c), c) for c in candidates), default=(0, None))
        assert alignment.closest_text(heard, text, candidates) == (want[1] if want[0] > share(heard, text) else None)
