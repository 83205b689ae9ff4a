"""Steps along long tracks, against the same steps taken one row after another."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from cuelake.functions import alignment
from cuelake.operators import chains, speech


@pytest.fixture(autouse=True)
def several_parts(spark):
    """Small tables are dealt to several parts too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_machine_of_two_states(spark):
    r = random.Random(1)
    rows = [(j, i, *r.choice([(False, False), (True, True), (False, True), (True, False), (False, True)])) for j, n in ((1, 700), (2, 1), (3, 40), (4, 300)) for i in range(n)]
    df = spark.createDataFrame(rows, "j int, i int, a boolean, b boolean").repartition(3)
    got = {(x.j, x.i): x._state for x in chains.with_state(chains.parted(df, ["j"], ["i"]), ["j"], ["i"], "a", "b").collect()}
    state, last = False, None
    for j, i, a, b in rows:
        state = state if j == last else False
        assert got[j, i] == state
        state, last = (b if state else a), j
    assert len(got) == len(rows)


def test_neighbours_and_running_values_over_parts(spark):
    r = random.Random(2)
    rows = [(j, i, r.randrange(1000)) for j, n in ((1, 900), (2, 1), (3, 60)) for i in range(n)]
    parts = chains.parted(spark.createDataFrame(rows, "j int, i int, v int").repartition(4), ["j"], ["i"])
    assert parts.select("_part").distinct().count() > 1
    after = {(x.j, x.i): x._next and x._next.v for x in chains.with_next(parts, ["j"], ["i"], ["v"]).collect()}
    most = {(x.j, x.i): x.m for x in chains.running_max(parts, ["j"], ["i"], "v", "m").collect()}
    least = {(x.j, x.i): x.m for x in chains.running_max(parts, ["j"], ["i"], "v", "m", descending=True).collect()}
    count = {(x.j, x.i): x.n for x in chains.running_count(parts, ["j"], ["i"], F.col("v") > 500, "n").collect()}
    of = {(j, i): v for j, i, v in rows}
    for j, n in ((1, 900), (2, 1), (3, 60)):
        values = [of[j, i] for i in range(n)]
        for i in range(n):
            assert after[j, i] == (values[i + 1] if i + 1 < n else None)
            assert most[j, i] == max(values[:i], default=None) and least[j, i] == min(values[i + 1 :], default=None)
            assert count[j, i] == sum(v > 500 for v in values[: i + 1])


def folded(job):
    """Pairs of a job one after another: which rows go back to what was recognised."""
    plain = lambda s: re.sub(r"\W", "", s)
    now, back = [llm for _, llm in job], [False] * len(job)
    for i in range(len(job) - 1):
        sides = [[plain(w) for w in t.split() if plain(w)] for t in now[i : i + 2]]
        small, large = ("".join(s) for s in (sides if len(sides[0]) <= len(sides[1]) else sides[::-1]))
        windows = [large[k : k + len(small)] for k in range(len(large) - len(small) + 1)]
        if len(small) < 2 or not any(w == small or SequenceMatcher(None, small, w).ratio() >= 0.85 for w in windows):
            continue
        heard = [plain(stt) for stt, _ in job[i : i + 2]]
        if all(heard) and (heard[0] in heard[1] or heard[1] in heard[0]):
            continue
        grown = [len("".join(s)) / len(h) if h else 0 for s, h in zip(sides, heard)]
        if max(grown) > 1.2:
            worst = i + (grown[1] > grown[0])
            now[worst], back[worst] = job[worst][0], True
    return list(zip(now, back))


@pytest.mark.parametrize("seed", range(3))
def test_clamp_equals_the_fold(spark, seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(["aa", "b", "cde", "ddd.", "fghij", "..."]) for _ in range(r.randint(0, n)))
    jobs = {}
    for j in range(30):
        job = []
        for _ in range(r.randint(1, 40)):
            stt = text(3)
            job.append((stt, r.choice([stt, text(4), f"{stt} {job[-1][1] if job else ''}".strip(), f"{job[-1][0] if job else ''} {stt}".strip()])))
        jobs[j] = job
    rows = [(j, i, j * 1000 + i, *t) for j, job in jobs.items() for i, t in enumerate(job)]
    got = {x.id: (x.text, x.clamped) for x in speech.clamped(spark.createDataFrame(rows, "job_id long, idx long, id long, text_stt string, text_llm string").repartition(3)).collect()}
    assert got == {j * 1000 + i: t for j, job in jobs.items() for i, t in enumerate(folded(job))}
    assert sum(b for _, b in got.values()) > 20


def test_clamp_of_nulls_and_nothing(spark):
    schema = "job_id long, idx long, id long, text_stt string, text_llm string, _part string, _next string"
    assert speech.clamped(spark.createDataFrame([], schema)).count() == 0
    got = speech.clamped(spark.createDataFrame([(1, 0, 1, None, None, "", ""), (1, 1, 2, "a", None, "", "")], schema)).collect()
    assert sorted((x.id, x.text, x.clamped) for x in got) == [(1, "", False), (2, "", False)]


def test_something_alike():
    r = random.Random(3)
    for _ in range(3000):
        short, long = ("".join(r.choice("abc") for _ in range(n)) for n in (r.randint(2, 9), r.randint(2, 20)))
        if len(short) <= len(long):
            want = any(SequenceMatcher(None, short, long[i : i + len(short)]).ratio() >= 0.85 for i in range(len(long) - len(short) + 1))
            assert alignment.holds_something_alike(short, long, 85) == want


def fitted(shown, start, end, words):
    if not words:
        return start, end, "no-speech"
    plain = lambda s: re.sub("[^가-힣0-9a-zA-Z]", "", s)
    owner = [k for k, (_, _, w) in enumerate(words) for _ in plain(w)]
    blocks = SequenceMatcher(None, "".join(plain(w) for _, _, w in words), plain(shown), autojunk=False).get_matching_blocks()
    matched = [owner[i] for b in blocks for i in range(b.a, b.a + b.size)]
    kept = [w for k, w in enumerate(words) if plain(w[2]) and matched.count(k) * 2 >= len(plain(w[2]))]
    if not kept or 2 * len(matched) / (len(owner) + len(plain(shown))) < 0.6:
        return start, end, "weak-align"
    first = min(w[0] for w in kept)
    last = max(max(w[1] for w in kept), first + 300)
    return (first, last, "trimmed") if max(abs(first - start), abs(last - end)) >= 500 else (start, end, "already-tight")


def test_tighten_equals_a_cue_at_a_time(spark):
    r = random.Random(5)
    cues, words, want = [], [], {}
    for i in range(120):
        start, end = i * 20_000, i * 20_000 + r.choice([900, 4000, 9000])
        said = [r.choice(["안녕", "하세요", "abc", "de", "-", "x1"]) for _ in range(r.randint(0, 6))]
        times = sorted(r.sample(range(start + 100, end - 200, 7), 2 * len(said)))
        own = [(a, b, w) for a, b, w in zip(times[::2], times[1::2], said)]
        shown = " ".join(w if r.random() < 0.8 else "다른" for w in said)
        cues.append((1, i, start, end, shown, "", ""))
        words += [(1, i, k, *w) for k, w in enumerate(own)]
        want[i] = fitted(shown, start, end, own)
    got = speech.tightened(spark.createDataFrame(cues, "job_id long, id long, start_ms long, end_ms long, text_final string, text_llm string, text_stt string"), spark.createDataFrame(words, "job_id long, cue_id long, word_no int, start_ms long, end_ms long, word string"))
    assert {x.id: (x.start_ms, x.end_ms, x.reason) for x in got.collect()} == want
    assert {x[2] for x in want.values()} == {"no-speech", "weak-align", "trimmed", "already-tight"}


@pytest.mark.parametrize("percent", [80, 50, 101])
def test_echoes_equal_all_pairs(spark, percent):
    r = random.Random(7)
    noise = lambda n: "".join(r.choice("ab ,가나") for _ in range(n))
    prompts = [noise(r.randint(0, 60)) for _ in range(40)]
    cues = []
    for i in range(300):
        p = r.choice(prompts)
        k = r.randint(0, len(p))
        cues.append((i, r.choice([noise(r.randint(0, 14)), p[k : k + r.randint(4, 15)], p[k : k + 9] + noise(2), noise(1) + p[k : k + 12]])))
    compact = lambda s: re.sub(r"\W", "", s).lower()

    def echo(cue):
        k = compact(cue)
        block = min(len(k), -(-percent * len(k) // 100))
        return len(k) >= 6 and any(k[i : i + block] in compact(p) for p in prompts for i in range(len(k) - block + 1))

    if percent == 50:  # a block shorter than a gram isn't led to
        cues = [c for c in cues if len(compact(c[1])) >= 7]
    got = speech.prompt_echoes(spark.createDataFrame(cues, "id long, text_stt string"), spark.createDataFrame([(p,) for p in prompts], "prompt string"), percent=percent)
    assert sorted(x.id for x in got.collect()) == [i for i, c in cues if echo(c)]
    assert got.count() > 30


def test_longest_chain(spark):
    r = random.Random(8)
    rows, want = [], {}
    for j in range(25):
        n = r.randint(1, 60)
        h = [i + (r.randint(-6, 6) if r.random() < 0.3 else 0) for i in range(n)]
        rows += [(j, i, x) for i, x in enumerate(h)]
        best = [1] * n
        for i in range(n):
            best[i] = 1 + max((best[k] for k in range(i) if h[k] < h[i]), default=0)
        want[j] = max(best)
    got = {}
    for x in speech.increasing(spark.createDataFrame(rows, "job_id int, s int, h int")).orderBy("job_id", "s").collect():
        got.setdefault(x.job_id, []).append(x.h)
    assert {j: len(h) for j, h in got.items()} == want
    assert all(a < b for h in got.values() for a, b in zip(h, h[1:]))


def spoken(seed, n, kinds=500):
    """A script, what was heard of it, and for each word of the script its place there, or None."""
    r = random.Random(seed)
    script = [f"w{r.randrange(kinds)}" for _ in range(n)]
    heard, truth = [], []
    for w in script:
        if r.random() < 0.03:
            heard += [f"w{r.randrange(kinds)}" for _ in range(r.randint(1, 3))]
        if r.random() < 0.05:
            truth.append(None)
            continue
        right = r.random() > 0.05
        truth.append(len(heard) if right else None)
        heard.append(w if right else "noise")
    return script, heard, truth


def places(spark, jobs):
    sentences = [(j, n, " ".join(script[n * 8 : n * 8 + 8])) for j, (script, _, _) in enumerate(jobs) for n in range(-(-len(script) // 8))]
    words = [(j, i * 100, i * 100 + 90, w) for j, (_, heard, _) in enumerate(jobs) for i, w in enumerate(heard)]
    script, heard = speech.script_and_heard(spark.createDataFrame(sentences, "job_id long, no long, text string"), spark.createDataFrame(words, "job_id long, start_ms long, end_ms long, word string"))
    return speech.word_places(script, heard)


def test_places_of_words_are_those_of_an_exact_alignment(spark):
    jobs = [spoken(seed, 600) for seed in range(4)]
    got = {(x.job_id, x.at): x.h for x in places(spark, jobs).collect()}
    exact = near = total = 0
    for j, (script, heard, truth) in enumerate(jobs):
        for b in SequenceMatcher(None, script, heard, autojunk=False).get_matching_blocks():
            for i in range(b.size):
                total += 1
                exact += got[j, b.a + i] == b.b + i
        near += sum(abs(got[j, i] - h) <= 2 for i, h in enumerate(truth) if h is not None)
        assert all(got[j, i] <= got[j, i + 1] for i in range(len(script) - 1))
    assert exact >= 0.98 * total and near >= 0.98 * sum(h is not None for _, _, t in jobs for h in t)
