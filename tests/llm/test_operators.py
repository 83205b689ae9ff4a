"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.llm import components, exact_dedup, language_id, license_scan, near_dedup, packing, repeats, secret_scan, segmentation, shingles, token_counts, tokens, webp
from cuelake.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, id string, _id string"


def frame(spark, rows):
    """Rows (doc_id, text) as documents, with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 1, None, 0.5, "x", "y") for i, t in rows], SCHEMA).repartition(3)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(40)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = text(60)
    rows = [(i, text(r.randint(0, 120))) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(8)]  # exact copies
    rows += [(n + 8 + i, " ".join(w if r.random() > 0.03 else "new" for w in rows[i][1].split(" "))) for i in range(12)]  # near copies
    rows += [(n + 20 + i, f"{text(9)} {passage} {text(r.randint(0, 9))}") for i in range(6)]
    rows += [(n + 30, None), (n + 31, ""), (n + 32, " \t\n"), (n + 33, "1234 ?!"), (n + 34, "z" * 3000), (n + 35, "Ab\tCd  ab"), (None, "null id"), (3, rows[3][1]), (n + 36, text(4000))]
    return rows


ROWS = corpus()


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(frame(spark, ROWS)).collect()
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in ROWS:
        groups.setdefault(key(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = []
    for i, t in ROWS:
        g = groups[key(t)]
        keep = min(g)[3]
        want.append((i, keep, len(g), keep == i, hashlib.sha256(key(t).encode()).hexdigest()))
    same((tuple(r) for r in got), want)


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, len(t), [(int(a), int(b)) for a, b in zip(spans[::2], spans[1::2])], bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("most_contents", [2048, 1])
def test_repeats(spark, most_contents):
    got = repeats.without_repeats(frame(spark, ROWS), length=40, most_contents=most_contents, at_once=3).collect()
    same(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got), brute_repeats(ROWS, 40))


@pytest.mark.parametrize("most_contents", [2048, 5])
def test_repeats_of_a_hot_anchor(spark, most_contents):
    """A passage shorter and one longer than a window, each in many texts between bytes of their own, some of them alike."""
    r = random.Random(5)
    noise = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    short, long, edge = noise(25), noise(60), noise(30)
    rows = [(i, noise(r.randint(0, 60)) + (edge[-r.randint(0, 30) or 30 :] if i % 3 == 0 else "") + (short if i % 2 else long) + noise(r.randint(0, 60))) for i in range(60)]
    got = repeats.without_repeats(frame(spark, rows), length=40, most_contents=most_contents).collect()
    same(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got), brute_repeats(rows, 40))


def test_interval_expansion_equals_comparison():
    r = random.Random(3)
    for _ in range(300):
        length, n = r.choice([4, 6, 9]), r.randint(1, 9)
        groups = np.sort(np.array([r.randint(0, 2) for _ in range(n)]))
        base = bytes(r.choice(b"ab") for _ in range(3 * length))
        contents, anchors = [], []
        for _ in range(n):
            left = r.randint(0, length - 1)
            c = bytearray(base[length - left : length + r.randint(length - left, length)])
            contents.append(bytes(r.choice(b"ab") if r.random() < 0.1 else x for x in c))
            anchors.append(left)
        got = repeats.repeated_windows(groups, contents, anchors, length)
        for i, c in enumerate(contents):
            for w in range(len(c) - length + 1):
                at = [w - anchors[i] + a for a in anchors]
                want = any(j != i and groups[j] == groups[i] and 0 <= at[j] <= len(contents[j]) - length and contents[j][at[j] : at[j] + length] == c[w : w + length] for j in range(n))
                assert got[i][w] == want


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i in sets for s in sets[i]]


@pytest.mark.parametrize("k, percent, block", [(3, 85, 768), (5, 80, 768), (2, 80, 4)])
def test_near_dedup(spark, k, percent, block):
    got = near_dedup.near_dedup(frame(spark, ROWS), k=k, percent=percent, block=block).collect()
    same((tuple(r) for r in got), brute_components(ROWS, k, percent))


@pytest.mark.parametrize("n", range(1, 8))
def test_shingles_of_batches_with_few_words(n):
    """Batches that hold fewer words than a shingle, one text or two."""
    words = [f"w{i}".encode() for i in range(n)]
    value, bounds = shingles.shingle_sets([b" ".join(words)], 5)
    assert len(value) == max(1, n - 4) and list(bounds) == [0, len(value)]
    two, bounds = shingles.shingle_sets([words[0], b"", b" ".join(words[1:])], 5)
    assert list(np.diff(bounds)) == [1, 0, max(1, n - 5) if n > 1 else 0]


def test_near_dedup_of_few_words(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 4))) for i in range(12)]
    got = near_dedup.near_dedup(frame(spark, rows).repartition(12)).collect()
    same((tuple(x) for x in got), brute_components(rows, 5, 80))


def test_near_dedup_of_a_large_group(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if r.random() > 0.035 else f"x{r.randint(0, 9)}" for w in base)) for i in range(150)]
    got = near_dedup.near_dedup(frame(spark, rows), k=3, percent=85, block=16).collect()
    same((tuple(x) for x in got), brute_components(rows, 3, 85))


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    named = {x for a, b in links if a != b for x in (a, b)}
    got = {x.id: x.component for x in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in named}


def test_webp_columns(spark):
    got = webp.read_media(webp.store_texts(frame(spark, ROWS))).collect()
    want = []
    for i, t in ROWS:
        b = (t or "").encode()
        p = webp.padded(b)
        m = webp.encode(p)
        assert len(p) % 64 == 0 and webp.samples(webp.decode(m), webp.is_grey(m))[: len(p)] == p
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()))
    same((tuple(r)[:7] for r in got), want)
    media = spark.createDataFrame([(1, bytearray(webp.encode(bytes(64)))), (2, None), (3, bytearray(b"junk"))], "k long, media binary")
    rows = {r.k: r for r in webp.pixel_arrays(media, "k").collect()}
    assert rows[1].argb == [0xFF000000] * 64 and rows[2].argb is None and rows[2].error is None and rows[3].error


def test_license_scan(spark):
    notice = license_scan.NOTICES[0][1].split()
    damaged = " ".join(w for i, w in enumerate(notice) if i % 13)
    rows = [*ROWS, (900, "Under the MIT License, under the mit\nlicense."), (901, f"x {damaged} y"), (902, "apache license version 2 cc-by-nc CC BY NC"), (903, "under mit license the")]
    got = {r.doc_id: r for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert (got[900].n_base, got[900].first_word, got[900].last_word, got[900].base_labels, got[900].labels, got[900].score) == (2, 0, 4, "mit", "mit", 1.0)
    assert got[901].n_base == 0 and got[901].first_word is None and got[901].labels == "mit" and 0.5 <= got[901].score < 1
    assert (got[902].n_base, got[902].base_labels) == (3, "apache-2,cc-by-nc") and got[903].labels == ""
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [p for phrase, _ in license_scan.BASE_PHRASES for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        assert (got[i].n_words, got[i].n_base) == (len(words), len(places))
    assert len(got) == len({i for i, _ in rows})


def test_token_counts(spark):
    starts, inside = (set(x) for x in token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model")))

    def greedy(word):
        n = i = 0
        while i < len(word):
            j = next((j for j in range(len(word), i, -1) if word[i:j] in (inside if i else starts)), None)
            if j is None:
                return 0
            n, i = n + 1, j
        return n

    want = []
    for i, t in ROWS:
        c = [greedy(w.decode()) for w in (t or "").encode().split()]
        want.append((i, len(c), sum(max(x, 1) for x in c), c.count(0), max((max(x, 1) for x in c), default=0)))
    same((tuple(r) for r in token_counts.token_counts(frame(spark, ROWS)).collect()), want)
    tiny = token_counts.LongestMatch(["ab", "a", "abcd"], ["c", "d", "cd", "x"])
    assert [tiny.count(w) for w in ("abcd", "abc", "abcx", "ad", "x", "abcdcd")] == [1, 2, 3, 2, 0, 2]


def test_sampled_segmentations(spark):
    got = segmentation.decoded(segmentation.sampled_segmentations(frame(spark, ROWS), k=3)).collect()
    texts = {}
    for i, t in ROWS:
        texts.setdefault(i, set()).add((t or "").encode())
    by = {}
    for r in got:
        assert bytes(r.decoded) in texts[r.doc_id] and 0 <= r.inclusion <= 1
        by.setdefault((r.doc_id, bytes(r.decoded)), set()).add((r.sample, r.ids_crc32))
    assert {i for i, _ in by} == set(texts) and all(len({c for _, c in s}) == len(s) for s in by.values())
    again = segmentation.decoded(segmentation.sampled_segmentations(frame(spark, ROWS).coalesce(1), k=3)).collect()
    same((tuple(r) for r in got), (tuple(r) for r in again))


def test_gumbel_draws_follow_the_distribution():
    vocabulary = segmentation.pieces(None, segmentation.ALPHA)
    text, n = "the ox", 6000
    names, at, _ = segmentation.units_of(pa.array([text]))
    units, places = [f"{segmentation.SPACE}{names[i]}" for i in at.tolist()], np.tile(at, n)

    def ways(u):
        if not u:
            return [((), 0.0)]
        return [((got[1], *p), got[0] + w) for size in range(1, len(u) + 1) if (got := vocabulary.known.get(u[:size])) for p, w in ways(u[size:])]

    every = [((), 0.0)]
    for u in units:
        every = [(a + b, x + y) for a, x in every for b, y in ways(u)]
    weights = np.exp([w for _, w in every])
    p = dict(zip((a for a, _ in every), weights / weights.sum()))
    at = segmentation.Lattices(vocabulary)
    starts = at.starts(names)[places]
    at.starts(pa.array(["more", "words", *names.to_pylist()]))  # what is built later leaves a lattice as it is
    search = segmentation.Search(at, starts, np.full(n, len(units)), segmentation.mixed(np.arange(n).astype(np.uint64)))
    limit = search.run(2)
    drawn = [[tuple(at.piece[x["edge"]][a:b]) for a, b in zip(x["first"][:-1], x["first"][1:])] for x in search.rounds]
    first, pairs = Counter(drawn[0]), Counter(zip(*drawn))
    assert all(abs(first[a] / n - p[a]) < 0.03 for a in p)
    assert all(a != b and abs(c / n - p[a] * p[b] / (1 - p[a])) < 0.03 for (a, b), c in pairs.items())
    estimate = Counter()
    for x, ids in zip(search.rounds, drawn):
        for d, a, lp in zip(x["docs"], ids, x["log_prob"]):
            assert abs(np.log(p[a]) - lp) < 1e-9
            estimate[a] += p[a] / -np.expm1(-np.exp(lp - limit[d])) / n
    assert all(abs(estimate[a] - p[a]) < 0.03 for a in p)


def test_language_id(spark):
    r = random.Random(4)
    say = lambda words: " ".join(r.choice(words) for _ in range(30))
    words = {"aa": ["the", "house", "with", "green"], "bb": ["das", "haus", "mit", "grün"]}
    rows = [(i, say(words[l]), l if i % 7 else None) for i in range(80) for l in [("aa", "bb")[i % 2]]]
    rows += [(500, None, "aa"), (501, "12 ?!", "bb"), (502, "", None), (None, "the house", "aa"), (503, "x" * 100_000, None)]
    docs = spark.createDataFrame([(*x, 0.1, "z") for x in rows], "doc_id long, text string, lang string, score double, _text string")
    got = {x.doc_id: x for x in language_id.language_id(docs).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(80))
    assert all(got[i].lang_pred == ("aa", "bb")[i % 2] and 0 <= got[i].score <= 1 for i in range(80))
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[500].score == 0 and len(got) == len(rows)
    none = language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {x.lang_pred for x in none} == {"und"}


def test_models_on_tokens_that_no_generator_of_ours_has_made(spark):
    """Random strings of four alphabets, and names of the standard library; the models are trained on made samples and on identifiers of the table's texts."""
    import argparse
    import ast
    import asyncio
    import email.message
    import http
    import inspect
    import logging
    import socket
    import ssl
    import string
    import subprocess
    import unittest
    import uuid

    r = random.Random(5)
    of = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    secrets = [of(string.ascii_letters + string.digits, r.randint(20, 40)) for _ in range(300)] + [of(string.ascii_lowercase + string.digits, r.randint(20, 40)) for _ in range(300)]
    secrets += [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(150)] + ["ghp_" + of(string.ascii_letters + string.digits, 36) for _ in range(150)]
    modules = (argparse, ast, asyncio, asyncio.BaseEventLoop, email.message, http, inspect, logging, socket, socket.socket, ssl, ssl.SSLContext, subprocess, unittest, unittest.TestCase)
    names = {n for m in modules for n in dir(m) if len(n) >= 16 and not n.startswith("__")}
    texts = [(i, f"The {a} calls {b}, see documentation of configuration number{i}.") for i, (a, b) in enumerate(zip(sorted(dir(str)) * 4, sorted(dir(dict)) * 8))]
    model = secret_scan.trained_on(spark.createDataFrame([*texts, (None, "nothing_of_this"), (1, None)], "doc_id long, text string"))
    tokens = spark.createDataFrame([(x, True) for x in secrets] + [(x, False) for x in sorted(names)], "token string, y boolean")
    got = tokens.withColumn("x", secret_scan.log_ratio(F.col("token"), model) >= 0.5).collect()
    missed, taken = sum(g.y and not g.x for g in got), sum(g.x and not g.y for g in got)
    assert len(names) > 300 and missed <= 0.03 * len(secrets) and taken <= 0.03 * len(names)


def test_license_scan_counts_rows_that_repeat(spark):
    rows = [(1, "under the mit license")] * 3 + [(1, "other words here")] * 2 + [(None, None)] * 2
    got = license_scan.license_scan(frame(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_base) for x in got) == sorted([("1", 4, 1)] * 3 + [("1", 3, 0)] * 2 + [("None", 0, 0)] * 2)


def test_language_training_is_bounded_by_rows(spark):
    rows = [(1, "aa bb", "xx")] * 50 + [(1, "aa cc", "xx")] * 50 + [(4, "dd ee", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counted = language_id.train(docs, most=5)
    alone = language_id.train(docs.distinct().filter("text <> 'aa cc'"), most=5)
    assert counted.languages == alone.languages and (counted.log_prob == alone.log_prob).all() and (counted.log_prior == alone.log_prior).all()


def test_secret_scan(spark):
    token = "aZ3kQ9xW7vB1nM5pL8tR2yU6"
    rows = [*ROWS, (900, 'é password = "hunter22" Api_Key:short x secret: token: abcdefgh'), (901, f"AKIA{'Q' * 16} AKIASHORT"), (902, f"{'0123456789abcdef' * 2} deadbeef"), (903, f"key {token} user_account_name_filter_index2 https://example.org/path/item/list/number1"), (904, None)]
    got = secret_scan.secret_scan(frame(spark, rows)).collect()
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = {}
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want[i] = [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want[r.doc_id]) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(want[r.doc_id]).encode()).hexdigest()
        assert set(want[r.doc_id]) <= set(r.spans.split(",")) | {""}
    spans = {r.doc_id: r.spans for r in got}
    assert spans[903] == "markov:4:28" and len(got) == len(rows)
    text = {r.doc_id: r.text for r in secret_scan.redacted(frame(spark, rows).select("doc_id", "text")).collect()}
    assert text[903].startswith("key [secret] user_") and text[904] is None and text[902] == "[secret] deadbeef"
    assert text[900].startswith('é [secret]" Api_Key:short')


def test_spans_of_a_text_with_very_many(spark):
    """Thousands of spans, in blocks; runs that touch an assignment are left to it."""
    r = random.Random(9)
    pool = [f"{r.getrandbits(128):032x}" for _ in range(300)]
    text = " ".join(["secret=abcdefgh12 xx_token=Zk3kQ9xW7vB1nM5pL8tR2y"] + [r.choice(pool) for _ in range(6000)])
    found = secret_scan.secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{24,}", text)]
    assert (found.n_assign, found.n_hex) == (2, len(want)) and "markov" not in found.spans
    assert [tuple(map(int, s.split(":")[1:])) for s in found.spans.split(",") if s.startswith("hex")] == want
    clean = secret_scan.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert clean == " ".join(["[secret] xx_[secret]"] + ["[secret]"] * 6000)


def test_markov_models_part_random_from_ordinary(spark):
    model = secret_scan.train(secret_scan.labelled_tokens(spark, 1000))
    seen = secret_scan.labelled_tokens(spark, 1000).select("token")
    fresh = secret_scan.labelled_tokens(spark, 2400).join(seen, "token", "left_anti").filter("length(token) >= 20").withColumn("llr", secret_scan.log_ratio(F.col("token"), model))
    right = fresh.select(((F.col("llr") >= 0.5) == F.col("is_random")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.97


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [(i, x) for i, x in ROWS if i not in (None, 3)] + [(950, "İI ǅ a. B, c.. 1.5 x.y ,z <|endoftext|> <|ENDOFTEXT|> it's don't")]
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in rows}
    got = packing.packed(frame(spark, rows)).toPandas()
    for i, g in got.sort_values("start").groupby("doc_id"):
        at = 0
        for r in g.itertuples():
            assert r.start == at and r.doc_tokens == len(want[i]) and r.ids_crc32 == zlib.crc32(want[i][at : at + r.length])
            at += r.length
        assert at == len(want[i])
    assert set(got.doc_id) == set(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
        n = g.length.sum()
        assert n == g.sequence_tokens.iloc[0] <= 4096 and n & (n - 1) == 0


def test_kept_words_are_bounded_by_bytes():
    small = tokens.WordIds(tokenizer_path("word_bpe_49k.json"), most_bytes=20_000)
    large = tokens.WordIds(tokenizer_path("word_bpe_49k.json"))
    r = random.Random(8)
    for _ in range(30):
        texts = pa.array(["".join(r.choice("abcéßÉ.,'!<| \n7한") for _ in range(r.choice([0, 5, 3000]))) for _ in range(4)] + [None])
        for x, y in zip(small.encode(texts), large.encode(texts)):
            assert (x == y).all()
        one = large.tokenizer.encode(texts[1].as_py(), add_special_tokens=False).ids
        ids, bounds = small.encode(texts)
        assert list(ids[bounds[1] : bounds[2]]) == one
    assert small.known.held < 20_000 + 4 * 3000 * 170 and large.known.held > small.known.held


def test_pack_fills_every_window():
    r = random.Random(6)
    for n in (0, 1, 5, 300):
        lengths = [r.choice([1, 3, 500, 512, 700, 2049, 4096, 9000]) for _ in range(n)]
        windows, left = packing.pack(lengths)
        assert not left and all(sum(p.length for p in parts) == size for size, parts in windows)
        assert sum(s for s, _ in windows) == sum(lengths)
        windows, left = packing.pack(lengths, last=False)
        assert sum(s for s, _ in windows) + sum(p.length for p in left) == sum(lengths) and sum(p.length for p in left) < 4096


def test_empty_tables(spark):
    none = frame(spark, ROWS).limit(0)
    for df in (
        exact_dedup.exact_dedup(none), repeats.without_repeats(none), near_dedup.near_dedup(none), webp.read_media(webp.store_texts(none)), license_scan.license_scan(none), token_counts.token_counts(none),
        segmentation.decoded(segmentation.sampled_segmentations(none)), language_id.language_id(none), secret_scan.secret_scan(none), packing.packed(none),
    ):
        assert df.count() == 0


@pytest.mark.parametrize("block", [3, 16])
def test_a_main_component_meets_the_others_of_its_bucket(spark, block):
    """Of a bucket with one large component and a few others every pair across is compared, and none within the large one."""
    r = np.random.default_rng(3)
    width = near_dedup.WORDS
    sketches = {i: r.integers(-(1 << 62), 1 << 62, width).tolist() for i in range(40)}
    rows = [(7, 40, i, 0 if i < 30 else i, 10, sketches[i if i < 33 else i - 33]) for i in range(40)]  # 33 on have the sketch of a main member
    members = spark.createDataFrame(rows, "bucket long, n long, id long, component long, n_shingles long, sketch array<long>")
    words = {i: " ".join(f"w{(i if i < 33 else i - 33) * 50 + k}" for k in range(12)) for i in range(40)}
    texts = spark.createDataFrame(list(words.items()), "id long, text string")
    got = {tuple(sorted((x.a, x.b))) for x in near_dedup.across(members, texts, 3, 85, 0, block).collect()}
    assert got == {(i - 33, i) for i in range(33, 40)}
