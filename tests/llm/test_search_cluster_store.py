"""Operators 11 to 13 against brute force, on tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cuelake.llm import clustering, lexical_search, repair, token_store
from cuelake.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, id string, n long, item string, part int, share int, rank int, term string, at int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 1, 1, 1, "z", 1) for i, t in rows], SCHEMA).repartition(3)


def corpus(seed=1, n=80):
    r = random.Random(seed)
    words = ["".join(r.choice("abcDé") for _ in range(r.randint(1, 4))) for _ in range(60)]
    text = lambda k: r.choice([" ", ", ", "\n"]).join(r.choice(words) for _ in range(k))
    rows = [(i, text(r.randint(0, 60))) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(15)] + [(3, rows[3][1]), (4, "another text of an id"), (None, text(20)), (None, None), (n + 20, None), (n + 21, ""), (n + 22, " .,\x00_"), (n + 23, text(5000)), (n + 24, "x" * 3000)]
    return rows, text


ROWS, TEXT = corpus()


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(rows, items, k):
    docs = [(i, terms(t)) for i, t in rows]
    n_docs, length = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    asked = {}
    for item, t in items:
        asked.setdefault(item, set()).update(terms(t))
    for item, words in asked.items():
        scored = []
        for i, t in docs:
            m = 50 + 50 * len(t) * n_docs // length if t else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * t.count(w) // (1000 * t.count(w) + 20 * m)) for w in words if w in t)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(map(str, out))


ITEMS = [(1, TEXT(6)), (2, TEXT(20)), (2, "and more ABC"), (None, TEXT(3)), (3, ""), (4, None), (5, "nothingofthis"), (6, TEXT(400)), *((7 + i, TEXT(1)) for i in range(20))]


@pytest.mark.parametrize("k, block_terms, triples", [(50, 1 << 20, 1 << 20), (5, 40, 100), (3, 1 << 20, 1)])
def test_ranked_search(spark, k, block_terms, triples):
    items = spark.createDataFrame([(i, t, 0.5, "x") for i, t in ITEMS], "item_id long, text string, score double, id string").repartition(2)
    got = lexical_search.ranked(frame(spark, ROWS), items, k=k, block_terms=block_terms, triples=triples)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str((x.item_id, x.rank, x.doc_id, x.score)) for x in got.collect()) == ranking(ROWS, ITEMS, k)


def test_ranked_search_of_nothing(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.ranked(frame(spark, []), items).count() == 0
    assert lexical_search.ranked(frame(spark, [(1, None), (2, "...")]), items).count() == 0
    none = lexical_search.ranked(frame(spark, ROWS), items.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_and_radix_order():
    texts = ["Ab,c", "", None, "x", "é-É 9_9", "c" * 70]
    found, bounds = lexical_search.terms_of(pa.array(texts))
    got = [[w.decode() for w in found[a:b].to_pylist()] for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [terms(t) for t in texts]
    r = np.random.default_rng(1)
    for top in (1, 100, 1 << 17, 1 << 40):
        keys = r.integers(0, top, 500)
        assert (keys[lexical_search.radix_order(keys)] == np.sort(keys)).all()
        low_sorted = np.sort(keys & 0xFFFF) | (r.integers(0, 1 << 20, 500) << 16)
        assert (low_sorted[lexical_search.radix_order(low_sorted, 16)] == np.sort(low_sorted)).all()


def vectors(seed=1, n=700, dims=8):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (6, dims))
    x = (centres[r.integers(0, 6, n)] + r.normal(0, 0.2, (n, dims))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(n + i, rows[0][1]) for i in range(200)]  # a frequent vector
    bad = [(5000, None), (5001, []), (5002, rows[0][1][:-1]), (5003, [*rows[0][1][:-1], None]), (5004, [*rows[0][1][:-1], float("nan")]), (5005, [*rows[0][1][:-1], float("inf")]), (5006, [*rows[0][1][:-1], -float("inf")]), (None, rows[5][1]), (9, rows[9][1]), (10, rows[30][1])]
    return rows + bad


def lloyd(rows, k, rounds, dims, seed=2):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda x: (hashlib.sha256(f"{seed}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))[:k]
    centroids = np.array([v for _, v in first]).reshape(-1, dims)
    points = np.array([v for _, v in kept]).reshape(-1, dims)

    def nearest():
        d = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    if not kept:
        return []
    for _ in range(rounds):
        of, _ = nearest()
        centroids = np.array([points[of == c].sum(axis=0) // (of == c).sum() if (of == c).any() else centroids[c] for c in range(len(centroids))])
    of, d = nearest()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return sorted(str((i, int(c), int(x), int(d[of == c].sum()), int(d.sum()), digest[c])) for (i, _), c, x in zip(kept, of, d))


@pytest.mark.parametrize("k, rounds, block", [(12, 5, 1024), (40, 3, 50), (3000, 1, 1024), (1, 2, 1)])
def test_clusters(spark, k, rounds, block):
    rows = vectors()[: 60 if block == 1 else None]
    df = spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, cluster int, id string, distance double").repartition(3)
    got = clustering.clusters(df, k=k, rounds=rounds, dims=8, block=block).collect()
    assert sorted(str((x.vec_id, x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256)) for x in got) == lloyd(rows, k, rounds, 8)


def test_clusters_of_nothing_and_of_too_much(spark):
    schema = "vec_id long, embedding array<double>"
    assert clustering.clusters(spark.createDataFrame([], schema)).count() == 0
    assert clustering.clusters(spark.createDataFrame([(1, None), (2, [1.0])], schema)).count() == 0
    far = spark.createDataFrame([(1, [1e9] * 64)], schema)
    with pytest.raises(Exception, match="a component beyond"):
        clustering.clusters(far).count()


def test_cover_trees_and_the_search():
    r = np.random.default_rng(4)
    for case in range(150):
        n, k, dims = r.integers(1, 150), r.integers(1, 40), r.integers(1, 5)
        points = r.integers(-20, 20, (n, dims))
        centroids = points[r.integers(0, n, k)] if case % 2 else r.integers(-20, 20, (k, dims))
        tree = clustering.CoverTree.over(points, 3)
        assert sorted(tree.order) == list(range(n))
        for node in range(len(tree.centre)):
            own = points[tree.order[tree.begin[node] : tree.end[node]]]
            away = np.sqrt(clustering.squared(own, points[tree.order[tree.centre[node]]]).astype(float))
            assert away.max() == tree.radius[node]
            kids = np.arange(tree.kids[node], tree.kids[node] + tree.n_kids[node])
            if len(kids):
                cover = 2 ** (np.ceil(np.log2(tree.radius[node])) - 1)
                assert (tree.end[kids] - tree.begin[kids]).sum() == len(own) and (tree.radius[kids] <= cover).all()
                hearts = points[tree.order[tree.centre[kids]]]
                gaps = np.sqrt(((hearts[:, None] - hearts[None]) ** 2).sum(axis=2))
                assert (gaps[~np.eye(len(kids), dtype=bool)] > cover).all()
        placed = points[tree.order]
        got = clustering.nearest(tree, placed, clustering.CoverTree.over(centroids, 1), centroids)
        assert (got == ((placed[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, token_store.END_ID] for t in texts]


def test_chunks_have_the_tokenizers_ids():
    r = random.Random(6)
    alphabet = "abéß×÷. ,\n\t\u0085 日\x1c'1!<|　 \x00 　"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(4000)] + ["x<|endoftext|> y", "a <|endoftext|>", None, "", " <|endoftext|>b I'll we're", "word " * 5000]
    for most in (1 << 30, 0):
        encoder = token_store.ChunkIds(tokenizer_path("byte_bpe_50k.json"), most)
        for part in (texts[:2000], texts[2000:], texts[1000:3000]):
            ids, bounds = encoder.encode(pa.array(part, pa.string()))
            assert [[*ids[a:b].tolist(), 2] for a, b in zip(bounds[:-1], bounds[1:])] == encoded(part)


@pytest.mark.parametrize("shard_ids", [1 << 17, 50])
def test_token_store(spark, shard_ids):
    rows = [r for r in ROWS if r[0] is not None]
    got = token_store.read_back(token_store.stored(frame(spark, rows), shard_ids=shard_ids)).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: r[0])
    want, at = [], 0
    for (i, t), ids in zip(ordered, encoded([t for _, t in ordered])):
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [x.doc_id for x in got] == [i for i, _, _ in want]
    assert sorted((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == sorted(want)
    for x in got:
        assert x.start == at
        at += x.n_tokens


def test_token_store_of_nulls_and_nothing(spark):
    got = token_store.read_back(token_store.stored(frame(spark, [(2, "b c"), (None, "a"), (None, None)]))).orderBy("start").collect()
    assert [x.doc_id for x in got] == [None, None, 2] and sorted(x.n_tokens for x in got[:2]) == [1, 2]
    assert token_store.read_back(token_store.stored(frame(spark, []))).count() == 0


def test_ranges_by_random_access(spark):
    stored = token_store.stored(frame(spark, ROWS), shard_ids=400)
    r = random.Random(3)
    asked = [(i, a, a + r.randint(0, 40)) for i, _ in r.sample(ROWS, 40) if i is not None for a in (0, r.randint(0, 70))] + [(10**6, 0, 5)]
    of = {}
    for (i, _), ids in zip(ROWS, encoded([t for _, t in ROWS])):
        of.setdefault(i, []).append(ids)
    got = token_store.token_ranges(stored, spark.createDataFrame(asked, "doc_id long, first int, last int")).collect()
    want = [(i, a, b, ids[a:b]) for i, a, b in asked for ids in of.get(i, [])]
    assert sorted(map(str, ((x.doc_id, x.first, x.last, x.tokens) for x in got))) == sorted(map(str, want))


def test_grammar_round_trip():
    r = np.random.default_rng(5)
    for case in range(60):
        n, kinds = int(r.integers(1, 3000)), int(r.choice([1, 2, 5, 200, 70000]))
        ids = r.integers(0, kinds, n).astype(np.uint32)
        if case % 3 == 0:
            ids = np.tile(ids[: max(1, n // 20)], 20)
        cuts = np.sort(r.integers(0, len(ids) + 1, int(r.integers(0, 8))))
        starts = np.concatenate([[0], cuts, [len(ids)]])  # some documents are empty
        data = repair.shard(ids, starts)
        back = repair.Shard.read(data)
        got, bounds = back.ids()
        assert (got == ids).all() and (bounds == starts).all()
        for _ in range(20):
            d = int(r.integers(0, len(starts) - 1))
            a, b = (int(x) for x in r.integers(-3, 60, 2))
            assert (back.part(d, a, b) == ids[starts[d] : starts[d + 1]][max(a, 0) : max(b, 0)]).all()
    with pytest.raises(ValueError, match="not a shard"):
        repair.Shard.read(bytes(40))


def test_grammar_leaves_no_frequent_pair():
    r = np.random.default_rng(6)
    for _ in range(30):
        s = r.integers(0, 6, 2000)
        left, last, rules = repair.replaced(s, np.array([0, 700, 2000]), 6)
        pairs = {}
        at = 0
        while at < len(left) - 1:
            key = (left[at], left[at + 1])
            step = 1
            if not last[at]:
                pairs[key] = pairs.get(key, 0) + 1
                step = 2 if left[at] == left[at + 1] else 1
            at += step
        # Pairs that are left can't be replaced often enough once overlaps are told apart.
        assert len(left) < 1300 and max(pairs.values()) < 3 * repair.LEAST
        assert (rules < np.arange(6, 6 + len(rules))[:, None]).all()
