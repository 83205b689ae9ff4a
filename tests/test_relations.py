"""Operators over several tables, and edits that follow one another, against the same steps taken one at a time."""

import random
from graphlib import CycleError

import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import editing, ordered, relations
from cuelake.operators.relations import Key

KEYS = [Key("page", "book", "book"), Key("note", "page", "page"), Key("note", "reply_to", "note"), Key("note", "book", "book")]


def library(spark, seed=1):
    r = random.Random(seed)
    maybe = lambda ids: r.choice([*ids, None])
    rows = {"book": [(i, f"b{i}") for i in range(6)], "page": [(i, maybe(range(6)), f"p{i}") for i in range(25)], "note": [(i, maybe(range(25)), maybe(range(i)) if i else None, maybe(range(6)), f"n{i}") for i in range(60)]}
    schemas = {"book": "id long, text string", "page": "id long, book long, text string", "note": "id long, page long, reply_to long, book long, text string"}
    return rows, {n: spark.createDataFrame(rows[n], schemas[n]).repartition(2) for n in rows}


def test_parents_come_first():
    assert relations.parents_first({"note": None, "page": None, "book": None}, KEYS) == ["book", "page", "note"]
    with pytest.raises(CycleError):
        relations.parents_first({"a": None, "b": None}, [Key("a", "x", "b"), Key("b", "y", "a")])


def ids(tables):
    return {n: sorted(x.id for x in df.select("id").collect()) for n, df in tables.items()}


def test_cascade(spark):
    rows, tables = library(spark)
    dead = {"book": {1, 4}, "page": {7}, "note": set()}
    while True:
        before = {n: len(d) for n, d in dead.items()}
        dead["page"] |= {i for i, b, _ in rows["page"] if b in dead["book"]}
        dead["note"] |= {i for i, p, t, b, _ in rows["note"] if p in dead["page"] or t in dead["note"] or b in dead["book"]}
        if before == {n: len(d) for n, d in dead.items()}:
            break
    doomed = {"book": spark.createDataFrame([(1,), (4,), (99,)], "id long"), "page": spark.createDataFrame([(7,)], "id long")}
    assert ids(relations.cascade(tables, KEYS, doomed)) == {n: [x[0] for x in rows[n] if x[0] not in dead[n]] for n in rows}
    assert ids(relations.cascade(tables, KEYS, {})) == ids(tables)


def test_deep_copy(spark):
    rows, tables = library(spark, 2)
    out = relations.deep_copied(tables, KEYS, "book", F.col("id").isin(2, 3), {"text": F.concat("text", F.lit("~"))})
    books = {2: 6, 3: 7}
    taken = sorted(i for i, b, _ in rows["page"] if b in books)
    pages = {old: 25 + k for k, old in enumerate(taken)}
    taken = sorted(i for i, p, _, b, _ in rows["note"] if p in pages or b in books)
    notes = {old: 60 + k for k, old in enumerate(taken)}
    got = {n: sorted(map(tuple, df.collect())) for n, df in out.items()}
    assert got["book"] == [(6, "b2~"), (7, "b3~")]
    assert got["page"] == sorted((pages[i], books[b], t) for i, b, t in rows["page"] if i in pages)
    assert got["note"] == sorted((notes[i], pages.get(p, p), notes.get(t, t), books.get(b, b), x) for i, p, t, b, x in rows["note"] if i in notes)
    assert ids(relations.deep_copied(tables, KEYS, "book", F.lit(False))) == {"book": [], "page": [], "note": []}


def test_copies_leave_a_filled_target_alone(spark):
    rows, tables = library(spark, 3)
    empty = {n: df.limit(0) for n, df in tables.items()}
    whole, refused = relations.copied(tables, empty, KEYS)
    assert ids(whole) == ids(tables) and ids(refused) == ids(empty)
    assert {x.table: x.next_id for x in relations.next_ids(whole).collect()} == {"book": 6, "page": 25, "note": 60}
    assert {x.next_id for x in relations.next_ids(empty).collect()} == {1}
    mine = {**empty, "book": tables["book"].filter("id = 0").withColumn("text", F.lit("mine"))}
    same, _ = relations.copied(tables, mine, KEYS)
    assert ids(same) == {"book": [0], "page": [], "note": []}
    forced, _ = relations.copied(tables, mine, KEYS, force=True)
    assert ids(forced) == ids(tables) and forced["book"].filter("id = 0").first().text == "mine"
    lost, refused = relations.copied({**tables, "book": tables["book"].filter("id <> 2")}, empty, KEYS)
    gone = {i for i, b, _ in rows["page"] if b == 2}
    assert gone and set(ids(refused)["page"]) == gone and not gone & set(ids(lost)["page"])


@pytest.mark.parametrize("seed", range(3))
def test_practice_flags_equal_one_change_after_another(spark, seed):
    r = random.Random(seed)
    media = [(j, r.random() < 0.3, j % 5 == 4, {1: "a", 2: "b"}.get(j, "")) for j in range(12)]
    changes = [(s, r.randrange(14), r.choice([None, "", "a", "b", "c", "zz"]), r.random() < 0.5) for s in range(r.choice([0, 5, 60]))]
    state = {j: [p, c] for j, p, _, c in media}
    clones = {j for j, _, is_clone, _ in media if is_clone}
    for _, j, course, on in changes:
        if j not in state or j in clones or course not in (None, "", "a", "b", "c"):
            continue
        if course is None:
            state[j][0] = on
            if not on:
                state[j][1] = ""
            continue
        if course:
            for other in state:
                if other != j and state[other][1] == course:
                    state[other][1] = ""
            state[j][0] = True
        state[j][1] = course
    got = editing.practice_flags(spark.createDataFrame(media, "job_id long, practice boolean, is_clone boolean, course string"), spark.createDataFrame(changes, "seq long, job_id long, course string, on boolean"), ("a", "b", "c"))
    assert {x.job_id: [x.practice, x.course] for x in got.collect()} == state


def test_cluster_around(spark):
    r = random.Random(4)
    rows = [(j, i, j * 100 + i, r.random() < 0.75) for j in range(20) for i in range(r.randint(1, 25))]
    chosen = {}
    for j, _, i, _ in rows:
        if j != 3 and (j not in chosen or r.random() < 0.2):
            chosen[j] = i
    got = ordered.cluster_around(spark.createDataFrame(rows, "job_id long, idx long, id long, needs boolean"), spark.createDataFrame([(i,) for i in chosen.values()], "id long"), F.col("needs"), reach=4)
    want = []
    for j, pivot in chosen.items():
        job = [x for x in rows if x[0] == j]
        p = next(k for k, x in enumerate(job) if x[2] == pivot)
        low = high = p
        while low > 0 and p - (low - 1) <= 4 and job[low - 1][3]:
            low -= 1
        while high < len(job) - 1 and high + 1 - p <= 4 and job[high + 1][3]:
            high += 1
        want += [x[2] for x in job[low : high + 1]]
    assert sorted(x.id for x in got.collect()) == sorted(want)


def test_retranslated_leaves_people_s_work_and_unanswered_jobs_alone(spark):
    cues = spark.createDataFrame([(j, i, j * 10 + i, f"text {i}", "", "") for j in (1, 2) for i in range(5)], "job_id long, idx long, id long, text_stt string, text_llm string, text_final string")
    rows = [(10, 1, "fr", "own", "other", True, True), (12, 1, "fr", "fresh", "text 2", True, False), (13, 1, "fr", "stale", "old text", True, False), (13, 1, "ja", "kept", "old", False, False), (23, 2, "fr", "stale", "old", False, False)]
    renditions = spark.createDataFrame(rows, "cue_id long, job_id long, lang string, text string, hash_of string, reviewed boolean, edited boolean")
    model = cues.select(editing.fresh_hash(F.col("text_stt")).alias("source_hash"), F.concat(F.lit("new "), "text_stt").alias("text")).filter("text <> 'new text 0'").distinct()
    ask = lambda *i: {(x.cue_id, x.lang): (x.text, x.reviewed, x.edited) for x in editing.retranslated(cues, renditions, spark.createDataFrame([(k,) for k in i], "id long"), model, "fr").collect()}
    before = {(r[0], r[2]): (r[3], r[5], r[6]) for r in rows}
    # Cue 13 is stale, 14 has nothing; 12 is fresh and ends the cluster on the left.
    assert ask(13) == {**before, (13, "fr"): ("new text 3", False, False), (14, "fr"): ("new text 4", False, False)}
    # The cue that is asked for is taken even if a person wrote it; its neighbour 11 has nothing.
    assert ask(11) == {**before, (11, "fr"): ("new text 1", False, False)}
    assert ask(20) == before  # the model has no text for it, so its neighbours stay too


def test_corrected_writes_each_hash_once(spark):
    cues = spark.createDataFrame([(1, i, i, t, c, f) for i, (t, c, f) in enumerate([("teh cat", "cap", True), ("teh cat", "cap", True), ("", "from caption", False), ("plain", "", False), (" ", None, True), ("a term", "", False), ("known", "", True)])], "job_id long, idx long, id long, text_stt string, text_caption string, flagged boolean")
    pairs = spark.createDataFrame([("teh", "the", 2)], "wrong string, right string, count long")
    forms = spark.createDataFrame([("term",)], "form string")
    memo = spark.range(1).select(T.content_hash(20, F.lit("v1"), F.lit("known"), F.lit("")).alias("source_hash"), F.lit("KNOWN").alias("text"), F.lit(True).alias("changed"), F.lit(True).alias("uncertain"))
    routes = editing.correction_routes(cues, pairs, forms, memo, "v1", chunk=2)
    assert [(x.route, x.chunk, x.text) for x in routes.orderBy("id").collect()] == [("sent", 0, None), ("sent", 0, None), ("skipped", None, "from caption"), ("skipped", None, "plain"), ("skipped", None, ""), ("sent", 1, None), ("cached", None, "KNOWN")]
    answers = spark.createDataFrame([(0, "the cat!", False)], "id long, text string, uncertain boolean")
    text, new = editing.corrected(routes, answers)
    assert {x.id: x.text for x in text.collect()} == {0: "the cat!", 1: "the cat", 2: "from caption", 3: "plain", 4: "", 5: "a term", 6: "KNOWN"}
    assert sorted((x.text, x.changed) for x in new.collect()) == [("a term", False), ("the cat!", True)]
