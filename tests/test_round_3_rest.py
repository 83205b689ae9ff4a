"""Further cases of the third round's findings."""

from __future__ import annotations

import glob

import duckdb
from pyspark.sql import functions as F

from cuelake.operators import learning
from cuelake.plans import registry
from cuelake.sources import storage
from cuelake.streaming import queue


def test_stragglers_take_letters_as_sql_does(spark, tmp_path):
    rows = [(1, 0, "user", " ".join(["wo"] * 31)), (1, 1, "user", "thé")]  # recognised as té, which thé holds only without é
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(db.sql(registry.oracle_sql()["w13_stragglers"]).fetchall())
    assert sorted(tuple(r) for r in registry.queries()["w13_stragglers"](spark, str(tmp_path)).select("no", "word", "cue_id").collect()) == want
    assert want[-1] == (1001000, "té", 1001)


def test_requests_in_many_files_a_part_are_all_released(spark, tmp_path):
    spark.range(300).selectExpr(
        "id AS event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id * 40) AS ts", "id % 20 AS user_id", "'signup' AS event_type", "double(id % 5) AS value", "'' AS props"
    ).selectExpr("* EXCEPT (ts)", "cast(ts AS timestamp_ntz) AS ts").repartition(20, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.sql(registry.oracle_sql()["r1_ordered_release"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # a task, and so a file, for each that is read
    try:
        got = registry.queries()["r1_ordered_release"](spark, str(tmp_path)).select(*want.columns).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())


def test_a_batch_reads_only_requests_that_it_releases(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    class Store(dict):
        def __init__(self):
            super().__init__()
            self.read = 0

        def containsKey(self, k):
            return k in self

        def getValue(self, k):
            self.read += len(self[k][0]) if isinstance(self[k][0], bytes) else 0
            return self[k]

        def updateValue(self, k, v):
            self[k] = v

        def removeKey(self, k):
            del self[k]

        iterator, get, exists = dict.items, lambda self: self[0], lambda self: 0 in self

        def update(self, v):
            self[0] = v

    class Handle:
        def __init__(self):
            self.timers, self.stores = [], {}

        def getMapState(self, name, *_):
            return self.stores.setdefault(name, Store())

        getValueState = getMapState

        def listTimers(self):
            return self.timers

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    class Passed:
        def __init__(self, hours):
            self.hours = hours

        def getCurrentWatermarkInMs(self):
            return self.hours * 3_600_000

    lane, handle = queue.Lane(), Handle()
    lane.init(handle)
    hour, out = 3_600_000_000, []
    for batch in range(50):
        at = np.arange(20) * 5 * hour + batch
        new = pd.DataFrame({"created_us": at, "request_id": at, "reclaimed": False, "run_us": 2 * hour, "code": 0})
        list(lane.handleInputRows((1,), iter([new]), None))
        if batch == 30:
            out += list(lane.handleExpiredTimer((1,), Passed(1), None))
    assert handle.stores["waiting"].read == 31 * queue.REQUEST.itemsize
    out += list(lane.handleExpiredTimer((1,), Passed(1000), None))
    got = pd.concat(out)
    assert len(got) == 1000 and not handle.timers and not handle.stores["waiting"]
    free = 0
    for made, started, ended in got[["created_us", "started_us", "ended_us"]].itertuples(index=False):
        assert started == max(made, free)
        free = ended


def test_tracks_lie_in_ranges_of_jobs(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2500).selectExpr("if(id = 7, null, if(id % 2 = 0, 'en', 'ja')) AS lang", "if(id = 9, null, id) AS job_id", "'old' AS text")
    storage.write_tracks(rows, path)
    storage.write_tracks(rows.filter("job_id IN (4, 5, 7, 2400) OR job_id IS NULL").withColumn("text", F.lit("new")), path)
    storage.write_tracks(spark.createDataFrame([(None, 8, "new")], rows.schema), path)
    got = {(r.lang, r.job_id, r.text) for r in spark.read.parquet(path).collect()}
    assert got == {(r.lang, r.job_id, "new" if r.job_id in (4, 5, 7, 2400, None) else "old") for r in rows.collect()} | {(None, 8, "new")}
    assert len(glob.glob(f"{path}/*/jobs=*")) == 8  # and not a folder a job


def test_routes_make_the_pre_pass_once(spark, monkeypatch):
    made, calls = learning.pre_passed, []
    monkeypatch.setattr(learning, "pre_passed", lambda *a: calls.append(a) or made(*a))
    registry.queries()["e16_correct_routing"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
