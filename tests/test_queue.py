"""The request queue: order of release over several files, and what is left of a run that is cut off."""

import datetime as dt
import random
import uuid

import pytest

from cuelake.sources.storage import shared_folder
from cuelake.streaming import queue

SCHEMA = "lane long, request_id long, status string, created_at timestamp, run_us long, code int"
START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def micros(seconds):
    return int((at(seconds) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def put(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{number}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}"


def brute(rows, passed):
    """What workers do one request after another: (lane, seq, request, reclaimed, start, end, status, note)."""
    out, free, taken = [], {}, {}
    for lane, request, status, created, run, code in sorted((r for r in rows if r[1] is not None and r[2] in ("pending", "processing") and r[3] <= passed), key=lambda r: (r[3], r[1])):
        start = max(micros(created), free.get(lane, 0))
        free[lane] = start + run
        out.append((lane, taken.get(lane, 0), request, status == "processing", start, free[lane], "error" if code else "done", f"exit {code}" if code else ""))
        taken[lane] = taken.get(lane, 0) + 1
    return sorted(out)


def told(df):
    return sorted((r.lane, r.seq, r.request_id, r.reclaimed, r.started_us, r.ended_us, r.status, r.note) for r in df.collect())


def made(seed=1, n=60):
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 2]), i, r.choice(["pending", "pending", "processing", "done"]), r.randrange(0, 100), r.choice([0, 1, 30]) * 1_000_000, r.choice([0, 0, 3])) for i in range(n)]


def with_times(rows):
    return [(*r[:3], at(r[3]), *r[4:]) for r in rows]


def test_oldest_first_over_two_files(spark, folder):
    rows = made()
    put(spark, folder, 0, with_times(rows[::2]))
    put(spark, folder, 1, with_times(rows[1::2]))  # as old as those of the first file
    put(spark, folder, 2, [(-1, None, None, at(1000), 0, 0)])
    got = queue.worked(queue.released(stream(spark, folder), "200 seconds"), f"{folder}/work", lambda claimed: claimed)
    assert told(got) == brute(rows, 800)


def test_requests_wait_until_none_older_can_come(spark, folder):
    rows = [(1, 1, "pending", 50, 0, 0), (1, 2, "pending", 10, 0, 0), (1, 3, "pending", 90, 0, 0)]
    put(spark, folder, 0, with_times(rows))
    got = queue.worked(queue.released(stream(spark, folder), "30 seconds"), f"{folder}/work", lambda claimed: claimed)
    assert [r[2] for r in told(got)] == [2, 1]
    put(spark, folder, 1, with_times([(1, 4, "pending", 70, 0, 0), (-1, None, None, 500, 0, 0)]))
    got = queue.worked(queue.released(stream(spark, folder), "30 seconds"), f"{folder}/work", lambda claimed: claimed)
    assert [(r[1], r[2]) for r in told(got)] == [(0, 2), (1, 1), (2, 4), (3, 3)]  # the state went on where it was


def test_a_run_that_is_cut_off_goes_on(spark, folder):
    rows = made(2)
    early, late = [r for r in rows if r[3] < 50], [r for r in rows if r[3] >= 50]
    put(spark, folder, 0, with_times(early) + [(-1, None, None, at(60), 0, 0)])
    put(spark, folder, 1, with_times(late) + [(-1, None, None, at(1000), 0, 0)])
    runs = []

    def dies(claimed):
        runs.append(claimed.count())
        if len([n for n in runs if n]) == 2:
            raise RuntimeError("the worker was killed")
        return claimed

    with pytest.raises(Exception, match="the worker was killed"):
        queue.worked(queue.released(stream(spark, folder), "5 seconds"), f"{folder}/work", dies)
    want = brute(rows, 900)
    done = told(spark.read.parquet(f"{folder}/work/out"))
    left = sorted(r.request_id for r in queue.orphans(spark, f"{folder}/work").collect())
    assert done and left and len(done) + len(left) == len(want)
    assert set(left) == {r[2] for r in want} - {r[2] for r in done}
    got = queue.worked(queue.released(stream(spark, folder), "5 seconds"), f"{folder}/work", lambda claimed: claimed)
    assert told(got) == want
    assert queue.orphans(spark, f"{folder}/work").count() == 0


def test_an_empty_log(spark, folder):
    put(spark, folder, 0, [(-1, None, None, at(0), 0, 0)])
    assert queue.worked(queue.released(stream(spark, folder), "5 seconds"), f"{folder}/work", lambda claimed: claimed).count() == 0
