"""Streams on Spark's own state: timers, restarts, replay by range, and a sink that takes each batch once."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.sources import log
from quarry.streaming import keyed, workers

COLUMNS = "k string, i long"


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, COLUMNS)


def feed(spark, path, pairs, **options):
    log.append(rows_of(spark, pairs), path, ["i"], **({"partitions": 2} | options))


def stream(spark, path):
    return log.stream(spark, path, COLUMNS, partitions=2)


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}"


def until(job, query, done, seconds=90):
    """Waits until done(rows so far) holds."""
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        found = job.rows().collect()
        if done(found):
            return found
        time.sleep(0.5)
    raise AssertionError(f"not there in time: {job.rows().collect()}")


def test_groups_fire_full_idle_and_at_the_end(spark, place):
    feed(spark, f"{place}/log", [("a", i) for i in range(45)] + [("b", 100 + i) for i in range(5)] + [(None, 200)])
    job = workers.Job(spark, lambda: keyed.accumulated(stream(spark, f"{place}/log"), ["k"], 20, 1000), f"{place}/job")
    query = job.start(processingTime="200 milliseconds")
    try:
        found = until(job, query, lambda rows: sum(len(r.rows) for r in rows) == 51)
    finally:
        query.stop()
    assert Counter((r.k, r.part, len(r.rows)) for r in found) == {("a", "full", 20): 2, ("a", "idle", 5): 1, ("b", "idle", 5): 1, (None, "idle", 1): 1}
    assert sorted(x.i for r in found for x in r.rows) == sorted([*range(45), *range(100, 105), 200])
    assert keyed.waiting(spark, job.checkpoint).count() == 0  # nothing is kept of groups that have fired


def test_restart_gives_each_row_once(spark, place):
    def make():
        return keyed.accumulated(stream(spark, f"{place}/log"), ["k"], 4, 86_400_000)

    feed(spark, f"{place}/log", [("a", i) for i in range(10)])
    workers.Job(spark, make, f"{place}/job").run()
    feed(spark, f"{place}/log", [("a", i) for i in range(10, 17)] + [("b", 50)])
    query = workers.Job(spark, make, f"{place}/job").start(processingTime="0 seconds")  # another query object on the same checkpoint
    time.sleep(2)
    query.stop()  # wherever it is
    job = workers.Job(spark, make, f"{place}/job")
    job.run()
    job.run()  # nothing new: nothing is written
    fired = [x.i for r in job.rows().collect() for x in r.rows]
    rest = [r.row.i for r in keyed.waiting(spark, job.checkpoint).collect()]
    assert len(fired) == 16 and sorted(fired + rest) == [*range(17), 50]


def test_completion_and_late_nodes_in_any_order(spark, place):
    runs = "ingestion_id string, produced long, received long, finalised boolean, i long"
    parts = [[("x", 2, 0, False, 0), ("x", 0, 1, False, 1), ("y", 1, 1, False, 2)], [("y", 0, 0, True, 3), ("x", 0, 0, True, 4), ("z", None, None, None, 5)], [("x", 0, 1, False, 6), ("y", 0, 5, True, 7)]]
    job = workers.Job(spark, lambda: keyed.completed(log.stream(spark, f"{place}/runs", runs, partitions=2).drop("i"), "ingestion_id"), f"{place}/a")
    for part in parts:
        log.append(spark.createDataFrame(part, runs), f"{place}/runs", ["i"], partitions=2)
        job.run()
    assert sorted((r.ingestion_id, r.produced, r.received) for r in job.rows().collect()) == [("x", 2, 2), ("y", 1, 1)]
    graph = "kind string, src string, dst string, i long"
    parts = [[("edge", "a", "1", 0), ("edge", "a", "1", 1), ("edge", "b", "1", 2)], [("node", "a", None, 3), ("edge", "a", "2", 4)], [("edge", "a", "1", 5), ("node", "a", None, 6), ("edge", "a", "3", 7), ("node", "c", None, 8), ("edge", "c", None, 9)]]
    job = workers.Job(spark, lambda: keyed.edges_with_nodes(log.stream(spark, f"{place}/graph", graph, partitions=2).drop("i")), f"{place}/b")
    for part in parts:
        log.append(spark.createDataFrame(part, graph), f"{place}/graph", ["i"], partitions=2)
        job.run()
    assert sorted(((r.src, r.dst) for r in job.rows().collect()), key=repr) == [("a", "1"), ("a", "2"), ("a", "3"), ("c", None)]


def test_replay_opens_only_what_it_needs(spark, place, tmp_path):
    base = 1_700_000_000
    rows = spark.createDataFrame([(f"k{i % 3}", i, base + i) for i in range(100)], f"{COLUMNS}, s long").withColumn("ts", F.timestamp_seconds("s"))
    for lo in (0, 40, 80):
        log.append(rows.where(f"i >= {lo} and i < {lo + 40}"), f"{place}/log", ["i"], time_col="ts", partitions=1, segment_rows=10)
    columns = f"{log.ddl(rows)}, partition int, offset long"
    everything = log.replay(spark, f"{place}/log", columns).collect()
    assert sorted((r.offset, r.i, r.ts.timestamp()) for r in everything) == [(i, i, base + i) for i in range(100)]
    some = log.replay(spark, f"{place}/log", columns, startingOffsets='{"0": 42}', endingOffsets='{"0": 57}')
    timed = log.replay(spark, f"{place}/log", columns, startingMillis=(base + 42) * 1000, endingMillis=(base + 56) * 1000)
    for r in spark.read.parquet(f"{place}/log/index").where("stop <= 42 or first > 56").collect():  # what lies outside is not even there
        for f in (tmp_path / "log" / "records" / r.run / f"__partition={r.partition}" / f"__slice={r.slice}").iterdir():
            f.unlink()
    assert sorted(r.i for r in some.collect()) == sorted(r.i for r in timed.collect()) == list(range(42, 57))
    # records that are not in the index are not read
    (tmp_path / "log" / "index").rename(tmp_path / "log" / "gone")
    assert log.replay(spark, f"{place}/log", columns).collect() == []


def test_batches_are_committed_once(spark, place, tmp_path):
    rows = rows_of(spark, [(f"k{i}", i) for i in range(50)]).repartition(3)
    log.put(rows, f"{place}/table", 7)
    log.put(rows.limit(3), f"{place}/table", 7)  # the batch is there already
    log.put(rows.limit(0), f"{place}/table", 8)
    fail = F.udf(lambda i: 1 // (i - 49) and i, "long")
    with pytest.raises(Exception):  # noqa: B017
        log.put(rows.withColumn("i", fail("i")), f"{place}/table", 9)
    got = log.got(spark, f"{place}/table", f"{COLUMNS}, batch long").collect()
    assert sorted((r.k, r.i, r.batch) for r in got) == sorted((f"k{i}", i, 7) for i in range(50))
    assert sorted(p.name for p in (tmp_path / "table" / "manifests").iterdir()) == ["00000000000000000007.json", "00000000000000000008.json"]
    log.sweep(f"{place}/table", older_s=0)  # what tasks left that were killed with the failed one
    assert sum(1 for _ in (tmp_path / "table" / "files").iterdir()) == 3
    assert log.got(spark, f"{place}/table", COLUMNS).count() == 50
    assert log.got(spark, f"{place}/none", f"{COLUMNS}, batch long").collect() == []


def test_latest_of_an_update_job(spark, place):
    columns = "entity_id string, at long, action string"
    job = workers.Job(spark, lambda: workers.changes_applied(log.stream(spark, f"{place}/log", columns, partitions=2), order="at"), f"{place}/job", update=True)
    for part in ([("a", 5, "update"), ("b", 1, "create")], [("a", 3, "create"), ("b", 2, "noise")], [("b", 9, "delete"), ("c", 4, "create")]):
        log.append(spark.createDataFrame(part, columns), f"{place}/log", ["at"], partitions=2)
        job.run()
    assert sorted((r.entity_id, r.at, r.action) for r in job.latest("entity_id").collect()) == [("a", 5, "update"), ("b", 9, "delete"), ("c", 4, "create")]
    assert job.rows().count() <= 6  # a batch writes what it changed
