"""Streams in several micro-batches, with disorder, late rows and a restart, against the folds over tables; sinks that batches reach twice."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.streaming import stateful
from tidewell.streaming.exactly_once import LedgerSink, RepairQueue

SCHEMA = "key long, event_id long, ts timestamp, failed boolean, priority long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def event_files(spark, folder, n=5, seed=4):
    """Files of events, each later than the one before but for disorder of up to 8 seconds; the last has an event a day later that lets the watermark pass all."""
    rng = random.Random(seed)
    events, t = [], 0.0
    for i in range(n * 60):
        t += rng.choice([0.05, 0.1, 0.4, 2.0])
        events.append((rng.randrange(4), i, t, rng.random() < 0.5, rng.randrange(3)))
    order = sorted(events, key=lambda e: e[2] + rng.uniform(0, 8))
    late = [(1, 10_000, 0.5, True, 2)]
    parts = [order[k * 60 : (k + 1) * 60] for k in range(n)]
    parts[3] += late  # long past the watermark
    parts.append([(99, 20_000, t + 86_400, False, 0)])
    parts.append([(99, 20_001, t + 172_800, False, 0)])
    for k, part in enumerate(parts):
        df = spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in part], "key long, event_id long, t double, failed boolean, priority long")
        df = df.select("key", "event_id", F.timestamp_micros((F.lit(1_700_000_000_000_000) + F.round(F.col("t") * 1e6)).cast("long")).alias("ts"), "failed", "priority")
        df.coalesce(1).write.parquet(f"{folder}/part{k}")
    return len(parts)


def run(spark, stream, folder, name):
    sink = LedgerSink(spark, f"{folder}/{name}/out", name_schema[name])
    query = stream.writeStream.foreachBatch(sink.write).option("checkpointLocation", f"{folder}/{name}/checkpoint").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return sink


LIMITED = "key long, event_id long, accepted boolean"
name_schema = {"bucket": LIMITED, "breaker": "key long, event_id long, state string, allowed boolean", "debounce": "key long, batch long, n long, first_id long, last_id long, lead_id long"}
FOLDS = {
    "bucket": (lambda e: stateful.token_bucket(e, 3.0, 0.2), lambda e: stateful.token_bucket_stream(e, 3.0, 0.2)),
    "breaker": (lambda e: stateful.circuit_breaker(e, 6, 50, 5.0, 2), lambda e: stateful.circuit_breaker_stream(e, 6, 50, 5.0, 2)),
    "debounce": (lambda e: stateful.debounced(e, 1.0, 4.0), lambda e: stateful.debounced_stream(e, 1.0, 4.0)),
}


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_stream_equals_the_fold(spark, tmp_path, rocks, name):
    n = event_files(spark, f"{tmp_path}/all")
    batch, stream = FOLDS[name]
    (tmp_path / "in").mkdir()
    for part in (range(3), range(3, n)):  # a stop and a restart from the checkpoint between them
        for k in part:
            for f in (tmp_path / f"all/part{k}").glob("part-*.parquet"):
                f.rename(tmp_path / f"in/{k}-{f.name}")
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        sink = run(spark, stream(source), tmp_path, name)
    got = sorted(map(tuple, sink.rows().where("key < 99").select(*[c.split()[0] for c in name_schema[name].split(", ")]).collect()))
    on_time = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in").where("key < 99 AND event_id < 10000")
    want = sorted(map(tuple, batch(on_time).collect()))
    assert got == want and len(got) > 20
    assert sink.ledger().count() > 4


def test_replayed_batches_add_nothing(spark, tmp_path):
    sink = LedgerSink(spark, f"{tmp_path}/sink", "id long, x string")
    assert sink.rows().count() == sink.ledger().count() == 0
    batch = lambda *ids: spark.createDataFrame([(i, f"x{i}") for i in ids], "id long, x string")
    sink.write(batch(1, 2), 0)
    sink.write(batch(3), 1)
    sink.write(batch(1, 2), 0)
    assert sorted(r["id"] for r in sink.rows().collect()) == [1, 2, 3]
    batch(4, 5).write.parquet(f"{tmp_path}/sink/rows/sink_batch=2")  # cut short before its line in the ledger
    assert sink.rows().count() == 3
    sink.write(batch(4, 5, 6), 2)
    assert sorted(r["id"] for r in sink.rows().collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted((r["sink_batch"], r["n"]) for r in sink.ledger().collect()) == [(0, 2), (1, 1), (2, 3)]


def test_repair_rounds(spark, tmp_path):
    failures = LedgerSink(spark, f"{tmp_path}/failed", "id long, x string")
    queue = RepairQueue(failures, most=3, rows=4)
    assert queue.round(lambda due: due) == -1
    failures.write(spark.createDataFrame([(i, "a") for i in range(6)], "id long, x string"), 0)
    failures.write(spark.createDataFrame([(0, "b")], "id long, x string"), 1)  # a row that fails anew counts once, its newest values
    even = lambda due: due.where("id % 2 = 0")
    assert queue.round(even) == 1
    state = {r["id"]: (r["x"], r["tries"], r["outcome"]) for r in queue.states().collect()}
    assert state == {0: ("b", 1, "done"), 1: ("a", 1, "retry"), 2: ("a", 1, "done"), 3: ("a", 1, "retry"), 4: ("a", 0, "pending"), 5: ("a", 0, "pending")}
    write, queue.outcomes.write = queue.outcomes.write, lambda *a: None  # a round that is lost
    assert queue.round(even) == 2
    queue.outcomes.write = write
    assert queue.round(even) == 2 and queue.round(even) == 3 and queue.round(even) == 4
    state = {r["id"]: (r["tries"], r["outcome"]) for r in queue.states().collect()}
    assert state == {0: (1, "done"), 1: (3, "dead"), 2: (1, "done"), 3: (3, "dead"), 4: (1, "done"), 5: (3, "dead")}
    assert queue.round(even) == -1
