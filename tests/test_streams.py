"""Keyed streams against the same rules on whole tables, over several batches."""

import random

import pyarrow as pa

from reelgraph.operators import catalogue
from reelgraph.streaming import jobs

UPDATES = "id string, status string, updated_at long, seq long, note string"
MEDIA = "id string, filename string, size_bytes long, seq long"


def arrive(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def updates_of(seed, n, ids=6):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        time, seq = rng.choice([None, *range(12)]), rng.choice([None, k, k, k])
        note = f"{seed}-{k}" if k % 3 else None
        out.append((f"i{rng.randrange(ids)}", rng.choice(["processing", "completed", "failed"]), time, seq, note))
    return out


def test_latest_state_over_batches_replays_and_deletions(spark, rows, tmp_path):
    source, dead, sink, checkpoint = (str(tmp_path / x) for x in ("in", "dead", "out", "ck"))
    batches = [updates_of(seed, 40) for seed in range(5)]
    told = []
    for number, batch in enumerate([*batches, batches[1], batches[3]]):
        told += batch
        stream = arrive(spark, batch, UPDATES, source)
        gone = arrive(spark, [("i2",), (None,)] if number == 2 else [("i99",)], "id string", dead)
        jobs.latest_state_stream(stream, sink, checkpoint, tombstones=gone, compact_every=2).awaitTermination()
        deleted = spark.createDataFrame([("i2",)] if number >= 2 else [], "id string")
        want, _ = catalogue.latest_state(spark.createDataFrame(told, UPDATES), deleted)
        columns = ["id", "status", "updated_at"]
        got = jobs.current_state(spark, sink)
        assert got.columns == want.columns
        assert rows(got, *columns) == rows(want, *columns)
    written = jobs._folders(spark, sink, "batch")
    assert len(jobs._folders(spark, sink, "base")) == 2 and written[0] > jobs._folders(spark, sink, "base")[0]
    # The last two batches were replays: nothing changed, nothing was written.
    last = written[-1]
    assert spark.read.parquet(f"{sink}/batch={last}").where("not _deleted").count() == 0


def test_equal_times_and_missing_numbers(spark, rows, tmp_path):
    """A terminal state holds at equal times; a NULL number is the lowest."""
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for batch in (
        [("a", "completed", 2, None, "x"), (None, "completed", 2, 1, "x")],
        [("a", "processing", 2, 9, "x"), ("b", "completed", None, 3, "x")],
        [("a", "failed", 2, 1, "x"), ("a", "processing", 1, 99, "x")],
    ):
        jobs.latest_state_stream(arrive(spark, batch, UPDATES, source), sink, checkpoint).awaitTermination()
    assert rows(jobs.current_state(spark, sink), "id", "status", "seq") == [("a", "failed", 1)]
    stream = spark.readStream.schema(UPDATES).parquet(source)
    jobs.quarantine_stream(stream, str(tmp_path / "odd"), str(tmp_path / "odd-ck")).awaitTermination()
    odd = spark.read.parquet(str(tmp_path / "odd"))
    assert rows(odd, "id", "reason") == [("b", "unknown_time"), (None, "unknown_id")]


def test_batches_shrink_before_the_shuffle():
    """One row an id leaves an Arrow batch: the newest, deletions first."""
    batch = pa.RecordBatch.from_pydict({
        "id": ["a", "b", "a", "a", "b"], "status": ["completed", "x", "x", "x", "x"],
        "updated_at": [5, 1, 5, 4, 1], "seq": [None, 1, 9, 99, 2], "_deleted": [False, False, False, False, True],
    })
    kept = next(jobs._newest_of_batch(("completed",))(iter([batch])))
    assert kept.column("seq").to_pylist() == [None, 2]


def test_intake_remembers_ids_over_batches(spark, rows, tmp_path):
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    batches = [
        [("a", "x.mp4", 5, 1), ("b", "x.txt", 5, 2), ("a", "y.mp4", 5, 3), (None, "n.mp4", 5, 4), ("z", "n.mp4", 5, None)],
        [("a", "z.mp4", 5, 5), ("b", "x.MOV", 5, 6), ("c", "c.mkv", 0, 7), ("d", "d.mkv", 99, 8), ("c", "c.mkv", None, 9)],
        [("d", "d.mkv", 50, 11), ("d", "d.mkv", 50, 10), ("b", "b.mp4", 1, 12)],
    ]
    for batch in batches:
        jobs.intake_stream(arrive(spark, batch, MEDIA, source), sink, checkpoint, 50).awaitTermination()
    assert rows(spark.read.parquet(sink), "seq", "reason") == sorted([
        (1, None), (2, "unsupported_suffix"), (3, "duplicate_id"), (4, "unknown_id"), (None, "unknown_seq"),
        (5, "duplicate_id"), (6, None), (7, "empty_file"), (8, "too_large"), (9, "empty_file"),
        (10, None), (11, "duplicate_id"), (12, "duplicate_id"),
    ], key=repr)


def test_one_batch_of_intake_equals_the_table_rule(spark, rows, tmp_path):
    rng = random.Random(4)
    data = [(f"v{rng.randrange(9)}", rng.choice(["a.mp4", "a.txt"]), rng.randrange(60), k) for k in range(400)]
    rng.shuffle(data)
    stream = arrive(spark, data, MEDIA, str(tmp_path / "in"))
    jobs.intake_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), 50).awaitTermination()
    want = jobs.judge_intake(spark.createDataFrame(data, MEDIA), max_bytes=50)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "seq", "reason") == rows(want, "seq", "reason")
