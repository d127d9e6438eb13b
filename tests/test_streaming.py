from tests.test_ingest import csv, daily

from barloom.sources import store
from barloom.streaming import ingest_stream


def test_files_arrive_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    header = "symbol,exchange,timeframe,timestamp,open,high,low,close,volume"
    rows = [("abc", "nse", "1d", *r) for r in daily(12)]
    path = f"file://{tmp_path}/store"
    run = lambda: ingest_stream(spark, f"file://{tmp_path}/in", path, f"file://{tmp_path}/marks").awaitTermination()
    csv(tmp_path / "in", rows[:8], "a.csv", header)
    run()
    assert store.read_candles(spark, path).count() == 8
    csv(tmp_path / "in", rows[4:], "b.csv", header)
    run()
    assert store.read_candles(spark, path, ["ABC"]).count() == 12
    run()
    assert store.read_candles(spark, path).count() == 12


def test_two_streams_and_a_new_checkpoint_lose_nothing(spark, tmp_path):
    """The first batch of every stream has number 0; none replaces another one's candles."""
    header, path = "symbol,exchange,timeframe,timestamp,open,high,low,close,volume", f"file://{tmp_path}/store"
    rows = [("abc", "nse", "1d", *r) for r in daily(3)]
    for name, part in (("one", rows[:2]), ("two", rows[2:])):
        (tmp_path / name).mkdir()
        csv(tmp_path / name, part, "a.csv", header)
    run = lambda name, marks: ingest_stream(spark, f"file://{tmp_path}/{name}", path, f"file://{tmp_path}/{marks}").awaitTermination()
    run("one", "m1")
    assert store.read_candles(spark, path).count() == 2
    run("two", "m2")
    assert store.read_candles(spark, path).count() == 3 and len(store.committed(spark, path).writers) == 2
    run("one", "m3")  # the same files under another checkpoint
    assert store.read_candles(spark, path).count() == 3


def test_a_batch_that_runs_again_is_skipped(spark, tmp_path):
    """A crash between the commit to the store and the stream's own mark: the batch comes again."""
    import shutil

    header, path = "symbol,exchange,timeframe,timestamp,open,high,low,close,volume", f"file://{tmp_path}/store"
    (tmp_path / "in").mkdir()
    csv(tmp_path / "in", [("abc", "nse", "1d", *r) for r in daily(4)], "a.csv", header)
    run = lambda: ingest_stream(spark, f"file://{tmp_path}/in", path, f"file://{tmp_path}/marks").awaitTermination()
    run()
    before = store.committed(spark, path)
    assert len(before.batches) == 1 and list(before.writers.values()) == [0]
    shutil.rmtree(tmp_path / "marks" / "commits")
    run()
    assert store.committed(spark, path) == before and store.read_candles(spark, path).count() == 4


def test_streams_at_the_same_time(spark, tmp_path):
    header, path = "symbol,exchange,timeframe,timestamp,open,high,low,close,volume", f"file://{tmp_path}/store"
    running = []
    for k in range(3):
        (tmp_path / f"in{k}").mkdir()
        csv(tmp_path / f"in{k}", [(f"s{k}", "nse", "1d", *r) for r in daily(5)], "a.csv", header)
        running.append(ingest_stream(spark, f"file://{tmp_path}/in{k}", path, f"file://{tmp_path}/m{k}"))
    for q in running:
        q.awaitTermination()
    assert store.read_candles(spark, path).count() == 15 and len(store.committed(spark, path).writers) == 3
