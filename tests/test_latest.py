"""Changed files as a stream: once a change, never an unchanged one, also after a restart."""

import os
import time

import pytest

from leafmill.streaming import incremental, latest


@pytest.fixture
def store(spark):
    before = spark.conf.get(latest.SETTING)
    latest.use_store(spark)
    yield
    spark.conf.set(latest.SETTING, before)


def put(folder, name, data, at):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data)
    os.utime(folder / name, (at, at))


def drained(spark, src, checkpoint, keep_ms=None):
    """What one run of the stream gives; each run is a restart from the checkpoint."""
    seen = []
    stream = latest.changed_files(incremental.new_files(spark, f"{src}/*"), keep_ms)
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(r.filename for r in df.collect())).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(seen)


def test_a_change_is_told_once(spark, tmp_path, store):
    src, check = tmp_path / "src", tmp_path / "check"
    src.mkdir()
    put(src / "a", "x.pdf", b"1", 1_700_000_000)
    put(src / "a", "y.pdf", b"1", 1_700_000_000)
    assert drained(spark, src, check) == ["x.pdf", "y.pdf"]
    assert drained(spark, src, check) == []
    # The same file again, in a new folder and later: unchanged. Another content: changed.
    put(src / "b", "x.pdf", b"1", 1_700_000_100)
    put(src / "b", "y.pdf", b"2", 1_700_000_100)
    assert drained(spark, src, check) == ["y.pdf"]
    # An older version that comes late changes nothing; two versions at once count as the last.
    put(src / "c", "y.pdf", b"1", 1_600_000_000)
    put(src / "d", "z.pdf", b"new", 1_700_000_300)
    put(src / "e", "z.pdf", b"old", 1_700_000_200)
    assert drained(spark, src, check) == ["z.pdf"]
    put(src / "f", "z.pdf", b"new", 1_700_000_400)
    assert drained(spark, src, check) == []


def test_a_forgotten_name_is_new_again(spark, tmp_path, store):
    """Timers need a stream that goes on: the file comes again after its name has been forgotten."""
    src, seen = tmp_path / "src", []
    put(src / "a", "x.pdf", b"1", 1_700_000_000)
    stream = latest.changed_files(incremental.new_files(spark, f"{src}/*"), 1)
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(r.filename for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        until(lambda: seen == ["x.pdf"])
        batch = query.lastProgress.batchId if query.lastProgress else 0
        until(lambda: query.lastProgress and query.lastProgress.batchId > batch + 1)
        put(src / "b", "x.pdf", b"1", 1_700_000_100)
        until(lambda: seen == ["x.pdf", "x.pdf"])
    finally:
        query.stop()


def until(test, seconds=40):
    began = time.time()
    while not test():
        assert time.time() - began < seconds
        time.sleep(0.2)
