"""The state as a log: small appends, merge on read, compaction, crashes at every step."""

import os

import pytest

from leafmill.operators import state
from leafmill.schemas import STATE
from leafmill.sources import shared


def rows(spark, tmp_path, *pairs):
    """A written table of (filename, hash)."""
    path = f"{tmp_path}/new-{len(os.listdir(tmp_path))}"
    spark.createDataFrame([(n, h, "o", "t", "text of " + n, []) for n, h in pairs], STATE).write.parquet(path)
    return spark.read.parquet(path)


def held(spark, folder, only=None):
    return {r.filename: r.hash for r in state.load(spark, folder, only).collect()}


def files_under(folder):
    return sorted(os.path.join(d, f) for d, _, own in os.walk(folder) for f in own if f.endswith(".parquet"))


def test_a_run_writes_its_new_files_alone(spark, tmp_path):
    folder = f"{tmp_path}/state"
    state.append(rows(spark, tmp_path, *[(f"f{k}", "1") for k in range(200)]), folder)
    before = {f: os.stat(f).st_mtime_ns for f in files_under(folder)}
    state.append(rows(spark, tmp_path, ("f7", "2")), folder)
    state.compact(spark, folder, 0)
    added = set(files_under(folder)) - set(before)
    assert len(added) == 1 and all(os.stat(f).st_mtime_ns == t for f, t in before.items())
    assert not state.append(rows(spark, tmp_path, ("x", "1")).limit(0), folder)
    assert set(files_under(folder)) == set(before) | added
    assert held(spark, folder) == {f"f{k}": "2" if k == 7 else "1" for k in range(200)}
    assert held(spark, folder, "f7") == {"f7": "2"} and held(spark, folder, "none") == {}
    plan = state.load(spark, folder, "f7")._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]


def test_merges_keep_the_latest_and_old_segments_go(spark, tmp_path):
    folder, want = f"{tmp_path}/state", {}
    for k in range(20):
        new = [(f"f{(k * j) % 13}", f"{k}") for j in range(3)]
        new = list(dict(new).items())
        want.update(new)
        state.append(rows(spark, tmp_path, *new), folder)
        state.compact(spark, folder, 0, fan=3)
        assert held(spark, folder) == want
    live, _ = state.entries(spark, folder)
    assert len(live) < 9
    for _ in range(3):
        state.vacuum(spark, folder, 0)
    live, gone = state.entries(spark, folder)
    assert gone == [] and set(shared.names(spark, f"{state._base(folder)}/segments")) == {f"s={e.segment}" for e in live}
    assert held(spark, folder) == want


def test_crash_between_segment_and_entry(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/state"
    state.append(rows(spark, tmp_path, ("a", "1"), ("b", "1")), folder)

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(state, "_commit", crash)
        with pytest.raises(OSError):
            state.append(rows(spark, tmp_path, ("a", "2")), folder)
        with pytest.raises(OSError):
            state._stand_for(spark, folder, state._read(spark, folder, state.entries(spark, folder)[0]), state.entries(spark, folder)[0])
    assert held(spark, folder) == {"a": "1", "b": "1"}
    assert len(shared.names(spark, f"{state._base(folder)}/segments")) == 3
    state.append(rows(spark, tmp_path, ("a", "3")), folder)
    assert len(state.vacuum(spark, folder, 3600)) == 0 and len(state.vacuum(spark, folder, 0)) == 2
    assert held(spark, folder) == {"a": "3", "b": "1"}


def test_a_segment_appended_during_a_merge_is_not_lost(spark, tmp_path):
    folder = f"{tmp_path}/state"
    for k in range(3):
        state.append(rows(spark, tmp_path, ("a", str(k)), (f"b{k}", "1")), folder)
    seen = state.entries(spark, folder)[0]
    merged = state.merged(state._read(spark, folder, seen))
    state.append(rows(spark, tmp_path, ("a", "new"), ("c", "1")), folder)
    state._stand_for(spark, folder, merged, seen)
    assert held(spark, folder) == {"a": "new", "b0": "1", "b1": "1", "b2": "1", "c": "1"}


def test_clear(spark, tmp_path):
    folder = f"{tmp_path}/state"
    state.clear(spark, folder)
    state.append(rows(spark, tmp_path, ("a", "1")), folder)
    state.clear(spark, folder)
    assert held(spark, folder) == {}
    state.append(rows(spark, tmp_path, ("b", "1")), folder)
    assert held(spark, folder) == {"b": "1"}


def test_texts_of_unchanged_files_are_not_shuffled(spark, tmp_path):
    folder = f"{tmp_path}/state"
    state.append(rows(spark, tmp_path, *[(f"f{k}", "1") for k in range(50)]), folder)
    state.append(rows(spark, tmp_path, ("f1", "2")), folder)
    loaded = state.load(spark, folder)
    loaded.collect()
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan.split("Initial Plan")[0]
