"""Operators 5 and 9 against the tokenizers library on whole texts."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import idfiles, packing, tokens

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda t: tool.encode(t or "", add_special_tokens=False).ids


def rows_of(spark, path):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


HARD = ["", " ", "\n\n", None, "it's we'll '' 's", "á ́b", "x\x01y \x01", "<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ ß", "1234 5,6", " a　b\x85c\x1cd", "日本語 \U0001f600\U0001f600", "w" * 3000, "a\tb\rc\x0bd\x0ce"]


def test_piecewise_ids_equal_whole_text_ids(spark, whole):
    texts = [t for _, t in rows_of(spark, SMALL)] + HARD
    tool = tokens.Encoder(tokens.default_vocabulary())
    assert tool.by_piece
    ids, ends = tool.encode(pa.array(texts, pa.string()), 1)
    for t, part in zip(texts, np.split(ids, ends[:-1]), strict=True):
        assert part.tolist() == [*whole(t), 1]


def check_files(spark, path, rows, whole):
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.start, r.n_tokens, r.ids_crc32) for r in idfiles.op5_id_files(spark, path).collect())
    assert len(got) == len(rows)
    at, want = 0, Counter()
    for (there, i), start, n, _ in sorted(got, key=lambda x: x[1]):
        assert start == at
        at += n
    assert [g[0] for g in sorted(got, key=lambda x: x[1])] == sorted(g[0] for g in got)
    for i, t in rows:
        ids = [*whole(t), 1]
        want[(i is not None, i or 0), len(ids), crc(ids)] += 1
    assert Counter((k, n, c) for k, _, n, c in got) == want


def test_id_files(spark, whole):
    check_files(spark, SMALL, rows_of(spark, SMALL), whole)


def test_id_files_odd_rows(spark, make, odd, whole):
    rows = odd + [(50, f"copy {i % 3}") for i in range(500)] + [(-5, t) for t in HARD]
    check_files(spark, make(rows), rows, whole)
    assert idfiles.op5_id_files(spark, make([])).collect() == []


def test_fetch_by_key(spark, make, tmp_path, whole):
    rows = [(i * 7, f"text number {i}") for i in range(300)] + [(7, "again")]
    docs = spark.read.parquet(f"{make(rows)}/documents.parquet")
    path = idfiles.write_shards(docs, f"file://{tmp_path}/ids")
    assert [x.tolist() for x in idfiles.fetch(spark, path, 14)] == [[*whole("text number 2"), 1]]
    assert sorted(x.tolist() for x in idfiles.fetch(spark, path, 7)) == sorted([[*whole("text number 1"), 1], [*whole("again"), 1]])
    assert idfiles.fetch(spark, path, 15) == []


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    table = idfiles.PerfectHash.of(keys)
    assert sorted(table.number(keys).tolist()) == list(range(5000))


def check_packing(spark, path, rows, whole):
    got = packing.op9_packing(spark, path).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for a, n in sorted(places):
            assert a == at
            at += n
        assert at <= packing.CAPACITY
    want = Counter()
    total = 0
    for i, t in rows:
        ids = [*whole(t), 0]
        total += len(ids)
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[i, k, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    return len(bins), -(-total // 2048)


def test_packing(spark, whole):
    used, least = check_packing(spark, SMALL, rows_of(spark, SMALL), whole)
    assert used <= least + max(1, least // 50)


def test_packing_odd_rows(spark, make, odd, whole):
    check_packing(spark, make(odd + list(enumerate(HARD))), odd + list(enumerate(HARD)), whole)
    assert packing.op9_packing(spark, make([])).collect() == []


def test_best_fit_takes_the_fullest_bin():
    bins, offsets = packing.best_fit(np.array([60, 50, 40, 30, 20]), 100)
    loads = Counter()
    for b, n in zip(bins, [60, 50, 40, 30, 20], strict=True):
        loads[b] += n
    assert sorted(loads.values()) == [100, 100] and set(offsets) == {0, 60, 50, 80}
