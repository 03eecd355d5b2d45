"""Operator 6 against all pairs, its words and its components."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import links, near
from leafmill.llm.words import Words, runs

SMALL = "/root/testdata/sf0.001"


def plain(rows, width, part, whole, lower=True):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(len(w) - width, 0) + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * whole >= max(len(x), len(y)) * part:
                both = len(x & y)
                if whole * both >= part * (len(x) + len(y) - both):
                    u, v = find(a), find(b)
                    root[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, path, width=3, part=85, whole=100):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain(rows, width, part, whole)
    got = near.near_groups(docs, width, (part, whole)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)
    return want


def test_small_table(spark):
    want = check(spark, SMALL)
    assert any(c != i for i, (_, c) in want.items())
    check(spark, SMALL, 5, 4, 5)


def test_dense_groups(spark, make):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(120)] for _ in range(3)]
    rows = []
    for i in range(240):
        words = list(base[i % 2])
        for _ in range(i % 4):
            words[rnd.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(300 + i, " ".join(base[2][: 120 - i])) for i in range(60)]
    rows += [(400 + i, " ".join(word() for _ in range(60))) for i in range(60)]
    check(spark, make(rows))


@pytest.mark.parametrize("hub", [-1, 5000])
def test_star_group(spark, make, hub):
    """Copies that are each close to one original and not to each other, more than a region pairs."""
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(402)]
    rows = [(hub, " ".join(base))]
    for i in range(1200):
        words = list(base)
        for k in range(10):
            words[rnd.randrange(40 * k + 2, 40 * k + 38)] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[k : k + 3]) for k in range(400)} for _, t in rows]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert min(alike(sets[0], x) for x in sets[1:]) >= 0.85
    assert max(alike(sets[1], x) for x in sets[2:]) < 0.85
    got = near.near_groups(spark.read.parquet(f"{make(rows)}/documents.parquet"), 3, (85, 100)).collect()
    assert len(got) == 1201 and {r.component_id for r in got} == {min(hub, 0)}


def star(n, seed=11):
    """An original and n copies, each at 0.85 to it at least and below that to each other."""
    rnd, base = random.Random(seed), [f"w{seed}_{i}" for i in range(402)]
    out = [" ".join(base)]
    for i in range(n):
        words = list(base)
        for k in range(10):
            words[rnd.randrange(40 * k + 2, 40 * k + 38)] = f"x{seed}_{i}y{k}"
        out.append(" ".join(words))
    return out


@pytest.fixture
def parts_of(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("parts", [4, 200])
def test_components_whatever_the_number_of_tasks(spark, make, parts_of, parts, monkeypatch):
    """Stars of sizes around a region's, on their own and among each other, also in more tasks than there are rows in a region."""
    monkeypatch.setattr(near, "LEAST_ROWS", 1)
    parts_of(parts)
    rows, centre = [], []
    for k, n in enumerate([5, 20, 23, 24, 25, 30, 47, 48, 49, 50]):
        for t in star(n, 11 + k):
            rows.append((len(rows), t))
            centre.append(len(rows) - 1 if not centre or t == star(n, 11 + k)[0] else centre[-1])
    turned = [(len(rows) - 1 - i if i % 2 else i, t) for i, t in rows]
    want = {}
    for (i, _), c in zip(turned, centre, strict=True):
        want.setdefault(c, []).append(i)
    least = {i: min(own) for own in want.values() for i in own}
    got = near.near_groups(spark.read.parquet(f"{make(turned)}/documents.parquet"), 3, (85, 100)).collect()
    assert {r.doc_id: r.component_id for r in got} == least


def test_small_stars_in_very_many_tasks(spark, make, parts_of, monkeypatch):
    monkeypatch.setattr(near, "LEAST_ROWS", 1)
    parts_of(400)
    rows = list(enumerate([*star(20), *star(23, 12)]))
    got = near.near_groups(spark.read.parquet(f"{make(rows)}/documents.parquet"), 3, (85, 100)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 0 if i < 21 else 21 for i, _ in rows}


def test_block_counts():
    rnd = np.random.default_rng(3)
    left, right = ([np.unique(rnd.integers(0, 9000, rnd.integers(1, 9000)).astype(np.uint64)) for _ in range(n)] for n in (7, 9))
    assert near.block_counts(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]


def test_odd_rows(spark, make):
    rows = [(1, "A b"), (2, None), (3, ""), (4, "a B"), (5, " \t\n"), (7, "word " * 30000), (8, "word word word word"), (9, "é ß"), (10, "x y z w"), (12, "X Y\nZ W")]
    want = check(spark, make(rows))
    assert want[4][1] == 1 and want[12][1] == 10 and want[8][1] == 7
    got = near.near_groups(spark.read.parquet(f"{make([(None, 'a b c'), (3, 'a b c'), (3, 'a b c')])}/documents.parquet")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (3, 3, True), (3, 3, True)]
    assert near.op6_lsh_forest(spark, make([])).collect() == []


def test_sql_gives_the_same(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(near.OP6_SQL).project("doc_id, n_shingles, component_id, kept").fetchall()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.op6_lsh_forest(spark, SMALL).collect()}
    assert got == want


def test_components(spark, tmp_path):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (500, 3)]
    got = links.components(spark.createDataFrame(chain, "a long, b long"), f"file://{tmp_path}/c").collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(41)}, 500: 0, 100: 100, 101: 100}
    assert links.components(spark.createDataFrame([], "a long, b long"), f"file://{tmp_path}/d").collect() == []


@pytest.mark.parametrize("sliced", [False, True])
def test_word_hashes(sliced):
    rnd = random.Random(2)
    texts = ["a b c", None, "", " x", "y ", "s s\n\tS", "é ü ab", "a", "b\x0bc\x0cd\x1ce", *[" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 60))) for _ in range(60)]]
    words = Words(pa.array(["zz q", *texts]).slice(1) if sliced else pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        own = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert len(words.of(i)) == len(own)
        for width in (1, 3, 26):
            for k, h in enumerate(runs(words.of(i), width).tolist()):
                assert seen.setdefault((width, *own[k : k + width]), h) == h
    assert len(set(seen.values())) == len(seen)
    assert np.uint64(near.digest(words.of(0))[0] % (1 << 64)) is not None
