"""Operator 13: passes against all tag sequences, gradients against differences, held-out labels, spans in place."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import toxicity as tox


def every_sequence(field, scores):
    """Marginals by summing over all tag sequences of one text."""
    ct, tc, tt, start = field.steps
    total, own = 0.0, np.zeros(len(scores))
    for tags in itertools.product((0, 1), repeat=len(scores)):
        s = start * tags[0] + sum(x * t for x, t in zip(scores, tags, strict=True))
        s += sum({(0, 1): ct, (1, 0): tc, (1, 1): tt, (0, 0): 0.0}[p] for p in zip(tags, tags[1:], strict=False))
        total += np.exp(s)
        own += np.exp(s) * np.array(tags)
    return own / total


@pytest.mark.parametrize("seed", range(5))
def test_marginals_are_those_of_all_sequences(seed):
    rnd = np.random.default_rng(seed)
    field = tox.Field(np.zeros(tox.BUCKETS), rnd.normal(0, 2, 4))
    sizes = rnd.integers(0, 9, 30)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    scores = rnd.normal(0, 3, bounds[-1])
    got = field.marginals(scores, bounds)
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b > a:
            assert np.allclose(got[a:b], every_sequence(field, scores[a:b]))


def test_long_text_equals_plain_passes():
    rnd = np.random.default_rng(1)
    field, n = tox.Field(np.zeros(tox.BUCKETS), np.array([-2.0, 1.0, 2.0, -1.0])), 20_000
    scores = rnd.normal(0, 8, n)
    a = np.exp(np.array([[0, -2.0], [1.0, 2.0]]))
    e = np.column_stack([np.ones(n), np.exp(np.clip(scores, -30, 30))])
    ahead, back = np.zeros((n, 2)), np.ones((n, 2))
    ahead[0] = e[0] * [1, np.exp(-1.0)]
    for t in range(1, n):
        ahead[t] = ahead[t - 1] @ a * e[t]
        ahead[t] /= ahead[t].sum()
    for t in range(n - 2, -1, -1):
        back[t] = a @ (e[t + 1] * back[t + 1])
        back[t] /= back[t].sum()
    both = ahead * back
    assert np.allclose(field.marginals(scores, np.array([0, n])), both[:, 1] / both.sum(axis=1))


def test_fitting_makes_the_tags_likelier():
    rnd = random.Random(0)
    texts = [" ".join(rnd.choice(["good", "fine", "bad", "badly"]) for _ in range(12)) for _ in range(60)]
    _, bounds, coded = tox.tokens_of(pa.array(texts))
    index, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
    tags = np.array([names[i].startswith("bad") for i in index]).astype(np.int64)
    field = tox.fit_field(tox.forms(names), index, bounds, tags)
    p = field.marginals(field.emissions(tox.forms(names))[index], bounds)
    assert p[tags == 1].min() > 0.9 and p[tags == 0].max() < 0.1
    assert field.emissions(tox.forms(["baddest"]))[0] > field.emissions(tox.forms(["finest"]))[0]


def drawn(n, seed=4):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        own, bad = rnd.choices(words, k=rnd.randint(5, 80)), rnd.random() < 0.2
        if bad:
            for _ in range(3):
                own.insert(rnd.randrange(len(own)), rnd.choice(["Vilewort", "VILEWORTEN", "grotbag!"]))
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def run(spark, make, rows, labels):
    path = make(rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return tox.op13_toxic_spans(spark, path).collect()


def test_held_out_labels_and_spans(spark, make):
    rows, labels = drawn(700)
    label, text = {i: t for i, _, t in labels}, dict(rows)
    got = run(spark, make, rows, labels)
    assert len(got) == 700
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == label[r.doc_id] for r in held) / len(held) > 0.97
    for r in held:
        own = {text[r.doc_id][slice(*map(int, s.split(":")))].lower() for s in r.spans.split(",") if s}
        assert own <= {"vilewort", "vileworten", "grotbag"} and bool(own) == bool(label[r.doc_id])


def test_labels_of_held_out_rows_are_not_used(spark, make):
    rows, labels = drawn(200)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    key = lambda r: r.doc_id
    assert sorted(run(spark, make, rows, labels), key=key) == sorted(run(spark, make, rows, turned), key=key)


def test_odd_rows(spark, make, odd):
    rows, labels = drawn(200)
    extra = [(1000 + k, t) for k, t in enumerate(["grotbag " * 50_000, "word " * 50_000 + "grotbag grotbag vilewort", "İGROTBAǴ ﬁ grotbag", "\x00 grotbag", "12345 !!"])]
    got = run(spark, make, [*rows, *[(None if i is None else 2000 + i, t) for i, t in odd], *extra], [*labels, (3000, 0, 1), (None, 0, 1), (5, 0, None), (6, 0, 7), *labels[:50]])
    assert len(got) == len(rows) + len(odd) + len(extra)
    by = {r.doc_id: r for r in got}
    assert by[1000].predicted == 1 and len(by[1000].spans.split(",")) == 50_000
    assert by[2002].score == by[2003].score == by[2005].score == by[1004].score < 0.5 and by[2003].spans == ""
    assert not by[None].held_out


def test_without_labels_or_documents(spark, make):
    assert [(r.score, r.predicted) for r in run(spark, make, [(1, "a b"), (2, None)], [])] == [(0.0, 0)] * 2
    assert all(r.score == 1.0 for r in run(spark, make, [(1, "a b"), (2, "c")], [(k, 0, 1) for k in range(9)]))
    assert run(spark, make, [], [(1, 0, 1), (2, 0, 0)]) == []
    assert len(run(spark, make, [(k, None) for k in range(9)], [(k, 0, k % 2) for k in range(9)])) == 9


def test_other_columns_pass(spark, make):
    rows, labels = drawn(60)
    docs = spark.read.parquet(f"{make(rows)}/documents.parquet")
    model = tox.learned(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = tox.tagged(docs, model)
    assert got.columns == [*docs.columns, "score", "spans"]
    assert {r.halo for r in got.collect()} == {"h"}


def test_a_text_of_18_megabytes():
    """Only the places of the offending words are told, however far apart they are."""
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(50_000)]
    own = rnd.choices(words, k=2_800_000)
    for k in (0, 1_400_000, 2_799_999):
        own[k] = "grotbag"
    field = tox.Field(np.zeros(tox.BUCKETS), np.array([-3.0, 0.0, 0.0, -3.0]))
    field.weights[0] = -4.0
    field.weights[tox.forms(["grotbag"])[0]] = 4.0
    field.weights[0] = -4.0
    _, bounds, coded = tox.tokens_of(pa.array([" ".join(own)]))
    p = tox.Tagger(field).marginals(bounds, coded)
    assert np.nonzero(p >= 0.5)[0].tolist() == [0, 1_400_000, 2_799_999]
