"""The pipeline's stages against plain Python, each on its own input."""

import re
from collections import Counter

import corpus_pipeline
from leafmill.llm import pii

from .test_native import plain_base
from .test_near import plain as plain_near
from .test_repeats import plain as plain_cut

SMALL = "/root/testdata/sf0.001"


def stage(spark, docs, name, path=SMALL):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, path)
    if name != "best_fit_packing":
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    return out


def cut_words(rows):
    """doc_id -> text after the removal of repeats."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for k in range(len(w) - 49):
            least[tuple(w[k : k + 50])] = min(i, least.get(tuple(w[k : k + 50]), i))
    out = {}
    for (i, w), (_, t) in zip(split, rows, strict=True):
        gone = {x for k in range(len(w) - 49) if least[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    full = {r.doc_id: r for r in docs.collect()}
    first = stage(spark, docs, "language_id").collect()
    assert {r.doc_id for r in first} == {i for i, r in full.items() if any(c.isalpha() for c in r.text or "")}
    assert all(full[r.doc_id] == r for r in first)

    texts = [(i, r.text) for i, r in sorted(full.items())]
    second = stage(spark, docs, "minhash_near_dedup").collect()
    assert sorted(r.doc_id for r in second) == sorted(i for i, (_, c) in plain_near(texts, 5, 4, 5).items() if i == c)
    assert all(full[r.doc_id] == r for r in second)

    want = cut_words(texts)
    assert any(want[i] != t for i, t in texts) and plain_cut(texts)
    third = {r.doc_id: r for r in stage(spark, docs, "substring_dedup").collect()}
    assert {i: r.text for i, r in third.items()} == want
    assert all(r.n_chars == len(r.text) and r.lang == full[i].lang for i, r in third.items())

    fourth = {r.doc_id: r for r in stage(spark, docs, "pii").collect()}
    found = {r.doc_id: r.spans for r in pii.op10_pii(spark, SMALL).collect()}
    for i, t in texts:
        spans, out, at = [x.split(":") for x in found[i].split(",") if x], [], 0
        assert set(plain_base(t)) <= {(k, int(a), int(b)) for k, a, b in spans}
        for kind, a, b in ((k, int(a), int(b)) for k, a, b in spans):
            if a >= at:
                out += [t[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        assert fourth[i].text == "".join([*out, t[at:]]) and fourth[i].n_chars == len(fourth[i].text)


def test_run_and_sequences(spark):
    out = corpus_pipeline.run(spark, SMALL).collect()
    fills = Counter()
    for r in out:
        fills[r.sequence_id] += r.length
    assert out and max(fills.values()) <= 2048 and len(fills) <= sum(fills.values()) / 2048 * 1.1 + 2


def test_odd_rows(spark, make, odd):
    rows = [*odd, (40, "mail a@b.cd"), (41, None), (42, "12"), (43, "mail a@b.cd")]
    path = make(rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, _ in corpus_pipeline.STAGES:
        out = stage(spark, docs, name, path).collect()
        assert out
        if name in ("substring_dedup", "pii"):
            assert len(out) == len(rows)
        if name == "minhash_near_dedup":
            ids = Counter(r.doc_id for r in out)
            assert 43 not in ids and ids[40] == 1 and ids[4] == 0 and ids[1] == 1 and ids[None] == 1
    empty = spark.read.parquet(f"{make([])}/documents.parquet")
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, empty, name, path).collect() == []


def test_spans_reach_the_text(spark):
    assert max(pii.fitted()[1].values()) < float("inf")
