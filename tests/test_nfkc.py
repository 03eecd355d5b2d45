"""Folding of a batch of texts in slices."""

import tracemalloc
import unicodedata

import pyarrow as pa

from leafmill.functions import strings as S


def test_slices_give_the_same_texts(monkeypatch):
    texts = ["ﬁne", None, "", "plain", "é", "½" * 50] * 40
    want = [t and unicodedata.normalize("NFKC", t) for t in texts]
    for size in (1, 200, 1 << 20):
        monkeypatch.setattr(S, "SLICE_BYTES", size)
        assert S.nfkc.func(pa.array(texts)).to_pylist() == want
    assert S.nfkc.func(pa.array([], pa.string())).to_pylist() == [] and S.nfkc.func(pa.array([None], pa.string())).to_pylist() == [None]


def test_few_texts_of_a_batch_are_python_strings_at_once():
    batch = pa.array([f"{i} ﬁ" + "x" * 2000 for i in range(10_000)])
    tracemalloc.start()
    folded = S.nfkc.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(folded) == 10_000 and folded[7].as_py().startswith("7 fix") and peak < 12 << 20
