"""Operator 11 against a plain form: whole texts by both libraries, all pairs of overlapping tokens."""

import base64
import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import align

SMALL = "/root/testdata/sf0.001"
FRAGMENTS = [" ", "  ", "   ", "\n", "\n\n", "\t", "a", "the", "word", "it's", "'ll", "1", "12345", "é", "ß", "日本語", "\U0001f600", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "\x01", "\x85", "\xa0", "　", "▁", "!", "...", "-", "a" * 16, "===", "Ω", "\r\n", "​", "x́"]


@pytest.fixture(scope="module")
def tools():
    return align.tokenizers_of(*align.default_vocabularies())


@pytest.fixture(scope="module")
def spelled():
    """The bytes of A's ids by the other public file of the same vocabulary, of B's by the library's own names."""
    import public_tokenizers as public
    import sentencepiece

    ranks = {int(r): base64.b64decode(x) for x, r in (line.split() for line in open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    tool = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    return ranks, lambda i: bytes([int(tool.id_to_piece(i)[3:5], 16)]) if tool.is_byte(i) else tool.id_to_piece(i).replace("▁", " ").encode()


def groups_of(text, tools, spelled):
    """(A ids, B ids, linked pairs) of each group of a whole text."""
    if not text:
        return []
    a, b = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
    a_bytes, b_bytes = [spelled[0][i] for i in a], [spelled[1](i) for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return []
    spans = [np.cumsum([0, *map(len, x)]).tolist() for x in (a_bytes, b_bytes)]
    edges = sorted(set(spans[0]) & set(spans[1]))
    out = []
    for x, y in zip(edges, edges[1:], strict=False):
        own = []
        for z, ids in zip(spans, (a, b), strict=True):
            p, q = bisect_left(z, x), bisect_left(z, y)
            own.append(list(zip(z[p:q], z[p + 1 : q + 1], ids[p:q], strict=True)))
        out.append(([i for *_, i in own[0]], [i for *_, i in own[1]], [(i, j) for s, e, i in own[0] for p, q, j in own[1] if s < q and p < e]))
    return out


def plain(rows, tools, spelled):
    found = [groups_of(t, tools, spelled) for _, t in rows]
    counts = Counter(pair for groups in found for *_, links in groups for pair in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = Counter()
    for (i, _), groups in zip(rows, found, strict=True):
        links = [p for *_, own in groups for p in own]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in groups)
        out[i, sum(len(a) for a, _, _ in groups), sum(len(b) for _, b, _ in groups), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""] += 1
    return out


def check(spark, path, tools, spelled):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = align.op11_groups(spark, path).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, tools, spelled)


def test_whole_table(spark, tools, spelled):
    check(spark, SMALL, tools, spelled)


def test_odd_rows(spark, make, odd, tools, spelled):
    rnd = random.Random(2)
    drawn = [(100 + k, "".join(rnd.choices(FRAGMENTS, k=rnd.randint(0, 12)))) for k in range(300)]
    check(spark, make([*odd, *drawn, (50, "a" * 20_000), (51, "xyzzy" * 4_000), (52, " " * 5000)]), tools, spelled)


def test_empty_table_and_texts_without_tokens(spark, make, tools, spelled):
    check(spark, make([]), tools, spelled)
    check(spark, make([(1, None), (2, ""), (3, "a▁b")]), tools, spelled)


def test_parts_are_what_whole_texts_give(tools, spelled):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(FRAGMENTS, k=rnd.randint(0, 12))) for _ in range(4000)]
    tool = align.Aligner(tools)
    flat, ends = tool.joined(pa.array(texts, pa.string()))
    names = tool.groups.to_pylist()
    for t, own in zip(texts, np.split(flat, ends[:-1]), strict=True):
        want = [",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in groups_of(t, tools, spelled)]
        assert ([] if (own == align.NO_PART).any() else [names[i] for i in own]) == want


def test_forgotten_parts_and_common_groups_change_nothing(spark, make, tools, spelled, monkeypatch):
    monkeypatch.setattr(align, "HOT", 3)
    check(spark, make([(k, "the house " * 40 + f"word{k} {k}x") for k in range(60)]), tools, spelled)
    import leafmill.llm.tokens as tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    tool = align.Aligner(tools)
    for k in range(6):
        text = " ".join(f"w{k}{j} the" for j in range(15))
        flat, _ = tool.joined(pa.array([text]))
        assert [tool.groups[i].as_py() for i in flat.tolist()] == [",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in groups_of(text, tools, spelled)]


def test_tables_of_the_operator(spark, make, tmp_path):
    docs = spark.read.parquet(f"{make([(1, 'the house'), (2, 'the house the'), (3, None)])}/documents.parquet")
    rows, dictionary, pairs = align.alignment(docs, f"file://{tmp_path}/work")
    assert rows.count() == 3
    assert {(r.freq, r.docs) for r in dictionary.collect()} == {(3, 2), (2, 2)}
    assert all(r.best and r.links in (2, 3) and r.docs_bound == 2 for r in pairs.collect())


def test_a_text_of_18_megabytes(tools):
    """Its groups spell it, on both sides, in memory that its tokens take."""
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(50_000)]
    text = " ".join(rnd.choices(words, k=2_800_000))
    tool = align.Aligner(tools)
    flat, ends = tool.joined(pa.array([text]))
    sides = [g.split("|") for g in tool.groups.to_pylist()]
    for side, spell in enumerate((tools.a_bytes, tools.b_bytes)):
        spoken = [b"".join(spell[int(i)] for i in s[side].split(",")) for s in sides]
        assert b"".join([spoken[i] for i in flat.tolist()]) == (" " + text).encode()
    assert ends.tolist() == [len(flat)]
