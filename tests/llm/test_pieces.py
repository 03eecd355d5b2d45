"""Operator 7: Viterbi against all segmentations, the trie against a dictionary, exact round trips."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import pieces

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(pieces.default_vocabulary())


@pytest.fixture(scope="module")
def names(vocab):
    """Piece -> id, from the model file."""
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=pieces.default_vocabulary())
    return {tool.id_to_piece(i): i for i in range(tool.get_piece_size()) if not (tool.is_control(i) or tool.is_unknown(i) or tool.is_byte(i))}


def test_trie_holds_the_pieces_and_no_others(vocab, names):
    def look(word):
        state = np.array([0])
        for c in word:
            state = vocab.trie.next(state, np.array([vocab.trie.codes.get(c, 0)]))
            if state[0] < 0:
                return -1
        return int(vocab.trie.value[state[0]])

    rnd = random.Random(3)
    for word in rnd.sample(sorted(names), 3000):
        assert look(word) == names[word]
        other = word[:-1] + rnd.choice("abcxyzé▁")
        assert look(other) == names.get(other, -1)


def best_score(chars, vocab, names, memo):
    """The best total over all segmentations, by recursion on the rest."""
    if not chars:
        return 0
    if chars not in memo:
        ways = []
        for k in range(1, min(len(chars), vocab.longest) + 1):
            if chars[:k] in names:
                ways.append(vocab.scores[names[chars[:k]]] + best_score(chars[k:], vocab, names, memo))
        if chars[0] not in names:
            ways.append(vocab.rarest - pieces.PENALTY + best_score(chars[1:], vocab, names, memo))
        memo[chars] = max(ways)
    return memo[chars]


def test_viterbi_finds_the_best(vocab, names):
    tool = pieces.Segmenter(vocab)
    words = ["▁the", "▁nation", "▁größe", "\nNext", "▁\U0001f600a", "▁▁▁x", "▁internationalisation", "q", "日本語", "▁" + "ab" * 25]
    for word, ids in zip(words, tool.segmented(words), strict=True):
        total = sum(vocab.scores[i] for i in ids if vocab.scores[i] > pieces.NEVER)
        missing = sum(c not in names for c in word)
        assert total + missing * (vocab.rarest - pieces.PENALTY) == best_score(word, vocab, names, {})
        assert tool.alone(list(word)).tolist() == ids.tolist()


HARD = ["", " ", "  a  b ", "a▁b", "\x00x\x00", "▁", "line\nline\n\n end\n", "tab\tcr\r", "\U0001f600é日", "own ▁ and own", "x" * 5000, "<0x41> <s> </s>", "a b"]


def test_round_trip(spark, vocab):
    tool = pieces.Segmenter(vocab)
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + HARD
    ids, ends = tool.encode(pa.array(texts))
    for t, own in zip(texts, np.split(ids, ends[:-1]), strict=True):
        assert tool.decode(own) == t
        again = tool.alone([pieces.MARK, *[pieces.OWN if c == pieces.MARK else pieces.MARK if c == " " else c for c in t]]) if t else np.zeros(0)
        assert again.tolist() == own.tolist()


def test_query(spark, make, odd):
    rows = [*odd, *[(100 + i, t) for i, t in enumerate(HARD)]]
    got = spark.createDataFrame(pieces.op7_sentencepiece(spark, make(rows)).toPandas()).collect()
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert sorted(r.text_sha256 for r in got) == want
    assert pieces.op7_sentencepiece(spark, make([])).collect() == []
