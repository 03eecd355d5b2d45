"""Operator 8: sums over segmentations against enumeration, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np

from leafmill.llm import langid

SMALL = "/root/testdata/sf0.001"


def enumerated(word, names, probs):
    """Probability of a word: the sum over all ways to cut it, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, min(langid.LONGEST, len(word)) + 1):
        p = probs[names[word[:k]]] if word[:k] in names else (langid.UNKNOWN if k == 1 else 0.0)
        total += p * enumerated(word[k:], names, probs)
    return total


def test_forward_sums_all_segmentations():
    tool = langid.pieces_of(langid.default_vocabulary())
    names = {p: i for i, p in enumerate(tool.names)}
    probs = np.random.default_rng(3).random((len(names), 2))
    probs /= probs.sum(axis=0)
    model = langid.Model(langid.default_vocabulary(), ["x", "y"], np.zeros(2), probs)
    words = [langid.MARK + w for w in ("the", "nation", "élan", "zzqx", "a", "größe", "日本")]
    got = model.word_scores(words)
    for w, row in zip(words, got, strict=True):
        for j in range(2):
            assert abs(row[j] - math.log(enumerated(w, names, probs[:, j]))) < 1e-9


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = langid.op8_langid(spark, SMALL).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_odd_rows(spark, make, odd):
    langs = {1: "en", 4: "en", 7: "fr", 9: "de"}
    rows = {(r.doc_id): r for r in langid.op8_langid(spark, make([*odd, (20, "12 34 !!"), (21, "x" * 5000)], langs)).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (2, 3, 5, 9, 20))
    assert all(rows[i].lang_pred in ("en", "fr") for i in (1, 4, 7, 8, 21, None))
    assert langid.op8_langid(spark, make([])).collect() == []
    assert {r.lang_pred for r in langid.op8_langid(spark, make([(1, "some words")])).collect()} == {"und"}


def test_long_pieces_are_found():
    tool = langid.pieces_of(langid.default_vocabulary())
    word = langid.MARK + "international"
    assert word in tool.names
    grid = tool.grid(np.array([[ord(c) for c in word]], np.uint64))
    assert tool.names[grid[0, len(word)][0]] == word


def test_all_words_of_the_sample_are_learned_from(spark, make, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda words, sizes, vocabulary: seen.update(words))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, "un deux trois trois quatre quatre" if k == 0 else "one two three four " * 3) for k, i in enumerate(ids)]
    path = make(rows, {i: "fr" if k == 0 else "en" for k, i in enumerate(ids)})
    langid.learned(spark.read.parquet(f"{path}/documents.parquet"))
    assert {k: sorted(v.values()) for k, v in seen.items()} == {"fr": [1, 1, 2, 2], "en": [3 * (len(ids) - 1)] * 4}


def test_fifty_languages(spark):
    """Rare languages keep all their words beside common ones."""
    rnd = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02d}": ["".join(rnd.choice(letters) for _ in range(rnd.randint(3, 9))) for _ in range(60)] for k in range(50)}
    rows, i = [], 0
    for k, (lang, own) in enumerate(words.items()):
        for _ in range(8 if k % 5 else 60):
            rows.append((i, " ".join(rnd.choices(own, k=40)), lang))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learned(docs)
    assert len(model.langs) == 50
    found = langid.predicted(docs, model).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
