"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's
probability in a language is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words; the prediction is the
language with the largest posterior, and the score that posterior. Piece probabilities
are fitted by expectation-maximisation over the same segmentations.

A word is a run of letters, lower case, with the vocabulary's word mark before it; runs
over CHUNK letters are taken CHUNK at a time. A letter that is no piece has a small
fixed probability in all languages. Fitting is on a bounded sample: all words of about
SAMPLE_DOCS whole documents of each language, drawn by a hash of doc_id. Prediction reads
every whole text.

Null text or a text with no letter: `und`, score 0. With no labelled rows all is `und`.
Null doc_id: not learned from, not held out. Repeated rows give repeated results.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, mapped, small_table, tidy
from .tokens import TOKEN_BYTES, slices

SAMPLE_DOCS = 400
ROUNDS = 3
CHUNK = 32
#: No piece found in a stretch is longer: its letters and the mark.
LONGEST = CHUNK + 1
#: Scores of remembered words, and of words scored at once.
REMEMBERED, AT_ONCE = 1_600_000, 16_384
UNKNOWN = 1e-7
SMOOTHING = 0.1
MARK = "▁"
UND = "und"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Finds pieces by hash, many at a time."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    WIDTH = 20

    def __init__(self, path: str):
        import sentencepiece

        tool = sentencepiece.SentencePieceProcessor(model_file=path)
        every = {tool.id_to_piece(i) for i in range(tool.get_piece_size())}
        self.names = sorted(p for p in every if len(p) <= LONGEST and p == p.lower() and (p == MARK or p.lstrip(MARK).isalpha()) and p.rfind(MARK) <= 0)
        self.longest = max(map(len, self.names), default=1)
        self.tables = []
        left, keys = np.arange(len(self.names)), np.array([self._hash(p) for p in self.names], np.uint64)
        while len(left):
            slot = self._slot(keys[left], len(self.tables))
            _, first = np.unique(slot, return_index=True)
            key, number = np.zeros(1 << self.WIDTH, np.uint64), np.full(1 << self.WIDTH, -1, np.int32)
            key[slot[first]], number[slot[first]] = keys[left[first]], left[first]
            self.tables.append((key, number))
            left = np.delete(left, first)

    def _hash(self, piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = self._next(h, np.array([ord(c)], np.uint64))
        return h[0]

    def _next(self, h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h + codes + np.uint64(1)) * self.BASE

    def _slot(self, h: np.ndarray, turn: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h ^ (h >> np.uint64(29 + turn))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.WIDTH)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        for turn, (key, number) in enumerate(self.tables):
            slot = self._slot(h, turn)
            hit = (key[slot] == h) & (number[slot] >= 0)
            out[hit] = number[slot[hit]]
        return out

    def grid(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """codes: words of one length, a row each. For (start, length): the piece there, -1 for none; empty columns left out."""
        n, width = codes.shape
        out = {}
        for i in range(width):
            h = np.zeros(n, np.uint64)
            for k in range(1, min(self.longest, width - i) + 1):
                h = self._next(h, codes[:, i + k - 1])
                got = self.find(h)
                if k == 1 or (got >= 0).any():
                    out[i, k] = got
        return out


@functools.lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def by_length(words: list[str]):
    """(indices, code matrix) for each length."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes).tolist():
        index = np.nonzero(sizes == size)[0]
        flat = "".join(words[i] for i in index.tolist()).encode("utf-32-le")
        yield index, np.frombuffer(flat, "<u4").reshape(len(index), size).astype(np.uint64)


def _weight(probs: np.ndarray, got: np.ndarray, k: int) -> np.ndarray:
    """Probability of each found piece in each language; a lone letter always has some."""
    p = probs[got]
    p[got < 0] = UNKNOWN if k == 1 else 0.0
    return p


def forward(grid: dict, n: int, width: int, probs: np.ndarray) -> np.ndarray:
    """alpha[j]: total probability of the first j letters, a row for each word, a column for each language."""
    alpha = np.zeros((width + 1, n, probs.shape[1]))
    alpha[0] = 1.0
    for i in range(width):
        for k in range(1, min(LONGEST, width - i) + 1):
            if (i, k) in grid:
                alpha[i + k] += alpha[i] * _weight(probs, grid[i, k], k)
    return alpha


@dataclass
class Model:
    vocabulary: str
    langs: list[str]
    log_prior: np.ndarray
    probs: np.ndarray  # pieces x languages

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (mark and at most CHUNK letters) in each language."""
        out = np.zeros((len(words), len(self.langs)))
        tool = pieces_of(self.vocabulary)
        step = max(AT_ONCE // len(self.langs), 64)
        for index, codes in by_length(words):
            for a in range(0, len(index), step):
                part = codes[a : a + step]
                alpha = forward(tool.grid(part), len(part), part.shape[1], self.probs)
                out[index[a : a + step]] = np.log(alpha[-1])
        return out


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Bounds of each text's words, and the words."""
    lower = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    spaced = pc.replace_substring_regex(lower, r"[^\pL]+", " ")
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))
    bounds = np.asarray(words.offsets)
    return bounds - bounds[0], words.flatten().dictionary_encode()


def chunks(word: str) -> list[str]:
    if len(word) < CHUNK:
        return [MARK + word]
    return [MARK * (i == 0) + word[i : i + CHUNK - 1] for i in range(0, len(word), CHUNK - 1)]


class Scorer:
    """Sums of word scores for each text; words are remembered up to REMEMBERED scores."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.scores = np.zeros((0, len(model.langs)))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods (a row for each text) and the number of words."""
        bounds, coded = split_words(texts)
        names = coded.dictionary.to_pylist()
        if (len(self.at) + len(names)) * self.scores.shape[1] > REMEMBERED:
            self.at, self.scores = {}, self.scores[:0]
        if new := [w for w in names if w not in self.at]:
            parts = [chunks(w) if w else [] for w in new]
            flat = [c for p in parts for c in p]
            own = np.concatenate([np.zeros((1, self.scores.shape[1])), np.cumsum(self.model.word_scores(flat), axis=0)]) if flat else np.zeros((1, self.scores.shape[1]))
            ends = np.cumsum([len(p) for p in parts])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, own[ends] - own[np.concatenate([[0], ends[:-1]])]])
        index = np.array([self.at[w] for w in names], np.int64)[np.asarray(coded.indices)] if names else np.zeros(0, np.int64)
        real = (np.array([bool(w) for w in names])[np.asarray(coded.indices)] if names else np.zeros(0, bool)).astype(np.int64)
        sums = np.concatenate([np.zeros((1, self.scores.shape[1])), np.cumsum(self.scores[index], axis=0)])
        count = np.concatenate([[0], np.cumsum(real)])
        return sums[bounds[1:]] - sums[bounds[:-1]], count[bounds[1:]] - count[bounds[:-1]]


def fit(words: dict[str, dict[str, int]], docs: dict[str, int], vocabulary: str) -> Model:
    """words: counts of words by language; docs: numbers of documents by language."""
    tool, langs = pieces_of(vocabulary), sorted(docs)
    counts = np.zeros((len(tool.names), len(langs)))
    every = sorted({c for lang in langs for w in words.get(lang, {}) for c in chunks(w)})
    place = {c: i for i, c in enumerate(every)}
    cells = np.array([(place[c], j, n) for j, lang in enumerate(langs) for w, n in words.get(lang, {}).items() for c in chunks(w)], np.int64).reshape(-1, 3)
    cells = cells[np.argsort(cells[:, 0], kind="stable")]
    begins = np.searchsorted(cells[:, 0], np.arange(len(every) + 1))
    lengths, most = list(by_length(every)) if every else [], max(AT_ONCE // len(langs), 64)

    def parts():
        """(piece grid, length, weights by language) of some words at a time, so that memory doesn't grow with their number."""
        for index, codes in lengths:
            for a in range(0, len(index), most):
                own, part = index[a : a + most], codes[a : a + most]
                n = begins[own + 1] - begins[own]
                at = np.arange(int(n.sum())) + np.repeat(begins[own] - np.cumsum(n) + n, n)
                weight = np.zeros((len(own), len(langs)))
                np.add.at(weight, (np.repeat(np.arange(len(own)), n), cells[at, 1]), cells[at, 2])
                yield tool.grid(part), part.shape[1], weight

    sizes = np.array([len(p) for p in tool.names])
    probs = np.repeat((1.0 / 8.0 ** np.minimum(sizes, 4))[:, None], len(langs), axis=1)
    probs /= probs.sum(axis=0)
    for _ in range(ROUNDS):
        counts[:] = 0
        for grid, width, own in parts():
            n = len(own)
            alpha = forward(grid, n, width, probs)
            beta = np.zeros_like(alpha)
            beta[width] = 1.0
            for i in range(width - 1, -1, -1):
                for k in range(1, min(LONGEST, width - i) + 1):
                    if (i, k) not in grid:
                        continue
                    got = grid[i, k]
                    step = _weight(probs, got, k) * beta[i + k]
                    beta[i] += step
                    share = alpha[i] * step / alpha[width] * own
                    there = got >= 0
                    for j in range(len(langs)):
                        counts[:, j] += np.bincount(got[there], share[there, j], len(counts))
        used = counts.sum(axis=1) > 0
        probs = np.where(used[:, None], counts + SMOOTHING, SMOOTHING)
        probs /= probs.sum(axis=0)
    total = sum(docs.values())
    return Model(vocabulary, langs, np.log([max(docs[x], 1) / max(total, 1) for x in langs]), probs)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def learned(docs: DataFrame, vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from labelled rows whose remainder is not 2."""
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 2))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Model(vocabulary, [], np.zeros(0), np.zeros((len(pieces_of(vocabulary).names), 0)))
    limits = small_table(docs.sparkSession, [{"lang": k, "most": int(min(1.0, sample_docs / n) * (1 << 20))} for k, n in sizes.items()], "lang: string, most: int")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 20))
    sample = rows.select("doc_id", "text", "lang").join(F.broadcast(limits), "lang").where(draw <= F.col("most")).select("lang", "text")

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                bounds, coded = split_words(part.column("text"))
                lang = part.column("lang").dictionary_encode()
                pair = np.repeat(np.asarray(lang.indices).astype(np.int64), np.diff(bounds)) * max(len(coded.dictionary), 1) + np.asarray(coded.indices)
                own, n = np.unique(pair, return_counts=True)
                width = max(len(coded.dictionary), 1)
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(own // width)).cast(pa.string()), coded.dictionary.take(pa.array(own % width)).cast(pa.string()), pa.array(n)], ["lang", "word", "n"])

    counted = sample.mapInArrow(tidy(count), "lang string, word string, n long").where(F.col("word") != "").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words: dict[str, dict[str, int]] = {}
    found = counted.toArrow()  # the words of SAMPLE_DOCS documents of each language
    for lang, word, n in zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        words.setdefault(lang, {})[word] = n
    return fit(words, sizes, vocabulary)


def predicted(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs, and the prediction."""
    def run(batches):
        tool = Scorer(model)
        most = TOKEN_BYTES * 2 // max(len(model.langs), 4)
        for batch in batches:
            for part in slices(batch, "text", most):
                n = part.num_rows
                langs, scores = [UND] * n, np.zeros(n)
                if model.langs:
                    own, count = tool.texts(part.column("text"))
                    own = own + model.log_prior
                    best = own.argmax(axis=1)
                    scores = np.where(count > 0, 1 / np.exp(own - own.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                    langs = [model.langs[b] if c else UND for b, c in zip(best.tolist(), count.tolist(), strict=True)]
                names = [*part.schema.names, *[f"c{part.num_columns + k}" for k in range(2)]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    return mapped(docs, run, [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)))
    found = predicted(rows, learned(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")
