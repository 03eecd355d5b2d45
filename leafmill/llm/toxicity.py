"""Toxic spans by a linear-chain conditional random field, documents by what it finds.

A text's tokens are its runs of letters, lower case. The field has two tags, clean and
toxic; a token's weight is that of its word, its beginnings and its ends, and tags follow
each other with weights of their own. Forward and backward passes give each token the
probability that it is toxic. A document's score is a logistic function of the number of
toxic tokens that these sum to, of their share, and of the largest; words of 0.5 or more are
its offending spans. As a word's weight doesn't depend on its neighbours, it is found once a
worker while the word is remembered, and the passes run over all tokens of many documents
in blocks, in step.

Labels are of documents, so tokens get theirs from them: in documents labelled toxic, those
with a form that is surely commoner there (its log odds less CERTAIN standard errors above
LEAST_ODDS); all others are clean. The field is fitted to these labels, then the toxic
documents' tokens are labelled anew by its marginals and it is fitted again. What the
logistic function is fitted on are marginals of documents that the field in question hasn't
learned from.

Learned from is a bounded sample: LEARN_DOCS documents of each label, in the order of a hash
of doc_id, of at most LEARN_CHARS characters, one of each kind of near copies (the
same least shingle). Every whole text is scored.

Null text is the empty text, which has no token and the least score. Null doc_id: not
learned from, not held out. Labels other than 0 and 1 are no labels; without both of them
the score is the share of toxic ones (0 without any). Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, mapped
from .langid import by_length
from .tokens import slices
from .words import mix

LEARN_DOCS, LEARN_CHARS = 1000, 50_000
BUCKETS = 1 << 17
#: Letters of a word that are looked at, and lengths of its beginnings and ends.
LETTERS, BEGINNINGS, ENDS = 32, (3, 4, 5, 6, 7), (3, 4, 5)
CERTAIN, LEAST_ODDS = 2.0, 1.0
STEPS, MORE_STEPS, RATE, DECAY = 45, 15, 0.25, 1e-4
REMEMBERED = 400_000
STRING = pa.large_string()


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.DictionaryArray]:
    """Texts with every character but letters blanked, bounds of each text's tokens, and the tokens."""
    blank = pc.replace_substring_regex(pc.fill_null(texts, "").cast(STRING), r"\PL", " ")
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(blank)))
    flat, bounds = words.flatten(), np.asarray(words.offsets).astype(np.int64)
    # A text without a letter is one empty word.
    real = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate([[0], np.cumsum(real)])
    return blank, before[bounds - bounds[0]], flat.filter(pa.array(real)).dictionary_encode()


def forms(words: list[str]) -> np.ndarray:
    """A row of buckets for each word: of itself, its beginnings and its ends; 0 (never used) where it is too short."""
    out = np.zeros((len(words), 1 + len(BEGINNINGS) + len(ENDS)), np.int64)
    base = np.uint64(0x9E3779B97F4A7C15)

    def bucket(h: np.ndarray, kind: int) -> np.ndarray:
        return (mix(h + np.uint64(kind << 40)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1

    with np.errstate(over="ignore"):
        for index, codes in by_length([w[:LETTERS] for w in words]) if words else []:
            for column, kind, lengths, own in ((1, 1, BEGINNINGS, codes), (1 + len(BEGINNINGS), 9, ENDS, codes[:, ::-1])):
                h = np.zeros(len(index), np.uint64)
                for k in range(own.shape[1]):
                    h = (h + own[:, k] + np.uint64(1)) * base
                    if k + 1 in lengths:
                        out[index, column + lengths.index(k + 1)] = bucket(h, kind + k)
                if kind == 1:
                    out[index, 0] = bucket(h, 0)
    return out


def _carried(part, wide: int) -> np.ndarray:
    """Ratios x[t] = (p x[t-1] + q) / (r x[t-1] + s); part(t) gives p, q, r, s of the tokens t. Blocks run in step: their whole maps first, then from their true beginnings."""
    size = max(int(wide**0.5 / 3), 1)
    count = -(-wide // size)
    at = np.minimum(np.arange(count)[None, :] * size + np.arange(size)[:, None], wide - 1)
    p, q, r, s = np.ones(count), np.zeros(count), np.zeros(count), np.ones(count)
    for row in at:
        a, b, c, d = part(row)
        p, q, r, s = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        top = np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p / top, q / top, r / top, s / top
    begin = [1.0]
    for a, b, c, d in zip(*(y[:-1].tolist() for y in (p, q, r, s)), strict=True):
        begin.append((a * begin[-1] + b) / (c * begin[-1] + d))
    x = np.array(begin)
    out = np.empty(at.shape)
    for i, row in enumerate(at):
        a, b, c, d = part(row)
        x = (a * x + b) / (c * x + d)
        out[i] = x
    return out.T.reshape(-1)[:wide]


@dataclass
class Field:
    """weights of forms (and of all tokens, in bucket 0), of the tag pairs clean-toxic, toxic-clean, toxic-toxic, and of a toxic beginning."""

    weights: np.ndarray
    steps: np.ndarray

    def emissions(self, buckets: np.ndarray) -> np.ndarray:
        return self.weights[buckets].sum(axis=1) - (buckets == 0).sum(axis=1) * self.weights[0] + self.weights[0]

    def passes(self, scores: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward ratios of toxic to clean, the exponentials of the scores, and which tokens begin a text."""
        e = np.exp(np.clip(scores, -30, 30))
        n = len(e)
        begins = np.zeros(n, bool)
        begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        ends = np.concatenate([begins[1:], [True]])
        ct, tc, tt, start = np.exp(np.clip(self.steps, -30, 30))

        def ahead(t):
            first, own = begins[t], e[t]
            return np.where(first, 0, own * tt), np.where(first, own * start, own * ct), np.where(first, 0, tc), 1.0

        def back(t):
            t = n - 1 - t
            last, own = ends[t], e[np.minimum(t + 1, n - 1)]
            return np.where(last, 0, own * tt), np.where(last, 1, tc), np.where(last, 0, own * ct), 1.0

        return _carried(ahead, n), _carried(back, n)[::-1], e, begins

    def marginals(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The probability that each token is toxic."""
        if not len(scores):
            return np.zeros(0)
        ahead, back, _, _ = self.passes(scores, bounds)
        return ahead * back / (1 + ahead * back)


def fit_field(buckets: np.ndarray, index: np.ndarray, bounds: np.ndarray, tags: np.ndarray, begun: Field | None = None) -> Field:
    """By maximum likelihood with decay: gradients from the marginals, steps by Adam, from a field that is begun or none. index: each token's word, a row of buckets."""
    field = begun or Field(np.zeros(BUCKETS), np.array([-2.0, 0.0, 0.0, -2.0]))
    steps = MORE_STEPS if begun else STEPS
    if not begun:
        field.weights[0] = -4.0
    seen = np.zeros(4)
    inner = np.ones(len(index), bool)
    inner[bounds[:-1][bounds[:-1] < bounds[1:]]] = False
    inner = np.nonzero(inner)[0]
    was, now = tags[inner - 1], tags[inner]
    seen[:3] = ((was == 0) & (now == 1)).sum(), ((was == 1) & (now == 0)).sum(), ((was == 1) & (now == 1)).sum()
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    seen[3] = tags[firsts].sum()
    observed = np.bincount(index, tags, len(buckets))
    used, slot = np.unique(buckets, return_inverse=True)
    slot, real = slot.reshape(buckets.shape), buckets > 0
    m, v = np.zeros(len(used) + 5), np.zeros(len(used) + 5)
    for step in range(1, steps + 1):
        scores = field.emissions(buckets)[index]
        ahead, back, e, _ = field.passes(scores, bounds)
        p = ahead * back / (1 + ahead * back)
        gap = observed - np.bincount(index, p, len(buckets))
        grad = np.bincount(slot[real], np.repeat(gap, real.sum(axis=1)), len(used))
        ct, tc, tt, _ = np.exp(np.clip(field.steps, -30, 30))
        x, y = ahead[inner - 1], e[inner] * back[inner]
        pairs = np.stack([ct * y, tc * x, tt * x * y])
        expected = (pairs / (1 + pairs.sum(axis=0))).sum(axis=1)
        own = np.concatenate([field.weights[used], [field.weights[0]], field.steps])
        full = np.concatenate([grad, [gap.sum()], seen - np.concatenate([expected, [p[firsts].sum()]])])
        full -= DECAY * len(bounds) * np.concatenate([own[: len(used)], np.zeros(5)])
        m, v = 0.9 * m + 0.1 * full, 0.99 * v + 0.01 * full**2
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        own = own + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        field.weights[used[used > 0]] = own[: len(used)][used > 0]
        field.weights[0], field.steps = own[len(used)], own[len(used) + 1 :]
    return field


def shares(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text what the score depends on: toxic tokens expected, their share, and the largest marginal."""
    total = np.concatenate([[0.0], np.cumsum(p)])
    count, own = np.diff(bounds), total[bounds[1:]] - total[bounds[:-1]]
    most = np.zeros(len(count))
    np.maximum.at(most, np.repeat(np.arange(len(count)), count), p)
    return np.column_stack([np.log(own + 0.02), np.log((own + 0.02) / (count + 20)), most, np.ones(len(count))])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    out, ridge = np.zeros(x.shape[1]), np.diag([0.3] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        out += np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ out), -3, 3)
    return out


@dataclass
class Model:
    field: Field | None
    final: np.ndarray
    share: float = 0.0

    def scores(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.field is None:
            return np.full(len(bounds) - 1, self.share)
        return 1 / (1 + np.exp(-np.clip(shares(p, bounds) @ self.final, -30, 30)))


def weak_tags(buckets: np.ndarray, index: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic texts with a form that is surely commoner there, by numbers of texts."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    pairs = np.unique(doc * np.int64(len(buckets)) + index)
    of, own = pairs // len(buckets), buckets[pairs % len(buckets)]
    held = np.unique((of[:, None] * np.int64(BUCKETS) + own).reshape(-1))
    form, bad = held % BUCKETS, toxic[held // BUCKETS] == 1
    a, b = np.bincount(form[bad], minlength=BUCKETS) + 0.5, np.bincount(form[~bad], minlength=BUCKETS) + 0.5
    n, m = toxic.sum() + 1, (1 - toxic).sum() + 1
    odds = np.log(a / (n - a)) - np.log(b / (m - b)) - CERTAIN * np.sqrt(1 / a + 1 / b)
    odds[0] = -np.inf
    return ((odds[buckets].max(axis=1) > LEAST_ODDS)[index] & (toxic[doc] == 1)).astype(np.int64)


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Model:
    """From texts and their labels; share: of toxic ones among all labelled rows, which the sample doesn't keep."""
    _, bounds, coded = tokens_of(pa.array(texts, pa.string()))
    index, buckets = np.asarray(coded.indices).astype(np.int64), forms(coded.dictionary.to_pylist())
    if not 0 < toxic.sum() < len(toxic) or not len(index):
        return Model(None, np.zeros(0), share)

    def learned(docs: np.ndarray) -> Field:
        own = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs])
        edges = np.concatenate([[0], np.cumsum(np.diff(bounds)[docs])])
        tags = weak_tags(buckets, index[own], edges, toxic[docs])
        field = fit_field(buckets, index[own], edges, tags)
        again = field.marginals(field.emissions(buckets)[index[own]], edges) >= 0.5
        tags = (again & (np.repeat(toxic[docs], np.diff(edges)) == 1)).astype(np.int64)
        return fit_field(buckets, index[own], edges, tags, field)

    seen = np.zeros((len(texts), 4))
    for fold in (0, 1):
        inside = np.nonzero(np.arange(len(texts)) % 2 != fold)[0]
        field = learned(inside) if 0 < toxic[inside].sum() < len(inside) else Field(np.zeros(BUCKETS), np.zeros(4))
        own = shares(field.marginals(field.emissions(buckets)[index], bounds), bounds)
        seen[np.arange(len(texts)) % 2 == fold] = own[np.arange(len(texts)) % 2 == fold]
    weight = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    return Model(learned(np.arange(len(texts))), fit_logistic(seen, toxic, weight), share)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labels of rows whose remainder is not 0."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 0)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}  # two rows
    share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    turn = F.xxhash64("doc_id", F.lit("toxicity"))
    drawn = [known.where(F.col("label") == k).orderBy(turn, "doc_id").limit(LEARN_DOCS) for k in (0, 1)]
    sample = drawn[0].union(drawn[1]).dropDuplicates(["doc_id"])
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= LEARN_CHARS)).join(F.broadcast(sample), "doc_id")
    found = texts.dropDuplicates(["doc_id"]).orderBy(turn, "doc_id").toArrow()  # at most 2 * LEARN_DOCS texts
    chosen, kinds = [], set()
    for k, text in enumerate(found.column("text").to_pylist()):
        words = text.split()
        # Near copies, which share their least shingle, would make their words look like signs.
        kind = min((hash_of(" ".join(words[i : i + 5])) for i in range(max(len(words) - 4, 1))), default=0)
        if kind not in kinds:
            kinds.add(kind)
            chosen.append(k)
    toxic = np.array(found.column("label").to_pylist(), np.int64)[chosen] if chosen else np.zeros(0, np.int64)
    return fit([found.column("text")[k].as_py() for k in chosen], toxic, share)


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "replace"))


class Tagger:
    """Marginals of texts; the weights of words are remembered up to REMEMBERED words."""

    def __init__(self, field: Field):
        self.field, self.at, self.scores = field, {}, np.zeros(0)

    def marginals(self, bounds: np.ndarray, coded: pa.DictionaryArray) -> np.ndarray:
        names = coded.dictionary.to_pylist()
        if len(self.at) + len(names) > REMEMBERED:
            self.at, self.scores = {}, self.scores[:0]
        if new := [w for w in names if w not in self.at]:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.field.emissions(forms(new))])
        own = self.scores[[self.at[w] for w in names]] if names else np.zeros(0)
        return self.field.marginals(own[np.asarray(coded.indices)], bounds)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def tagged(docs: DataFrame, model: Model, score: str = "score", spans: str = "spans") -> DataFrame:
    """All columns of docs, the score, and the offending spans (code points, end exclusive)."""
    place = docs.columns.index("text")

    def run(batches):
        tool = Tagger(model.field) if model.field is not None else None
        for batch in batches:
            for part in slices(batch.set_column(place, pa.field("text", pa.string()), batch.column(place).cast(pa.string())), "text"):
                blank, bounds, coded = tokens_of(part.column(place))
                p = tool.marginals(bounds, coded) if tool else np.zeros(len(coded))
                found = [[] for _ in range(part.num_rows)]
                doc = np.searchsorted(bounds, np.nonzero(p >= 0.5)[0], "right") - 1
                for d in np.unique(doc).tolist():
                    own = p[bounds[d] : bounds[d + 1]].tolist()
                    found[d] = [{"start": m.start(), "end": m.end(), "p": x} for m, x in zip(re.finditer("[^ ]+", blank[d].as_py()), own, strict=True) if x >= 0.5]
                names = [*part.schema.names, *[f"c{part.num_columns + k}" for k in range(2)]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(p, bounds)), pa.array(found, ARROW_SPANS)], names)

    return mapped(docs, run, [T.StructField(score, T.DoubleType()), T.StructField(spans, SPANS)])


def op13_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans: start:end of the offending words, comma-joined."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = tagged(docs.select("doc_id", "text"), learned(docs, labels))
    told = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), told.alias("spans"))
