"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and their order come from a public vocabulary file; a piece's log score follows
from its rank there (Zipf's law), since that file's own scores are merge ranks and no
probabilities. The segmentation of the largest total score is found by Viterbi on a trie
of code points in two arrays. A character that is no piece counts PENALTY less than the
rarest piece and becomes its UTF-8 bytes, a byte piece each.

A blank is the mark; one mark goes before the text, and decoding takes it off again. A
mark in the text itself is written in bytes, so decoding gives back every text exactly.
No piece holds a mark behind another character, nor a line end, so a text is the sum of
its parts between those; distinct parts are segmented once per worker while remembered.

Null text is the empty text, which has no ids. Whole texts are encoded, however long.
Repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, tidy
from .langid import by_length, default_vocabulary
from .tokens import Remembered, crc32, slices

MARK = "▁"
CUT = "\x00"
OWN = "own"  # a mark of the text itself, among characters
WIDE = 64
#: Scores are whole numbers of 1/UNIT, so that sums are exact and ties fall alike everywhere.
UNIT = 1 << 20
PENALTY = 10 * UNIT
NEVER = -(1 << 60)


@dataclass
class Trie:
    """base[s] + code is the next state if check there is s; value is the piece that ends there, -1 for none."""

    codes: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, words: dict[str, int]) -> Trie:
        codes = {c: i for i, c in enumerate(sorted({c for w in words for c in w}), 1)}
        tree: dict = {}
        for word, number in words.items():
            node = tree
            for c in word:
                node = node.setdefault(codes[c], {})
            node[0] = number
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = -2
        waiting, free = [(0, tree)], 1
        while waiting:
            state, node = waiting.pop()
            value[state] = node.get(0, -1)
            own = np.array(sorted(c for c in node if c), np.int64)
            if not len(own):
                base[state] = -1
                continue
            at = max(free - int(own[0]), 0)
            while True:
                span = 1 << 10 if len(own) > 1 else 1 << 8
                while at + span + len(codes) + 2 >= len(base):
                    n = len(base)
                    base, check, value = np.concatenate([base, np.zeros(n, np.int32)]), np.concatenate([check, np.full(n, -1, np.int32)]), np.concatenate([value, np.full(n, -1, np.int32)])
                fits = np.ones(span, bool)
                for c in own.tolist():
                    fits &= check[at + c : at + c + span] == -1
                if fits.any():
                    at += int(np.argmax(fits))
                    break
                at += span
            base[state] = at
            check[at + own] = state
            while free < len(check) and check[free] != -1:
                free += 1
            waiting += [(at + int(c), node[int(c)]) for c in own]
        used = int(np.nonzero(check != -1)[0].max()) + len(codes) + 2
        pad = [np.concatenate([x[:used], np.full(max(0, used - len(x)), f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1))]
        return cls(codes, *pad)

    def next(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """-1 from a state or code that is none."""
        base = self.base[state]
        to = np.where((state >= 0) & (code > 0) & (base >= 0), base + code, 0)
        return np.where((self.check[to] == state) & (to > 0), to, -1)


@dataclass
class Vocabulary:
    trie: Trie
    scores: np.ndarray  # of all ids
    spoken: list[bytes]  # of all ids, marks as blanks
    byte_ids: np.ndarray  # of the 256 byte pieces
    longest: int
    rarest: int


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    n = tool.get_piece_size()
    plain = [i for i in range(n) if not (tool.is_control(i) or tool.is_unknown(i) or tool.is_byte(i) or tool.is_unused(i))]
    names = {i: tool.id_to_piece(i) for i in plain}
    if any(re.search(f"[^{MARK}]{MARK}|[\n{CUT}]", x) for x in names.values()):
        raise ValueError("a piece crosses a word's edge")
    ranked = sorted(plain, key=lambda i: (-tool.get_score(i), i))
    scores, whole = np.full(n, NEVER, np.int64), sum(1 / r for r in range(1, len(ranked) + 1))
    scores[ranked] = [round(-math.log(r * whole) * UNIT) for r in range(1, len(ranked) + 1)]
    spoken, byte_ids = [b""] * n, np.zeros(256, np.uint32)
    for i in range(n):
        if tool.is_byte(i):
            b = int(tool.id_to_piece(i)[1:-1], 16)
            spoken[i], byte_ids[b] = bytes([b]), i
    for i, x in names.items():
        spoken[i] = x.replace(MARK, " ").encode()
    return Vocabulary(Trie.of({x: i for i, x in names.items()}), scores, spoken, byte_ids, max(map(len, names.values())), int(scores[ranked[-1]]))


class Segmenter(Remembered):
    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.v = vocab
        self.lists = None

    def pieces(self, texts: pa.Array) -> pa.Array:
        """Parts between words; a text that holds a mark or CUT itself is one part, CUT before it."""
        texts = texts.cast(pa.large_string())
        mark, none = (pa.scalar(x, pa.large_string()) for x in (MARK, ""))
        marked = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(mark, pc.replace_substring(texts, " ", MARK), none))
        cut = pc.replace_substring_regex(marked, f"([^{MARK}\n])([{MARK}\n])", f"\\1{CUT}\\2")
        odd = pc.or_(pc.match_substring(texts, MARK), pc.match_substring(texts, CUT))
        parts = pc.split_pattern(cut, CUT)
        if not pc.any(odd).as_py():
            return parts
        whole = [[CUT + t] if o else p for t, o, p in zip(texts.to_pylist(), odd.to_pylist(), parts.to_pylist(), strict=True)]
        return pa.array(whole, pa.large_list(pa.large_string()))

    def _bytes(self, c: str) -> np.ndarray:
        return self.v.byte_ids[np.frombuffer((MARK if c == OWN else c).encode(), np.uint8)]

    def ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.segmented(pieces.to_pylist())
        return np.arange(len(found)), np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def segmented(self, pieces: list[str]) -> list[np.ndarray]:
        found: list = [np.zeros(0, np.uint32)] * len(pieces)
        short = [i for i, p in enumerate(pieces) if 0 < len(p) <= WIDE and p[0] != CUT]
        for i, p in enumerate(pieces):
            if p and p[0] == CUT:
                found[i] = self.alone([MARK, *[OWN if c == MARK else MARK if c == " " else c for c in p[1:]]])
            elif len(p) > WIDE:
                found[i] = self.alone(list(p))
        for index, points in by_length([pieces[i] for i in short]) if short else []:
            for a in range(0, len(index), 4096):
                part = [short[k] for k in index[a : a + 4096].tolist()]
                for i, ids in zip(part, self.together(points[a : a + 4096]), strict=True):
                    found[i] = ids
        return found

    def alone(self, chars: list[str]) -> np.ndarray:
        """Viterbi for one part of any length."""
        v, trie = self.v, self.v.trie
        if self.lists is None:
            self.lists = (trie.base.tolist(), trie.check.tolist(), trie.value.tolist(), v.scores.tolist())
        base, check, value, scores = self.lists
        chars = [" " if c == "" else c for c in chars]
        codes = [trie.codes.get(MARK if c == " " else c, 0) for c in chars]
        n = len(codes)
        best, back = [NEVER] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0
        for i in range(n):
            state, lone = 0, False
            for j in range(i, min(n, i + v.longest)):
                to = base[state] + codes[j]
                if not codes[j] or base[state] < 0 or check[to] != state:
                    break
                state = to
                if value[to] >= 0:
                    lone |= j == i
                    total = best[i] + scores[value[to]]
                    if total > best[j + 1]:
                        best[j + 1], back[j + 1] = total, (i, value[to])
            if not lone and best[i] + v.rarest - PENALTY > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + v.rarest - PENALTY, (i, -1)
        out, j = [], n
        while j:
            i, piece = back[j]
            out.append([piece] if piece >= 0 else self._bytes(chars[i]).tolist())
            j = i
        return np.array([x for part in reversed(out) for x in part], np.uint32)

    def together(self, points: np.ndarray) -> list[np.ndarray]:
        """Viterbi for many parts of one length, in step."""
        v, trie = self.v, self.v.trie
        n, width = points.shape
        names, inverse = np.unique(points, return_inverse=True)
        codes = np.array([trie.codes.get(chr(int(c)), 0) for c in names], np.int64)[inverse].reshape(n, width)
        best, size, piece = np.full((width + 1, n), NEVER), np.zeros((width + 1, n), np.int64), np.full((width + 1, n), -1, np.int64)
        best[0] = 0
        for i in range(width):
            rows, state, lone = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
            for j in range(i, min(width, i + v.longest)):
                state = trie.next(state, codes[rows, j])
                alive = state >= 0
                rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                value = trie.value[state].astype(np.int64)
                total = np.where(value >= 0, best[i, rows] + v.scores[value], NEVER)
                if j == i:
                    lone[rows[value >= 0]] = True
                better = total > best[j + 1, rows]
                at = rows[better]
                best[j + 1, at], size[j + 1, at], piece[j + 1, at] = total[better], j + 1 - i, value[better]
            fall = ~lone & (best[i] + v.rarest - PENALTY > best[i + 1])
            best[i + 1, fall], size[i + 1, fall], piece[i + 1, fall] = best[i, fall] + v.rarest - PENALTY, 1, -1
        ids, count, end, all_rows = np.zeros((width, n), np.int64), np.zeros(n, np.int64), np.full(n, width), np.arange(n)
        while (open_ := all_rows[end[all_rows] > 0]).size:
            p = piece[end[open_], open_]
            ids[count[open_], open_] = np.where(p >= 0, p, -1 - points[open_, end[open_] - 1].astype(np.int64))
            count[open_] += 1
            end[open_] -= size[end[open_], open_]
        out = []
        for r in range(n):
            own = ids[: count[r], r][::-1]
            if (own < 0).any():
                own = np.concatenate([[x] if x >= 0 else self._bytes(chr(-1 - x)) for x in own.tolist()])
            out.append(own.astype(np.uint32))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.joined(pc.fill_null(texts, ""))

    def decode(self, ids: np.ndarray) -> str:
        spoken = self.v.spoken
        return b"".join([spoken[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (raw, two bytes each) of every row."""
    vocab = vocabulary(path or default_vocabulary())
    if len(vocab.scores) > 1 << 16:
        raise ValueError("ids don't fit two bytes")

    def run(batches):
        tool = Segmenter(vocab)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = tool.encode(part.column("text"))
                raw = ids.astype("<u2").tobytes()
                edges = [0, *(2 * ends).tolist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([raw[a:b] for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, ids binary")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces among them), ids_crc32, score, text of `encoded` rows."""
    vocab = vocabulary(path or default_vocabulary())
    is_byte = np.zeros(len(vocab.scores), bool)
    is_byte[vocab.byte_ids] = True
    scores = np.where(vocab.scores > NEVER, vocab.scores, 0)

    def run(batches):
        tool = Segmenter(vocab)
        for batch in batches:
            out = []
            for raw in batch.column("ids").to_pylist():
                ids = np.frombuffer(raw, "<u2")
                out.append((len(ids), int(is_byte[ids].sum()), crc32(ids), int(scores[ids].sum()) / UNIT, tool.decode(ids)))
            n, b, crc, score, text = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(b, pa.int64()), pa.array(crc, pa.int64()), pa.array(score, pa.float64()), pa.array(text, pa.string())], ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "score", "text"])

    return rows.mapInArrow(tidy(run), "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, score double, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again; text_sha256 is of the decoded text."""
    rows = decoded(encoded(documents(spark, sf_dir)))
    return rows.select("doc_id", "n_pieces", "n_bytes", "ids_crc32", "score", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
