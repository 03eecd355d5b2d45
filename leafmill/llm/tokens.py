"""Token ids of whole texts, by the tokenizers library, with the words of a worker remembered.

The vocabulary drops white space, so a text's ids are those of its pieces between ASCII
white space, one after the other; each distinct piece is encoded once per worker while
it stays among at most REMEMBERED ones. When they are full, those that were met again stay. A vocabulary for which that doesn't hold (a
probe tells) gets whole texts.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED, REMEMBERED_BYTES, AT_ONCE = 800_000, 24 << 20, 256
SLICE_BYTES, TOKEN_BYTES = 1 << 19, 4 << 20
MARK = "\x01"
SPECIAL = "<|"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Remembered:
    """Ids of texts from the ids of their distinct pieces, which are kept until there are too many."""

    def __init__(self):
        self.names = pa.array([], pa.large_string())
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes, self.again = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def forget(self) -> None:
        """Pieces that were met again stay, unless they fill half the room."""
        names, sizes, starts = self.names.filter(pa.array(self.again)), self.sizes[self.again], self.starts[self.again]
        if len(names) > REMEMBERED // 2 or names.nbytes > REMEMBERED_BYTES // 2:
            names, sizes, starts = names.slice(0, 0), sizes[:0], starts[:0]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(starts - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
        Remembered.__init__(self)
        # A copy, so that the old names are let go.
        self._keep(pa.concat_arrays([names, self.names]), ids, sizes)

    def pieces(self, texts: pa.Array) -> pa.Array:
        """A list of pieces for each text."""
        raise NotImplementedError

    def ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the pieces, all their ids in that order, and how many each has."""
        raise NotImplementedError

    def _keep(self, names: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.names = pa.concat_arrays([self.names, names])
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.again = np.concatenate([self.again, np.zeros(len(names), bool)])
        self.used += len(ids)

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's ids end."""
        pieces = self.pieces(texts)
        bounds = np.asarray(pieces.offsets)
        coded = pieces.flatten().dictionary_encode()
        if len(self.names) + len(coded.dictionary) > REMEMBERED or self.names.nbytes > REMEMBERED_BYTES:
            self.forget()
        known = len(self.names)
        own = np.asarray(pc.fill_null(pc.index_in(coded.dictionary, value_set=self.names), -1)).astype(np.int64)
        self.again[own[own >= 0]] = True
        if (new := own < 0).any():
            fresh = coded.dictionary.filter(pa.array(new))
            order, ids, sizes = self.ids_of(fresh)
            self._keep(fresh.take(pa.array(order)), ids, sizes)
            own[np.nonzero(new)[0][order]] = known + np.arange(len(order))
        index = own[np.asarray(coded.indices)]
        sizes = self.sizes[index]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.repeat(self.starts[index] - ends + sizes, sizes) + np.arange(total)]
        return flat, np.concatenate([[0], ends])[bounds[1:] - bounds[0]]


class Encoder(Remembered):
    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        mark = self._whole(["a", "b", MARK, f"a {MARK} b", " a\n\tb "])
        self.by_piece = len(mark[2]) == 1 and mark[3] == [*mark[0], *mark[2], *mark[1]] and mark[4] == [*mark[0], *mark[1]]
        self.mark = mark[2][0] if self.by_piece else -1

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, texts: pa.Array) -> pa.Array:
        return pc.ascii_split_whitespace(texts.cast(pa.large_string()))

    def ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Plain pieces are encoded many to a text, a mark between them."""
        odd = np.asarray(pc.or_(pc.match_substring(pieces, MARK), pc.match_substring(pieces, SPECIAL)))
        plain = pieces.filter(pa.array(~odd))
        ids: list[int] = []
        cuts = pa.array([*range(0, len(plain), AT_ONCE), len(plain)], pa.int64())
        for part in self._whole(pc.binary_join(pa.LargeListArray.from_arrays(cuts, plain), pa.scalar(f" {MARK} ", pa.large_string())).to_pylist()) if len(plain) else []:
            ids += part
            ids.append(self.mark)
        flat = np.array(ids, np.uint32)
        ends = np.nonzero(flat == self.mark)[0]
        sizes = np.diff(ends, prepend=-1) - 1
        assert len(sizes) == len(plain)
        alone = self._whole(pieces.filter(pa.array(odd)).to_pylist())
        order = np.concatenate([np.nonzero(~odd)[0], np.nonzero(odd)[0]])
        return order, np.concatenate([flat[flat != self.mark], *[np.array(x, np.uint32) for x in alone]]), np.concatenate([sizes, np.array([len(x) for x in alone], np.int64)])

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, `end` after each text, and where each text's ids end."""
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            lists = [[*x, end] for x in self._whole(texts.to_pylist())]
            return np.array([i for x in lists for i in x], np.uint32), np.cumsum([len(x) for x in lists])
        flat, text_ends = self.joined(texts)
        out = np.full(len(flat) + len(texts), end, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), np.diff(text_ends, prepend=0))] = flat
        return out, text_ends + np.arange(1, len(texts) + 1)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Parts of a batch of about `most` bytes of text each; a longer text is one part."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.nonzero(np.diff(part))[0] + 1), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
