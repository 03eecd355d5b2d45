"""Word hashes of many texts at once. A word is a run of other characters than ASCII white space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 17
STEP = np.uint64(0xD6E8FEB86659FD93)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def powers(n: int, step: np.uint64 = STEP) -> np.ndarray:
    """step to the powers 0 to n - 1, modulo 2^64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), step)])).astype(np.uint64)[:n]


class Words:
    """hashes of all words of a batch in order; bounds: first word of each text and the end; start, stop: their bytes in data.

    Beyond a flag and a code for each byte, memory is by the word: bytes are hashed BLOCK at a time.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        edges = offsets - offsets[0]
        self.data = _LOWER[data] if lower else data
        full = ~_SPACE[self.data]
        before = np.concatenate([[False], full[:-1]]) if len(full) else full
        first = edges[:-1][edges[:-1] < len(full)]
        before[first] = False
        self.start = np.nonzero(full & ~before)[0]
        after = np.concatenate([full[1:], [False]]) if len(full) else full
        last = edges[1:][edges[1:] > 0] - 1
        after[last] = False
        self.stop = np.nonzero(full & ~after)[0] + 1
        self.bounds = np.searchsorted(self.start, edges)
        sizes = self.stop - self.start
        with np.errstate(over="ignore"):
            self.hashes = mix(self._sums(sizes) + sizes.astype(np.uint64) * STEP)

    def _sums(self, sizes: np.ndarray) -> np.ndarray:
        """For each word the sum of its bytes' codes times the powers of STEP."""
        out = np.zeros(len(sizes), np.uint64)
        power = powers(min(int(sizes.max()), BLOCK) if len(sizes) else 0)
        ends = np.cumsum(sizes)
        long = np.nonzero(sizes > BLOCK)[0]
        with np.errstate(over="ignore"):
            for w in long.tolist():
                ahead = np.uint64(1)
                for a in range(int(self.start[w]), int(self.stop[w]), BLOCK):
                    part = _BYTE[self.data[a : min(a + BLOCK, int(self.stop[w]))]]
                    out[w] += (part * power[: len(part)]).sum() * ahead
                    ahead = ahead * power[-1] * STEP
            block = (ends - sizes) // BLOCK
            block[long] = -1
            cuts = [0, *(np.nonzero(np.diff(block))[0] + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a and block[a] >= 0:
                    own = sizes[a:b]
                    at = np.cumsum(own) - own
                    inside = np.arange(int(own.sum())) - np.repeat(at, own)
                    out[a:b] = np.add.reduceat(_BYTE[self.data[np.repeat(self.start[a:b], own) + inside]] * power[inside], at)
        return out

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive words, rolled so that the cost doesn't depend on the width."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(len(hashes)))])
        # A run that begins at i holds the surplus factor STEP^i; its inverse takes that away.
        return mix((total[width:] - total[:n]) * powers(n, BACK))


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sequences of words apart, as two longs."""
    power = powers(len(hashes))
    with np.errstate(over="ignore"):
        a = mix(np.array([(hashes * power).sum() + np.uint64(len(hashes))], np.uint64))[0]
        b = mix(np.array([(mix(hashes ^ STEP) * power[::-1]).sum()], np.uint64))[0]
    return int(a.view(np.int64)), int(b.view(np.int64))
