"""Words of whole texts in numpy: one pass over the bytes of a slice of Arrow strings.

UTF-8 keeps ASCII blanks apart from all other characters, so words cut from bytes are the
words cut from code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from haulmark.llm.common import BLANKS

U64 = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers so that every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def joined(texts: pa.Array, blank: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with ``blank`` after each, and where each text starts (one more at the end)."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes + len(blank), out=starts[1:])
    sep = blank.decode()
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), sep)[0]
    return np.frombuffer(whole.as_buffer().to_pybytes() + blank, np.uint8), starts


@dataclass
class Words:
    """Words of some texts, one after the other: ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word: its bytes eight at a time, each eight scrambled into the last."""
        size = self.end - self.begin
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data),), "<u8", padded.data, strides=(1,))
        with np.errstate(over="ignore"):
            h = mix(size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
            h = mix(h ^ (eight[self.begin] & _LOW_BYTES[np.minimum(size, 8)]))
            at, rest = np.flatnonzero(size > 8), 8
            while len(at):
                lane = eight[self.begin[at] + rest] & _LOW_BYTES[np.minimum(size[at] - rest, 8)]
                h[at] = mix(h[at] * U64(0xD6E8FEB86659FD93) ^ lane)
                rest += 8
                at = at[size[at] > rest]
        return h


def cut_words(texts: pa.Array, lower: bool = False) -> Words:
    data, starts = joined(texts)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = ~_BLANK[data]
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(data, begin, end, np.searchsorted(begin, starts))


def window_hashes(h: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hash of the k numbers that start at each place; the last k - 1 places have none."""
    n = max(len(h) - k + 1, 0)
    with np.errstate(over="ignore"):
        out = np.full(n, seed, U64)
        for i in range(k):
            out = mix(out * U64(0xD6E8FEB86659FD93) ^ h[i : i + n])
    return out


class SpanHashes:
    """Hash of any run of words, from running sums of powers of an odd number modulo 2**64."""

    def __init__(self, h: np.ndarray, base: int) -> None:
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            one = np.ones(1, U64)
            up = np.cumprod(np.concatenate([one, np.full(len(h), base, U64)]), dtype=U64)
            self.down = np.cumprod(np.concatenate([one, np.full(len(h), inverse, U64)]), dtype=U64)
            self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(h * up[:-1], dtype=U64)])

    def __call__(self, begin: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[begin + length] - self.sums[begin]) * self.down[begin] + np.asarray(length).astype(U64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of the ``width`` numbers that start at each place, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    if have < width:
        more = width - have
        out = np.minimum(out[: len(out) - more], out[more:]) if len(out) > more else out[:0]
    return out


def longs(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as the signed ones Spark has."""
    return pa.array(x.view(np.int64))
