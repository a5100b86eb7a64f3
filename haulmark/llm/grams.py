"""Hashed character n-grams of whole texts: an n-gram may touch blanks at its ends, never inside."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from haulmark.llm.words import joined

_U32 = np.uint32


def letters_only(keep: bytes = b"") -> np.ndarray:
    """Byte table: ASCII letters, ``keep`` and all bytes of other characters stay, the rest turns blank."""
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    for b in [*range(97, 123), *keep]:
        out[b] = b
    return out


def clean(texts: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts with blanks around each, and where the texts start."""
    data, starts = joined(pc.utf8_lower(pc.fill_null(texts, "")), b"  ")
    return np.concatenate([[np.uint8(32)], letters[data]]), starts + 1


def gram_places(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte; ``2 ** bits`` where there is none."""
    size = max(len(data) - n + 1, 0)
    blank = data == 32
    with np.errstate(over="ignore"):
        code = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, _U32)
        for i in range(n):
            code = (code ^ data[i : i + size]) * _U32(0x01000193)
            code ^= code >> _U32(15)
        code = (code * _U32(0x85EBCA6B)) >> _U32(32 - bits)
    dropped = blank[: size] & blank[n - 1 : n - 1 + size] if n == 2 else np.zeros(size, bool)
    for i in range(1, n - 1):
        dropped |= blank[i : i + size]
    out = code.astype(np.int32)
    out[dropped] = 1 << bits
    return np.concatenate([out, np.full(len(data) - size, 1 << bits, np.int32)])
