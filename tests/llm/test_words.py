"""Words, hashes and windows against plain Python."""

import numpy as np
import pyarrow as pa
from helpers import hard_rows, random_texts, words

from haulmark.llm.words import SpanHashes, cut_words, sliding_min, window_hashes

TEXTS = [t for _, t, _, _ in hard_rows()] + random_texts(20)


def test_words_are_those_of_the_pattern():
    found = cut_words(pa.array(TEXTS, pa.string()))
    raw = found.data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(found.begin, found.end, strict=True)]
    assert got == [w for t in TEXTS for w in words(t)]
    assert found.counts.tolist() == [len(words(t)) for t in TEXTS]


def test_equal_words_and_only_they_hash_alike():
    long_ = ["x" * n for n in range(1, 40)] + ["x" * 20 + "y", "abcdefgh", "abcdefghé"]
    ws = [w for t in TEXTS for w in words(t)] + long_
    h = cut_words(pa.array([" ".join(ws)])).hashes()
    assert len(set(h.tolist())) == len(set(ws))
    assert all(x == y for x, y in zip(h.tolist(), cut_words(pa.array(ws)).hashes().tolist(), strict=True))


def test_span_hashes_know_words_and_length_but_not_the_place():
    h = cut_words(pa.array([" ".join(["a", "b", "c", "d"] * 5)])).hashes()
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        spans = SpanHashes(h, base)
        assert len(set(spans(np.arange(16), 5).tolist())) == 4
        assert spans(np.array([0, 4]), np.array([3, 3]))[0] == spans(np.array([0, 4]), np.array([3, 3]))[1]
        assert spans(np.array([0, 0]), np.array([3, 4]))[0] != spans(np.array([0, 0]), np.array([3, 4]))[1]


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 100, 60).astype(np.uint64)
    for width in (1, 2, 7, 43, 60, 61):
        assert sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(max(0, 60 - width + 1))]
    assert len(window_hashes(x, 61)) == 0
