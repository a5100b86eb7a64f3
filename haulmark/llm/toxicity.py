"""Toxicity: character n-gram embeddings averaged into a linear softmax, trained together in numpy.

The vector of a word is the mean of its n-gram vectors, so a misspelling that was never seen
still stands near the word it comes from. The bag that is averaged is a run of a few words; every
run of the whole text is judged and a text is as toxic as its runs, weighted by how toxic each is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import labelled_sample, over_text
from haulmark.llm.grams import clean, gram_places, letters_only

BITS = 17
SIZES = (3, 5, 7)
DIM = 8
RUN = 2
SHARP = 4.0
#: Bounds of the training sample: labelled rows, and the longest text that it takes in.
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 32_768
EPOCHS = 8
BATCH = 64
RATE = 0.5
#: Signs inside a word that misspellings put in place of letters.
_LETTERS = letters_only(b"0123456789@$*")


@dataclass
class Bags:
    """N-gram buckets of some texts by place, their words, and the runs of words."""

    cells: list[np.ndarray]
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def sums(self, at_place: np.ndarray) -> np.ndarray:
        """Add up what n-grams have, by word; the n-grams of a word start at the blank before it or later."""
        total = np.concatenate([[0.0], np.cumsum(at_place)])
        return total[self.end] - total[self.begin - 1]


def bags_of(texts: pa.Array) -> Bags:
    data, starts = clean(texts, _LETTERS)
    word = np.concatenate([[False], data != 32])
    edge = np.diff(word.astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Bags([gram_places(data, n, BITS) for n in SIZES], begin, end, np.searchsorted(begin, starts))


@dataclass
class Runs:
    """All runs of ``RUN`` words inside a text (a shorter text is one run)."""

    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray


def runs_of(first: np.ndarray) -> Runs:
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(n - RUN + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = first[text] + place
    return Runs(begin, np.minimum(begin + RUN, first[text + 1]), text)


def judge(bags: Bags, pull: np.ndarray, bias: float):
    """Logit of each text. ``pull`` is what the linear layer makes of each n-gram vector."""
    texts = len(bags.first) - 1
    at_place, grams = np.zeros(len(bags.cells[0])), np.zeros(len(bags.cells[0]))
    for cells in bags.cells:
        at_place += pull[cells]
        grams += cells < 1 << BITS
    many = np.maximum(bags.sums(grams), 1)
    words = np.concatenate([[0.0], np.cumsum(bags.sums(at_place) / many)])
    runs = runs_of(bags.first)
    z = (words[runs.end] - words[runs.begin]) / (runs.end - runs.begin)
    top = np.full(texts, -np.inf)
    np.maximum.at(top, runs.text, z)
    weight = np.exp(SHARP * (z - top[runs.text]))
    weight /= np.bincount(runs.text, weight, minlength=texts)[runs.text]
    mean = np.bincount(runs.text, weight * z, minlength=texts)
    return mean + bias, (many, runs, z, weight, mean)


def pull_back(bags: Bags, state, wrong: np.ndarray) -> np.ndarray:
    """Gradient by bucket of what ``judge`` gave, for errors ``wrong`` of the logits."""
    many, runs, z, weight, mean = state
    by_run = wrong[runs.text] * weight * (1 + SHARP * (z - mean[runs.text])) / (runs.end - runs.begin)
    change = np.zeros(len(bags.begin) + 1)
    np.add.at(change, runs.begin, by_run)
    np.subtract.at(change, runs.end, by_run)
    by_word = np.cumsum(change)[:-1] / many
    at = np.zeros(len(bags.cells[0]) + 1)
    np.add.at(at, bags.begin - 1, by_word)
    np.subtract.at(at, bags.end, by_word)
    by_place = np.cumsum(at)[:-1]
    out = np.zeros((1 << BITS) + 1)
    for cells in bags.cells:
        out += np.bincount(cells, by_place, minlength=len(out))
    out[-1] = 0
    return out


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """Pull of each bucket and the bias. Embeddings and softmax weights learn together (Adagrad)."""
    rng = np.random.default_rng(11)
    if len(set(labels)) < 2:
        return np.zeros((1 << BITS) + 1), (8.0 if labels[0] else -8.0) if labels else -8.0
    vectors = np.zeros(((1 << BITS) + 1, DIM), np.float32)
    softmax, bias = rng.normal(0, 1, (2, DIM)), np.zeros(2)
    seen, seen_soft, seen_bias = np.full((1 << BITS) + 1, 1e-8), np.full(DIM, 1e-8), 1e-8
    share = sum(labels) / len(labels)
    # Half way between rows of equal weight and labels of equal weight.
    heavy = np.sqrt([0.5 / (1 - share), 0.5 / share])
    order = rng.permutation(len(texts))
    parts = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    ready = [(bags_of(pa.array([texts[i] for i in p], pa.string())), np.array([labels[i] for i in p])) for p in parts]
    for _ in range(EPOCHS):
        for k in rng.permutation(len(ready)):
            bags, y = ready[k]
            lean = softmax[1] - softmax[0]
            logit, state = judge(bags, vectors @ lean, bias[1] - bias[0])
            wrong = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * heavy[y] / len(y)
            by_bucket = pull_back(bags, state, wrong)
            to_soft = by_bucket @ vectors
            at = np.flatnonzero(by_bucket)
            seen[at] += by_bucket[at] ** 2
            vectors[at] -= (RATE * (by_bucket[at] / np.sqrt(seen[at])))[:, None] * (lean / np.linalg.norm(lean))
            seen_soft += to_soft**2
            step = 0.1 * to_soft / np.sqrt(seen_soft)
            softmax[1] -= step
            softmax[0] += step
            seen_bias += wrong.sum() ** 2
            bias[1] -= 0.1 * wrong.sum() / np.sqrt(seen_bias)
    return vectors @ (softmax[1] - softmax[0]), float(bias[1] - bias[0])


def score_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``score`` (0 to 1) and ``predicted`` of each whole text.

    Learns from ``labels.toxic`` of rows where ``allowed`` holds, at most ``SAMPLE_ROWS`` of them.
    Null texts and texts without a word get the score of the bias alone. Without labels, or with
    labels of one value only, every text gets that one verdict (not toxic where there are none).
    Null labels are not used; repeated rows are scored alike; an empty table gives no rows.
    """
    pull, bias = train(*labelled_sample(docs, labels, "toxic", allowed, SAMPLE_ROWS, SAMPLE_CHARS))
    model = docs.sparkSession.sparkContext.broadcast((pull.astype(np.float32), bias))

    def score(texts: pa.Array) -> dict[str, pa.Array]:
        pull, bias = model.value
        p = 1 / (1 + np.exp(-np.clip(judge(bags_of(texts), pull, bias)[0], -30, 30)))
        return {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))}

    return over_text(docs, score, "score double, predicted int", keep)
