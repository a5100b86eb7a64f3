"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import over_text, small_batches, text_slices
from haulmark.llm.grams import clean, gram_places, letters_only

BITS = 15
SIZES = (2, 3, 4)
SMOOTHING = 0.5
UNKNOWN = "und"
_LETTERS = letters_only()


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all texts; bucket -1 counts the texts themselves.

    Each task adds up a language by bucket table of its own and hands over the filled cells, so
    what is shuffled is bounded by tasks times cells, not by the text.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        langs: dict[str, int] = {}
        counts = np.zeros((0, (1 << BITS) + 2), np.int64)
        for part in text_slices(batches):
            names = part.column("lang").to_pylist()
            for name in names:
                langs.setdefault(name, len(langs))
            if len(langs) > len(counts):
                counts = np.concatenate([counts, np.zeros((len(langs) - len(counts), counts.shape[1]), np.int64)])
            row = np.array([langs[x] for x in names])
            data, starts = clean(part.column("text"), _LETTERS)
            base = np.repeat(row, np.diff(starts)).astype(np.int32) * counts.shape[1]
            for n in SIZES:
                cells = gram_places(data, n, BITS)[: len(base)] + base
                counts += np.bincount(cells, minlength=counts.size).reshape(counts.shape)
            counts[:, -1] += np.bincount(row, minlength=len(counts))
        counts[:, -2] = 0
        for name, i in langs.items():
            at = np.flatnonzero(counts[i])
            bucket = np.where(at == (1 << BITS) + 1, -1, at).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(bucket), pa.array(counts[i][at])], names=["lang", "bucket", "n"]
            )

    found = docs.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by code point, log prior, and log probability of each bucket (rows) in each language.

    Learns from every row with a text and a language. The matrix has 2 ** ``BITS`` + 1 rows and a
    column per language, whatever the number of texts; that bounds what comes to the driver and
    goes out again.
    """
    cells = count_grams(docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())).toArrow()
    langs = sorted(set(cells.column("lang").to_pylist()), key=lambda x: x.encode())
    place = {x: i for i, x in enumerate(langs)}
    column = np.array([place[x] for x in cells.column("lang").to_pylist()], int)
    bucket, n = cells.column("bucket").to_numpy(), cells.column("n").to_numpy()
    texts, counts = np.zeros(len(langs)), np.zeros(((1 << BITS) + 1, len(langs)))
    texts[column[bucket < 0]] = n[bucket < 0]
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    logs = np.log(counts + SMOOTHING) - np.log(counts[:-1].sum(axis=0) + SMOOTHING * (1 << BITS))
    logs[-1] = 0  # the row for "no n-gram here"
    return langs, np.log(texts) - np.log(texts.sum() or 1), logs.astype(np.float32)


def _has_letter(data: np.ndarray, starts: np.ndarray, texts: pa.Array) -> np.ndarray:
    out = np.add.reduceat((data[1:] >= 97) & (data[1:] <= 122), starts[:-1] - 1, dtype=np.int64) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in texts[i].as_py() or "")
    return out


def identify_languages(docs: DataFrame, train: Column, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score`` (the posterior probability) of each whole text.

    Learns from the rows where ``train`` holds and both text and lang are given. Null texts,
    texts without a letter, and all texts when there is nothing to learn from get ``und`` and
    score 0. Ties go to the first language by code point; repeated rows are scored alike; an
    empty table gives no rows; further columns are not looked at.
    """
    langs, prior, logs = fit_languages(docs.filter(train))
    model = docs.sparkSession.sparkContext.broadcast((prior, logs))

    def score(texts: pa.Array) -> dict[str, pa.Array]:
        prior, logs = model.value
        data, starts = clean(texts, _LETTERS)
        known = _has_letter(data, starts, texts) & bool(langs)
        total = np.tile(prior, (len(texts), 1))
        if langs:
            # A text with its blanks; the places between start and next start hold all its n-grams.
            for n in SIZES:
                cells = gram_places(data, n, BITS)[: starts[-1]]
                total += np.add.reduceat(logs[cells], starts[:-1] - 1, axis=0, dtype=np.float64)
            best = total.argmax(axis=1)
            sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        else:
            best, sure = np.zeros(len(texts), int), np.zeros(len(texts))
        names = [langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.where(known, sure, 0.0))}

    return over_text(docs, score, "lang_pred string, score double", keep)
