"""Substring dedup by compacting the de Bruijn graph of words.

Edges of the graph are windows of ``WINDOW`` words (k-mers over tokens); neighbours on a text
share all but one word. Following the way large graphs are compacted, a text is cut into runs of
consecutive edges that have the same minimizer (the smallest hash of a shorter k-mer inside the
edge): equal edges have equal minimizers, so they always meet in the same bucket. Then

1. minimizers of one document only are dropped: no edge there repeats across documents;
2. a bucket in which all runs spell the same words is a nonbranching path: one row stands for all
   its edges, and all documents but the smallest have theirs repeated;
3. in a bucket that branches, runs that spell the same words are still one path; only the first
   document of each path has its run opened up into edges, which meet by their own hash.

Document and position (the source coordinates) go along, and the words that repeated edges cover are cut
out of the whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import small_batches, stored, text_slices
from haulmark.llm.narrow import maybe_in
from haulmark.llm.words import SpanHashes, cut_words, longs, sliding_min, window_hashes

WINDOW = 50
MINIMIZER = 8
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Null ids are taken as larger than any other.
_LAST = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """``doc, key, text``: the id, and a hash of the text so that rows with one id stay apart (64 bits)."""
    return docs.select(F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("doc"), F.xxhash64("text").alias("key"), "text")


def runs_of_edges(rows: DataFrame, window: int, small: int) -> DataFrame:
    """``minimizer, path, doc, key, begin, edges``: runs of edges with one minimizer, and a hash of their words."""
    small_batches(rows.sparkSession)

    def run(batches):
        for part in text_slices(batches):
            words = cut_words(part.column("text"))
            h, text = words.hashes(), words.text_of
            if len(h) < window:
                continue
            least = sliding_min(window_hashes(h, small), window - small + 1)
            inside = text[: len(least)] == text[window - 1 :]
            fresh = inside.copy()
            fresh[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
            begin = np.flatnonzero(fresh)
            if not len(begin):
                continue
            # A run goes on to the next one or to the first place where no window fits.
            stops = np.flatnonzero(fresh | ~inside)
            at = np.searchsorted(stops, begin, "right")
            end = np.append(stops, len(inside))[at]
            path = SpanHashes(h, _BASES[0])(begin, end - begin + window - 1)
            of = text[begin]
            yield pa.RecordBatch.from_arrays(
                [
                    longs(least[begin]), longs(path), part.column("doc").take(pa.array(of)), part.column("key").take(pa.array(of)),
                    pa.array((begin - words.first[of]).astype(np.int32)), pa.array((end - begin).astype(np.int32)),
                ],
                names=["minimizer", "path", "doc", "key", "begin", "edges"],
            )

    return rows.mapInArrow(run, "minimizer long, path long, doc long, key long, begin int, edges int")


def open_edges(rows: DataFrame, window: int) -> DataFrame:
    """``e1, e2, doc, key, begin``: every edge of the runs listed beside each text."""
    small_batches(rows.sparkSession)

    def run(batches):
        for part in text_slices(batches):
            words = cut_words(part.column("text"))
            h = words.hashes()
            spans = part.column("runs")
            of = np.repeat(np.arange(part.num_rows), np.diff(spans.offsets.to_numpy()))
            flat = spans.flatten()
            begin, edges = flat.field("begin").to_numpy(), flat.field("edges").to_numpy()
            at = np.repeat(begin + words.first[of], edges) + np.arange(edges.sum()) - np.repeat(np.cumsum(edges) - edges, edges)
            of = pa.array(np.repeat(of, edges))
            place = at - words.first[of.to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(longs(SpanHashes(h, b)(at, window)) for b in _BASES), part.column("doc").take(of), part.column("key").take(of),
                    pa.array(place.astype(np.int32)),
                ],
                names=["e1", "e2", "doc", "key", "begin"],
            )

    return rows.mapInArrow(run, "e1 long, e2 long, doc long, key long, begin int")


def per_text(runs: DataFrame) -> DataFrame:
    """Runs of each text in one row; a text has fewer runs than words, and copies of one id have the same."""
    return runs.groupBy("doc", "key").agg(F.collect_set(F.struct("begin", "edges")).alias("runs"))


def repeated_runs(docs: DataFrame, window: int = WINDOW, small: int = MINIMIZER) -> DataFrame:
    """``doc, key, begin, edges``: runs of edges whose words also start in a document with a smaller id."""
    runs = stored(runs_of_edges(keyed(docs), window, small))
    met = runs.groupBy("minimizer").agg(
        F.min("doc").alias("lowest"), F.max("doc").alias("_hi"), (F.min("path") != F.max("path")).alias("branches")
    )
    # Summaries are written before they are joined: then Spark can split the rows of a hot key.
    met = stored(met.filter(F.col("lowest") < F.col("_hi")).drop("_hi"))
    shared = stored(runs.join(met, "minimizer"))
    plain = shared.filter(~F.col("branches") & (F.col("doc") > F.col("lowest")))
    branching = shared.filter("branches").drop("branches", "lowest")
    paths = stored(branching.groupBy("minimizer", "path").agg(F.min("doc").alias("lowest")))
    split = stored(branching.join(paths, ["minimizer", "path"]).select("doc", "key", "begin", "edges", (F.col("doc") > F.col("lowest")).alias("again")))
    leading = stored(per_text(split.filter(~F.col("again"))))
    near, _ = maybe_in(keyed(docs), leading, "doc", "key")
    texts = near.join(leading, ["doc", "key"]).select("doc", "key", "text", "runs")
    edges = stored(open_edges(texts, window))
    twice = edges.groupBy("e1", "e2").agg(F.min("doc").alias("lowest"), F.max("doc").alias("_hi"))
    twice = stored(twice.filter("lowest < _hi").drop("_hi"))
    single = edges.join(twice, ["e1", "e2"]).filter(F.col("doc") > F.col("lowest"))
    columns = ["doc", "key", "begin", "edges"]
    return (
        plain.select(*columns).unionByName(split.filter("again").select(*columns))
        .unionByName(single.select("doc", "key", "begin", F.lit(1).alias("edges")))
    )


def _cut(window: int, with_text: bool):
    def run(batches):
        for batch in batches:
            out = [[] for _ in range(4)]
            runs = batch.column("runs").to_pylist() if "runs" in batch.schema.names else [None] * batch.num_rows
            for text, spans in zip(batch.column("text").to_pylist(), runs, strict=True):
                words = text.encode().split() if text else []
                n = len(words)
                if spans:
                    edge = np.zeros(n + 1, np.int32)
                    begin = np.array([s["begin"] for s in spans])
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + np.array([s["edges"] for s in spans]) + window - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                for column, value in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text and spans else None), strict=True):
                    column.append(value)
            made = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())]
            rest = [c for c in batch.schema.names if c not in ("text", "runs")] if not with_text else [c for c in batch.schema.names if c != "runs"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made], names=[*rest, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def cut_passages(docs: DataFrame, keep: list[str], window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """``keep`` columns, ``n_words, n_removed, kept_sha256`` and ``kept_text`` of each document.

    Every word that lies in a window of ``window`` words which also starts in a document with a
    smaller id is removed; windows are judged on the input. ``kept_text`` holds the kept words
    joined by one space where something was removed and ``with_text`` is set, else null (the text
    stands as it is). Null texts have no words. Rows with the same id are never taken for
    smaller ones of each other, and null ids count as the largest. Texts of fewer words than the
    window lose nothing. Names of further columns do not matter.
    """
    runs = stored(per_text(repeated_runs(docs, window)))
    own = [F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("_doc"), F.xxhash64("text").alias("_key")]
    rows = docs.select(*dict.fromkeys([*keep, "text"]), *own)
    wanted = runs.select(F.col("doc").alias("_doc"), F.col("key").alias("_key"))
    near, far = maybe_in(rows, wanted, "_doc", "_key")
    spans = runs.select(F.col("doc").alias("_doc"), F.col("key").alias("_key"), "runs")
    near = near.join(spans, ["_doc", "_key"], "left").drop("_doc", "_key")
    far = far.drop("_doc", "_key")
    small_batches(docs.sparkSession)
    shown = [f for f in far.schema.fields if with_text or f.name in keep]
    shown = [f for f in shown if with_text or f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown)
    schema += ", n_words long, n_removed long, kept_sha256 string, kept_text string"
    return near.mapInArrow(_cut(window, with_text), schema).unionByName(far.mapInArrow(_cut(window, with_text), schema))
