"""Token ids as Parquet files in document order, and their selective reading.

``write_tokens`` orders documents by range partitions, encodes each whole text and writes one file
per partition: ``doc_id``, ``n_tokens``, ``offset`` (ids of earlier documents of the same file),
``part`` (number of the file) and ``ids`` as a list column. Parquet keeps the columns apart, so
``read_metadata`` never touches an id; rows are in the order of ``doc_id``, so a filter on it skips
row groups by their statistics and pages by the page index.

Defined cases: a null text is empty and gives the end id alone. Rows with a null id come first.
Rows of equal id lie in the order of a hash of their text; equal rows are all written. An empty
table gives an empty folder with a schema. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.llm.common import small_batches, text_slices

#: A Python worker remembers encoded pieces over its tasks: at most about twice as many, of some 200 bytes each.
REMEMBERED = 300_000
# Letters of ASCII and Latin-1, and characters that are neither blank nor outside of these.
_L, _SEEN = "A-Za-zÀ-ÖØ-öø-ÿ", "!-~À-ÖØ-öø-ÿ"
#: A word where a byte-level tokenizer surely starts and ends a piece: letters up to a character that
#: is surely no letter, with the space before them if that follows a visible character; or letters after a mark
#: or digit (an apostrophe may belong to them) or after a single line end.
_WORD = rf"(?:(?<=[{_SEEN}]) |(?<=[!-&(-@\[-`{{-~])|(?<=[{_SEEN}]\n))[{_L}]++(?![^\x00-\x7f])"
_PIECES = re.compile(rf"{_WORD}|(?:(?!{_WORD}).)+", re.S)
#: How the id column is written: by dictionary pages, or as differences of neighbouring ids.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_1_0"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers, with a bounded memory of encoded pieces.

    Where the tokenizer splits by the standard byte-level pattern, texts are cut where that pattern is
    sure to start a piece and never looks across, and equal pieces are encoded once. Texts that hold
    an added token, and texts for any other tokenizer, are encoded whole.
    """

    def __init__(self, tokenizer_json: str) -> None:
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as little-endian 32-bit numbers")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = json.loads(tokenizer_json)
        self.library = Tokenizer.from_str(tokenizer_json)
        self.model, self.letters = self.library.model, byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.by_pieces = splits_at_words(made)
        self.added = [t["content"] for t in made.get("added_tokens") or []]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: set[str]) -> None:
        words = [p for p in pieces if p[-1:].isalpha() and p.lstrip(" ").isalpha()]
        for word in words:
            # ASCII letters stand for themselves.
            spelt = word.replace(" ", self.letters[0x20]) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            self.known[word] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        rest = list(pieces.difference(words))
        self.known.update(zip(rest, self.whole(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_pieces:
            return self.whole(texts)
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        cut = [None if any(a in t for a in self.added) else _PIECES.findall(t) for t in texts]
        new = set().union(*filter(None, cut)).difference(self.known)
        # Pieces that come again move on from the older half, the others are forgotten with it.
        again = new.intersection(self.older)
        self.known.update((p, self.older[p]) for p in again)
        self.learn(new.difference(again))
        known = self.known.__getitem__
        return [self.whole([t])[0] if pieces is None else b"".join(map(known, pieces)) for t, pieces in zip(texts, cut, strict=True)]


_LAST: dict[int, Encoder] = {}


def encoder_for(tokenizer_json: str) -> Encoder:
    """The encoder this worker made for the tokenizer before, or a new one; one is kept."""
    key = zlib.crc32(tokenizer_json.encode()) << 32 | len(tokenizer_json)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Encoder(tokenizer_json)
    return _LAST[key]


def splits_at_words(made: dict) -> bool:
    """Whether pieces can be encoded one by one."""
    split = made.get("pre_tokenizer") or {}
    return (
        made.get("normalizer") is None
        and made.get("model", {}).get("type", "BPE") == "BPE"
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space", True)
        and not made.get("truncation")
    )


def cut_at_words(text: str) -> list[str]:
    """The text in pieces that can be encoded one by one."""
    return _PIECES.findall(text)


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 5000,
    codec: str = "zstd",
) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) and write them below ``path`` in ascending order of doc_id.

    ``tokenizer`` is the file of a tokenizer; the driver reads it and sends it with the tasks.
    """
    small_batches(docs.sparkSession)
    made = tokenizer_text(tokenizer)
    # Equal ids are spread by their text, equal texts by the place of the row in the input.
    order = ["doc_id", "_text", "_row"]
    placed = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_row"))
        .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = encoder_for(made), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in text_slices(batches):
            whole = [e + end for e in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
            sizes = np.array([len(w) // 4 for w in whole], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            flat = pa.array(np.frombuffer(b"".join(whole), "<i4"))
            ids = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(before + starts[:-1]), pa.array(np.full(len(sizes), part, np.int32)), ids],
                names=["doc_id", "n_tokens", "offset", "part", "ids"],
            )
            before += int(starts[-1])

    encoded = placed.mapInArrow(run, f"doc_id {kind}, n_tokens long, offset long, part int, ids array<int>")
    limits = {
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
        "parquet.block.size.row.check.min": 10, "parquet.page.size.row.check.min": 10,
    }
    writer = encoded.write.option("compression", codec).options(**{k: str(v) for k, v in limits.items()})
    # Rows are already ordered within each file, and the name of a file has the number of its partition.
    writer.options(**ENCODINGS[encoding]).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` and ``n_tokens`` of each document, without reading ids."""
    return _started(spark, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids``; ``where`` (on doc_id) skips row groups and pages."""
    return _started(spark, path, where).select("doc_id", "start", "n_tokens", "ids")


def _started(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    # One row per file.
    sizes = rows.groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("_size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    chosen = rows.filter(where) if where else rows
    # One row per file; the rows with ids are not shuffled.
    return chosen.join(F.broadcast(starts), "part").withColumn("start", F.col("_start") + F.col("offset"))


def id_checksums(tokens: DataFrame) -> DataFrame:
    """``ids_crc32`` of the ids of each row, as little-endian 32-bit numbers, beside the other columns."""
    keep = [c for c in tokens.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sums, pa.int64())], names=[*keep, "ids_crc32"])

    small_batches(tokens.sparkSession)
    kept = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in keep)
    return tokens.mapInArrow(run, f"{kept}, ids_crc32 long")
