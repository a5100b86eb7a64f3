"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted and each has a cost. Pieces go in by falling length, each into the
open bin that it fills best; if none has room, a new bin is opened with the length that costs least for
each word it can be expected to hold, judged by the pieces that are left. At the end each bin
shrinks to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import stored, told_apart
from haulmark.llm.mixing import word_count

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces that one task packs together.
BLOCK = 8192
#: Share of a bin that must be full for it to stand; the rest meet in fewer blocks and are packed again.
FULL = 0.98
#: Attention grows with the square of the length: at this length it costs as much as all the rest.
EVEN_LENGTH = 16_384


def cost_of(length: int) -> float:
    return length * (1 + length / EVEN_LENGTH)


class Rooms:
    """Open bins by the room they have left; the tightest that fits is found in one look at a bit set."""

    def __init__(self) -> None:
        self.bits, self.bins = 0, {}

    def add(self, room: int, bin_: int) -> None:
        if room:
            self.bits |= 1 << room
            self.bins.setdefault(room, []).append(bin_)

    def take(self, size: int) -> tuple[int, int] | None:
        fitting = self.bits >> size
        if not fitting:
            return None
        room = size + (fitting & -fitting).bit_length() - 1
        stack = self.bins[room]
        bin_ = stack.pop()
        if not stack:
            self.bits &= ~(1 << room)
        return room, bin_


def filling(counts: dict[int, int], bits: int, room: int) -> int:
    """Words that the largest pieces left would put into an empty room of this size."""
    got = 0
    while room:
        below = bits & ((1 << (room + 1)) - 1)
        if not below:
            break
        size = below.bit_length() - 1
        n = min(counts[size], room // size)
        got, room = got + n * size, room - n * size
        bits &= (1 << size) - 1
    return got


def cheapest_opening(size: int, counts: dict[int, int], bits: int, lengths: Sequence[int]) -> int:
    """The permitted length whose cost per expected word is least; the longer one at a tie."""
    def per_word(length: int) -> tuple[float, int]:
        return cost_of(length) / (size + filling(counts, bits, length - size)), -length

    return min((c for c in lengths if c >= size), key=per_word)


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the (shrunk) length of each bin. No piece is over the longest length."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    bits = sum(1 << s for s in counts if s)
    rooms, bin_of, offset, used = Rooms(), [0] * len(sizes), [0] * len(sizes), []
    for i in order:
        s = sizes[i]
        counts[s] -= 1
        if not counts[s]:
            bits &= ~(1 << s)
        found = rooms.take(s)
        if found is None:
            room, b = cheapest_opening(s, counts, bits, lengths), len(used)
            used.append(0)
        else:
            room, b = found
        bin_of[i], offset[i] = b, used[b]
        used[b] += s
        rooms.add(room - s, b)
    return bin_of, offset, [next(c for c in lengths if c >= u) for u in used]


def _pack_block(lengths: tuple[int, ...], level: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "order", "doc_id", "begin"], ascending=[False, True, True, True], kind="stable")
        bin_of, offset, capacity = pack(rows["size"].tolist(), lengths)
        used = np.bincount(bin_of, rows["size"], minlength=len(capacity)).astype(np.int64)
        bins, capacity = np.array(bin_of), np.array(capacity)
        last = int(rows["blocks"].iloc[0]) == 1
        done = last | (used[bins] >= FULL * capacity[bins])
        # Level, block and place in the block make the number of a bin unique without counting all bins.
        number = (level << 58) | (int(key[0]) << 20) | bins
        return rows.assign(
            bin_id=number, capacity=capacity[bins], used=used[bins], offset=np.array(offset, dtype="int64"), done=done
        ).drop(columns=["blocks", "block"])

    return run


def pieces_of(docs: DataFrame, longest: int, size: Column | None = None) -> DataFrame:
    """``doc_id, begin, size``: a document longer than the longest length is cut into pieces of it and a rest."""
    n = word_count() if size is None else size
    sized = docs.select("doc_id", n.alias("_n"), F.coalesce(F.xxhash64("doc_id", "text"), F.lit(0)).alias("order"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_n") - 1, F.lit(0).cast("long")), F.lit(longest).cast("long"))
    cut = sized.filter("_n > 0").select("doc_id", "order", "_n", F.explode(starts).alias("begin"))
    return cut.select("doc_id", "order", "begin", F.least(F.col("_n") - F.col("begin"), F.lit(longest)).cast("long").alias("size"))


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, block: int = BLOCK) -> DataFrame:
    """``bin_id, capacity, used, offset, doc_id, begin, size``: one row for each piece of each document.

    ``size`` counts words; ``begin`` is the piece's first word in its document and ``offset`` its place
    in the bin. ``used`` is what the bin holds. Documents without words (null texts too) need no room and have
    no row. Rows with equal ids are packed each on its own. An empty table gives no rows. Pieces
    are dealt to blocks by a hash, so no source or group of copies fills a task; bins that a block leaves
    less than ``FULL`` are emptied again and packed in fewer blocks, down to one, for as long as each round
    settles half of its pieces at least.
    """
    if min(lengths) < 1 or max(lengths) >= 1 << 20:
        raise ValueError("sequence lengths must lie between 1 and 2**20 - 1 words")
    # Equal pieces get hashes of their own, so that copies do not fill one block.
    pieces = told_apart(pieces_of(docs, max(lengths)), "order", "begin")
    own = F.when(F.col("_nth") == 0, F.col("order")).otherwise(F.xxhash64("order", "_nth"))
    rest, level, out = stored(pieces.withColumn("order", own).drop("_nth")), 0, []
    columns = ["doc_id", "order", "begin", "size"]
    pieces = rest.count()
    while True:
        # ``blocks`` is one number in every row; it falls with each level, as full bins stay behind.
        blocks = max(1, -(-pieces // block))
        dealt = rest.withColumn("blocks", F.lit(blocks).cast("long")).withColumn(
            "block", F.pmod(F.xxhash64("order", "begin", F.lit(level)), F.lit(blocks))
        )
        schema = rest.select(*columns).schema
        text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        packed = stored(dealt.groupBy("block").applyInPandas(
            _pack_block(lengths, level), f"{text}, bin_id long, capacity int, used long, offset long, done boolean"
        ))
        left = packed.filter("NOT done")
        before, pieces = pieces, left.count()
        if not pieces or 2 * pieces > before:
            out.append(packed)
            break
        out.append(packed.filter("done"))
        rest, level = left.select(*columns), level + 1
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole.select("bin_id", "capacity", "used", "offset", "doc_id", "begin", "size")
