"""MinHash near-dedup: universal hash minima, banding, signature and full-set checks, components.

Texts with the same shingle set are one class from the start, whatever their number. Classes
that agree on a band meet in a bucket. A bucket is not turned into pairs: its members are
compared with one of them, the centre, which is the member that meets most others. Members
unlike the centre get centres of their own, so that every pair of a bucket whose signatures do not
rule it out lies in a star. What the centre does not settle is settled among the members of its star
on full sets, in blocks of bounded size, and only between members that are not connected already.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import over_text, small_batches, stored, text_slices
from haulmark.llm.components import components
from haulmark.llm.narrow import maybe_in
from haulmark.llm.words import U64, cut_words, mix, window_hashes

SHINGLE = 5
PERCENT = 80
#: Minima in a band, and how often a pair right at the threshold may miss all bands.
ROWS = 5
MISS = 1e-5
#: Standard deviations below the threshold at which a signature rules a pair out.
SIGMAS = 5.0
#: Share of equal signature bytes from which a member belongs to the star of a centre.
INNER = 0.35
#: Centres that a bucket gets one after the other while more than ``BLOCK`` members are left.
PASSES = 8
#: Members on either side of a comparison block.
BLOCK = 512


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each set starts.

    A text of fewer than ``k`` words has its whole word sequence as its one shingle.
    """
    words = cut_words(texts, lower=True)
    h, n = words.hashes(), words.counts
    text = words.text_of
    whole = window_hashes(h, k)
    inside = np.flatnonzero(text[: len(whole)] == text[k - 1 :][: len(whole)])
    value, of = [whole[inside]], [text[inside]]
    for m in range(1, k):  # short texts
        at = words.first[:-1][n == m]
        if len(at):
            value.append(window_hashes(h, m, seed=7 + k - m)[at])
            of.append(np.flatnonzero(n == m))
    value, of = np.concatenate(value), np.concatenate(of)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[first], of[first]
    return value, np.searchsorted(of, np.arange(len(texts) + 1))


def by_set(x: np.ndarray, first: np.ndarray, fold) -> np.ndarray:
    """Fold the numbers of each set; sets that are empty give 0."""
    full = np.diff(first) > 0
    out = np.zeros(len(full), x.dtype)
    if full.any():
        out[full] = fold.reduceat(x, first[:-1][full])
    return out


def fingerprints(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set, the same in any order of its members."""
    with np.errstate(over="ignore"):
        summed = by_set(mix(value ^ U64(0xA0761D6478BD642F)), first, np.add)
        return mix(summed ^ by_set(mix(value), first, np.bitwise_xor) ^ np.diff(first).astype(U64))


def minima(value: np.ndarray, first: np.ndarray, many: int) -> np.ndarray:
    """Smallest value of each of ``many`` universal hash functions on each set (sets by functions)."""
    rng = np.random.default_rng(23)
    factor = rng.integers(1, 1 << 63, many, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    shift = rng.integers(0, 1 << 63, many, dtype=np.int64).astype(U64)
    out = np.zeros((len(first) - 1, many), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(many):
            out[:, i] = by_set(((value * factor[i] + shift[i]) >> U64(32)).astype(np.uint32), first, np.minimum)
    return out


def signatures(docs: DataFrame, shingle: int, bands: int, keep: list[str]) -> DataFrame:
    """``keep``, ``n_shingles, node, bands, signature`` per document; ``node`` is null for an empty set.

    The signature keeps one byte of each minimum, which is enough to tell close sets from others.
    """

    def score(texts: pa.Array) -> dict[str, pa.Array]:
        value, first = shingle_sets(texts, shingle)
        n = np.diff(first)
        low = minima(value, first, bands * ROWS)
        keys = np.zeros((len(n), bands), U64)
        with np.errstate(over="ignore"):
            for b in range(bands):
                key = np.full(len(n), b + 1, U64)
                for i in range(b * ROWS, (b + 1) * ROWS):
                    key = mix(key * U64(0xD6E8FEB86659FD93) ^ low[:, i].astype(U64))
                keys[:, b] = key
        offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
        small = (low & 0xFF).astype(np.uint8)
        return {
            "n_shingles": pa.array(n.astype(np.int64)),
            "node": pa.array(fingerprints(value, first).view(np.int64), mask=n == 0),
            "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].ravel().view(np.int64))),
            "signature": pa.array([small[i].tobytes() for i in range(len(n))], pa.binary()),
        }

    schema = "n_shingles long, node long, bands array<long>, signature binary"
    return over_text(docs, score, schema, keep)


def cuts(percent: int) -> tuple[float, float, float]:
    """Shares of equal signature bytes: of a pair that may be linked, of a member of a star, and of a member that is done with its bucket.

    The share of unequal bytes is a metric. If a pair may be linked and one of it falls short of
    the second share with a centre, the other falls short of the third: both stay in the bucket.
    """
    t = percent / 100
    least = t - SIGMAS * math.sqrt(t * (1 - t) / (bands_for(percent) * ROWS))
    inner = min(least, INNER)
    return least, inner, inner + 1 - least + 1e-9


def bucket_members(sigs: DataFrame) -> DataFrame:
    """``bucket, node, weight`` for each bucket of at least two classes; a class that meets more others weighs more."""
    entries = sigs.filter("node IS NOT NULL").select("node", F.explode("bands").alias("bucket"))
    met = entries.groupBy("bucket").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi"), F.count("*").alias("size"))
    # Summaries are written before they are joined: then Spark can split the rows of a hot key.
    met = stored(met.filter("_lo < _hi").select("bucket", "size"))
    # Copies of one text bring the same entry many times; a class counts once from here on.
    inside = stored(entries.join(met, "bucket").distinct())
    weight = stored(inside.groupBy("node").agg(F.sum("size").alias("weight")))
    return stored(inside.select("bucket", "node").join(weight, "node"))


def signature_shares(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """``centre, node, more`` of each pair and the share of its signature bytes that are equal."""
    with_node = pairs.join(one.withColumnRenamed("signature", "_s"), "node")
    both = with_node.join(one.select(F.col("node").alias("centre"), F.col("signature").alias("_c")), "centre")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("_s", "_c"))
            kept = batch.select(["centre", "node", "more"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array((x == y).mean(axis=1))], names=[*kept.schema.names, "share"])

    return both.select("centre", "node", "more", "_s", "_c").mapInArrow(run, "centre long, node long, more boolean, share double")


def star_pass(members: DataFrame, one: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of each bucket's centre with the members near it, and the members that still have to meet others of their bucket."""
    least, inner, leave = cuts(percent)
    centres = members.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("_c"), F.count("*").alias("_n"))
    centres = stored(centres.select("bucket", F.col("_c.node").alias("centre"), (F.col("_n") > 2).alias("more")))
    starred = members.join(centres, "bucket").filter("centre != node")
    shares = stored(signature_shares(starred.groupBy("centre", "node").agg(F.max("more").alias("more")), one))
    near = shares.filter(F.col("share") >= F.when(F.col("more"), inner).otherwise(least)).select("centre", "node")
    far = shares.filter(F.col("more") & (F.col("share") < leave)).select("centre", "node")
    stay = stored(starred.filter("more").join(far, ["centre", "node"]).select("bucket", "node", "weight"))
    sizes = stored(stay.groupBy("bucket").agg(F.count("*").alias("left")).filter("left > 1"))
    return near, stay.join(sizes, "bucket")


def _rest_stars(percent: int):
    """The stars of one group of classes that cover each of its pairs that may be linked."""
    least, inner, leave = cuts(percent)

    def run(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        bytes_ = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(node), -1)
        share = np.stack([(bytes_ == row).mean(axis=1) for row in bytes_])
        close = share >= least
        np.fill_diagonal(close, False)
        here, many = np.ones(len(node), bool), close.sum(axis=1)
        centre, other = [], []
        while many.any():
            c = int(many.argmax())
            star = (many > 0) & (share[c] >= inner)
            star[c] = False
            centre.append(np.full(star.sum(), node[c]))
            other.append(node[star])
            done = here & (share[c] >= leave)
            done[c] = True
            here &= ~done
            many = np.where(here, many - close[:, done].sum(axis=1), 0)
        none = [np.zeros(0, np.int64)]
        return pa.table({"centre": np.concatenate(centre or none), "node": np.concatenate(other or none)})

    return run


def rest_stars(members: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """``centre, node`` of stars inside groups of at most about two ``BLOCK``; any two members of a bucket meet in a group."""
    parts = F.ceil(F.col("left") / BLOCK)
    mine = F.pmod(F.xxhash64("node", F.lit(9)), F.col("parts"))
    dealt = members.join(one, "node").withColumn("parts", parts).withColumn("x", mine)
    dealt = dealt.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("bucket", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "node", "signature")
    return dealt.groupBy("bucket", "lo", "hi").applyInArrow(_rest_stars(percent), "centre long, node long")


def alike_by_signature(sigs: DataFrame, percent: int) -> DataFrame:
    """``centre, node``: stars that hold every pair of a bucket whose signatures do not rule it out.

    A bucket gets one centre after the other, each among the members that the last one left, until
    it has at most ``BLOCK`` of them; these, and what ``PASSES`` centres leave, are covered in groups.
    """
    one = stored(sigs.filter("node IS NOT NULL").groupBy("node").agg(F.min("signature").alias("signature")))
    near, left = star_pass(bucket_members(sigs), one, percent)
    found, small = near, []
    for _ in range(PASSES - 1):
        small.append(left.filter(F.col("left") <= BLOCK))
        left = left.filter(F.col("left") > BLOCK)
        if left.isEmpty():
            break
        near, left = star_pass(left.drop("left"), one, percent)
        found = found.unionByName(near)
    for some in small:
        left = left.unionByName(some)
    return found.unionByName(rest_stars(left, one, percent)).distinct()


def full_sets(docs: DataFrame, sigs: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """``node, items``: the whole set of every class that a pair names, sorted."""
    wanted = pairs.select("node").union(pairs.select(F.col("centre").alias("node"))).distinct()
    # A row is found by its id and its text: ids can be null, and null ones have many texts.
    key = ["_none", "_id", "_text"]
    own = [F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "_text"]
    holders = sigs.filter("node IS NOT NULL").select("node", F.struct(*own).alias("_row")).groupBy("node").agg(F.min("_row").alias("_row"))
    holder = stored(holders.join(wanted, "node").select("_row.*"))
    near, _ = maybe_in(docs.select("text", *own), holder, *key)
    texts = near.join(holder.distinct(), key, "left_semi")
    small_batches(docs.sparkSession)

    def run(batches):
        for part in text_slices(batches):
            value, first = shingle_sets(part.column("text"), shingle)
            items = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.view(np.int64)))
            n = np.diff(first)
            made = pa.RecordBatch.from_arrays(
                [pa.array(fingerprints(value, first).view(np.int64)), items], names=["node", "items"]
            )
            yield made.filter(pa.array(n > 0))

    sets = texts.select("text").mapInArrow(run, "node long, items array<long>")
    return sets.dropDuplicates(["node"])


def star_overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Every star pair with its overlap, and what the member lacks or has beside its centre."""
    mine = pairs.join(sets.withColumnRenamed("items", "_x"), "node")
    both = mine.join(sets.select(F.col("node").alias("centre"), F.col("items").alias("_c")), "centre")
    out = both.select(
        "centre", "node", F.size("_x").alias("n"), F.size("_c").alias("n_centre"),
        F.array_except("_c", "_x").alias("lacks"), F.array_except("_x", "_c").alias("adds"),
    )
    overlap = F.col("n_centre") - F.size("lacks")
    return out.withColumn("overlap", overlap).withColumn("united", F.col("n") + F.col("n_centre") - overlap)


def _block_links(percent: int):
    """Links between open members and members of other components, one for each two components."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return none
        size = int(left["n_centre"].iloc[0])

        def spread(rows):
            parts = [np.concatenate([x, y]) for x, y in zip(rows["lacks"], rows["adds"], strict=True)]
            return np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts) if parts else np.zeros(0, np.int64)

        (li, lv), (ri, rv) = spread(left), spread(right)
        both = np.intersect1d(lv, rv)
        shared = np.zeros((len(left), len(right)), np.float32)
        for a in range(0, len(both), 4096):
            some = both[a : a + 4096]
            x, y = np.zeros((len(left), len(some)), np.float32), np.zeros((len(right), len(some)), np.float32)
            for grid, i, v in ((x, li, lv), (y, ri, rv)):
                at = np.searchsorted(some, v)
                ok = (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == v)
                grid[i[ok], at[ok]] = 1
            shared += x @ y.T
        lacks = np.add.outer(left["lacks"].map(len).to_numpy(), right["lacks"].map(len).to_numpy())
        overlap = size - lacks + shared
        united = np.add.outer(left["n"].to_numpy(), right["n"].to_numpy()) - overlap
        apart = left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :]
        i, j = np.nonzero((100 * overlap >= percent * united) & apart)
        found = pd.DataFrame({"a": left["root"].to_numpy()[i], "b": right["root"].to_numpy()[j]})
        return found.drop_duplicates() if len(found) else none

    return run


def links_inside_stars(overlaps: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Edges between components that only members of one star, not its centre, make.

    Members are compared by what they lack and add beside the centre, which gives their exact
    overlap. Two members that are both linked to the centre are connected already, so one of a
    pair must be open (not linked to it). A block pair holds at most about ``BLOCK`` members a side.
    """
    rooted = overlaps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = F.col("overlap") * 100 >= F.col("united") * percent
    members = stored(rooted.select("centre", "node", "root", "n", "n_centre", "lacks", "adds", (~linked).alias("open")))
    sizes = members.groupBy("centre").agg(
        F.count("*").alias("all"), F.sum(F.col("open").cast("long")).alias("opened"),
        (F.min("root") != F.max("root")).alias("apart"),
    )
    sizes = stored(sizes.filter("opened > 0 AND apart").select(
        "centre", F.ceil(F.col("all") / BLOCK).alias("parts"), F.ceil(F.col("opened") / BLOCK).alias("open_parts")
    ))
    placed = members.join(sizes, "centre")
    own = F.xxhash64("node", F.lit(5))

    def spread(df, mine, other, first, second):
        return df.withColumn(first, F.pmod(own, F.col(mine))).withColumn(second, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))

    left = spread(placed.filter("open"), "open_parts", "parts", "x", "y")
    right = spread(placed, "parts", "open_parts", "y", "x")
    columns = ["centre", "x", "y", "root", "n", "n_centre", "lacks", "adds"]
    keys = ["centre", "x", "y"]
    paired = left.select(*columns).groupBy(*keys).cogroup(right.select(*[F.col(c).alias(c) for c in columns]).groupBy(*keys))
    return paired.applyInPandas(_block_links(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document, and its columns ``more``.

    Words are lower-cased in A-Z. Two documents are linked when 100 * shared shingles >= ``percent``
    * all shingles of both; a component is what links reach, named by its smallest doc_id, and
    the document of that id is kept. Texts without words (or null) have no shingles and are
    components of their own. Rows that share a doc_id and a set are one class; a null doc_id never
    names a component that has another id. An empty table gives no rows. A pair right at the
    threshold is missed with probability ``MISS`` at most by the bands, and less often than one in a
    million by its signatures (``SIGMAS``); everything after them is exact.
    """
    bands = bands_for(percent)
    docs = docs.withColumn("_text", F.xxhash64("text"))
    sigs = stored(signatures(docs, shingle, bands, ["doc_id", "_text", *more]))
    pairs = stored(alike_by_signature(sigs, percent))
    sets = stored(full_sets(docs, sigs, pairs, shingle))
    overlaps = stored(star_overlaps(pairs, sets))
    linked = overlaps.filter(F.col("overlap") * 100 >= F.col("united") * percent)
    edges = linked.select(F.col("centre").alias("a"), F.col("node").alias("b"))
    roots = components(edges)
    across = stored(links_inside_stars(overlaps, roots, percent))
    if not across.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(across))
    classes = sigs.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("_lowest"))
    rooted = stored(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # Written before it is joined: then Spark can split the classes of one large component.
    lowest = stored(rooted.groupBy("root").agg(F.min("_lowest").alias("component_id")))
    named = stored(rooted.join(lowest, "root").select("node", "component_id"))
    out = sigs.select("doc_id", *more, "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", *more, "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
