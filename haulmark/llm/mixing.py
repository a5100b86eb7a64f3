"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a target number of words. Its documents are taken a whole number of times plus
once more with some probability, and the cube method draws those extra takes: it moves the
probabilities inside the null space of the balancing constraints (words and documents), so both
totals stay where they were while one document after the other reaches 0 or 1.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import stored, told_apart, WORD
from haulmark.operators.ordering import prefix_sums, row_numbers

#: Documents that one task moves together; a source of more is cut into blocks of about as many.
BLOCK = 4096
SETTLED = 1e-9
#: Documents that the landing may turn over to bring the words back to their target.
TURNS = 8
#: Parts that the rows of one source are joined in.
SALTS = 64


def null_direction(a: float, b: float, c: float) -> tuple[float, float, float]:
    """A move of three probabilities that changes neither their sum nor their sum weighted by sizes."""
    u = (c - b, a - c, b - a)
    top = max(map(abs, u))
    return tuple(x / top for x in u) if top > 0 else (1.0, -1.0, 0.0)


def move(p: list[float], at: list[int], u: tuple, draw: float) -> None:
    """Go along ``u`` or against it until a probability is 0 or 1, so that each keeps its expectation."""
    ahead = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(at, u, strict=True) if abs(x) > 1e-12)
    back = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(at, u, strict=True) if abs(x) > 1e-12)
    step = ahead if draw * (ahead + back) < back else -back
    for i, x in zip(at, u, strict=True):
        q = p[i] + step * x
        p[i] = 0.0 if q < SETTLED else 1.0 if q > 1 - SETTLED else q


def fly(sizes: list[int], p: list[float], rng: random.Random) -> list[float]:
    """Flight phase: at most two probabilities are left between 0 and 1, those of the smallest documents."""
    p, open_, waiting = list(p), [], iter(sorted(range(len(p)), key=lambda i: -sizes[i]))
    while True:
        open_ = [i for i in open_ if 0 < p[i] < 1]
        while len(open_) < 3 and (nxt := next(waiting, None)) is not None:
            if 0 < p[nxt] < 1:
                open_.append(nxt)
        if len(open_) < 3:
            return p
        move(p, open_, null_direction(*(sizes[i] for i in open_)), rng.random())


def land(sizes: list[int], p: list[float], start: list[float], rng: random.Random) -> list[float]:
    """Landing phase for the one or two left: the document count is let go first, then the words.

    A long document that was left may have thrown the words off by most of its size. Single
    documents are then turned over, each the one whose size fits what is off best.
    """
    p = list(p)
    left = [i for i in range(len(p)) if 0 < p[i] < 1]
    if len(left) == 2:
        a, b = (sizes[i] for i in left)
        move(p, left, (b / (a + b), -a / (a + b)) if a and b else (1.0, -1.0), rng.random())
    for i in left:
        if 0 < p[i] < 1:
            p[i] = float(rng.random() < p[i])
    off = sum(s * (x - q) for s, x, q in zip(sizes, p, start, strict=True))
    for _ in range(TURNS):
        best = min(range(len(p)), key=lambda i: abs(off + sizes[i] * (1 - 2 * p[i])))
        after = off + sizes[best] * (1 - 2 * p[best])
        if abs(after) >= abs(off):
            break
        p[best], off = 1 - p[best], after
    return p


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """One row per source: its place by code point (null last), weight, size and target.

    Weights 1, 2, 3 repeat by place and share the words of all sources; no target passes ``most``
    times its source, and what is over goes to the others by weight. That is the level ``w * t`` for one t: with
    sources ordered by how soon they fill up, t is the largest of (words left) / (weight left).
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = row_numbers(totals.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "place")
    weighed = placed.select(
        "source", "source_size", "place", (F.col("place") % 3 + 1).cast("double").alias("weight"),
        (F.col("source_size") * F.lit(float(most))).alias("cap"),
    )
    weighed = stored(weighed.withColumn("fills_at", F.col("cap") / F.col("weight")))
    steps = prefix_sums(weighed, ["fills_at", "place"], ["cap", "weight"])
    all_words = weighed.select(F.sum("source_size")).scalar()
    all_weight = weighed.select(F.sum("weight")).scalar()
    level = steps.select(F.max((all_words - F.col("before_cap")) / (all_weight - F.col("before_weight")))).scalar()
    return weighed.select("source", "source_size", "place", F.least("cap", level * F.col("weight")).alias("target"))


def by_source(rows: DataFrame, sources: DataFrame, row_key: Column, on: list[str]) -> DataFrame:
    """Join rows to a table of sources that is repeated ``SALTS`` times: no task gets all rows of one source."""
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(row_key, F.lit(SALTS))).join(salted, [*on, "salt"]).drop("salt")


def _draw(level: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        place, block = int(key[0]), int(key[1])
        rows = rows.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable")
        rng = random.Random((place << 40) ^ (block << 8) ^ level)
        sizes, p = rows["size"].tolist(), fly(rows["size"].tolist(), rows["p"].tolist(), rng)
        if rows["blocks"].iloc[0] == 1:
            p = land(sizes, p, rows["p"].tolist(), rng)
        return rows.assign(p=p).drop(columns=["blocks", "block"])

    return run


def mix_sources(docs: DataFrame, most: float = 3.0, block: int = BLOCK, key: Column | None = None) -> DataFrame:
    """How often each document is taken: ``doc_id, size, source_size, target, copies, taken`` per row.

    ``size`` is the number of words (0 for null). A document is taken floor(target / source size)
    times, and once more by the cube draw. Draws depend on ids, sizes and a fixed seed only, so
    reruns agree. Rows with equal ids are documents of their own; null sources form one source;
    an empty table gives no rows. ``key`` (a long) is passed through and helps to order equal ids.
    Blocks are dealt by a hash, so a source with most of the rows is drawn by many tasks: each
    leaves at most two documents open, which meet in fewer blocks at the next level, until one
    block per source lands the last two.
    """
    key = F.lit(0).cast("long") if key is None else key
    sizes = docs.select("doc_id", "source", word_count().alias("size"), key.alias("key"))
    sizes = stored(told_apart(sizes, "doc_id", "key"))
    # Rows of equal id and key have hashes of their own: no block and no salt gets all of them.
    own = F.when(F.col("_nth") == 0, F.xxhash64("doc_id", "key")).otherwise(F.xxhash64("doc_id", "key", "_nth"))
    named = [F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")]
    targets = stored(source_targets(sizes, most)).select(*named, "place", "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sizes.select("doc_id", "key", "size", *named, own.alias("order"))
    units = by_source(rows, targets, F.col("order"), ["none", "name"]).select(
        "doc_id", "key", "size", "place", "source_size", "target",
        F.floor(ratio + SETTLED).alias("whole"), "order",
        F.greatest(ratio - F.floor(ratio + SETTLED), F.lit(0.0)).alias("p"),
    )
    units = units.withColumn("p", F.when(F.col("p") < SETTLED, F.lit(0.0)).otherwise(F.col("p")))
    # Documents without words weigh nothing; they stay with probability 0 and keep the draw small.
    rest, level, out = units.withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(F.lit(0.0))), 0, []
    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    while True:
        out.append(rest.filter(~is_open))
        rest = rest.filter(is_open)
        counts = rest.groupBy("place").agg(F.ceil(F.count("*") / block).alias("blocks"))
        dealt = by_source(rest, counts, F.col("order"), ["place"]).withColumn("block", F.pmod(F.xxhash64("order", F.lit(level)), F.col("blocks")))
        drawn = dealt.groupBy("place", "block").applyInPandas(_draw(level), rest.schema)
        rest, level = stored(drawn), level + 1
        if rest.filter(is_open).isEmpty():
            out.append(rest)
            break
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return whole.select(
        "doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "key"
    )
