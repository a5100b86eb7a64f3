"""Ties and large norms in the search, and many rows of one id in the mix, the packing and the passages."""

import numpy as np
from pyspark.sql import functions as F

from haulmark.llm.mixing import mix_sources
from haulmark.llm.neighbours import nearest_neighbours
from haulmark.llm.packing import cheapest_opening, pack, pack_documents
from haulmark.llm.passages import cut_passages
from tests.llm.helpers import WORDS, cut_by_brute_force, frame


def nearest_by_brute_force(rows, every, k):
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in rows:
        if i % every == 0:
            score = (x * np.array(v)).sum(axis=1)
            pairs = sorted((-s, j) for s, (j, _) in zip(score.tolist(), rows, strict=True) if j != i)[:k]
            out[i] = [(j, -s) for s, j in pairs]
    return out


def search_all(spark, rows, every, k, factor, shard):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest_neighbours(df, every, k=k, factor=factor, shard=shard).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_factor_one_is_exact_among_many_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.integers(-2, 3, 4)]) for i in range(1400)]
    rows = [(i, v) for i, v in rows if any(v)]
    assert search_all(spark, rows, 50, 20, 1.0, 400) == nearest_by_brute_force(rows, 50, 20)


def test_one_vector_of_large_norm_costs_no_recall(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 1500)] + [(0, [1e8] * 8)]
    got, want = search_all(spark, rows, 50, 20, 1.0, 2000), nearest_by_brute_force(rows, 50, 20)
    assert {q: [i for i, _ in found] for q, found in got.items()} == {q: [i for i, _ in found] for q, found in want.items()}


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 40)] + [(100, [1.0]), (101, [1.0, 2.0, 3.0])]
    got = search_all(spark, rows, 10, 3, 1.0, 100)
    assert got == nearest_by_brute_force(rows[:39], 10, 3) and 100 not in got


def test_many_rows_without_id_spread_over_blocks(spark):
    rows = [(None, "one two three", "en", "a")] * 3000 + [(i, "four five six", "en", "b") for i in range(100)]
    mixed = mix_sources(frame(spark, rows).repartition(5), block=64)
    got = mixed.groupBy("source_size").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert sorted(r["n"] for r in got) == [100, 3000] and all(abs(r["taken"] - r["target"]) <= 9 for r in got)
    packed = pack_documents(frame(spark, rows).repartition(5), lengths=(8, 16), block=64)
    assert packed.count() == 3100 and packed.select("bin_id").distinct().count() <= 3100 * 3 / 8 + 20
    assert packed.groupBy("bin_id").agg(F.sum("size").alias("s"), F.max("used").alias("u")).filter("s <> u").isEmpty()


def test_copies_of_a_text_without_id_are_cut_alike(spark):
    base = " ".join(WORDS[i * 7 % 400] for i in range(130))
    rows = [(1, base, "en", "a")] + [(None, "start " + base + " end", "en", "a")] * 60 + [(None, base[::-1], "en", "a")]
    want = sorted((str(i), n, gone, sha) for i, n, gone, sha in cut_by_brute_force([(10**9 if i is None else i, t) for i, t, _, _ in rows], 50))
    got = cut_passages(frame(spark, rows), ["doc_id"]).collect()
    made = sorted((str(10**9 if r["doc_id"] is None else r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got)
    assert made == want


def packed_by_scanning(sizes, lengths):
    """Best fit with a list of open bins that is scanned for each piece."""
    counts = {s: sizes.count(s) for s in set(sizes)}
    bins = []
    for s in sorted(sizes, reverse=True):
        counts[s] -= 1
        bits = sum(1 << x for x, n in counts.items() if n and x)
        fits = [b for b in bins if b[0] - b[1] >= s]
        if fits:
            min(fits, key=lambda b: b[0] - b[1])[1] += s
        else:
            bins.append([cheapest_opening(s, {x: n for x, n in counts.items() if n}, bits, sorted(lengths)), s])
    return sorted((used, min(c for c in lengths if c >= used)) for _, used in bins)


def test_packing_against_a_scan_of_all_bins():
    rng = np.random.default_rng(6)
    for lengths in ((16, 64, 256), (100,), (7, 13, 40)):
        for n in (1, 5, 60, 300):
            sizes = [int(x) for x in rng.integers(1, max(lengths) + 1, n)]
            bin_of, offset, capacity = pack(sizes, lengths)
            used = np.bincount(bin_of, sizes, minlength=len(capacity)).astype(int).tolist()
            assert sorted(zip(used, capacity, strict=True)) == packed_by_scanning(sizes, lengths)
