import random

import pytest
from helpers import WORDS, components_by_brute_force, frame, hard_rows, random_texts
from pyspark.sql import functions as F

from haulmark.llm import neardup
from haulmark.llm.components import components
from haulmark.llm.neardup import near_duplicates


def family(rng, size, words, strongest):
    base = [rng.choice(WORDS) for _ in range(words)]
    for _ in range(size):
        ws = list(base)
        for _ in range(rng.randint(0, strongest)):
            ws[rng.randrange(len(ws))] = rng.choice(WORDS) + rng.choice("abcdef")
        yield " ".join(ws).title() if rng.random() < 0.3 else " ".join(ws)


def planted(seed):
    rng = random.Random(seed)
    texts = random_texts(40, seed) + [t for n, w, s in ((60, 120, 12), (25, 60, 6), (8, 200, 4)) for t in family(rng, n, w, s)]
    rng.shuffle(texts)
    return list(enumerate(texts + ["", "a b", "A B", "one", None]))


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 85), (2, 3, 85), (3, 5, 80)])
def test_components_equal_brute_force(spark, seed, k, percent):
    rows = planted(seed)
    got = near_duplicates(frame(spark, [(i, t, "en", "a") for i, t in rows]), k, percent).collect()
    want = components_by_brute_force(rows, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_stars_in_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = list(enumerate(family(random.Random(8), 150, 80, 14)))
    got = near_duplicates(frame(spark, [(i, t, "en", "a") for i, t in rows]), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_brute_force(rows, 3, 85)


def test_hard_rows(spark):
    got = near_duplicates(frame(spark, hard_rows())).collect()
    assert len(got) == len(hard_rows())
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].component_id == by_id[2].component_id == 1 and by_id[7].component_id == 6
    assert by_id[3].n_shingles == by_id[4].n_shingles == by_id[5].n_shingles == 0
    assert all(by_id[i].kept for i in (1, 3, 4, 5, 6, 8, 10, 11))
    none = sorted((r.component_id or 0, r.kept) for r in got if r.doc_id is None)
    assert none == [(0, True), (1, False)]
    assert near_duplicates(frame(spark, [])).count() == 0


def test_near_copies_without_an_id(spark):
    ws = [f"{w}{i}" for i, w in enumerate(random.Random(5).choices(WORDS, k=200))]
    rows = [(1, " ".join(ws[:80])), (None, " ".join(ws[2:82])), (2, " ".join(ws[100:180])), (3, " ".join(ws[110:190])), (None, " ".join(ws[105:185]))]
    got = near_duplicates(frame(spark, [(i, t, "en", "a") for i, t in rows]), 3, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, 1, False), (0, 2, False), (1, 1, True), (2, 2, True), (3, 2, False)]
    # Without the rows that have no id, 2 and 3 are not linked.
    assert [c for _, c in components_by_brute_force([r for r in rows if r[0]], 3, 85).values()] == [1, 2, 3]


def test_stars_join_chains_hubs_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, 100 + i) for i in range(1, 60)]
    edges = spark.createDataFrame([*chain, *hub, (7, 7), (200, 201), (201, 200)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def in_buckets(monkeypatch, buckets):
    """Deal documents to buckets by their id instead of by their bands."""
    real = neardup.signatures

    def dealt(docs, *rest):
        named = [F.when(F.col("doc_id") == i, F.array(*[F.lit(b).cast("long") for b in bs])) for i, bs in buckets.items()]
        return real(docs, *rest).withColumn("bands", F.coalesce(*named))

    monkeypatch.setattr(neardup, "signatures", dealt)


@pytest.mark.parametrize("block", [512, 2])
def test_close_pairs_in_a_bucket_with_an_unlike_centre(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PASSES", 2, raising=False)
    rng = random.Random(4)
    ws = [f"{w}{i}" for i, w in enumerate(rng.choices(WORDS, k=200))]
    # 1 and 2 are unlike the centre; 3 is near the centre and 4 is not, though 3 and 4 are linked.
    rows = [(1, " ".join(ws[:80])), (2, " ".join(ws[2:82]))]
    rows += [(3, " ".join(ws[116:196])), (4, " ".join(ws[120:200])), (9, " ".join(ws[103:183])), (10, "some other words of its own")]
    in_buckets(monkeypatch, {1: [7], 2: [7], 3: [7], 4: [7], 9: [7, 8], 10: [8]})
    got = near_duplicates(frame(spark, [(i, t, "en", "a") for i, t in rows]), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_brute_force(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 9: 9, 10: 10}
