import random

import numpy as np
import pytest
from helpers import frame, hard_rows, random_texts, words

from haulmark.llm.licenses import TEMPLATES, scan_licenses
from haulmark.llm.neighbours import nearest_neighbours
from haulmark.llm.packing import cheapest_opening, pack, pack_documents

VECTORS = "vec_id long, embedding array<float>, label int, score double, query_id string"


def vectors(seed, n, repeat=30):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32) * rng.uniform(0.5, 2, (n, 1)).astype(np.float32)
    x[rng.choice(n, repeat, replace=False)] = x[0]
    return x


def brute(ids, x, every, k):
    x = x.astype(np.float64)
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            score = (x * x[i]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
            out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], 1, 0.0, "q") for i, row in zip(ids, x, strict=True)], VECTORS)


@pytest.mark.parametrize("shard", [64, 100_000])
def test_factor_one_is_exact_with_ties(spark, shard):
    x, ids = vectors(1, 600), np.random.default_rng(9).permutation(600)
    got = nearest_neighbours(table(spark, ids, x), every=20, factor=1.0, shard=shard).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(ids, x, 20, 20)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(a == pytest.approx(b, abs=1e-12) for q in want for (_, a), (_, b) in zip(found[q], want[q], strict=True))


def test_recall_at_the_production_factor(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32)
    got = nearest_neighbours(spark.read.parquet(f"{folder}/embeddings.parquet"), every=20, shard=500).collect()
    want = {(q, i) for q, v in brute(ids, x, 20, 20).items() for i, _ in v}
    assert len({(r.query_id, r.vec_id) for r in got} & want) / len(want) >= 0.9


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 0.0, "q") for i, v in rows], VECTORS)
    got = nearest_neighbours(df, every=20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 20, 1.0), (0, 2, 6, 0.5), (20, 1, 0, 1.0), (20, 2, 6, 0.5)]
    assert nearest_neighbours(df.filter("false"), every=20).count() == 0


def test_packing_is_whole_tight_and_never_over(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(random_texts(700, 7, 0, 300))] + [(r[0] + 1000 if r[0] else None, *r[1:]) for r in hard_rows()]
    got = pack_documents(frame(spark, rows), (64, 128, 256), block=128).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        members.sort(key=lambda r: r.offset)
        used = sum(r["size"] for r in members)
        assert {(r.capacity, r.used) for r in members} == {(min(c for c in (64, 128, 256) if c >= used), used)}
        assert [r.offset for r in members] == np.cumsum([0, *[r["size"] for r in members]])[:-1].tolist()
    assert sum(r["size"] for r in got) == sum(len(words(t)) for _, t, _, _ in rows)
    assert sum(r["size"] for r in got) / sum(m[0].capacity for m in bins.values()) > 0.95
    assert sorted((r.doc_id or -1, r.begin, r.offset, r.bin_id) for r in got) == sorted(
        (r.doc_id or -1, r.begin, r.offset, r.bin_id) for r in pack_documents(frame(spark, rows[::-1]), (64, 128, 256), block=128).collect()
    )
    assert pack_documents(frame(spark, [])).count() == 0


def test_rounds_stop_when_nothing_more_fits(spark):
    rows = [(i, " ".join(["w"] * 40), "en", "a") for i in range(300)]
    got = pack_documents(frame(spark, rows), (64,), block=32).collect()
    assert len(got) == 300 == len({r.bin_id for r in got})


def test_best_fit_and_opening():
    bin_of, offset, lengths = pack([60, 50, 40, 30, 10, 4], (64, 128))
    assert sum(lengths) <= 256 and len(set(zip(bin_of, offset, strict=True))) == 6
    # A long bin is worth its cost when the pieces left fill it; alone in the bin, the short one is.
    assert cheapest_opening(60, {}, 0, (64, 128)) == 64
    rng = random.Random(1)
    sizes = [rng.randint(1, 128) for _ in range(400)]
    _, _, lengths = pack(sizes, (64, 128))
    assert sum(sizes) / sum(lengths) > 0.97


def test_every_template_is_recognised_and_directories_inherit(spark):
    files = [(i, f"src/lib{i}/LICENSE", f"Some words first.\n{text}\nand more") for i, (_, text) in enumerate(TEMPLATES)]
    files += [
        (100, "src/lib6/deep/er/a.py", "no statement"), (101, "src/lib6/deep/LICENSE", "Licensed under the\nApache License, Version 2.0."),
        (102, "src/lib6/deep/er/b.py", None), (103, "other/x.py", ""), (104, None, "nothing"), (105, "top.py", "a"),
        (106, "src/lib6/c.py", "the driving license of the copyright clerk is long and tells of quite other matters"),
        (106, "src/lib6/c.py", "the driving license of the copyright clerk is long and tells of quite other matters"),
        (107, None, TEMPLATES[1][1]),
    ]
    df = spark.createDataFrame([(*f, "x", 0.5) for f in files], "doc_id long, path string, text string, license string, score double")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    assert [got[i].own_license for i in range(len(TEMPLATES))] == [name for name, _ in TEMPLATES]
    assert got[100].license == got[102].license == got[101].own_license == "Apache-2.0" and got[100].from_dir == "src/lib6/deep"
    assert got[106].own_license is None and got[106].license == TEMPLATES[6][0] and got[106].from_dir == "src/lib6"
    assert [got[i].license for i in (103, 104, 105, 107)] == [None, None, None, "Apache-2.0"] and len(got) == len(TEMPLATES) + 8
    assert scan_licenses(df.filter("false")).count() == 0


def test_license_scan_runs_without_python(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["op5_licenses"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
