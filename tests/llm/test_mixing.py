import random

from helpers import frame, hard_rows, random_texts, words

from haulmark.llm.mixing import fly, land, mix_sources


def water_level(sizes):
    """Targets by resharing again and again what is over three times a source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_flight_keeps_both_totals_and_settles_all_but_two():
    rng = random.Random(5)
    sizes = [rng.randint(1, 400) for _ in range(500)]
    p = [rng.random() for _ in sizes]
    q = fly(sizes, p, rng)
    assert abs(sum(q) - sum(p)) < 1e-6 and abs(sum(s * (x - y) for s, x, y in zip(sizes, q, p, strict=True))) < 1e-4
    assert sum(0 < x < 1 for x in q) <= 2
    done = land(sizes, q, p, rng)
    assert set(done) <= {0.0, 1.0} and abs(sum(s * (x - y) for s, x, y in zip(sizes, done, p, strict=True))) < 20


def test_targets_are_met_in_blocks_and_reruns_agree(spark):
    rng = random.Random(2)
    rows = [(i, t, "en", rng.choice("aaaaaaabcd") if i % 50 else None) for i, t in enumerate(random_texts(900, 4))]
    rows += [(2000, "tiny", "en", "z")]
    docs = frame(spark, rows)
    got = mix_sources(docs, block=64).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want, source = water_level(sizes), {i: s for i, _, _, s in rows}
    assert len(got) == len(rows)
    for s in sizes:
        mine = [r for r in got if source[r.doc_id] == s]
        assert all(abs(r.target - want[s]) < 1e-6 * want[s] and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(5, 0.01 * want[s])
        assert all(r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in mine)
    again = mix_sources(docs.repartition(7), block=64).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_hard_rows(spark):
    got = mix_sources(frame(spark, hard_rows())).collect()
    assert len(got) == len(hard_rows()) and all(r.taken <= 3 * r["size"] for r in got)
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert mix_sources(frame(spark, [])).count() == 0
    assert [r.taken for r in mix_sources(frame(spark, [(1, None, None, None), (2, "", None, "a")])).collect()] == [0, 0]
