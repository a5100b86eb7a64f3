import random

import pytest
from helpers import WORDS, cut_by_brute_force, frame, hard_rows, random_texts

from haulmark.llm.passages import cut_passages


def planted(seed):
    """Passages of 40 to 90 words that repeat whole, in part and chopped up, runs of one word, and nested copies."""
    rng = random.Random(seed)
    shared = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(40, 90))) for _ in range(4)] + ["la " * 80, "up down " * 40]
    out = []
    for i, text in enumerate(random_texts(40, seed, 0, 120)):
        ws = text.split()
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared).split()
            a, b = sorted(rng.sample(range(len(p) + 1), 2)) if rng.random() < 0.5 else (0, len(p))
            at = rng.randint(0, len(ws))
            ws[at:at] = p[a:b]
        out.append((i, rng.choice([" ", "\n"]).join(ws)))
    return out


@pytest.mark.parametrize(("seed", "window"), [(1, 50), (2, 50), (3, 12)])
def test_cut_equals_brute_force(spark, seed, window):
    rows = planted(seed)
    got = cut_passages(frame(spark, [(i, t, "en", "a") for i, t in rows]), ["doc_id"], window=window).drop("kept_text").collect()
    assert sorted(map(tuple, got)) == cut_by_brute_force(rows, window)


def test_hard_rows(spark):
    got = cut_passages(frame(spark, hard_rows()), ["doc_id"], with_text=False).collect()
    removed = sorted((r.doc_id if r.doc_id is not None else 10**9, r.n_words, r.n_removed) for r in got)
    assert len(removed) == len(hard_rows())
    # The null id is the largest, rows of one id leave each other alone, long texts are read whole.
    assert removed[:3] == [(1, 120, 0), (2, 120, 120), (2, 120, 120)]
    assert (7, 30_001, 30_000) in removed and (10**9, 120, 120) in removed and (3, 0, 0) in removed and (4, 0, 0) in removed
    assert cut_passages(frame(spark, []), ["doc_id"]).count() == 0
