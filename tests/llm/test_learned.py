"""Quality network, decision lists, toxicity and language: held-out accuracy and defined edge results."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, LABELS, WORDS, frame, hard_rows, words
from pyspark.sql import functions as F

from haulmark.llm import bytenet, langid, queries, rules, toxicity
from haulmark.llm.common import bucket_of

FOLDER = "/root/testdata/sf0.01"


def bucket(i, n):
    return zlib.crc32(str(i).encode()) % n


def labelled(seed=1, n=400):
    """Half of the texts shout or hold bars (bad), some hold a slur or a misspelling of it (toxic)."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        ws = [rng.choice(WORDS) for _ in range(rng.randint(30, 80))]
        bad, toxic = rng.random() < 0.5, rng.random() < 0.3
        if toxic:
            ws[rng.randrange(len(ws))] = rng.choice(["scoundrel", "scoundrell", "scoundre1"]) if i % 2 else "scoundrels"
        if bad:
            ws = [w.upper() + "!!" if i % 2 else w + " |" for w in ws]
        rows.append((i, " ".join(ws), "en", "a"))
        labels.append((i, int(not bad), int(toxic), 0.1))
    return rows, labels


def test_quality_network_tells_held_out_texts(spark):
    rows, labels = labelled()
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    got = bytenet.score_quality(docs, lab, bucket_of("doc_id", 3) != 1, ["doc_id"]).collect()
    held = [(r, labels[r.doc_id][1]) for r in got if bucket(r.doc_id, 3) == 1]
    assert np.mean([r.predicted == y for r, y in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_network_gradients_equal_finite_differences():
    net = bytenet.Net.fresh()
    chunks = bytenet.chunks_of(pa.array(["some text " * 40, "OTHER!! text", "", "x"]))
    y, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.ones(4)

    def loss():
        best, _ = bytenet.convolve(chunks, net.tables().astype(np.float64))
        z = bytenet.features(chunks, best, net.offset)[1] @ net.out + net.bias
        return (np.logaddexp(0, z) - y * z).mean()

    best, where = bytenet.convolve(chunks, net.tables(), True)
    for p, g in zip(net.parts, bytenet.gradients(net, chunks, best, where, y, weight), strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[i], 1e-2
        p[i] = old + step
        up = loss()
        p[i] = old - step
        down = loss()
        p[i] = old
        assert (up - down) / (2 * step) == pytest.approx(g[i], rel=0.15, abs=2e-4)


def test_network_reads_every_byte_of_long_texts():
    tables = np.zeros((bytenet.WIDTH, 256, bytenet.FILTERS), np.float32)
    for k, byte in enumerate(b"ZQXYW"):
        tables[k, byte, 0] = 1
    for at in (0, 1, 253, 254, 255, 256, 4990, 4995):
        text = "a" * at + "ZQXYW" + "a" * (4995 - at)
        chunks = bytenet.chunks_of(pa.array(["ZQX", text, "YW"]))
        best, where = bytenet.convolve(chunks, tables, True)
        assert best[chunks.text == 1, 0].max() == 5 and best[chunks.text != 1, 0].max() <= 3
        place = where[chunks.text == 1, 0][best[chunks.text == 1, 0].argmax()]
        assert chunks.data[place : place + 5].tobytes() == b"ZQXYW"


def test_toxicity_finds_misspellings_and_leaves_clean_texts(spark):
    rows, labels = labelled(2, 600)
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    got = toxicity.score_toxicity(docs, lab, bucket_of("doc_id", 5) != 0, ["doc_id"]).collect()
    held = [(r, labels[r.doc_id][2]) for r in got if bucket(r.doc_id, 5) == 0]
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    pull, bias = toxicity.train([t for _, t, _, _ in rows], [x[2] for x in labels])
    unseen = toxicity.bags_of(pa.array([f"{WORDS[1]} {WORDS[2]} scoundreel {WORDS[3]}", f"{WORDS[1]} {WORDS[2]} {WORDS[4]} {WORDS[3]}"]))
    logit = toxicity.judge(unseen, pull, bias)[0]
    assert logit[0] > 0 > logit[1]


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = queries.QUERIES["op7_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if bucket(r.doc_id, 4) == 2}
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def counts_by_brute_force(text):
    ws = words(text)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    hit = [False] * len(ws)
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit[i : i + 8] = [True] * 8
    lines = [line for line in (text or "").split("\n") if words(line)]
    return (
        len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"),
        sum(line in lines[:i] for i, line in enumerate(lines)), sum(hit),
    )


def test_rule_counts_equal_brute_force():
    rng = random.Random(4)
    texts = [t for _, t, _, _ in hard_rows() if t is None or len(t) < 2000]
    texts += ["a b\na b\n\na b \n", "é|#é $é\n" * 30, "x " * 25, " ".join(str(i % 9) for i in range(60))]
    texts += ["\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(12)) for _ in range(40)]
    got = rules.count_texts(pa.array(texts, pa.string()))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert list(zip(*[got[n].to_pylist() for n in names], strict=True)) == [counts_by_brute_force(t) for t in texts]


def test_decision_list_rejects_what_labels_reject(spark):
    rows, labels = labelled(3)
    got, learned = rules.apply_rules(frame(spark, rows), spark.createDataFrame(labels, LABELS))
    got = got.collect()
    assert learned and np.mean([r.kept == bool(labels[r.doc_id][1]) for r in got]) > 0.97
    assert all(len(rule) <= rules.MOST_CONDITIONS and str(rule[0]) for rule in learned)
    assert all(not r.kept for r in got if r.base_failed)


def test_rules_that_do_not_hold_on_other_rows_are_dropped():
    rng = np.random.default_rng(0)
    x = {"noise": rng.random(600), "other": rng.random(600)}
    assert rules.learn_rules(x, rng.random(600) < 0.3) == []


def test_hard_rows_have_defined_results(spark):
    docs, none = frame(spark, hard_rows()), spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(None, 1, 1, 0.1), (1, None, None, 0.1), (999, 0, 0, 0.1), (4, 1, 0, 0.1), (4, 1, 0, 0.1)], LABELS)
    n, yes = len(hard_rows()), F.lit(True)
    for labels in (none, odd):
        quality = bytenet.score_quality(docs, labels, yes, ["doc_id"]).collect()
        toxic = toxicity.score_toxicity(docs, labels, yes, ["doc_id"]).collect()
        assert len(quality) == len(toxic) == n
        assert all(r.predicted == 1 for r in quality) and all(r.predicted == 0 for r in toxic)
        kept = rules.apply_rules(docs, labels)[0].collect()
        assert len(kept) == n and {r.doc_id for r in kept if r.kept} >= {1, 2, 6}
        assert all(r.base_failed and not r.kept for r in kept if r.n_words == 0)
    found = langid.identify_languages(docs, yes, ["doc_id"]).collect()
    assert {r.lang_pred for r in found if r.doc_id in (3, 4, 5, 11)} == {"und"} and len(found) == n
    nothing = langid.identify_languages(docs, F.lit(False), ["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    yes = F.lit(True)
    assert bytenet.score_quality(docs, labels, yes, ["doc_id"]).count() == 0
    assert toxicity.score_toxicity(docs, labels, yes, ["doc_id"]).count() == 0
    assert rules.apply_rules(docs, labels)[0].count() == 0
    assert langid.identify_languages(docs, yes, ["doc_id"]).count() == 0
