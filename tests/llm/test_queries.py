"""Registered queries against their SQL, and the pipeline stage by stage."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as entry
import corpus_pipeline
from haulmark.llm import queries
from tools.compare import compare, duck

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, queries.QUERIES[name], queries.ORACLES[name]) == ""


def test_all_ten_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(names) and "pipeline" not in entry.oracle_sql()


def test_toxic_and_quality_verdicts_on_held_out_rows(spark):
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    for name, label, least in (("op4_byte_network", "quality", 0.97), ("op6_toxicity", "toxic", 0.94)):
        got = [r for r in queries.QUERIES[name](spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
        assert sum(r.predicted == labels[r.doc_id][label] for r in got) / len(got) >= least


def test_pipeline_stages_keep_what_they_should(spark, tmp_path):
    from helpers import components_by_brute_force, cut_by_brute_force, words

    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        ids = {r.doc_id for r in rows} if name != "packing" else set()
        if name == "quality":
            good = [i for i, _ in before if labels.get(i) == 1]
            assert len(ids & set(good)) > 0.97 * len(good)
            assert len([i for i in ids if labels.get(i) == 0]) < 0.1 * len([i for i, _ in before if labels.get(i) == 0])
        elif name == "near_dedup":
            want = components_by_brute_force(before, 5, 80)
            assert ids == {i for i, (_, root) in want.items() if i == root} and len(rows) == len(ids)
        elif name == "passages":
            want = {i: n - gone for i, n, gone, _ in cut_by_brute_force(before, 50) if not n or n > gone}
            assert {r.doc_id: len(words(r.text)) for r in rows} == want
        elif name == "mix":
            assert ids <= {i for i, _ in before}
        else:
            assert sum(r["size"] for r in rows) == sum(len(words(t)) for _, t in before)
        seen[name] = len(rows)
    assert all(seen.values())


def test_pipeline_on_hard_rows(spark, tmp_path):
    from helpers import LABELS, frame, hard_rows

    for rows in (hard_rows(), []):
        folder = tmp_path / str(len(rows))
        frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], LABELS).write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert bool(out) == bool(rows)
