"""Each stage of the pipeline against a plain version of it, on its own input."""

import importlib
import os
import sys

import pytest

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    schema = docs.schema
    for name, f in corpus_pipeline.STAGES:
        done = f(spark, spark.createDataFrame(out[-1], schema), SF)
        out.append(done.collect())
        if name != "packing":
            assert done.columns == docs.columns
    return out


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_quality_keeps_rows_as_they_are(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert after.items() <= before.items() and 0.7 * len(before) < len(after) < len(before)


def test_line_stage(stages):
    from test_texts import sha, without_runs

    expected = without_runs([(r["doc_id"], r["text"]) for r in stages[1]], 3)
    after = texts(stages[2])
    for i, t in texts(stages[1]).items():
        if i in after:
            assert sha(after[i]) == expected[i][2]
            assert expected[i][1] or after[i] == t
        else:
            assert expected[i][1]
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_near_stage(stages):
    from test_groups import components

    expected = components([(r["doc_id"], r["text"]) for r in stages[2]], 5, 80)
    after = texts(stages[3])
    assert set(after) == {i for i, (n, c) in expected.items() if i == c}
    assert after.items() <= texts(stages[2]).items()


def test_secret_stage(stages):
    from test_texts import base_spans

    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    for i, t in before.items():
        if base_spans(t):
            assert "[SECRET]" in after[i] and not base_spans(after[i])
        elif "[SECRET]" not in after[i]:
            assert after[i] == t


def test_packing_stage(stages):
    from test_texts import pieces

    rows = stages[5]
    for r in stages[4]:
        own = sorted((x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in rows if x["doc_id"] == r["doc_id"])
        assert own == pieces(r["text"], 2048)


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11))
