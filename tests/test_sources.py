"""Sources and sinks on temporary files."""

import hashlib
import io
import json
import tarfile

import pytest

from gaugeworks.sources import files


def write(path, text):
    path.write_text(text)
    return str(path)


def test_strict_and_tolerant_lines(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", '{"id": "x", "n": 1}\n\n{"id": "y", "n": 2}\n')
    assert sorted(r["id"] for r in files.json_lines(spark, good, "id string, n int").collect()) == ["x", "y"]
    bad = write(tmp_path / "b.jsonl", '{"id": "x", "n": 1}\nnot json\n{"id": "z"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_lines(spark, bad, "id string, n int").collect()
    rows, n_bad = files.json_lines_tolerant(spark, bad, "id string, n int")
    assert sorted(r["id"] for r in rows.collect()) == ["x", "z"]
    assert n_bad.first()["n_bad"] == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.json_lines(spark, str(tmp_path / "none.jsonl"), "id string")


def test_append_refuses_known_keys(spark, tmp_path):
    sink = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, n int")
    assert files.append_new(first, sink, ["id"]) == (2, 1)
    again = spark.createDataFrame([("b", 9), ("c", 4)], "id string, n int")
    assert files.append_new(again, sink, ["id"]) == (1, 1)
    # The first of repeats stays.
    assert sorted(tuple(r) for r in spark.read.parquet(sink).collect()) == [("a", 1), ("b", 2), ("c", 4)]
    later = spark.createDataFrame([("d", 9), ("d", 3), ("d", 5)], "id string, n int")
    assert files.append_new(later, sink, ["id"], order="n") == (1, 2)
    assert spark.read.parquet(sink).where("id = 'd'").first()["n"] == 3


def test_write_once(spark, tmp_path):
    sink = str(tmp_path / "blobs")
    rows = spark.createDataFrame([("k", "v")], "key string, content string")
    assert files.write_once(rows, sink) == 1
    assert files.write_once(rows, sink) == 0
    with pytest.raises(ValueError, match="differs"):
        files.write_once(spark.createDataFrame([("k", "other")], "key string, content string"), sink)
    with pytest.raises(ValueError, match="two contents"):
        files.write_once(spark.createDataFrame([("m", "v"), ("m", "w")], "key string, content string"), sink)
    assert files.write_once(spark.createDataFrame([("m", "v"), ("m", "v"), ("k", "v")], "key string, content string"), sink) == 1
    assert sorted((r["key"], r["content"]) for r in spark.read.parquet(sink).collect()) == [("k", "v"), ("m", "v")]


def test_csv_and_documents(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'Question,Answer\n"two\nlines",x\n,y\n')
    kept, reasons = files.csv_with_reasons(spark, p, ["Question", "Answer"])
    assert kept.count() == 1
    assert {r["reason"]: r["n"] for r in reasons.collect()} == {"admitted": 1, "missing Question": 1}
    d = write(tmp_path / "one.json", json.dumps({"a": {"b": 1}}, indent=1))
    assert files.json_document(spark, d).select("a.b").first()[0] == 1


def test_tar_of_tasks(spark, tmp_path):
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        for name, body in (("x/a.json", b'{"k": 1}'), ("../evil.json", b"{}"), ("x/b.json", b"oops"), ("x/readme.md", b"hi")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    rows = {r["member"]: r["problem"] for r in files.tar_tasks(spark, str(tmp_path / "t.tar")).collect()}
    assert rows == {"x/a.json": None, "../evil.json": "unsafe name", "x/b.json": "not JSON"}


def test_hashes_and_globs(spark, tmp_path):
    p = write(tmp_path / "a.txt", "abc")
    wanted = spark.createDataFrame([("a.txt", hashlib.sha256(b"abc").hexdigest()), ("gone.txt", "0")], "name string, sha256 string")
    assert {r["name"]: r["state"] for r in files.verified(spark, str(tmp_path / "*.txt"), wanted).collect()} == {"a.txt": "ok", "gone.txt": "missing"}
    assert files.exactly_one(spark, str(tmp_path / "*.txt")).endswith("a.txt")
    write(tmp_path / "b.txt", "")
    with pytest.raises(ValueError, match="2 files"):
        files.exactly_one(spark, str(tmp_path / "*.txt"))
    assert p


def test_strict_json_text(spark):
    row = spark.createDataFrame([(1.5, float("nan"), float("inf"))], "a double, b double, c double")
    assert json.loads(files.strict_json(row).first()["json"]) == {"a": 1.5, "b": "NaN", "c": "Infinity"}


def test_replay(spark):
    asked = spark.createDataFrame([("q1",), ("q2",)], "request string")
    cache = spark.createDataFrame([(hashlib.sha256(b"q1").hexdigest(), "r1")], "request_sha256 string, response string")
    assert {r["request"]: (r["response"], r["replayed"]) for r in files.replayed(asked, cache).collect()} == {"q1": ("r1", True), "q2": (None, False)}


def test_derived_tables_of_a_run(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "n int, s string")
    found = files.derived_set({"items": rows, "results": rows.where("false"), "attempts": rows}, f"{tmp_path}/run")
    assert {k: v.count() for k, v in found.items()} == {"items": 1, "results": 0, "attempts": 1}
    with pytest.raises(Exception, match="exist"):
        files.derived_set({"items": rows}, f"{tmp_path}/run")


def test_scores_of_pages(spark):
    from gaugeworks.sources import pages

    body = lambda **f: [0, {k: [0, v] for k, v in f.items()}]
    table = lambda models: '"overall":[0,' + json.dumps(models, separators=(",", ":")) + "]"
    plain = table({"x/y-1": body(accuracy=0.5, latency=None), "no slug": body(accuracy=1.0)})
    named = table({"a/B.c": body(accuracy=61.25, stderr=1, provider="a", cost_per_test="free")}) + ',"updated":[0,"2025-01-02"]'
    rows = [(1, f"<p>{plain}</p>"), (2, f"{plain} {named} {plain}"), (3, '"overall":[0,{broken'), (4, None), (5, "")]
    found = sorted(tuple(r) for r in pages.scores(spark.createDataFrame(rows, "page_id bigint, html string")).collect())
    assert found == [(1, "x/y-1", 0.5, None, None, None, None, None), (2, "a/B.c", 61.25, 1.0, None, None, "a", "2025-01-02")]


def test_structures_in_text(spark):
    from pyspark.sql import functions as F

    from gaugeworks.functions import parsing

    text = F.col("t")
    rows = spark.createDataFrame([("a knows b, b knows c\nName: x y\n name : 2\nName: z: 1\non 2001-02-03 and 2001-01-30, 12001-01-01",), ("",), (None,)], "t string")
    found = rows.select(parsing.edges(text, " knows ").alias("e"), parsing.registry(text).alias("r"), parsing.dates(text).alias("d")).collect()
    assert [tuple(x) for x in found[0]["e"]] == [("a", "b"), ("b", "c")]
    assert found[0]["r"] == {"Name": "z: 1", "name": "2"}
    assert found[0]["d"] == [2001 * 360 + 63, 2001 * 360 + 60]
    assert (found[1]["e"], found[1]["r"], found[1]["d"]) == ([], {}, [])
    assert tuple(found[2]) == (None, None, None)
