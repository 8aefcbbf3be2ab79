"""Readers, sinks and the stream."""

import csv
import glob
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from querywarden.operators import evaluation as ev
from querywarden.operators.verdict import score
from querywarden.plans.querylog import query_log
from querywarden.sources.corpus import read_corpus
from querywarden.sources.sinks import CSV_FIELDS, SLIM_FIELDS, csv_rows, write_csv, write_report
from querywarden.sources.storage import shared_dir
from querywarden.streaming.guard import start_guard

ITEMS = [
    {"query": "SELECT 1", "question": "n", "toxic": 1, "db_id": "d"},
    {"query": "SELECT 2"},
    {"query": "SELECT 3", "toxic": "1"},
    {"query": None, "toxic": True},
    {"toxic": 1.0},
    {"query": "SELECT 4", "toxic": "odd"},
    {"query": "SELECT 5", "toxic": 2, "other": {"a": 1}},
]
LABELS = {"SELECT 1": 1, "SELECT 2": 0, "SELECT 3": 1, "SELECT 4": -1, "SELECT 5": 2}


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(ITEMS, indent=1))
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, ITEMS)))
    spark.createDataFrame([("SELECT 1", 1)], "query STRING, toxic INT").write.parquet(str(tmp_path / "p"))
    for fmt, name in (("json", "a.json"), ("jsonl", "a.jsonl")):
        rows = read_corpus(spark, str(tmp_path / name), fmt).collect()
        assert len(rows) == len(ITEMS)
        assert {r["query"]: r["toxic"] for r in rows if r["query"]} == LABELS
        assert [r["toxic"] for r in rows if r["query"] is None] == [1, 1]
        assert all(r["question"] is not None and r["db_id"] is not None for r in rows)
    row = read_corpus(spark, str(tmp_path / "p"), "parquet").first()
    assert (row["toxic"], row["db_id"]) == (1, "")


def test_sinks(spark, tmp_path):
    texts = ["SELECT 1", 'say "hi", it\'s\n-- new line', None, "OR 1=1 " * 200] * 10
    rows = [(i, q, f"q{i}", i % 2, "d") for i, q in enumerate(texts)]
    run = ev.run_evaluation(spark.createDataFrame(rows, "id INT, query STRING, question STRING, toxic INT, db_id STRING"))
    write_csv(run.rows, str(tmp_path / "csv"))
    assert max(len(r.sql) for r in csv_rows(run.rows, shorten=True).collect()) == 500
    write_report(run.report, run.rows, str(tmp_path / "report"))
    read = []
    for part in glob.glob(f"{tmp_path}/csv/part-*"):
        with open(part, encoding="utf-8", newline="") as fh:
            read += list(csv.DictReader(fh))
    assert len(read) == 40 and tuple(read[0]) == CSV_FIELDS
    assert {r["sql"] for r in read} == {t or "" for t in texts}
    assert all(len(r["score"].split(".")[1]) == 4 for r in read)
    report = json.loads("".join(open(p, encoding="utf-8").read() for p in glob.glob(f"{tmp_path}/report/report/part-*")))
    assert set(report) == {"config", "train", "validate", "test"} and report["config"]["random_seed"] == 42
    slim = spark.read.json(f"{tmp_path}/report/rows")
    assert slim.count() == 40 and set(slim.columns) == set(SLIM_FIELDS)


def test_stream_equals_batch_and_resumes(spark, sf, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    log = query_log(spark, sf).select("id", "sql")
    for part in range(2):
        log.filter(F.col("id") % 2 == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id BIGINT, sql STRING").parquet(source)
        start_guard(stream, out, checkpoint, available_now=True).awaitTermination()
    got = spark.read.parquet(out).select("id", "action", "overall_risk_score")
    want = score(log).select("id", "action", "overall_risk_score")
    assert got.count() == log.count()
    assert got.exceptAll(want).count() == 0


class _Session:
    """Stands in for a session of a cluster, whose settings cannot be changed from here."""

    def __init__(self, root, master="yarn"):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": root}, self
        self.master, self.getCheckpointDir = master, lambda: None


def test_shared_dir_is_the_sessions():
    assert shared_dir(_Session("s3a://bucket/ckpt/"), "x").startswith("s3a://bucket/ckpt/querywarden/x-")
    assert shared_dir(_Session("/shared"), "x") != shared_dir(_Session("/shared"), "x")
    with pytest.raises(ValueError):
        shared_dir(_Session(None), "x")
    assert "querywarden" in shared_dir(_Session(None, "local[2]"), "x")


def test_from_file_to_report(spark, tmp_path):
    lines = [{"id": i, "attack": "a" if i % 3 == 0 else None, "query": "SELECT 1 -- x" if i % 3 == 0 else "SELECT a FROM t", "toxic": str(int(i % 3 == 0))} for i in range(60)]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    (tmp_path / "c.json").write_text(json.dumps(lines))
    for fmt in ("jsonl", "json"):
        for extra in (None, "id LONG, attack STRING"):
            corpus = read_corpus(spark, str(tmp_path / f"c.{fmt}"), fmt, extra)
            assert {"id", "attack", "query", "question", "toxic", "db_id"} == set(corpus.columns) and corpus.filter("attack = 'a'").count() == 20
    run = ev.run_evaluation(corpus.withColumnRenamed("id", "qid"), id_col="qid", store=True)
    report = run.report.first()
    assert report["train"]["n"] + report["validate"]["n"] + report["test"]["n"] == 60
    assert run.rows.select("qid").distinct().count() == 60 and {r.n_total for r in run.split_stats.collect()} == {36, 12}
    folder = Path(run.path)
    assert folder.exists()
    run.close()
    assert not folder.exists()
    with pytest.raises(ValueError, match="id_col"):
        ev.run_evaluation(corpus.drop("id"))
