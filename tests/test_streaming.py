from __future__ import annotations

import json

import pytest

from pickwell.functions.vectors import HashEncoder
from pickwell.operators.dedup import conform
from pickwell.operators.rerank import clean_queries
from pickwell.plans.index import build_index
from pickwell.plans.results import responses
from pickwell.plans.search import recommend
from pickwell.sources.tables import read_index, write_index
from pickwell.streaming import answers
from pickwell.streaming.answers import AnswerTable, answer_stream
from pickwell.streaming.recommend import query_stream, recommend_stream

ENC = HashEncoder(32)


def test_stream_answers_like_a_batch_and_only_new_files(spark, tmp_path):
    items = conform(
        spark.createDataFrame([(f"https://x.com/{i}", f"{w} test") for i, w in enumerate(["java", "sales", "tea", "data"] * 5)], "url string, title string")
    )
    write_index(build_index(items, ENC), str(tmp_path / "index"))
    index = read_index(spark, str(tmp_path / "index"))
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    inbox.mkdir()

    def write(rows, batch_id):
        # one folder per batch id, overwritten if the batch is run again
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def run():
        recommend_stream(query_stream(spark, str(inbox)), index, write, checkpoint, encoder=ENC).awaitTermination(120)

    first = [{"query": "java", "topk": 2}, {"query": " ", "topk": 2}, {"query": "tea or sales"}]
    (inbox / "1.json").write_text("\n".join(map(json.dumps, first)))
    run()
    (inbox / "2.json").write_text(json.dumps({"query": "data data", "topk": 0}))
    run()
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 2
    rows = [(q["query"], q.get("topk")) for q in first] + [("data data", 0)]
    clean = clean_queries(spark.createDataFrame(rows, "query string, topk int"), topk="topk")
    want = responses(clean, recommend(clean, index, ENC))
    assert sorted(map(str, got.drop("batch").collect())) == sorted(map(str, want.collect()))
    assert got.count() == 3


class Stopped(Exception):
    pass


def _answers(table):
    df = table.read()
    return [] if df is None else sorted((r.batch, r.query, r.answered_at, str(r.recommendations)) for r in df.collect())


@pytest.mark.parametrize("where", ["before the answers", "inside the answers", "before the marker", "after the marker"])
def test_a_batch_that_is_stopped_and_run_again_is_written_once(spark, tmp_path, monkeypatch, where):
    index = _index(spark, tmp_path)
    inbox = tmp_path / "in"
    inbox.mkdir()
    path, checkpoint = str(tmp_path / "answers"), str(tmp_path / "cp")
    table = AnswerTable(spark, path)
    searched = []
    monkeypatch.setattr(answers, "recommend", lambda clean, *a, **o: searched.append(clean.count()) or recommend(clean, *a, **o))

    def run(now):
        answer_stream(query_stream(spark, str(inbox)), index, path, checkpoint, clock=lambda: now, encoder=ENC).awaitTermination(120)

    (inbox / "1.json").write_text(json.dumps({"query": "java", "topk": 2}))
    run(100.0)
    (inbox / "2.json").write_text("\n".join(json.dumps({"query": q, "topk": 2}) for q in ("java", "tea", "data")))
    write, commit = AnswerTable.write, AnswerTable.commit

    def stopped_write(self, df, batch_id):
        if where == "inside the answers":
            write(self, df.limit(1), batch_id)
        if "answers" in where:
            raise Stopped
        write(self, df, batch_id)

    def stopped_commit(self, batch_id, at):
        if where == "after the marker":
            commit(self, batch_id, at)
        raise Stopped

    with monkeypatch.context() as m:
        m.setattr(AnswerTable, "write", stopped_write)
        m.setattr(AnswerTable, "commit", stopped_commit)
        with pytest.raises(Exception, match="Stopped"):
            run(200.0)
        # nothing of a batch without marker is read
        assert [a[1] for a in _answers(table) if a[0] == 1] == (["data", "java", "tea"] if where == "after the marker" else [])
    run(300.0)
    got = _answers(table)
    later = 200.0 if where == "after the marker" else 300.0
    # the first answer to "java" was taken over, with its time
    assert [a[:3] for a in got] == [(0, "java", 100.0), (1, "data", later), (1, "java", 100.0), (1, "tea", later)]
    assert got[0][3] == got[2][3]
    assert searched == ([1, 2] if where == "after the marker" else [1, 2, 2])


def test_answers_expire(spark, tmp_path, monkeypatch):
    index = _index(spark, tmp_path)
    inbox = tmp_path / "in"
    inbox.mkdir()
    searched = []
    monkeypatch.setattr(answers, "recommend", lambda clean, *a, **o: searched.append(clean.count()) or recommend(clean, *a, **o))
    for i, now in enumerate((0.0, 50.0, 99.0, 101.0, 140.0)):
        (inbox / f"{i}.json").write_text(json.dumps({"query": "java", "topk": 1 if i == 1 else 2}))
        answer_stream(query_stream(spark, str(inbox)), index, str(tmp_path / "answers"), str(tmp_path / "cp"), expiry=100.0, clock=lambda now=now: now, encoder=ENC).awaitTermination(120)
    # asked for one result it is another query; taking an answer over does not renew it
    assert searched == [1, 1, 0, 1, 0]
    assert [a[2] for a in _answers(AnswerTable(spark, str(tmp_path / "answers")))] == [0.0, 50.0, 0.0, 101.0, 101.0]


def test_an_index_that_is_a_plan_is_refused(spark, tmp_path):
    items = conform(spark.createDataFrame([("u", "java")], "url string, title string"))
    with pytest.raises(ValueError, match="store"):
        answer_stream(query_stream(spark, str(tmp_path)), build_index(items, ENC), str(tmp_path / "a"), str(tmp_path / "c"), encoder=ENC)


def _index(spark, tmp_path):
    words = ["java", "sales", "tea", "data"] * 3
    items = conform(spark.createDataFrame([(f"https://x.com/{i}", f"{w} test") for i, w in enumerate(words)], "url string, title string"))
    write_index(build_index(items, ENC), str(tmp_path / "index"))
    return read_index(spark, str(tmp_path / "index"))
