"""Every table survives being written and read back."""

from __future__ import annotations

import pytest

from pickwell.functions.vectors import HashEncoder
from pickwell.operators.dedup import conform
from pickwell.plans.index import build_index, require_encoder
from pickwell.plans.results import result_view
from pickwell.schemas import CATALOG_COLUMNS, CATALOG_SCHEMA
from pickwell.sources import tables as S

TRICKY = '  He said "yes", then\nleft; a\\b \\" é '


@pytest.fixture
def catalog(spark):
    rows = [("a", TRICKY, "https://x.com/a", "d,1", None, "K", None, 30, "English", "x;y"), ("b", "t", "https://x.com/b", *[None] * 7)]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def test_catalog_csv(spark, catalog, tmp_path):
    path = str(tmp_path / "deep" / "catalog")
    S.write_catalog(catalog, path)
    back = S.read_catalog(spark, path)
    assert back.schema == CATALOG_SCHEMA
    assert sorted(map(str, back.collect())) == sorted(map(str, catalog.collect()))


def test_catalog_csv_of_other_writers(spark, tmp_path):
    (tmp_path / "c.csv").write_text('url,title,duration_min,more\nu,"a ""b""\nc",30.0,z\nv,w,,z\n', encoding="utf-8")
    got = S.read_catalog(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.url, r.title, r.duration_min, r.tags) for r in got] == [("u", 'a "b"\nc', 30, None), ("v", "w", None, None)]
    (tmp_path / "empty.csv").write_text("url,title\n")
    with pytest.raises(ValueError, match="empty"):
        S.read_catalog(spark, str(tmp_path / "empty.csv"))


def test_pairs_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("query,relevant_url\nq,u\n")
    assert S.read_pairs(spark, str(tmp_path / "p.csv")).count() == 1
    (tmp_path / "bad.csv").write_text("query,url\nq,u\n")
    with pytest.raises(ValueError, match="relevant_url"):
        S.read_pairs(spark, str(tmp_path / "bad.csv"))


@pytest.mark.parametrize("header, found", [("Id, JD ", True), ("text,query", True), ("Job_Description", True), ("Queries", True), ("question", False)])
def test_query_csv_finds_its_column(spark, tmp_path, header, found):
    wide = header.split(",")
    name = next((c for c in wide if c.strip().lower() in ("query", "queries", "jd", "job_description", "text")), None)
    row = ",".join('"a ""b"",\n\nc"' if c == name else "0" for c in wide)
    (tmp_path / "q.csv").write_text(f"{header}\n{row}\n{row}\n")
    if found:
        got = S.read_queries(spark, str(tmp_path / "q.csv"))
        assert got.columns == ["query"] and [r.query for r in got.collect()] == ['a "b",\n\nc'] * 2
    else:
        with pytest.raises(ValueError, match="the text must be in a column"):
            S.read_queries(spark, str(tmp_path / "q.csv"))


def test_index_keeps_vectors_and_encoder(spark, catalog, tmp_path):
    path = str(tmp_path / "index")
    index = build_index(catalog, HashEncoder(16))
    S.write_index(index, path)
    back = S.read_index(spark, path)
    assert back.columns == ["item_id", *CATALOG_COLUMNS, "embedding"]
    assert sorted(map(str, back.collect())) == sorted(map(str, index.collect()))
    require_encoder(back, HashEncoder(16))
    with pytest.raises(ValueError, match="hash-md5-16"):
        require_encoder(back, HashEncoder(8))
    meta = str(tmp_path / "meta")
    S.write_metadata(back, meta)
    assert spark.read.parquet(meta).columns == CATALOG_COLUMNS
    assert sorted(map(str, S.read_metadata(spark, meta).collect())) == sorted(map(str, catalog.collect()))


def test_result_view_csv(spark, catalog, tmp_path):
    path = str(tmp_path / "view")
    S.write_result_view(result_view(catalog), path)
    back = S._read_csv(spark, path)
    assert back.columns == ["Assessment", "URL", "Type", "Level", "Language", "Duration (min)", "Description"]
    assert back.orderBy("URL").first()["Assessment"] == TRICKY


def test_merge_is_written_only_if_something_is_added(spark, catalog, tmp_path):
    path = str(tmp_path / "merged")
    assert not S.write_merged_catalog(catalog, catalog.limit(0), path)
    assert not (tmp_path / "merged").exists()
    added = conform(spark.createDataFrame([("https://x.com/a", "dup"), ("https://x.com/n", "new")], "url string, title string"))
    assert S.write_merged_catalog(catalog, added, path)
    assert sorted(r.title for r in S.read_catalog(spark, path).collect()) == sorted([TRICKY, "t", "new"])


def test_export_writes_its_header_without_rows(spark, tmp_path):
    path = tmp_path / "out"
    S.write_batch_export(spark.createDataFrame([], "Query string, Assessment_url string"), str(path))
    text = "".join(p.read_text() for p in path.glob("*.csv"))
    assert text == "Query,Assessment_url\n"
    S.write_batch_export(spark.createDataFrame([(TRICKY, "u")], "Query string, Assessment_url string"), str(path))
    assert S._read_csv(spark, str(path)).first().Query == TRICKY
