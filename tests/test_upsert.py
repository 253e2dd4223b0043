"""Incremental versions against rebuilds, and how little work they do."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pickwell.functions.vectors import HashEncoder, ModelEncoder
from pickwell.operators.dedup import conform
from pickwell.operators.pages import page_rejects
from pickwell.plans import catalog as C
from pickwell.plans import upsert as U
from pickwell.plans.index import build_index
from pickwell.session import materialise
from registry.inputs import PAGES, derived
from registry.queries import _earlier

ENC = HashEncoder(16)


def rows(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def items(spark, titles):
    return conform(spark.createDataFrame(list(titles.items()), "url string, title string"))


def test_fingerprints_tell_values_apart(spark):
    values = [(None, ""), ("", None), ("a", "b"), ("ab", ""), ("", "ab"), ("1:a", "b"), (None, None), ("-", None), (None, "-"), ("ä", "b")]
    df = spark.createDataFrame(values, "x string, y string").select(U.fingerprint(F.col("x"), F.col("y")).alias("f"))
    assert df.distinct().count() == len(values)


def test_updated_pages_equal_parsed_ones(spark, sf_dir):
    pages = derived(spark, sf_dir, PAGES).filter("page_id <= 300")
    odd = spark.createDataFrame([(1000, None, "<h1>x</h1>"), (1000, None, "<h1>x</h1>"), (None, "u", None), (1001, "u", "<h1>y</h1>")], "page_id long, url string, html string")
    pages = pages.unionByName(odd)
    before = U.materialise(U.parse_pages(_earlier(pages, "page_id", "html")))
    after = U.update_pages(before, pages)
    whole = U.parse_pages(pages)
    assert rows(after) == rows(whole) and whole.count() == pages.distinct().count()
    # a tenth changed, a seventeenth is new
    assert 0 < U.changed_pages(before, pages).count() < 0.25 * pages.count()
    assert rows(U.catalog_of(whole)) == rows(C.build_catalog(pages))
    assert rows(U.rejects_of(whole)) == rows(page_rejects(pages.distinct()))
    assert rows(U.update_pages(U.materialise(whole), pages.limit(0))) == []
    assert U.changed_pages(U.materialise(whole), pages).count() == 0


def test_only_changed_rows_are_encoded(spark, tmp_path):
    encoded = spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            encoded.add(len(texts))
            return np.array([[len(t), 1.0] for t in texts])

        return model

    enc = ModelEncoder("counted", 2, load)
    old = items(spark, {f"u{i}": f"title {i}" for i in range(200)})
    new = items(spark, {f"u{i}": f"title {i}" + " new" * (i % 50 == 7) for i in range(5, 210)})
    U.write_table(U.index_rows(old, enc), path := str(tmp_path / "index"), folders=16)
    assert encoded.value == 200
    counts = U.apply_changes(path, U.index_changes(U.read_table(spark, path), new, enc))
    assert encoded.value == 200 + 4 + 10
    assert (counts["added"], counts["dropped"]) == (14, 9) and counts["folders"] <= 16
    assert rows(U.read_table(spark, path)) == rows(U.index_rows(new, enc))
    assert rows(U.read_table(spark, path).drop("fingerprint")) == rows(build_index(new, enc))
    with pytest.raises(ValueError, match="encoder"):
        U.index_changes(U.read_table(spark, path), new, ENC)


def test_untouched_folders_keep_their_files(spark, tmp_path):
    path = tmp_path / "index"
    titles = {f"u{i}": f"title {i}" for i in range(60)}
    U.write_table(U.index_rows(items(spark, titles), ENC), str(path), folders=8)

    def files():
        return {str(f.relative_to(path)) for f in path.glob("folder=*/*.parquet")}

    before = files()
    same = U.index_changes(U.read_table(spark, str(path)), items(spark, titles), ENC)
    assert U.apply_changes(str(path), same) == {"added": 0, "dropped": 0, "folders": 0} and files() == before
    titles["u3"] = "other"
    counts = U.apply_changes(str(path), U.index_changes(U.read_table(spark, str(path)), items(spark, titles), ENC))
    assert counts == {"added": 1, "dropped": 1, "folders": 1} and len({f.split("/")[0] for f in files() - before}) == 1
    # all rows of a folder may go
    few = items(spark, {"u3": "other"})
    U.apply_changes(str(path), U.index_changes(U.read_table(spark, str(path)), few, ENC))
    assert [r.item_id for r in U.read_table(spark, str(path)).collect()] == ["u3"]
    U.apply_changes(str(path), U.index_changes(U.read_table(spark, str(path)), few.limit(0), ENC))
    assert U.read_table(spark, str(path)).count() == 0
    U.apply_changes(str(path), U.index_changes(U.read_table(spark, str(path)), few, ENC))
    assert rows(U.read_table(spark, str(path))) == rows(U.index_rows(few, ENC))


def test_update_in_memory_equals_rebuild(spark):
    old, new = items(spark, {"a": "1", "b": "2", "c": "3"}), items(spark, {"b": "2", "c": "4", "d": "5"})
    index = U.materialise(U.index_rows(old, ENC))
    assert rows(U.update_index(index, new, ENC)) == rows(U.index_rows(new, ENC))


def _events(tmp_path, code):
    """What a session of its own wrote to Spark's event log while it ran ``code``."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    head = f"""
from pickwell import get_session
spark = get_session("t", "local[2]", spark__ui__enabled="false", spark__eventLog__enabled="true", spark__eventLog__dir="file://{tmp_path}/log",
    spark__eventLog__rolling__enabled="false", spark__eventLog__compress="false", spark__checkpoint__dir="{tmp_path}/shared")
"""
    (tmp_path / "log").mkdir()
    root = str(Path(U.__file__).parents[2])
    done = subprocess.run([sys.executable, "-c", head + code + "\nspark.stop()"], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True)
    assert not done.returncode, done.stderr[-2000:]
    (log,) = [f for f in (tmp_path / "log").iterdir() if f.is_file()]
    return [json.loads(line) for line in log.read_text().split("\n") if line], done.stdout


def test_good_pages_and_rejects_come_from_one_scan(spark, sf_dir, tmp_path):
    derived(spark, sf_dir, PAGES).write.parquet(f"{tmp_path}/pages")
    events, _ = _events(
        tmp_path,
        f"""
from pickwell.plans import upsert as U
from pickwell.session import materialise
parsed = materialise(U.parse_pages(spark.read.parquet("{tmp_path}/pages")))
U.catalog_of(parsed).write.parquet("{tmp_path}/catalog")
U.rejects_of(parsed).write.parquet("{tmp_path}/rejects")
""",
    )
    n = spark.read.parquet(f"{tmp_path}/pages").count()
    started = [json.dumps(e["sparkPlanInfo"]) for e in events if e["Event"].endswith("SparkListenerSQLExecutionStart")]
    assert sum('html:string' in p for p in started) == 1
    assert spark.read.parquet(f"{tmp_path}/catalog").count() + spark.read.parquet(f"{tmp_path}/rejects").count() == n


def test_counts_come_with_the_write(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages.write.parquet(f"{tmp_path}/pages")
    events, said = _events(
        tmp_path,
        f"""
from pickwell.plans.catalog import write_counted
print(write_counted(spark.read.parquet("{tmp_path}/pages"), "{tmp_path}/catalog"))
""",
    )
    want = {r.metric: r.n for r in C.catalog_counts(pages, C.build_catalog(pages)).collect()}
    assert eval(said.strip().splitlines()[-1]) == want
    assert rows(spark.read.parquet(f"{tmp_path}/catalog")) == rows(C.build_catalog(pages))
    plans = [e for e in events if e["Event"].endswith("SparkListenerSQLExecutionStart")]
    assert len(plans) == 1


def test_changed_pages_have_their_tags_read_once(spark):
    pages = spark.createDataFrame([(1, "u", "<h1>x</h1><b class=tag>y</b><nav class=breadcrumb><a>z</a></nav>")], "page_id long, url string, html string")
    parsed = U.parse_pages(pages)
    assert (parsed.first().tags, parsed.first().category) == ("y", "z")
    updated = U.update_pages(materialise(U.parse_pages(pages.filter("page_id > 1"))), pages)
    for df in (parsed, updated):
        assert df._jdf.queryExecution().optimizedPlan().toString().count(r"(?i)^class\s*=") == 1
