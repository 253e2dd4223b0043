"""Adding to parsed pages, catalogs and indexes without redoing what has not changed.

Every stored row carries a fingerprint of the input it was made of. A new version of
the input is compared by fingerprints alone, in narrow rows; only input that no
stored row was made of is parsed or encoded, and stored rows whose input is gone
are dropped. The result has the rows that a rebuild would give.

``write_table`` stores rows in folders by a hash of their key, and ``apply_changes``
rewrites only the folders that gain or lose a row, so a small change of a large
table touches few files. Rows of a folder are bounded by the number of folders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickwell.functions.vectors import HashEncoder
from pickwell.operators.dedup import keep_first
from pickwell.operators.joins import restrict_to
from pickwell.operators.pages import page_fields, page_reject_reason
from pickwell.plans.catalog import catalog_rows
from pickwell.plans.index import encoded, index_documents, require_encoder
from pickwell.session import materialise

FOLDERS = 256


def fingerprint(*columns: Column) -> Column:
    """A digest of the values, in which NULL differs from empty and no value runs into the next."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.md5(F.concat(*map(part, columns)))


# ---------------------------------------------------------------- pages


def parse_pages(pages: DataFrame, variant: str = "crawl") -> DataFrame:
    """Typed fields of every page, good or not, with ``reason`` (NULL for good ones) and ``fingerprint``.

    One pass over the markup; store the result, and take ``catalog_of`` and ``rejects_of``
    from it. ``pages`` are ``page_id, url, html``; equal rows count once.
    """
    return _one_each(_parsed(_marked(pages), variant))


def _marked(pages: DataFrame) -> DataFrame:
    print_of = fingerprint(F.col("page_id"), F.col("url"), F.col("html"))
    return pages.select("page_id", "url", "html", print_of.alias("fingerprint"), F.col("html").isNull().alias("_no_html"))


def _parsed(marked: DataFrame, variant: str) -> DataFrame:
    fields = page_fields(marked, variant)
    # any text stands for markup that is there
    html = F.when(~F.col("_no_html"), "")
    return fields.withColumn("reason", page_reject_reason(F.col("url"), html, F.col("title"))).drop("_no_html")


def _one_each(rows: DataFrame) -> DataFrame:
    return keep_first(rows, ["fingerprint"], ["fingerprint"])


def changed_pages(parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages that ``update_pages`` parses: those no stored row was made of, and few others."""
    marked = _marked(pages)
    fresh = marked.select("fingerprint").join(parsed.select("fingerprint"), "fingerprint", "left_anti").distinct()
    return restrict_to(marked, materialise(fresh), "fingerprint")


def update_pages(parsed: DataFrame, pages: DataFrame, variant: str = "crawl") -> DataFrame:
    """The rows of ``parse_pages(pages)``, with those already in ``parsed`` taken from there."""
    now = materialise(_marked(pages).select("fingerprint").distinct())
    fresh = materialise(now.join(parsed.select("fingerprint"), "fingerprint", "left_anti"))
    read = restrict_to(_marked(pages), fresh, "fingerprint")
    added = _one_each(_parsed(read, variant)).join(fresh, "fingerprint", "left_semi")
    return parsed.join(now, "fingerprint", "left_semi").unionByName(added)


def catalog_of(parsed: DataFrame) -> DataFrame:
    """Catalog of parsed pages: the first page of each URL, if it is a good one."""
    first = keep_first(parsed, ["url"], ["page_id", "fingerprint"])
    return catalog_rows(first.filter(F.col("reason").isNull()))


def rejects_of(parsed: DataFrame) -> DataFrame:
    """``page_id, url, reason`` of the pages that give no catalog row."""
    return parsed.filter(F.col("reason").isNotNull()).select("page_id", "url", "reason")


# ---------------------------------------------------------------- index


def _printed(catalog: DataFrame, encoder, item_id: str) -> DataFrame:
    """Rows to index with a fingerprint of all that goes into them, the encoder among it."""
    rows = index_documents(catalog, item_id)
    own = [F.col(c) for c in rows.columns]
    return rows.withColumn("fingerprint", fingerprint(F.lit(encoder.name), *own))


def index_rows(catalog: DataFrame, encoder=HashEncoder(), item_id: str = "url") -> DataFrame:
    """``build_index`` with a ``fingerprint`` for each row."""
    return encoded(_printed(catalog, encoder, item_id), encoder)


@dataclass
class Changes:
    """What makes one version of an index the next: rows to add, fingerprints of rows to drop."""

    added: DataFrame
    gone: DataFrame


def index_changes(index: DataFrame, catalog: DataFrame, encoder=HashEncoder(), item_id: str = "url") -> Changes:
    """How ``index`` differs from ``index_rows(catalog)``; only added rows are encoded, once."""
    require_encoder(index, encoder)
    rows = _printed(catalog, encoder, item_id)
    # stored, as it is compared both ways; documents and vectors are not part of it
    now = materialise(rows.select("fingerprint", "item_id"))
    have = index.select("fingerprint", "item_id")
    fresh = materialise(now.join(have, "fingerprint", "left_anti"))
    added = encoded(rows.join(fresh.select("fingerprint"), "fingerprint", "left_semi"), encoder)
    return Changes(materialise(added), materialise(have.join(now, "fingerprint", "left_anti")))


def update_index(index: DataFrame, catalog: DataFrame, encoder=HashEncoder(), item_id: str = "url") -> DataFrame:
    """The rows of ``index_rows(catalog)``, with those already in ``index`` taken from there."""
    changes = index_changes(index, catalog, encoder, item_id)
    kept = index.join(changes.gone.select("fingerprint"), "fingerprint", "left_anti")
    return kept.select(*changes.added.columns).unionByName(changes.added)


# ---------------------------------------------------------------- tables


def _folder(key: str, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


def write_table(rows: DataFrame, path: str, key: str = "item_id", folders: int = FOLDERS) -> None:
    """Store rows in folders by a hash of their key."""
    rows.withColumn("folder", _folder(key, folders)).repartition(folders, "folder").write.mode("overwrite").partitionBy("folder").parquet(path)
    # a table without rows has no file that tells its columns
    rows.sparkSession.createDataFrame([], _plain(rows.schema)).write.parquet(f"{path}/_columns")
    rows.sparkSession.range(folders, folders + 1).write.parquet(f"{path}/_folders")


def _plain(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).drop("folder")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/_columns").schema
    return spark.read.schema(T.StructType([*schema, T.StructField("folder", T.IntegerType())])).parquet(path)


def apply_changes(path: str, changes: Changes, key: str = "item_id") -> dict[str, int]:
    """Change the table at ``path``; folders that no change touches keep their files.

    Gives the numbers of rows added and dropped and of folders written; without
    changes nothing is written.
    """
    spark = changes.added.sparkSession
    folders = spark.read.parquet(f"{path}/_folders").first()[0]
    added = changes.added.withColumn("folder", _folder(key, folders))
    gone = changes.gone.withColumn("folder", _folder(key, folders))
    touched = [r.folder for r in added.select("folder").unionByName(gone.select("folder")).distinct().collect()]
    counts = {"added": added.count(), "dropped": gone.count(), "folders": len(touched)}
    if not touched:
        return counts
    kept = _stored(spark, path).filter(F.col("folder").isin(touched)).join(gone.select("fingerprint"), "fingerprint", "left_anti")
    # stored first: a table cannot be read while it is overwritten
    after = materialise(kept.unionByName(added))
    filled = {r.folder for r in after.select("folder").distinct().collect()}
    after.repartition(len(touched), "folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(path)
    for folder in set(touched) - filled:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/folder={folder}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return counts
