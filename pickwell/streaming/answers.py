"""A table of answers that a stream fills exactly once, and that saves it repeated searches.

A micro-batch writes its answers into a folder of its own and then a marker with its
number and time. Readers take folders that have a marker. A batch that Spark runs again
after a failure finds its marker and does nothing, or finds none and overwrites
whatever was left, so no answer is lost or doubled.

The marked folders are also the state of the stream: a query answered less than
``expiry`` seconds ago gets that answer again instead of a new search. State is read by
batch folder, only those young enough, and joined by the query's id, so no task or
driver holds it. The driver holds one number and time for each batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pickwell.operators.dedup import keep_first
from pickwell.operators.rerank import MAX_TOPK, clean_queries
from pickwell.plans.results import responses
from pickwell.plans.search import recommend
from pickwell.session import materialise
from pickwell.streaming.recommend import require_stored


class AnswerTable:
    """Answers by batch under ``path``; one table belongs to one stream's checkpoint."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def commits(self) -> dict[int, float]:
        """Time of each batch whose answers are complete."""
        files, place = self._at("_commits")
        if not files.exists(place):
            return {}
        names = [s.getPath().getName().split("-") for s in files.listStatus(place)]
        return {int(number): int(millis) / 1000 for number, millis in names}

    def commit(self, batch_id: int, at: float) -> None:
        """Creating a file is one step: the marker is there or is not."""
        files, place = self._at(f"_commits/{batch_id}-{int(at * 1000)}")
        files.createNewFile(place)

    def write(self, answers: DataFrame, batch_id: int) -> None:
        answers.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, since: float | None = None, columns: T.StructType | None = None) -> DataFrame | None:
        """Committed answers with ``batch`` and ``answered_at``, those of ``since`` or later; None if there are none."""
        young = [b for b, at in self.commits().items() if since is None or at >= since]
        if not young:
            return None
        reader = self.spark.read.option("basePath", self.path)
        reader = reader.schema(columns) if columns else reader
        return reader.parquet(*(f"{self.path}/batch={b}" for b in sorted(young)))


def answer_stream(
    queries: DataFrame,
    index: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    expiry: float = 3600.0,
    clock: Callable[[], float] = time.time,
    **options,
) -> StreamingQuery:
    """Answer ``queries`` (``query, topk``) into the ``AnswerTable`` at ``path``.

    A row is ``qid, query, count, recommendations, answered_at``: one for each distinct query and
    number of results of a batch. ``answered_at`` is the time of the search, so an answer
    taken over keeps the older time and expires by it. ``options`` are those of ``recommend``;
    the index is fixed for the life of the table.
    """
    require_stored(index)
    table = AnswerTable(queries.sparkSession, path)

    def answer(batch: DataFrame, batch_id: int) -> None:
        if batch_id in table.commits():
            return
        now = clock()
        clean = materialise(clean_queries(batch, topk="topk", max_topk=options.get("max_topk", MAX_TOPK)))
        known = table.read(since=now - expiry)
        if known is not None:
            young = known.filter(F.col("answered_at") >= now - expiry).join(clean.select("qid"), "qid", "left_semi")
            known = materialise(keep_first(young, ["qid"], [F.desc("answered_at"), "batch"]).drop("batch"))
            clean = clean.join(known.select("qid"), "qid", "left_anti")
        fresh = responses(clean, recommend(clean, index, **options)).withColumn("answered_at", F.lit(now))
        table.write(fresh if known is None else fresh.unionByName(known), batch_id)
        table.commit(batch_id, now)

    return (
        queries.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
