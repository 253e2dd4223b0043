"""Queries arriving as a stream, answered against a static index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pickwell.operators.rerank import MAX_TOPK, clean_queries
from pickwell.plans.results import responses
from pickwell.plans.search import recommend

QUERY_SCHEMA = T.StructType([T.StructField("query", T.StringType()), T.StructField("topk", T.IntegerType())])


def query_stream(spark: SparkSession, folder: str, fmt: str = "json", max_files: int = 100) -> DataFrame:
    """A stream over the query files put into a folder."""
    return spark.readStream.format(fmt).schema(QUERY_SCHEMA).option("maxFilesPerTrigger", max_files).load(folder)


def require_stored(index: DataFrame) -> None:
    """The index is read for every batch: one that a plan would encode each time is refused."""
    if not index.inputFiles() or "PythonUDF" in index._jdf.queryExecution().optimizedPlan().toString():
        raise ValueError("store the index first: it would be encoded again for every batch")


def recommend_stream(
    queries: DataFrame,
    index: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Answer each micro-batch with the batch plan and hand it to ``write(answers, batch_id)``.

    ``trigger`` takes the arguments of ``DataStreamWriter.trigger``, for instance
    ``{"processingTime": "10 seconds"}``; without it the query answers what is there
    and ends. The index is read for every batch, so it must be a stored one
    (``write_index`` and ``read_index``): a plan that would encode it each time is refused.

    Rows are independent, so there is no state and no watermark. A batch is run
    again after a failure: ``write`` should be idempotent per batch id.
    """
    require_stored(index)

    def answer(batch: DataFrame, batch_id: int) -> None:
        clean = clean_queries(batch, topk="topk", max_topk=options.get("max_topk", MAX_TOPK)).persist()
        try:
            write(responses(clean, recommend(clean, index, **options)), batch_id)
        finally:
            clean.unpersist()

    return (
        queries.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
