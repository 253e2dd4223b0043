from __future__ import annotations

from pickwell.llm.counts import most_frequent


def test_whole_levels_up_to_the_bound(spark):
    counts = [1] * 50 + [2] * 20 + [3] * 5 + [5000, 9000, 10_000, 70_000]
    table = spark.createDataFrame(list(enumerate(counts)), "key long, n long").repartition(4)
    size = lambda most: sorted(r.n for r in most_frequent(table, most).collect())
    assert size(100) == sorted(counts)
    assert size(30) == sorted(c for c in counts if c >= 2)
    assert size(9) == sorted(c for c in counts if c >= 3) and size(8) == [5000, 9000, 10_000, 70_000]
    assert size(2) == [70_000] and size(0) == [] and most_frequent(table.limit(0), 5).count() == 0
