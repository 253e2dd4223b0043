"""Toxicity score from a factorization machine over hashed terms.

Terms are the distinct words of a text and the beginnings of words (three to five
letters, so inflected forms share a term), hashed. The score of a text is ``sigmoid(bias + sum w_t + sum of v_t . v_u over
pairs)``, the pair term over factors, so that two terms can mean together what
neither means alone.

Learning uses a bounded sample of the labelled rows: per label the ``max_rows``
with the smallest hash of their id. It runs in one task on that sample; the
model keeps terms found in at least ``MIN_DF`` of its texts. The sample takes the
two classes at different rates, so the log ratio of the rates is taken off the bias:
scores are for the class shares of all labelled rows, however large the table is.

Defined cases: NULL or blank texts get the score of the bias alone; labels other
than 0 and 1 and documents without a label are not learned from; with no labels
every score is 0; repeated rows count as often as they come; other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickwell.llm import common as C

MAX_ROWS = 6000
MIN_DF = 10
FACTORS = 8
EPOCHS = 10
L2, FACTOR_L2, FACTOR_RATE = 0.1, 0.5, 0.03
PREFIXES = (3, 4, 5)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct term of each text, sorted by row."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " ")
    rows, words = C.split_words(spaced, lower=False)
    codes, found = C.distinct(words)
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    lengths = pc.utf8_length(found).to_numpy(zero_copy_only=False)
    all_rows, values = [], []
    for k in (0, *PREFIXES):
        part, names = (np.arange(len(found)), found) if not k else C.distinct(pc.utf8_slice_codeunits(found, 0, k))
        hashes = C.mix(C.hash_words(names) ^ np.uint64(k)).view(np.int64)
        use = slice(None) if not k else lengths[codes] >= k
        pairs = np.unique(rows[use] * len(names) + part[codes[use]])
        all_rows.append(pairs // len(names))
        values.append(hashes[pairs % len(names)])
    rows = np.concatenate(all_rows)
    order = np.argsort(rows, kind="stable")
    return rows[order], np.concatenate(values)[order]


@dataclass
class FactorModel:
    bias: float
    keys: np.ndarray  # sorted term hashes
    weights: np.ndarray  # per term: linear weight, then factors

    def score(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        rows, values = terms(texts)
        at = np.searchsorted(self.keys, values)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == values[known]
        rows, at = rows[known], at[known]
        return 1 / (1 + np.exp(-_logit(self.bias, self.weights, rows, at, n)[0]))


def _logit(bias: float, weights: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int):
    """Scores before the sigmoid and the factor sums of each text; rows are sorted."""
    out, sums = np.full(n, bias, np.float64), np.zeros((n, weights.shape[1] - 1))
    if len(rows):
        starts = C.run_starts(rows)
        own = weights[at]
        added = np.add.reduceat(own, starts, axis=0)
        squares = np.add.reduceat((own[:, 1:] ** 2).sum(1), starts)
        sums[rows[starts]] = added[:, 1:]
        out[rows[starts]] += added[:, 0] + 0.5 * ((added[:, 1:] ** 2).sum(1) - squares)
    return np.clip(out, -30, 30), sums


def fit(row_terms: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, l2: float = L2, factor_l2: float = FACTOR_L2, factor_rate: float = FACTOR_RATE) -> FactorModel:
    """AdaGrad on the logistic loss over small batches in a fixed random order."""
    rng = np.random.default_rng(7)
    keys, df = np.unique(np.concatenate([*row_terms, np.zeros(0, np.int64)]), return_counts=True)
    keys = keys[df >= MIN_DF]
    lengths = np.array([len(t) for t in row_terms])
    flat = np.concatenate([*row_terms, np.zeros(0, np.int64)])
    at = np.searchsorted(keys, flat)
    known = at < len(keys)
    known[known] = keys[at[known]] == flat[known]
    owner = np.repeat(np.arange(len(labels)), lengths)[known]
    at = at[known]
    counts = np.bincount(owner, minlength=len(labels))
    begins = np.cumsum(counts) - counts
    weights = np.zeros((len(keys), 1 + factors), np.float64)
    weights[:, 1:] = rng.normal(0, 0.01, (len(keys), factors))
    seen = np.full(weights.shape, 1e-3)
    penalty = np.r_[l2, np.full(factors, factor_l2)]
    pace = np.r_[1.0, np.full(factors, factor_rate)]
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    bias, bias_seen = float(np.log(share / (1 - share))), 1e-3
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), 64):
            docs = order[a : a + 64]
            own = at[C.ranges(begins[docs], counts[docs])]
            rows = np.repeat(np.arange(len(docs)), counts[docs])
            logit, sums = _logit(bias, weights, rows, own, len(docs))
            error = 1 / (1 + np.exp(-logit)) - labels[docs]
            slope = np.empty((len(own), 1 + factors))
            slope[:, 0] = error[rows]
            slope[:, 1:] = error[rows][:, None] * (sums[rows] - weights[own, 1:])
            terms_, which = np.unique(own, return_inverse=True)
            total = np.stack([np.bincount(which, slope[:, j], len(terms_)) for j in range(1 + factors)], 1) + penalty * weights[terms_]
            seen[terms_] += total**2
            rate = 0.3 / (1 + epoch)
            weights[terms_] -= rate * pace * total / np.sqrt(seen[terms_])
            bias_seen += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(bias_seen)
    return FactorModel(bias, keys, weights.astype(np.float32))


def rate_ratio(rows: dict[int, int], sampled: dict[int, int]) -> float:
    """Log of the sampling rate of label 1 over that of label 0; 0 where a class has no rows in the sample."""
    if not all(rows.get(v) and sampled.get(v) for v in (0, 1)):
        return 0.0
    return float(np.log(sampled[1] / rows[1]) - np.log(sampled[0] / rows[0]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", max_rows: int = MAX_ROWS) -> FactorModel | None:
    """A model from at most ``max_rows`` labelled documents of each class; None without any."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    order = F.xxhash64("key")
    picked = [known.filter(F.col("label") == v).orderBy(order, "key").limit(max_rows) for v in (0, 1)]
    wanted = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * max_rows small rows at most
    every = docs.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).join(known, "key")
    rows = {r["label"]: r["n"] for r in every.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    sample = docs.select(F.col(key).alias("key"), F.col("text").alias("text")).join(wanted, "key")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.blocks(batches):
            rows, values = terms(C.column(block, "text"))
            found = C.lists(values, np.bincount(rows, minlength=block.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays([C.column(block, "key").cast(pa.int64()), C.column(block, "label").cast(pa.int32()), found], ["key", "label", "terms"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        row_terms = [np.asarray(x.values) for x in table.column("terms")]
        order = sorted(range(len(row_terms)), key=lambda i: (table.column("key")[i].as_py(), row_terms[i].tobytes()))
        labels = table.column("label").to_numpy()[order].astype(float)
        model = fit([row_terms[i] for i in order], labels)
        model.bias -= rate_ratio(rows, {v: int((labels == v).sum()) for v in (0, 1)})
        keys = np.concatenate([[0], model.keys])
        values = np.concatenate([[[model.bias] + [0.0] * FACTORS], model.weights])
        first = np.arange(len(keys)) == 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(first), pa.array(keys, pa.int64()), C.lists(values.ravel(), np.full(len(keys), 1 + FACTORS), pa.float32())],
            ["is_bias", "term", "weights"],
        )

    features = sample.mapInArrow(hashed, "key long, label int, terms array<long>")
    table = features.repartition(1).mapInArrow(train, "is_bias boolean, term long, weights array<float>").toArrow()
    if not table.num_rows:
        return None
    weights = np.array(table.column("weights").combine_chunks().flatten()).reshape(table.num_rows, -1)
    bias = table.column("is_bias").to_numpy()
    keys = table.column("term").to_numpy()[~bias]
    order = np.argsort(keys)
    return FactorModel(float(weights[bias][0, 0]), keys[order], weights[~bias][order])


def score(docs: DataFrame, model: FactorModel | None, text: str = "text", name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score in ``name``; an old column of that name is replaced."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name])
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in C.blocks(batches, text):
            found = held.value.score(C.column(block, text))
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(found, pa.float64())], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document, learned from labelled documents outside the held-out fold."""
    rows = docs.select("doc_id", "text")
    known = labels.select("doc_id", "toxic").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = score(rows, learn(rows, known))
    return scored.select(
        "doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )
