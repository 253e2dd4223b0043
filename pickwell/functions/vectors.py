"""Vector expressions and the text encoders.

An encoder is anything with a ``name``, a ``dim`` and a call ``Column of text ->
Column of ARRAY<FLOAT>``; the same one must serve items and queries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(v: Column) -> Column:
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def normalize(v: Column) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    length = norm(v)
    # the length enters as a one-element array so that it is computed once per row
    scaled = F.transform(
        F.array(length),
        lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)),
    )
    return F.get(scaled, F.lit(0))


# ---------------------------------------------------------------- encoders


@dataclass(frozen=True)
class HashEncoder:
    """Feature hashing: word counts per bucket, scaled to unit length.

    A word is a run of letters and digits in lower case; its bucket is the first
    32 bits of its md5, modulo ``dim``. It knows spelling, not meaning. Texts are
    split by Arrow's compute kernels, and each distinct word of a batch is hashed
    once, which beats the same steps as SQL expressions by more than twice.
    """

    dim: int = 384

    @property
    def name(self) -> str:
        return f"hash-md5-{self.dim}"

    def __call__(self, text: Column) -> Column:
        dim = self.dim

        @F.arrow_udf("array<float>")
        def encode(texts: pa.Array) -> pa.Array:
            step = _texts_at_once(dim)
            parts = [_hash_texts(texts.slice(i, step), dim) for i in range(0, len(texts), step)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

        return encode(F.coalesce(text, F.lit("")))


# the dense counts of the texts hashed at once take about this much
_COUNT_BYTES = 16 * 1024 * 1024


def _texts_at_once(dim: int) -> int:
    return max(1, min(1024, _COUNT_BYTES // (8 * dim)))


def _word_buckets(texts: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\pL\pN]+")
    words = pc.list_flatten(lists).dictionary_encode()
    buckets = np.array([_bucket(w, dim) for w in words.dictionary.to_pylist()], dtype=np.int64)
    bucket = buckets[words.indices.to_numpy()]
    row = pc.list_parent_indices(lists).to_numpy()
    # splitting leaves an empty word where a text begins or ends with a separator
    real = bucket >= 0
    return row[real], bucket[real]


def _hash_texts(texts: pa.Array, dim: int) -> pa.Array:
    n = len(texts)
    row, bucket = _word_buckets(texts, dim)
    counts = np.bincount(row * dim + bucket, minlength=n * dim).reshape(n, dim).astype(np.float64)
    return _unit_vectors(counts)


@dataclass(frozen=True)
class SparseHashEncoder:
    """Feature hashing as ``HashEncoder`` does it, of which only the buckets in use are kept.

    Gives ``(bucket, weight)`` lists by bucket, so ``dim`` may be large enough that words hardly
    ever share a bucket; no array is as wide as ``dim``.
    """

    dim: int = 1 << 18

    @property
    def name(self) -> str:
        return f"sparse-hash-md5-{self.dim}"

    def __call__(self, text: Column) -> Column:
        dim = self.dim

        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            # each part is handed on before the next is hashed
            for texts in batches:
                if not len(texts):
                    yield pa.array([], _TERMS)
                for part in _text_parts(texts):
                    yield _hash_sparse(part, dim)

        encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(encode, "array<struct<bucket:int,weight:float>>")(F.coalesce(text, F.lit("")))


_TERMS = pa.list_(pa.struct([("bucket", pa.int32()), ("weight", pa.float32())]))


# the texts hashed at once have so many bytes; a longer one is hashed by itself
_TEXT_BYTES = 4 * 1024 * 1024


def _text_parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of at most 1,024 texts and bounded size."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = min(start + 1024, max(start + 1, int(np.searchsorted(ends, before + _TEXT_BYTES, "right"))))
        yield texts.slice(start, stop - start)
        start = stop


def _hash_sparse(texts: pa.Array, dim: int) -> pa.Array:
    row, bucket = _word_buckets(texts, dim)
    key, count = np.unique(row.astype(np.int64) * dim + bucket, return_counts=True)
    row = key // dim
    squares = np.bincount(row, count.astype(np.float64) ** 2, minlength=len(texts))
    weight = count / np.sqrt(squares)[row]
    cells = pa.StructArray.from_arrays([pa.array(key % dim, pa.int32()), pa.array(weight, pa.float32())], fields=list(_TERMS.value_type))
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells, type=_TERMS)


def _bucket(word: str, dim: int) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % dim if word else -1


def _unit_vectors(matrix: np.ndarray) -> pa.Array:
    """Rows scaled to unit length, as ARRAY<FLOAT>; a zero row stays zero."""
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return _vectors(np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0))


def _vectors(matrix: np.ndarray) -> pa.Array:
    n, dim = matrix.shape
    offsets = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.astype(np.float32).ravel()))


@dataclass(frozen=True)
class ModelEncoder:
    """A user's embedding model, loaded once per worker.

    ``load`` returns a function from a list of texts to an ``n x dim`` matrix.
    """

    name: str
    dim: int
    load: Callable[[], Callable[[list[str]], np.ndarray]] = field(repr=False)
    unit_length: bool = True

    def __call__(self, text: Column) -> Column:
        dim, load, unit_length = self.dim, self.load, self.unit_length

        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = load()
            for batch in batches:
                if not len(batch):
                    yield pa.array([], pa.list_(pa.float32()))
                    continue
                matrix = np.asarray(model(batch.to_pylist()), dtype=np.float64).reshape(len(batch), -1)
                if matrix.shape[1] != dim:
                    raise ValueError(f"model gives {matrix.shape[1]} dimensions, declared are {dim}")
                yield _unit_vectors(matrix) if unit_length else _vectors(matrix)

        encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(encode, "array<float>")(F.coalesce(text, F.lit("")))
