"""Arrow and numpy helpers of the corpus operators; they run inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

_U = np.uint64
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_STEP = _U(0x9E3779B97F4A7C15)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again in slices whose texts hold about ``most`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        before = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))[:-1]])
        starts = np.flatnonzero(np.diff(before // most, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
            # a reused worker would keep what the largest block needed
            pa.default_memory_pool().release_unused()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Row number and text of every word ``[^\\x20\\x09-\\x0D]+``; A-Z lower-cased. NULL and blank texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    rows, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    rows, flat = rows.filter(real), flat.filter(real)
    return rows.to_numpy(zero_copy_only=False).astype(np.int64), flat


def distinct(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of every word and the distinct words."""
    encoded = words.dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and bytes of a string array."""
    words = words.cast(pa.large_string())
    if words.offset or words.null_count:
        words = pa.concat_arrays([words.fill_null("")])
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64, words.offset + len(words) + 1)[words.offset :] if len(words) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return ends - ends[0], raw[ends[0] : ends[-1]]


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each non-empty word, the same in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends, raw = buffers(words)
    lengths = np.diff(ends)
    place = np.arange(len(raw)) - np.repeat(ends[:-1], lengths)
    terms = _BYTE[raw] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, ends[:-1]) + lengths.astype(np.uint64))


_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_TERM = np.where(_BLANK, _U(0), _BYTE)  # of lower-cased bytes, none of blanks
_TERM[65:91] = _BYTE[97:123]
_BACK = _U(pow(int(_STEP), -1, 1 << 64))


def hashed_words(texts: pa.Array, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of every word: ``split_words`` and ``hash_words`` from the bytes of the texts, ``most`` words at once.

    Bytes are weighted by their place in the stretch; one division by the power of a word's start gives its hash.
    """
    ends, raw = buffers(texts)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = ~_BLANK[raw]
    borders = ends[1:-1]
    borders = borders[(borders > 0) & (borders < len(raw))]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    first[borders] = word[borders]
    last[:-1] &= ~word[1:]
    last[borders - 1] = word[borders - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.zeros(len(starts), np.uint64)
    cuts = [*range(0, len(starts), most), len(starts)]
    longest = max((int(stops[b - 1] - starts[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), default=0)
    up, down = powers(longest), powers(longest, _BACK)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        begin = starts[a:b] - starts[a]
        terms = np.take(_TERM, raw[starts[a] : stops[b - 1]])
        terms *= up[: len(terms)]
        out[a:b] = mix(np.add.reduceat(terms, begin) * down[begin] + (stops[a:b] - starts[a:b]).astype(np.uint64))
    return np.searchsorted(ends, starts, "right") - 1, out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``start .. start + length`` of all runs, one after the other."""
    total = int(lengths.sum())
    shift = starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(starts) else starts
    return np.arange(total) + np.repeat(shift, lengths)


def run_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
