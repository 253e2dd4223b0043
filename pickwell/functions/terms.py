"""Vocabularies too large to be spelled out in a plan.

``Vocabulary`` is the large form of the word list that ``functions.text`` takes: words
are looked up by hash, and all terms are searched in a text in one pass of an
Aho-Corasick automaton, whatever their number. The terms travel to tasks once, so
their size is bounded (``MAX_BYTES``); a larger vocabulary is split by the caller, and
what its parts find is joined with ``array_union``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 32 * 1024 * 1024
_WORDS = "array<string>"


@lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...], padded: bool):
    """Built once in a worker."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        made.add_word(f" {term} " if padded else term, number)
    made.make_automaton()
    return made


class Vocabulary:
    """Distinct terms in lower case; empty ones are left out."""

    def __init__(self, terms: Iterable[str], max_bytes: int = MAX_BYTES):
        found, size = set(), 0
        for term in terms:
            if term and term not in found:
                found.add(term)
                size += len(term.encode())
                if size > max_bytes:
                    raise ValueError(f"vocabulary of more than {max_bytes} bytes: split it and join what the parts find")
        self.terms = tuple(sorted(found))

    @classmethod
    def of(cls, df: DataFrame, column: str, max_bytes: int = MAX_BYTES) -> Vocabulary:
        """Of the values of a column; their size is measured before they are fetched."""
        values = df.select(F.col(column).alias("t")).filter(F.col("t") != "").distinct()
        size = values.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        if size > max_bytes:
            raise ValueError(f"vocabulary of {size} bytes, more than {max_bytes}: split it and join what the parts find")
        return cls((r.t for r in values.toLocalIterator()), max_bytes)

    def strong_terms(self, text: Column) -> Column:
        """Words of the text that are in the vocabulary, in order, repeats kept; as ``text.strong_terms``."""
        known = pa.array(self.terms, pa.string())

        @F.arrow_udf(_WORDS)
        def find(texts: pa.Array) -> pa.Array:
            lists = pc.split_pattern_regex(pc.ascii_lower(texts), "[^a-z]+")
            words = pc.list_flatten(lists)
            kept = pc.is_valid(pc.index_in(words, known))
            rows = pc.list_parent_indices(lists).filter(kept).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(kept))

        return find(F.coalesce(text, F.lit("")))

    def found_in(self, text: Column, whole_word: bool = False) -> Column:
        """The terms that a lower-case text holds, each once, in their order; as substrings or as whole words of a-z."""
        terms = self.terms

        def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            automaton = _automaton(terms, whole_word) if terms else None
            for texts in batches:
                rows = []
                for t in texts.to_pylist():
                    t = " " + re.sub("[^a-z]+", " ", t) + " " if whole_word else t
                    rows.append([terms[i] for i in sorted({n for _, n in automaton.iter(t)})] if automaton else [])
                yield pa.array(rows, pa.list_(pa.string()))

        find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(find, _WORDS)(F.coalesce(text, F.lit("")))
