"""Language identification of mixed-language text.

Learning counts character trigrams per language over all training rows. To
predict, the script of a word (code point ranges) leaves the languages that use
that script; each word gets a score per language from its trigrams; a Viterbi
pass with a penalty for each switch labels every word, and runs of equal labels
are the spans. A document's language is the one with most letters.

Defined cases: a text that is NULL or has no letter is ``und`` with score 0 and
no spans; with nothing to learn from, every text is ``und``; of languages with
equally many letters the smaller name wins; training rows without text or
language are ignored; other columns are ignored.
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

UNKNOWN = "und"
BUCKETS = 1 << 15
SWITCH_PENALTY = 6.0
MIN_SHARE = 0.001
MAX_LANGUAGES = 512

# First code points of the ranges told apart, and their scripts (0: any other).
_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
_STARTS = np.array([r[0] for r in _RANGES])
SCRIPTS = sorted({r[1] for r in _RANGES})
_SCRIPT = np.array([SCRIPTS.index(r[1]) for r in _RANGES])
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


@dataclass
class WordFeatures:
    """Of each distinct word: trigram buckets (flat, with ``ends``), script of its first letter (-1: none), letters."""

    buckets: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    letters: np.ndarray


def word_features(words: pa.Array) -> WordFeatures:
    joined = "".join(f"\x00{w}\x00" for w in words.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    edges = np.flatnonzero(points == 0) if len(points) else np.zeros(0, np.int64)
    # words hold no NUL of their own, see split
    starts, stops = edges[0::2], edges[1::2]
    letter = _letters()[points]
    before = np.concatenate([[0], np.cumsum(letter)])
    letters = before[stops] - before[starts]
    first = np.searchsorted(np.flatnonzero(letter), starts)
    where = np.append(np.flatnonzero(letter), 0)[first]
    script = np.where(letters > 0, _SCRIPT[np.searchsorted(_STARTS, points[where], "right") - 1], -1)
    # a trigram for each inner character, edges included
    middles = C.ranges(starts + 1, stops - starts - 1)
    keys = (points[middles - 1] * 0x1F1F1F + points[middles]) * 0x3D4D51 + points[middles + 1]
    buckets = (C.mix(keys.view(np.uint64)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return WordFeatures(buckets, np.concatenate([[0], np.cumsum(stops - starts - 1)]), script, letters)


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and word code of every lower-cased word, and the distinct words."""
    spaced = pc.replace_substring(pc.utf8_lower(texts), "\x00", " ")
    rows, words = C.split_words(spaced, lower=False)
    codes, found = C.distinct(words)
    return rows, codes, found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts (bucket >= 0) and letters by script (bucket = -1 - script) of each language of this task."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for block in C.blocks(batches):
        rows, codes, found = split(C.column(block, "text"))
        features = word_features(found)
        langs, names = C.distinct(C.column(block, "lang"))
        for k, name in enumerate(names.to_pylist()):
            times = np.bincount(codes[langs[rows] == k], minlength=len(found))
            spread = np.repeat(times, np.diff(features.ends))
            own = grams.setdefault(name, np.zeros(BUCKETS))
            own += np.bincount(features.buckets, spread, BUCKETS)
            own = scripts.setdefault(name, np.zeros(len(SCRIPTS)))
            real = features.script >= 0
            own += np.bincount(features.script[real], (times * features.letters)[real], len(SCRIPTS))
    for name, counts in grams.items():
        at, by = np.flatnonzero(counts), np.flatnonzero(scripts[name])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * (len(at) + len(by)), pa.string()),
                pa.array(np.concatenate([at, -1 - by]), pa.int32()),
                pa.array(np.concatenate([counts[at], scripts[name][by]]), pa.float64()),
            ],
            ["lang", "bucket", "n"],
        )


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # BUCKETS x languages
    allowed: np.ndarray  # scripts x languages


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Counts over all rows with text and language. The model holds at most
    ``BUCKETS`` numbers per language; more than ``max_languages`` names are an error."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    names = rows.select("lang").distinct().limit(max_languages + 1).count()
    if names > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counted = rows.mapInArrow(_count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    at = np.array([languages.index(x) for x in table.column("lang").to_pylist()], np.int64)
    bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    grams, scripts = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
    gram = bucket >= 0
    grams[bucket[gram], at[gram]] = n[gram]
    scripts[-1 - bucket[~gram], at[~gram]] = n[~gram]
    smooth = 0.5
    log_prob = np.log((grams + smooth) / (grams.sum(0) + smooth * BUCKETS)) if languages else grams
    allowed = scripts >= MIN_SHARE * np.maximum(scripts.sum(0), 1) if languages else scripts > 0
    # a script that no language uses says nothing
    allowed = allowed | ~allowed.any(1, keepdims=True)
    return LanguageModel(languages, log_prob.astype(np.float32), allowed)


def word_scores(model: LanguageModel, features: WordFeatures) -> np.ndarray:
    """Log-probability of each distinct word in each language; -inf outside the languages of its script."""
    n = len(features.letters)
    scores = np.zeros((n, len(model.languages)), np.float32)
    if n:
        scores = np.add.reduceat(model.log_prob[features.buckets], features.ends[:-1], axis=0)
        no_letter = features.script < 0
        scores[no_letter] = 0
        scores[~no_letter[:, None] & ~model.allowed[features.script]] = -1e6
    return scores


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word of all texts (flat, ``lengths`` words each), all texts one step at a time."""
    labels = np.zeros(len(scores), np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts longer than each step
    best = np.zeros((len(sizes), scores.shape[1]), np.float32)
    switched = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)  # where a switch into this word comes from
    for t in range(steps):
        k = active[t]
        at = starts[:k] + t
        if t:
            held = best[:k]
            top = held.argmax(1)
            jump = held[np.arange(k), top] - penalty
            swap = held < jump[:, None]
            switched[at], source[at] = swap, top
            held = np.where(swap, jump[:, None], held)
        else:
            held = best[:k]
        best[:k] = held + scores[at]
    current = best.argmax(1) if len(sizes) else np.zeros(0, np.int64)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        labels[at] = current[:k]
        if t:
            moved = switched[at, current[:k]]
            current[:k] = np.where(moved, source[at], current[:k])
    return labels


def label_block(model: LanguageModel, texts: pa.Array, penalty: float):
    """Per text: predicted label (-1: none), score, and the spans (label, words, letters) with their number per text."""
    n = len(texts)
    rows, codes, found = split(texts)
    features = word_features(found)
    lengths = np.bincount(rows, minlength=n)
    letters = features.letters[codes]
    k = len(model.languages)
    pred, score = np.full(n, -1), np.zeros(n)
    if not k or not len(rows):
        return pred, score, np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    labels = viterbi(word_scores(model, features)[codes], lengths, penalty)
    weight = np.bincount(rows * k + labels, letters, n * k).reshape(n, k)
    total = weight.sum(1)
    some = total > 0
    pred[some] = weight[some].argmax(1)
    score[some] = weight[some].max(1) / total[some]
    cut = C.run_starts(rows * k + labels)
    span_rows = rows[cut]
    words = np.diff(np.append(cut, len(rows)))
    return pred, score, np.bincount(span_rows, minlength=n), labels[cut], words, np.add.reduceat(letters, cut)


SPAN = T.ArrayType(T.StructType().add("lang", "string").add("words", "integer").add("letters", "integer"))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``lang_pred, lang_score, lang_spans`` beside all columns of ``docs``; equal old names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_spans")]
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("lang_pred", "string").add("lang_score", "double").add("lang_spans", SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.languages, UNKNOWN], object)
        for block in C.blocks(batches, text):
            pred, score, spans, label, words, letters = label_block(model, C.column(block, text), penalty)
            struct = pa.StructArray.from_arrays(
                [pa.array(names[label], pa.string()), pa.array(words, pa.int32()), pa.array(letters, pa.int32())],
                ["lang", "words", "letters"],
            )
            offsets = pa.array(np.concatenate([[0], np.cumsum(spans)]), pa.int32())
            found = [pa.array(names[pred], pa.string()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(offsets, struct)]
            yield pa.RecordBatch.from_arrays([*block.columns, *found], [*kept, "lang_pred", "lang_score", "lang_spans"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def training(docs: DataFrame, key: str = "doc_id", folds: int = 5) -> DataFrame:
    """Rows whose checksum puts them outside the held-out fold."""
    return docs.filter(F.crc32(F.col(key).cast("string")) % folds != 0)


def language_query(docs: DataFrame) -> DataFrame:
    """Language of every document, learned from the training folds only."""
    rows = docs.select("doc_id", "text", "lang")
    model = learn(training(rows))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return identify(rows.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_spans"
    )
