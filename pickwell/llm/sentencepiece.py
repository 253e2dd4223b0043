"""Piece ids of whole texts by streaming Viterbi, and the way back.

A text is written with ``U+2581`` for each blank and one before it. Viterbi finds
the pieces with the highest sum of scores. It streams: only the back pointers of
the last ``longest piece`` positions are live, and whenever all of them go back
through one boundary, everything before that boundary is final and its ids leave
the window.

A block of texts goes through this as arrays. Where no piece crosses from another
character into ``U+2581``, that place is a boundary for any text, so texts become parts,
and each distinct part is encoded once. The pieces that begin at each character are
looked up by rolling hashes, one length after the other. All paths go through
every place that none of them crosses: there they converge, whatever comes later, and
the pieces before are committed. The stretches between such places are advanced in step, all
of a block at once. A stretch longer than the window (``WINDOW``) is streamed on its own,
with boundaries found by its back pointers.

The vocabulary file is a parameter (a public model is not part of this code).
A character without a piece, and a ``U+2581`` of the text itself, become byte pieces.

Defined cases: NULL has NULL ids, an empty text an empty list; decoding gives the
very same text back; ids outside the vocabulary are an error; repeated rows and
other columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickwell.llm import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
WINDOW = 64
AT_ONCE = 1 << 16
_U = np.uint64
_SLOT_BITS = 21
_LITERAL = "\ue000"  # stands for a U+2581 of the text inside a part; never a piece


class Pieces:
    """Pieces and scores read from a model file."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = [-1] * 256
        self.scores = [0.0] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.scores[i] = i, sp.get_score(i)
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        if min(self.byte_ids) < 0:
            raise ValueError("the vocabulary needs a piece for every byte")
        self.longest = max(map(len, self.ids), default=1)
        self.size = np.array([len(self.bytes_of[i].decode("utf-8", "replace")) for i in range(n)])
        self.score_of = np.array(self.scores)
        self.unknown = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._index()

    @cached_property
    def heads(self) -> set[str]:
        """All beginnings of pieces, so that the search stops where none goes on."""
        return {p[:k] for p in self.ids for k in range(1, len(p) + 1)}

    def _index(self) -> None:
        """Beginnings of pieces by their hash, each with the piece that ends there (-1: none)."""
        names = list(self.ids)
        sizes = np.array([len(p) for p in names])
        points = np.zeros((len(names), self.longest), np.uint32)
        points[np.arange(self.longest) < sizes[:, None]] = _points("".join(names))
        numbers = np.array([self.ids[p] for p in names], np.int64)
        found, h = [], np.zeros(len(names), np.uint64)
        for k in range(1, self.longest + 1):
            own = sizes >= k
            h[own] = _rolled(h[own], points[own, k - 1])
            found.append(np.stack([h[own].view(np.int64), np.where(sizes[own] == k, numbers[own], -1)]))
        key, piece = np.concatenate(found, axis=1)
        order = np.lexsort((-piece, key.view(np.uint64)))
        key, piece = key[order].view(np.uint64), piece[order]
        first = C.run_starts(key)
        # sorted keys, and by their first bits where to look
        self.key, self.piece = key[first], piece[first]
        slots = (self.key >> _U(64 - _SLOT_BITS)).astype(np.int64)
        self.slot = np.searchsorted(slots, np.arange((1 << _SLOT_BITS) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.slot).max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the beginnings, -1 where it is none."""
        at = (h >> _U(64 - _SLOT_BITS)).astype(np.int64)
        place, end = self.slot[at], self.slot[at + 1]
        out = np.full(len(h), -1, np.int64)
        look = np.flatnonzero(place < end)
        for step in range(self.deepest):
            here = place[look] + step
            same = self.key[here] == h[look]
            out[look[same]] = here[same]
            look = look[~same & (here + 1 < end[look])]
            if not len(look):
                break
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _rolled(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hash of a string that is one character longer."""
    x = (h + points.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def stream(text: str, pieces: Pieces) -> Iterator[list[int]]:
    """Ids of ``text`` (blanks already written as U+2581) in batches, each final when it comes.

    State: scores and back pointers of the positions since the last commit. Ties go
    to the longer last piece.
    """
    ids, heads, scores, longest = pieces.ids, pieces.heads, pieces.scores, pieces.longest
    n = len(text)
    low = float("-inf")
    base = 0  # everything before is committed
    best = [0.0] + [low] * longest  # scores at base, base + 1, ...
    back: list[tuple[int, int]] = [(0, -1)] * (longest + 1)  # start of the last piece, its id

    def reach(at: int, score: float, start: int, piece: int) -> None:
        while len(best) <= at - base:
            best.append(low)
            back.append((0, -1))
        if score > best[at - base]:
            best[at - base], back[at - base] = score, (start, piece)

    def path(end: int, start: int) -> list[int]:
        out: list[int] = []
        while end > start:
            begin, piece = back[end - base]
            out.append(piece if piece >= 0 else -1 - ord(text[begin]))
            end = begin
        return out[::-1]

    for i in range(n):
        here = best[i - base]
        if here > low:
            known = False
            for j in range(i + 1, min(i + longest, n) + 1):
                part = text[i:j]
                if part not in heads:
                    break
                piece = ids.get(part, -1)
                if piece >= 0:
                    reach(j, here + scores[piece], i, piece)
                    known = known or j == i + 1
            if not known:
                reach(i + 1, here + pieces.unknown, i, -1)
        # positions after i that are reached: do all go back through one boundary?
        if i + 1 - base >= 4 * longest:
            ends = [e for e in range(i + 1, min(base + len(best), i + 1 + longest)) if best[e - base] > low]
            seen = set(ends)
            while len(seen) > 1:
                last = max(seen)
                seen.remove(last)
                seen.add(back[last - base][0])
            (cut,) = seen
            if cut > base:
                yield path(cut, base)
                shift = cut - base
                held = best[shift]
                best[:] = [b - held for b in best[shift:]]
                back[:] = back[shift:]
                base = cut
    yield path(n, base)


def encode_part(part: str, pieces: Pieces) -> list[int]:
    """Ids of one part, characters without a piece as bytes."""
    out: list[int] = []
    for batch in stream(part, pieces):
        for piece in batch:
            if piece >= 0:
                out.append(piece)
            else:
                ch = chr(-1 - piece)
                out += [pieces.byte_ids[b] for b in (SPACE if ch == _LITERAL else ch).encode("utf-8", "surrogatepass")]
    return out


def encode_parts(parts: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts, one after the other, and the number of each part's ids; ``AT_ONCE`` characters at a time."""
    if not len(parts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    before = np.cumsum(pc.utf8_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(before // AT_ONCE, prepend=-1))
    found = [_encode_some(parts.slice(a, b - a), pieces) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(parts)])]
    return tuple(np.concatenate(x) for x in zip(*found))


def _encode_some(parts: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.utf8_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    points = _points("".join(parts.to_pylist()))
    n = len(points)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(parts), np.int64)
    start, length, piece = _edges(points, sizes, pieces)
    # places that no edge crosses are where all paths converge
    reach = np.arange(n) + 1
    np.maximum.at(reach, start, start + length)
    until = np.maximum.accumulate(reach)
    first = np.flatnonzero(np.concatenate([[True], until[:-1] == np.arange(1, n)]))
    stretch = np.append(first[1:], n) - first
    taken = np.full(n, -2, np.int64)
    _in_step(taken, start, length, piece, first, stretch, pieces)
    for a, b in zip(first[stretch > WINDOW].tolist(), (first + stretch)[stretch > WINDOW].tolist(), strict=True):
        at = a
        for batch in stream(points[a:b].tobytes().decode("utf-32-le", "surrogatepass"), pieces):
            for number in batch:
                taken[at] = max(number, -1)
                at += pieces.size[number] if number >= 0 else 1
    chosen = np.flatnonzero(taken > -2)
    ids = taken[chosen]
    counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[chosen], minlength=len(sizes))
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids.astype(np.int32), counts
    # characters without a piece become their bytes
    kinds, which = np.unique(points[chosen[odd]], return_inverse=True)
    spelled = [[pieces.byte_ids[x] for x in (SPACE if chr(k) == _LITERAL else chr(k)).encode("utf-8", "surrogatepass")] for k in kinds.tolist()]
    wide = np.array([len(x) for x in spelled])
    times = np.ones(len(ids), np.int64)
    times[odd] = wide[which]
    out = np.repeat(ids, times)
    out[out < 0] = np.concatenate([*(np.array(x) for x in spelled)])[C.ranges((np.cumsum(wide) - wide)[which], wide[which])]
    ends = np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], np.cumsum(counts)])]
    return out.astype(np.int32), np.diff(ends)


def _edges(points: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and number (-1: a character without a piece) of all pieces in the parts."""
    n = len(points)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    alive, h = np.arange(n), np.zeros(n, np.uint64)
    bare = np.ones(n, bool)
    found = []
    for k in range(1, pieces.longest + 1):
        inside = left[alive] >= k
        alive, h = alive[inside], h[inside]
        h = _rolled(h, points[alive + k - 1])
        place = pieces.find(h)
        alive, h, place = alive[place >= 0], h[place >= 0], place[place >= 0]
        number = pieces.piece[place]
        own = number >= 0
        found.append((alive[own], np.full(np.count_nonzero(own), k), number[own]))
        if k == 1:
            bare[alive[own]] = False
        if not len(alive):
            break
    odd = np.flatnonzero(bare)
    found.append((odd, np.ones(len(odd), np.int64), np.full(len(odd), -1)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _in_step(taken: np.ndarray, start: np.ndarray, length: np.ndarray, piece: np.ndarray, first: np.ndarray, stretch: np.ndarray, pieces: Pieces) -> None:
    """Best pieces of the stretches up to ``WINDOW``, put where they begin. Ties go to the longer last piece."""
    number = np.repeat(np.arange(len(first)), stretch)
    short = stretch <= WINDOW
    own = short[number[start]]
    start, length, piece = start[own], length[own], piece[own]
    wide = pieces.longest + 1
    # small numbers are sorted without comparing them
    turn = (start - first[number[start]]) * wide + length
    turn = turn.astype(np.uint16 if (WINDOW + 1) * wide < 1 << 16 else np.int64)
    order = np.argsort(turn, kind="stable")
    start, length, piece, turn = start[order], length[order], piece[order], turn[order]
    score = np.where(piece >= 0, pieces.score_of[piece], pieces.unknown)
    # a stretch of m characters has m + 1 places
    node = start + number[start]
    best = np.full(len(number) + len(first), -np.inf)
    best[first + np.arange(len(first))] = 0.0
    back, by = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
    groups = C.run_starts(turn)
    for a, b in zip(groups.tolist(), np.append(groups[1:], len(start))[: len(groups)].tolist()):
        total = best[node[a:b]] + score[a:b]
        to = node[a:b] + length[a:b]
        better = total > best[to]
        to = to[better]
        best[to], back[to], by[to] = total[better], length[a:b][better], piece[a:b][better]
    begin = (first + np.arange(len(first)))[short]
    at = begin + stretch[short]
    shift = np.arange(len(first))[short]
    while len(at):
        step = back[at]
        taken[at - step - shift] = by[at]
        at = at - step
        more = at > begin
        at, begin, shift = at[more], begin[more], shift[more]


def parts_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row and text of the parts between boundaries; joined again they are the marked text."""
    # a private-use character of the text itself would be mistaken for the stand-in
    if pc.any(pc.match_substring(texts, _LITERAL)).as_py():
        raise _Stand
    marked = pc.replace_substring(texts, SPACE, _LITERAL)
    some = pc.fill_null(pc.greater(pc.binary_length(marked), 0), False)
    rows = np.flatnonzero(some.to_numpy(zero_copy_only=False))
    # a mark after another character begins a part; marks in a row stay together
    apart = pc.replace_substring(marked.filter(some), " ", "\x00" + SPACE)
    marked = pc.binary_join_element_wise(pa.scalar(SPACE), apart, "")
    while pc.any(pc.match_substring(marked, SPACE + "\x00")).as_py():
        marked = pc.replace_substring(marked, SPACE + "\x00" + SPACE, SPACE + SPACE)
    cut = pc.split_pattern(marked, "\x00")
    return rows[pc.list_parent_indices(cut).to_numpy(zero_copy_only=False)], pc.list_flatten(cut)


class _Stand(Exception):
    """The texts hold the characters used as stand-ins."""


def encode_texts(texts: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one text after the other, and the number of each text's ids."""
    n = len(texts)
    try:
        if pieces.crossing or pc.any(pc.match_substring(texts, "\x00")).as_py():
            raise _Stand
        rows, parts = parts_of(texts)
    except _Stand:
        # rare characters or another kind of vocabulary: each text is one stream
        found = [encode_text(t, pieces) if t else [] for t in texts.to_pylist()]
        return np.array([i for f in found for i in f], np.int32), np.array([len(f) for f in found], np.int64)
    codes, distinct = C.distinct(parts)
    flat, lengths = encode_parts(distinct, pieces)
    starts = np.cumsum(lengths) - lengths
    out = flat[C.ranges(starts[codes], lengths[codes])] if len(codes) else np.zeros(0, np.int32)
    return out, np.bincount(rows, lengths[codes], n).astype(np.int64)


def encode_text(text: str, pieces: Pieces) -> list[int]:
    """Ids of one whole text, streamed from end to end."""
    marked = SPACE + text.replace(" ", SPACE) if SPACE not in text else None
    if marked is not None:
        return encode_part(marked, pieces) if _LITERAL not in text else _with_bytes(text, pieces)
    return _with_bytes(text, pieces)


def _with_bytes(text: str, pieces: Pieces) -> list[int]:
    """As ``encode_text`` where the text holds U+2581 or its stand-in: these go as bytes between the rest."""
    out: list[int] = []
    rest = SPACE
    for ch in text:
        if ch in (SPACE, _LITERAL):
            out += encode_part(rest, pieces) if rest else []
            out += [pieces.byte_ids[b] for b in ch.encode()]
            rest = ""
        else:
            rest += SPACE if ch == " " else ch
    return out + (encode_part(rest, pieces) if rest else [])


def decode_ids(ids: np.ndarray, lengths: np.ndarray, table: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of each list of ids, without the first blank; ``table`` holds the bytes of all pieces."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(ends) - 1):
        raise ValueError("an id is not in the vocabulary")
    sizes = (ends[1:] - ends[:-1])[ids]
    raw = table[C.ranges(ends[ids], sizes)].tobytes() if len(ids) else b""
    stops = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths)])]
    return [raw[a + 1 : b] if b > a else b"" for a, b in zip(stops[:-1], stops[1:], strict=True)]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, text: str = "text", name: str = "ids", model: str = MODEL) -> DataFrame:
    """All columns of ``docs`` and the ids of ``text``; an old column of that name is replaced."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name])
    held = docs.sparkSession.sparkContext.broadcast(read_model(model))  # a vocabulary file, fixed in size
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held.value)
        for block in C.blocks(batches, text):
            texts = C.column(block, text)
            ids, lengths = encode_texts(texts, pieces)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            missing = pc.is_null(texts)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.ListArray.from_arrays(offsets, pa.array(ids), mask=missing)], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def _decoded(block: pa.RecordBatch, ids: str, pieces: Pieces, table: np.ndarray, ends: np.ndarray) -> list[str | None]:
    lists = C.column(block, ids)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    valid = pc.is_valid(lists).to_numpy(zero_copy_only=False)
    found = decode_ids(flat, lengths, table, ends)
    return [b.decode("utf-8", "replace") if v else None for b, v in zip(found, valid, strict=True)]


def decode(rows: DataFrame, ids: str = "ids", name: str = "decoded", model: str = MODEL) -> DataFrame:
    """All columns of ``rows`` and the text of ``ids``; an old column of that name is replaced."""
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != name])
    held = rows.sparkSession.sparkContext.broadcast(read_model(model))
    names = [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held.value)
        table = np.frombuffer(b"".join(pieces.bytes_of), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(b) for b in pieces.bytes_of])])
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                block = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(_decoded(block, ids, pieces, table, ends), pa.string())], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def encoding_query(docs: DataFrame) -> DataFrame:
    """Ids of every document, and whether decoding gives its text back."""
    back = decode(encode(docs.select("doc_id", "text")))
    return back.select(
        "doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
