from __future__ import annotations

import random

import pyarrow as pa
import pytest

from pickwell.llm import sentencepiece as S

pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def pieces():
    return S.Pieces(S.read_model(S.MODEL))


def best_path(text, pieces):
    """Viterbi over the whole text, nothing committed before its end."""
    best, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        known = False
        for j in range(i + 1, min(i + pieces.longest, len(text)) + 1):
            p = pieces.ids.get(text[i:j])
            if p is not None:
                known = known or j == i + 1
                if best[i] + pieces.scores[p] > best[j]:
                    best[j], back[j] = best[i] + pieces.scores[p], (i, p)
        if not known and best[i] + pieces.unknown > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + pieces.unknown, (i, -1 - ord(text[i]))
    out, at = [], len(text)
    while at:
        at, p = back[at][0], back[at][1]
        out.append(p)
    return out[::-1]


def strange_texts(n=150):
    rng = random.Random(9)
    return ["".join(rng.choice("abthe rionsé漢\n\t<>🙂 ▁\x00 ") for _ in range(rng.randint(0, 150))) for _ in range(n)]


def test_stream_commits_the_best_path(pieces):
    for text in [*strange_texts(), "x" * 500, "ab" * 300, "the" * 200]:
        marked = S.SPACE + text.replace(" ", S.SPACE)
        batches = list(S.stream(marked, pieces))
        assert [p for b in batches for p in b] == best_path(marked, pieces)
    assert len(list(S.stream("▁abc" * 500, pieces))) > 10


def test_parts_and_streams_agree_and_decode(pieces):
    import numpy as np

    texts = strange_texts()
    table = np.frombuffer(b"".join(pieces.bytes_of), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(b) for b in pieces.bytes_of])])
    plain = [t for t in texts if not set(t) & {"\x00", ""}]
    for group in (texts, plain):
        ids, lengths = S.encode_texts(pa.array(group), pieces)
        assert [b.decode() for b in S.decode_ids(ids.astype(np.int64), lengths, table, ends)] == group
    marks_free = [t for t in plain if S.SPACE not in t]
    ids, lengths = S.encode_texts(pa.array(marks_free), pieces)
    assert ids.tolist() == [i for t in marks_free if t for i in S.encode_text(t, pieces)]


def test_parts_in_step_give_the_best_path(pieces):
    rng = random.Random(4)
    some = list(pieces.ids)
    parts = [S.SPACE + "".join(rng.choices(some, k=rng.randint(0, 6))) for _ in range(400)]
    parts += ["".join(rng.choice("abthe rionsé漢🙂\x01") for _ in range(rng.randint(1, 60))) for _ in range(200)] + [S._LITERAL, "", "x" * 300, "the" * 100 + "🙂🙂", "ab" * 40]
    ids, lengths = S.encode_parts(pa.array(parts), pieces)
    stops = lengths.cumsum()
    for part, stop, n in zip(parts, stops, lengths):
        want = []
        for piece in best_path(part, pieces):
            ch = chr(-1 - piece) if piece < 0 else ""
            want += [piece] if piece >= 0 else [pieces.byte_ids[b] for b in (S.SPACE if ch == S._LITERAL else ch).encode()]
        assert ids[stop - n : stop].tolist() == want, part


def test_a_long_text_without_blanks_is_committed_as_it_goes(pieces):
    rng = random.Random(5)
    plain, runs = "".join(rng.choices("etaoinshrdlu", k=1_000_000)), "x" * 20_000
    for text in (plain, runs):
        ids, lengths = S.encode_texts(pa.array([text]), pieces)
        assert lengths.tolist() == [len(ids)] and "".join(pieces.bytes_of[i].decode() for i in ids.tolist()) == " " + text
    assert ids.tolist() == S.encode_text(runs, pieces)
    assert S.encode_texts(pa.array([plain[:3000]]), pieces)[0].tolist() == best_path(S.SPACE + plain[:3000], pieces)


def test_the_library_decodes_the_ids(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    for text in ("hello  world\n<s>", " a\tb é 漢 ", "no\r\nblank"):
        assert sp.decode(S.encode_text(text, pieces)) == text


def test_query_round_trips(docs, doc_rows, no_docs, pieces):
    got = S.encoding_query(docs).collect()
    assert len(got) == len(doc_rows) and all(r.round_trip for r in got)
    by_id = {r.doc_id: r.ids for r in got}
    assert by_id[150] is None and by_id[151] == [] and by_id[155] == S.encode_text("one", pieces)
    assert S.encoding_query(no_docs).count() == 0


def test_unknown_ids_are_an_error(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        S.decode(spark.createDataFrame([([99_999_999],)], "ids array<int>")).collect()
