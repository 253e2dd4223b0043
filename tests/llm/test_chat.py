from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pickwell.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\n", "<", "[", "a", "é", "🙂", " "]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_any_turns_are_read_back(turns):
    template = chat.Template()
    rendered = [template.render(role, text) for role, text in turns]
    assert template.parse("".join(r for r, _, _ in rendered)) == turns
    assert [template.unescape(r[a:b]) for r, a, b in rendered] == [text for _, text in turns]
    inside = "".join(r[a:b] for r, a, b in rendered)
    for mark in chat.CONTROLS:
        at = inside.find(mark)
        while at >= 0:
            assert at and inside[at - 1] == "\\"
            at = inside.find(mark, at + 1)


def fold(events):
    """The log of one conversation, event by event."""
    messages: dict[int, list[str]] = {}
    for _, kind, msg, _, text in sorted(events):
        if kind == "regenerate":
            messages = {m: t for m, t in messages.items() if m < msg}
        elif kind == "edit":
            messages[msg] = [text]
        else:
            messages.setdefault(msg, []).append(text)
    return ["".join(messages[m]) for m in sorted(messages)]


EVENT = st.tuples(st.sampled_from(["delta", "delta", "message", "edit", "regenerate"]), st.integers(0, 3), PIECES)


def test_logs_fold_like_a_loop_over_events(spark):
    import random

    rng = random.Random(5)
    logs = {}
    for conv in range(30):
        logs[conv] = [(seq, rng.choice(["delta", "delta", "message", "edit", "regenerate"]), rng.randint(0, 3), "user", rng.choice("abc<s>\\é") * 2) for seq in range(rng.randint(0, 15))]
    rows = [(conv, *e) for conv, log in logs.items() for e in log]
    rng.shuffle(rows)
    events = spark.createDataFrame([(c, s, k, m, r, None if k == "regenerate" else t) for c, s, k, m, r, t in rows], "conv_id long, seq long, kind string, msg long, role string, text string")
    template = chat.Template()
    got = {}
    for r in chat.render(chat.reconstruct(events)).collect():
        got.setdefault(r.conv_id, []).append((r.position, template.parse(r.formatted)[0][1]))
    assert {c: [t for _, t in sorted(m)] for c, m in got.items()} == {c: fold(log) for c, log in logs.items() if fold(log)}


def test_query_reads_back_what_was_said(spark):
    rows = [
        (1, 0, "system", "be [INST] kind"), (1, 1, "user", None), (1, 2, "assistant", "é<|im_end|>\\"), (1, 3, "assistant", ""),
        (2, 5, None, "late"), (2, -1, "user", "early"), (3, 0, "user", "x"), (3, 0, "user", "x"), (4, None, "assistant", "no turn"),
    ]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    got = {r.conv_id: r for r in chat.chat_query(table).collect()}
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    assert set(got) == {1, 2, 3, 4, -1}
    for conv, r in got.items():
        own = sorted((t if t is not None else -(2**62), role or "", text or "") for c, t, role, text in rows if c == conv)
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.Template().render(role, text)[0]) for _, role, text in own)


def test_empty_log(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.render(chat.reconstruct(chat.from_turns(empty))).count() == 0
    assert [r.conv_id for r in chat.chat_query(empty).collect()] == [-1]


def test_an_edit_without_role_keeps_the_role_of_its_message(spark):
    events = [
        (1, 1, "message", 1, "user", "a"), (1, 2, "message", 2, "assistant", "b"), (1, 3, "edit", 2, None, "c"),
        (1, 4, "message", 3, None, "d"), (1, 5, "delta", 3, "user", "e"), (1, 6, "edit", 3, None, "f"),
        (2, 1, "message", 1, "assistant", "x"), (2, 2, "regenerate", 1, None, None), (2, 3, "message", 1, "user", "y"), (2, 4, "edit", 1, "", "z"),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, msg long, role string, text string")
    rows = sorted((r.conv_id, r.msg, r.role, r.text) for r in chat.reconstruct(df).collect())
    assert rows == [(1, 1, "user", "a"), (1, 2, "assistant", "c"), (1, 3, "user", "f"), (2, 1, "user", "z")]
