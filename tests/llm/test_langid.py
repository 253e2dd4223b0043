from __future__ import annotations

import zlib

import numpy as np

from pickwell.llm import langid


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(0, 6, 4)
        scores = rng.normal(0, 2, (int(lengths.sum()), 3)).astype(np.float32)
        labels, at = langid.viterbi(scores, lengths, 1.5), 0
        for n in lengths:
            own = scores[at : at + n]

            def worth(path, own=own):
                return sum(own[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))

            best = max((worth(p) for p in np.ndindex(*[3] * int(n))), default=0)
            assert np.isclose(worth(labels[at : at + n].tolist()), best, atol=1e-4)
            at += n


def test_language_of_whole_texts(docs, doc_rows):
    got = langid.language_query(docs).collect()
    assert len(got) == len(doc_rows)
    truth = {i: (text, lang) for i, text, lang, *_ in doc_rows}
    right = []
    for r in got:
        text, lang = truth[r.doc_id]
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score, r.lang_spans) == ("und", 0.0, r.lang_spans) and not any(s.letters for s in r.lang_spans)
        elif r.held_out and r.doc_id < 150 and "very same" not in text:
            right.append(r.lang_pred == lang)
    assert np.mean(right) > 0.9


def test_spans_of_a_mixed_text(docs, spark):
    model = langid.learn(docs)
    text = "the water of the house and with therness waterly " * 3 + "über der haus und wasserung schaft einkeit " * 3 + "дом вода крание приова лес на "
    row = langid.identify(spark.createDataFrame([(text, "kept", 1)], "text string, lang string, lang_pred int"), model).first()
    assert [s.lang for s in row.lang_spans] == ["en", "de", "ru"]
    assert row.lang == "kept" and sum(s.words for s in row.lang_spans) == len(text.split())


def test_nothing_to_learn_from(no_docs, docs):
    model = langid.learn(no_docs)
    assert {r.lang_pred for r in langid.identify(docs, model).select("lang_pred").collect()} == {"und"}
    assert langid.language_query(no_docs).count() == 0
