import os
import random

import numpy as np
import pytest

from factloom.llm.sentencepiece import MODEL, Vocabulary
from factloom.llm import sentencepiece as S

PIECES = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "▁▁", "é", "cab"]
SCORES = [0.0] * 257 + [-3.1, -2.2, -2.3, -2.9, -2.0, -3.3, -3.9, -4.4, -3.0, -2.7, -5.1, -4.9]
TEXTS = ["", None, "a", "abc abcab", "  ab  c ", "xyé🦊", "a\nb\tc\x00", "▁", "a▁ b▁▁", "▁ a", " ", "abcabcabc" * 50, "é" * 3000]


def small():
    return S.Vocabulary.build(PIECES, SCORES, set(range(257)), {b: b + 1 for b in range(256)})


def brute(v, word):
    """The best score of a word by plain dynamic programming over strings."""
    table = dict(zip(PIECES[257:], SCORES[257:]))
    best = [0.0] + [-1e18] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            s = table.get(word[start:end], v.unknown if end - start == 1 else None)
            if s is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


def test_viterbi_equals_brute_force():
    v, rng = small(), random.Random(1)
    words = list({"".join(rng.choices("abcé", k=rng.randint(1, 12))) for _ in range(300)})
    score = dict(zip(range(257, len(PIECES)), SCORES[257:]))
    for word, ids in zip(words, v.segment(words), strict=True):
        got = sum(score.get(int(i), 0.0) for i in ids)
        assert "".join(PIECES[i] for i in ids if i >= 257) == word
        assert np.isclose(got, brute(v, word))


def test_whole_texts_equal_unsplit_segmentation():
    v = small()
    for text in ("ab ab  abc", "cab ab", "abc  ab a"):
        whole = "▁" + text.replace(" ", "▁")
        ids = next(iter(v.encode([text])))
        score = dict(zip(range(257, len(PIECES)), SCORES[257:]))
        assert np.isclose(sum(score[int(i)] for i in ids), brute(v, whole))


@pytest.mark.parametrize("slice_size", [8_000_000, 5])
def test_round_trip(monkeypatch, slice_size):
    monkeypatch.setattr(S, "SLICE", slice_size)
    monkeypatch.setattr(S, "REMEMBERED", 3 if slice_size == 5 else 400_000)
    v = small()
    back = v.decoder()
    assert [back(ids).decode() for ids in v.encode(TEXTS)] == [t or "" for t in TEXTS]


@pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no public piece file")
def test_public_model_and_columns(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", "y"), (2, "a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = S.encode(docs)
    got = encoded.collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert all(len(r.ids) == r.n_pieces for r in got)
    assert sorted((-1 if r.id is None else r.id, r.text) for r in S.decode(encoded).collect()) == sorted((i if i is not None else -1, t or "") for i, t, _ in rows)
    assert S.encode(docs.limit(0)).count() == 0
    v = S.Vocabulary.load()
    assert v.pieces[next(iter(v.encode(["Hello  world"])))[0]] == "▁Hello"


def test_broken_vocabularies():
    with pytest.raises(ValueError):
        S.Vocabulary.build([*PIECES, "a"], [*SCORES, -1.0], set(range(257)), {b: b + 1 for b in range(256)})
    with pytest.raises(ValueError):
        S.Vocabulary.build([*PIECES, "a▁b"], [*SCORES, -1.0], set(range(257)), {b: b + 1 for b in range(256)})


def test_long_words_of_unknown_characters_take_linear_time():
    import time

    vocabulary = Vocabulary.load()
    took = []
    for n in (50_000, 200_000):
        text = "\U000f0000" * n
        began = time.perf_counter()
        (ids,) = vocabulary.encode([text])
        took.append(time.perf_counter() - began)
        assert vocabulary.decoder()(ids).decode() == text
    assert took[1] < 10 * took[0] + 1


def test_merges_give_the_librarys_ids():
    """Every text of the driver's smallest table, and edges: the ids of the published tokenizer. The library drops spaces at
    the ends and joins runs of them, which encode() keeps, so texts are compared where it does neither."""
    import os

    import pyarrow.parquet as pq
    import sentencepiece

    path = "/root/testdata/sf0.001/documents.parquet"
    texts = ["the quick brown fox", "hello", "é ü 🦊", "x" * 500, "a" * 64, "a" * 65, "streaming analytics 12345", "Ünïcödé\U000f0000 end"]
    texts += [t for t in pq.read_table(path)["text"].to_pylist() if t] if os.path.exists(path) else []
    own, library = Vocabulary.load(merges=True), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = [t for t in texts if library.decode(library.encode(t)) == t]
    assert len(plain) > 0.9 * len(texts)
    for t, ids in zip(plain, own.encode(plain), strict=True):
        assert ids.tolist() == library.encode(t)
    decode = own.decoder()
    assert all(decode(ids).decode() == t for t, ids in zip(texts, own.encode(texts), strict=True))
