"""Encoding by backtracking against the library, over plain, random and awkward texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from qpanel.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(pieces.MODEL)


def ids_of(own, text):
    return [own.begin, *np.frombuffer(own.encode(text), dtype="<u4").tolist(), own.end]


def same(own, library, text):
    want = library.encode(text, add_bos=True, add_eos=True)
    assert ids_of(own, text) == want, text[:200]
    assert own.decode(np.array(want, dtype="<u4").tobytes()).decode() == library.decode(want), text[:200]


AWKWARD = ["", " ", "  ", "▁", " ▁ ▁", "\n", "\t\n ", "a\0b", "<s></s><unk><0x41>", "\x7f\x80", "é", "é", "​‍﻿", "🇩🇪👩‍👩‍👧", "日本語の文章", "١٢٣", "x²³.", "²." * 30, "No.1,000.000", "CamelCaseHTTPServer2x", "ﬁ ﬃ", "ſ", "ǅ", "A̐éö̲", "��", "don't can’t", "�", "\U0010ffff"]


@pytest.mark.parametrize("text", AWKWARD)
def test_awkward_texts(own, library, text):
    for t in (text, "a" + text, text + " b", f" {text}{text} "):
        same(own, library, t)


def test_blanks_and_repeats_of_any_length(own, library):
    for n in range(66):
        for t in (" " * n, "a" + " " * n, " " * n + "the", "x" + " " * n + "y" + " " * n, "a" * n, "ab" * n, "é" * n, "\n" * n, "=" * n, "-_" * n):
            same(own, library, t)


@pytest.mark.parametrize("letters", ["abcdefghij etaoin  ", "日本語中文テスト абвгд é́​😀", "0123456789.,;- ()[]{}'\"", "    ▁▁ab\n\t", "inertheonreeninges ", "the and ing tion ed er re"], ids=range(6))
def test_random_texts(own, library, letters):
    rng = random.Random(letters)
    for _ in range(1500):
        same(own, library, "".join(rng.choice(letters) for _ in range(rng.randint(1, 60))))


def test_random_rows_of_pieces(own, library):
    rng, names = random.Random(3), list(own.number)
    for _ in range(4000):
        same(own, library, "".join(rng.choice(names) for _ in range(rng.randint(1, 12))))


def test_decoding_any_ids(own, library):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 9))]
        assert own.decode(np.array(ids, dtype="<u4").tobytes()).decode() == library.decode(ids), ids


def test_neighbours_are_those_that_merging_leaves(own):
    rng, names = random.Random(5), [p for p in own.number if len(p) > 1]
    kinds = set()
    for _ in range(4000):
        a, b = rng.choice(names), rng.choice(names)
        left = own.merges(a + b)[0] == [a, b]
        assert own.together(a, b) == left, (a, b)
        kinds.add(left)
    assert kinds == {True, False}


def test_failed_places_are_met_and_left(own, library):
    """Texts in which the longest piece first is wrong, so that pieces are taken back."""
    rng, taken = random.Random(6), 0
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(4, 14))) for _ in range(3000)]
    for w in words:
        greedy, at = [], 0
        text = "▁" + w
        while at < len(text):
            n = max(n for n in range(1, len(text) - at + 1) if text[at : at + n] in own.made)
            greedy.append(text[at : at + n])
            at += n
        taken += own.split(text) != greedy
        same(own, library, w)
    assert taken > 300


def test_long_text_without_blanks(own, library):
    rng = random.Random(7)
    same(own, library, "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(60_000)))
    same(own, library, "a" * 60_000)


def test_full_memory_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(pieces, "CHUNKS", 5)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    small, rng = pieces.Pieces(pieces.MODEL), random.Random(8)
    for _ in range(300):
        same(small, library, " ".join("".join(rng.choice("aeioustr") for _ in range(rng.randint(1, 9))) for _ in range(8)))


def test_query_over_edge_rows(spark, make, edge, library):
    rows = [*edge, edge[3], edge[3]]
    df = pieces.round_trips(make(rows).repartition(3))
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect()) == sorted(want)
    assert pieces.round_trips(make([])).collect() == []


def test_ids_and_texts_as_columns(spark, make, edge, library):
    coded = pieces.encoded(make(edge))
    for r in coded.collect():
        text = dict(edge)[r["doc_id"]]
        assert r["ids"] == library.encode(text or "", add_bos=True, add_eos=True)
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(coded).collect()}
    assert back == {i: t or "" for i, t in edge}
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in pieces.decoded(nothing).collect()] == ["", ""]
    assert pieces.encoded(make([(1, "ab")]), ends=False).first()["ids"] == library.encode("ab")


def test_bytes_that_are_no_characters(spark, library):
    df = spark.createDataFrame([(1, bytearray(b"a\xff\xc3b"))], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) as text")
    ids = library.encode("a��b", add_bos=True, add_eos=True)
    assert pieces.encoded(df).first()["ids"] == ids
