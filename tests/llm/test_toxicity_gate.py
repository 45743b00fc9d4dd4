"""Hidden words at a token's end, with doubled letters, in mixed runs and in long tokens are decoded."""

from __future__ import annotations

import numpy as np
import pytest

from qpanel.llm import toxicity


@pytest.fixture(scope="module")
def reader():
    data = (b"  you are all worthless scum and idiot people in this town  " * 50)
    c = toxicity.letter_codes()[np.frombuffer(data, dtype=np.uint8)]
    n = toxicity.SIZE
    return toxicity.Reader(np.bincount(c[:-2] * n * n + c[1:-1] * n + c[2:], minlength=n**3).astype(float))


@pytest.mark.parametrize("hidden, word", [("idio7", "idiot"), ("idio+", "idiot"), ("scuum", "scum"), ("iddiot", "idiot"), ("i d 1 o t", "idiot"), ("1d10+", "idiot"), ("y o u a r e a l l w o r t h l e s s p e o p l e i n t h i s t o w n", "youareallworthlesspeopleinthistown"), ("worthless-" * 8 + "1d1ot", "idiot"), ("(town)(1diot)", "idiot")])
def test_hidden_words(reader, hidden, word):
    features, runs = reader.of(f"calm {hidden} calm")
    assert word in features


def test_long_tokens_are_read_in_linear_time(reader):
    assert len(reader.decoder.search("a1" * 20_000, False)) > 20_000


def test_long_runs_and_wide_gaps(reader):
    evidence = toxicity.Evidence({"zorgblat": (20, 0), "calm": (5, 100)}, 0.1)
    calm = evidence.of(*reader.of("calm and quiet"))[0]
    sentence = " ".join("youareatotalworthless") + " z o r g b l a t"
    for hidden in (sentence, "z  o   r g\nb l  a t", "very-long-hyphenated-" * 9 + "z0rgblat-token", "z" * 50 + "0rgblat", "Z.O.R.G.B.L.A.T"):
        assert evidence.of(*reader.of(f"calm {hidden} calm"))[0] > calm + 1, hidden


def slow_reading(decoder, token):
    """The least costly reading of all, each of them spelled out; a reading as one word."""
    import itertools

    options = []
    for k, ch in enumerate(token):
        o = []
        if ch.isalpha():
            o.append((ch, 0.0))
            if k and token[k - 1] == ch:
                o.append(("", toxicity.REPEAT))
        o += [(x, toxicity.SUBSTITUTE) for x in toxicity.LEET.get(ch, "")]
        if ch in toxicity.SEPARATORS or not o:
            o.append(("", toxicity.SEPARATOR))
        options.append(o)
    best = (1e9, "")
    for reading in itertools.product(*options):
        letters = [x for x, _ in reading if x]
        codes = [toxicity.END, toxicity.END, *[decoder.codes.get(x, toxicity.ELSE) for x in letters], toxicity.END]
        total = sum(e for _, e in reading) + sum(decoder.cost[codes[i], codes[i + 1], codes[i + 2]] for i in range(len(codes) - 2))
        best = min(best, (total, "".join(letters)))
    return best[1]


@pytest.mark.parametrize("token", ["1d1ot", "sc|_|m", "w.0.r.th1ess", "peeople", "a$$!!", "w0r1d", "t-o-w-n", "éé1", "((", "y00uu"])
def test_viterbi_is_the_search_of_all_readings(reader, token):
    assert reader.decoder.search(token, False) == slow_reading(reader.decoder, token)
