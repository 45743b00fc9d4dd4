"""Each operator against a brute-force version, and its results for nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from qpanel.llm import components, exact_dedup, language, licenses, mixing, packing, quality, simhash, suffix_dedup, tokens, toxicity
from qpanel.llm.shared import WORD

WS = " \t\n\x0b\x0c\r"


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# op1
def test_licenses_rules(make, edge):
    first, second = licenses.MIT_GRANT, licenses.MIT_NOTICE
    docs = [*edge, (20, "Text. Licensed under the Apache License, Version 2.0.\nmore"), (21, f"x\n\n{first}\n\n{second}"), (22, f"{second} {first}"), (23, "Released under the MIT License. Licensed under CC BY-NC 4.0."), (24, "not licensed under anything"), (25, "// SPDX-License-Identifier: MPL-2.0\nint x;"), (26, "a mit license, spdx")]
    got = rows(licenses.scanned(make(docs)))
    number = {s: licenses.SENTENCES[licenses.cut(s)[0]] for s in (first, second)}
    assert len(got) == len({d[0] for d in docs})
    assert got[20]["license"] == "Apache-2.0" and got[20]["n_known"] == 1
    assert got[21]["license"] == "MIT" and got[21]["sentence_ids"] == f"{number[first]},{number[second]}"
    assert got[22]["license"] is None and got[22]["sentence_ids"] == f"{number[second]},{number[first]}"  # order matters
    assert got[23]["licenses"] == "MIT,CC-BY-NC-4.0" and got[25]["license"] == "MPL-2.0" and got[26]["license"] is None
    assert got[24]["licenses"] == "" and got[1]["n_sentences"] == 0 and got[2]["n_sentences"] == 0
    assert licenses.scanned(make([])).count() == 0


def test_licenses_wrapped_texts(make):
    """Each rule's wording, wrapped at 72 columns, bare and behind comment prefixes, amid other text."""
    import textwrap

    texts = [(name, parts) for name, parts in licenses.TEXTS]
    docs = []
    for k, (_, parts) in enumerate(texts):
        wrapped = "\n\n".join(textwrap.fill(f"{n + 1}. {p}" if len(parts) > 2 and n else p, 72) for n, p in enumerate(parts))
        for j, prefix in enumerate(("", "# ", " * ", "//  ")):
            body = "\n".join(prefix + line for line in f"Copyright (c) 2020 Someone\n\n{wrapped}\n\nTHE REST IS OTHER TEXT".split("\n"))
            docs.append((10 * k + j, ("/*\n" if j == 2 else "") + body + "\ncode = 1;\n"))
    got = rows(licenses.scanned(make(docs)))
    missed = [(texts[i // 10][0], i % 10, r["license"]) for i, r in got.items() if texts[i // 10][0] not in r["licenses"].split(",")]
    assert not missed


def test_licenses_of_very_many_sentences(make):
    many = f"{licenses.MIT_GRANT} " + "All rights reserved.\n" * 50_000
    got = rows(licenses.scanned(make([(1, many), (2, many + licenses.MIT_NOTICE), (3, licenses.BSD_GRANT + " x. " + (licenses.BSD_SOURCE + "\n") * 20_000)])))
    assert got[1]["n_known"] == 50_001 and got[1]["license"] == "LicenseRef-AllRightsReserved"
    assert got[2]["licenses"] == "MIT,LicenseRef-AllRightsReserved" and got[3]["license"] is None


def slow_rules(ids):
    def fits(rule):
        it = iter(ids)
        return all(x in it for x in rule)

    def alone():
        left = list(ids)
        for at in [k for k, x in enumerate(ids) if x in licenses.BEYOND]:
            taken, k = [], 0
            for x in licenses.BASE:
                while k < at and left[k] != x:
                    k += 1
                taken.append(k)
                k += 1
            if taken[-1] < at:
                for k in taken:
                    left[k] = None
        it = iter(left)
        return all(x in it for x in licenses.BASE)

    return list(dict.fromkeys(name for name, rule in licenses.RULES if fits(rule) and (rule != licenses.BASE or alone())))


def slow_ids(text):
    """Identifiers of the sentences of texts without tags' expressions or named slots, statements within longer sentences included."""
    out = []
    for s in licenses.cut(text):
        found = [s] if s in licenses.SENTENCES else [known for p, known in licenses.PHRASES if p in s and f"not {p}" not in s]
        if s not in licenses.SENTENCES:
            found = [known for end, most, known in licenses.SLOTS if s.endswith(end) and len(s) <= most][:1] or found
        out += [licenses.SENTENCES[x] for x in dict.fromkeys(found)]
    return out


def test_licenses_brute_force_and_sql(make):
    import duckdb

    rng = random.Random(3)
    pool = [p for _, parts in licenses.TEXTS for p in parts] + ["SPDX-License-Identifier: ISC\n", "Other words; and more:", "x"]
    docs = [(k, rng.choice([" ", "\n", "\n\n", "\r\n# "]).join(rng.choices(pool, k=rng.randint(0, 9)))) for k in range(200)] + [(900, None)]
    got = rows(licenses.scanned(make(docs)))
    for i, t in docs:
        ids = slow_ids(t or "")
        assert got[i]["sentence_ids"] == ",".join(map(str, ids)) and got[i]["licenses"] == ",".join(slow_rules(ids)), t
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert sorted(con.execute(licenses.oracle()).fetchall()) == sorted(tuple(r) for r in got.values())


# op2
SYLLABLES = {"aa": "ba ke lu mo ri", "bb": "xyo qua zhi wre jek", "cc": "ßen öde ülm ärg och"}


def languages(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        out.append((i, " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang, "s"))
    return out


def test_language_held_out(make, edge):
    docs = languages(240)
    got = rows(language.predicted(make([*docs, *[(1000 + (k or 500), t) for k, t in edge]])))
    held = [d for d in docs if got[d[0]]["held_out"]]
    assert held and all((zlib.crc32(str(d[0]).encode()) % 4 == 2) == got[d[0]]["held_out"] for d in docs)
    assert np.mean([got[d[0]]["lang_pred"] == d[2] for d in held]) > 0.97
    assert {r["lang_pred"] for r in got.values()} <= {*SYLLABLES, "und"} and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1001]["lang_pred"] == got[1002]["lang_pred"] == got[1003]["lang_pred"] == "und"


def test_language_does_not_see_held_out_labels(make):
    docs = languages(200)
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in docs]
    a, b = rows(language.predicted(make(docs))), rows(language.predicted(make(swapped)))
    assert {k: tuple(v) for k, v in a.items()} == {k: tuple(v) for k, v in b.items()}


def test_kernel_is_that_of_presence():
    p = language.Presence()
    x, y = p.of("banana tree"), p.of("a banana")
    k = language.kernel(np.array([x], np.float32), np.array([y], np.float32))[0, 0]
    assert k == pytest.approx((x & y).sum() / math.sqrt(x.sum() * y.sum()), rel=1e-6)
    assert p.of("12 34 !") is None


def slow_regressions(docs, test):
    """Ridge regression in the space of all n-grams, one language against the rest; the language of each test text."""
    presence = language.Presence()
    unit = lambda t: (lambda r: r / math.sqrt(max(r.sum(), 1)))(presence.of(t).astype(float))
    names = sorted({lang for _, _, lang, _ in docs})
    x = np.array([unit(t) for _, t, _, _ in docs])
    w = np.array([len(docs) / (len(names) * sum(d[2] == lang for d in docs)) for _, _, lang, _ in docs])
    c = x.mean(axis=0)
    xc = x - c
    gram = (xc * w[:, None]) @ xc.T  # the solution lies in the span of the rows
    scores = []
    for name in names:
        y = np.array([1.0 if d[2] == name else -1.0 for d in docs])
        level = (w * y).mean()
        alpha = np.linalg.solve(gram + language.RIDGE * len(docs) * np.eye(len(docs)), w * (y - level))
        scores.append([level + (unit(t) - c) @ (xc.T @ alpha) for t in test])
    return names, np.array(scores).T


def test_language_is_kernel_ridge_regression(make, monkeypatch):
    """With all of the sample as landmarks the scores are those of regressions on the n-grams themselves."""
    monkeypatch.setattr(language, "LANDMARKS", 10_000)
    monkeypatch.setattr(language, "MOST_LANDMARKS", 10_000)
    monkeypatch.setattr(language, "PER_LANGUAGE", 1_000_003)
    monkeypatch.setattr(language, "SAMPLE", 10**9)
    docs = languages(60)
    model = language.trained(make(docs), "doc_id", "text", "lang")
    learned = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 != 2]
    names, want = slow_regressions(learned, [t for _, t, _, _ in docs])
    assert model[0] == names and len(model[1]) == len({t for _, t, _, _ in learned})
    presence = language.Presence()
    rows_ = np.array([presence.of(t) for _, t, _, _ in docs]).astype(np.float32)
    got = language.kernel(rows_, np.unpackbits(model[1], axis=1, count=language.WIDTH).astype(np.float32)) @ model[2] + model[3]
    assert (got.argmax(axis=1) == want.argmax(axis=1)).all() and np.abs(got - want).max() < 0.02


def test_language_every_language_is_learned(make, monkeypatch):
    """Null and repeated ids, and more languages than the sample has rows for."""
    rng = random.Random(2)
    docs = [(None if k % 2 else 7, " ".join("".join(rng.choices(lang * 3 + "aeiou", k=5)) for _ in range(20)), lang * 2, "s") for k in range(600) for lang in [chr(97 + k % 3 * 7)]]
    monkeypatch.setattr(language, "PER_LANGUAGE", 20)
    got = language.predicted(make([d for d in docs if zlib.crc32(b"7") % 4 != 2 or d[0] is None])).collect()
    assert {r["lang_pred"] for r in got} == {"aa", "hh", "oo"}
    many = [(k, " ".join("".join(rng.choices(chr(0x4E00 + k % 100) + "aeiou", k=6)) for _ in range(30)), f"l{k % 100:03}", "s") for k in range(800)]
    monkeypatch.setattr(language, "SAMPLE", 250)
    names = language.trained(make(many), "doc_id", "text", "lang")[0]
    assert len(names) == 100
    pred = rows(language.predicted(make(many)))
    assert np.mean([pred[d[0]]["lang_pred"] == d[2] for d in many]) > 0.9


def test_language_nothing_to_learn(make):
    got = rows(language.predicted(make([(1, "abc"), (2, None)])))
    assert got[1]["lang_pred"] == "und" and got[1]["score"] == 0 and got[2]["score"] == 1
    assert language.predicted(make([])).count() == 0


# op3
def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans(dict.fromkeys(WS, " "))).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            bits[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(shingles))


def slow_components(fps):
    ids = sorted(fps, key=lambda i: (i is None, i))
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                if x != y:
                    low, high = sorted((x, y), key=lambda i: (i is None, i))
                    parent[high] = low
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("most", [50_000, 2])
def test_simhash_brute_force(make, prose, edge, most):
    rng = random.Random(3)
    docs = [*edge]
    for k in range(40):
        words = prose(300, k).split()
        docs.append((100 + k, " ".join(words)))
        for j in range(rng.randint(0, 3)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = f"edit{j}"
            docs.append((1000 + 10 * k + j, "\n".join(copy).upper() if j == 1 else " ".join(copy)))
    got = rows(simhash.near_duplicates(make(docs), most_in_pair=most))
    fps = {i: slow_fingerprint(t) for i, t in docs}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps and all(len(r["fingerprint"]) == 16 for r in got.values())
    assert {i: r["component_id"] for i, r in got.items()} == slow_components(fps)
    assert len(set(slow_components(fps).values())) < len(fps)


def test_simhash_empty_and_pipeline_rows(make, spark):
    assert simhash.near_duplicates(make([])).count() == 0 and simhash.kept_rows(make([])).count() == 0
    docs = make([(2, "a b c d"), (1, "a b c d"), (3, "other words entirely here"), (1, "a b c d"), (None, "a b c d"), (4, None), (5, "")])
    clashing = docs.selectExpr("*", "1 AS _away", "2 AS _stays", "3 AS _row", "4 AS _id", "6 AS component_id")
    kept = simhash.kept_rows(clashing)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 3, 4] and kept.columns == clashing.columns


def test_simhash_hot_fingerprints_are_dealt(make, spark):
    from qpanel.llm.shared import spread_join

    many = spark.createDataFrame([("h", k) for k in range(50)] + [("c", 99)], "k string, v long")
    one = spark.createDataFrame([("h", 1), ("c", 2), ("x", 3)], "k string, w long")
    got = spread_join(many, one, "k", most=7).collect()
    assert sorted((r["k"], r["v"], r["w"]) for r in got) == sorted([("h", k, 1) for k in range(50)] + [("c", 99, 2)])


def distances(prints):
    bits = np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1), axis=1).astype(np.int32)
    return bits @ (1 - bits.T) + (1 - bits) @ bits.T


def least_members(linked):
    """The smallest member of each component of a matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked | np.eye(len(linked), dtype=bool), label[None, :], len(linked)).min(axis=1)
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("budget, words", [(3, 1), (9, 1), (38, 4)])
def test_forest_is_that_of_all_pairs(budget, words):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, (30, words), dtype=np.uint64)
    prints = np.repeat(centres, 20, axis=0)
    for k in range(len(prints)):
        for _ in range(int(rng.integers(0, budget))):
            prints[k, rng.integers(words)] ^= np.uint64(1) << rng.integers(0, 48, dtype=np.uint64)
    prints = np.unique(prints, axis=0)
    zeros = np.zeros(len(prints), np.int64)
    forest = simhash.Forest(zeros, zeros, prints[:, 0] & np.uint64(2**48 - 1), prints, budget, 48)
    got = np.arange(len(prints))
    child, root = forest.edges()
    linked = np.zeros((len(prints), len(prints)), bool)
    linked[child, root] = linked[root, child] = True
    got = least_members(linked)
    agree = np.ones((len(prints), len(prints)), bool)
    assert (got == least_members((distances([p.astype(">u8").tobytes() for p in prints]) <= budget) & agree)).all()


def edited(words, edits, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"new{rng.random()}"
    return out


def similar_texts(prose):
    """Texts with copies on both sides of the threshold, a large group, a common line, and edges."""
    rng, texts = random.Random(4), {}
    for k in range(60):
        words = prose(rng.randint(100, 400), k, 3000).split()
        texts[k] = " ".join(words)
        for e in range(3):
            texts[100 * (e + 1) + k] = " ".join(edited(words, rng.randint(1, max(1, len(words) // 35)), rng))
    for k in range(80):
        texts[1000 + k] = " ".join(edited(texts[0].split(), 1, rng))
        texts[2000 + k] = "the same line of ten words in all of these " + prose(rng.randint(60, 90), 500 + k, 3000)
    return texts | {3000: None, 3001: "", 3002: "a b", 3003: "A  b", 3004: "a b c"}


def slow_similar(texts, scheme):
    """Classes over fingerprints within the budget that agree on a leading block."""
    ids = sorted(texts)
    prints = [simhash.fingerprint((texts[i] or "").encode(), scheme) for i in ids]
    bits = np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(len(ids), -1), axis=1)
    near = distances(prints) <= scheme.budget
    lead = np.zeros_like(near)
    for t in range(scheme.turns):
        block = bits[:, scheme.lead * t : scheme.lead * (t + 1)]
        lead |= (block[:, None, :] == block[None, :, :]).all(axis=2)
    label = least_members(near & lead)
    return {i: ids[label[k]] for k, i in enumerate(ids)}


@pytest.mark.parametrize("most", [50_000, 20])
def test_similar_scheme_brute_force(make, prose, most):
    texts = similar_texts(prose)
    found = simhash.near_duplicates(make(list(texts.items())), scheme=simhash.SIMILAR, most_in_pair=most).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == slow_similar(texts, simhash.SIMILAR) and len(found) == len(texts)


def shingle_set(text, width=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def test_similar_scheme_finds_jaccard_links(prose):
    """Recall of pairs by their Jaccard similarity of five-word shingles, and no class of unlike texts."""
    texts = similar_texts(prose)
    sets, classes = {i: shingle_set(t) for i, t in texts.items()}, slow_similar(texts, simhash.SIMILAR)
    ids, found = sorted(texts), defaultdict(list)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            j = len(x & y) / len(x | y) if x | y else 1.0
            found["over 0.85" if j >= 0.85 else "over 0.8" if j >= 0.8 else "under 0.5" if j < 0.5 else "between"].append(classes[a] == classes[b])
    assert np.mean(found["over 0.85"]) > 0.99 and np.mean(found["over 0.8"]) >= 0.9 and np.mean(found["under 0.5"]) == 0, {k: np.mean(v) for k, v in found.items()}


def test_rows_of_a_split_count_for_the_tasks(spark, monkeypatch):
    """Fingerprints with one leading block: a split makes more rows, and there are tasks enough for them."""
    rng = np.random.default_rng(1)
    prints = [(bytearray(b"\x12\x34" + rng.bytes(6)),) for _ in range(400)]
    fps = spark.createDataFrame(prints, "fp binary")
    monkeypatch.setattr(simhash, "TASK_ROWS", 500)
    plan = simhash.links(fps, simhash.QUERY, 50)
    split = simhash.links(fps, simhash.QUERY, 1_000_000)
    assert split.rdd.getNumPartitions() == 4 and plan.rdd.getNumPartitions() > 20
    assert plan.count() == split.count() == 0


def test_components_of_chains(spark):
    edges = [(i + 1, i) for i in range(60) if i % 20 != 19] + [(200, 3), (200, 45)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[19] == 0 and got[39] == 20 and got[45] == got[200] == got[59] == 0 and got[40] == 0
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# op4
def slow_suffix(docs, t=200):
    seen = Counter()
    data = [(i, (x or "").encode()) for i, x in docs]
    for _, b in data:
        seen.update(b[k : k + t] for k in range(len(b) - t + 1))
    out = []
    for i, b in data:
        covered = bytearray(len(b))
        for k in range(len(b) - t + 1):
            if seen[b[k : k + t]] > 1:
                covered[k : k + t] = b"\1" * t
        spans = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_brute_force(make, prose, edge):
    passage = prose(70, 99)
    docs = [*edge, (20, passage), (21, prose(80, 1) + passage + prose(30, 2)), (22, prose(5, 3) + passage[:199]), (23, passage[:200]), (24, passage[100:] + prose(50, 4)), (25, "ab" * 400), (26, prose(300, 5)), (27, prose(300, 5)), (27, prose(300, 5)), (28, prose(100, 6) + "x" + prose(100, 7)), (29, prose(100, 6) + "y" + prose(100, 7)), (30, "é" * 250)]
    got = suffix_dedup.repeated_strings(make(docs))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == slow_suffix(docs)
    assert suffix_dedup.repeated_strings(make([])).count() == 0


def test_suffix_blocks_and_chunks_do_not_matter(make, prose, monkeypatch):
    docs = [(k, prose(400, k % 7) + prose(200, k)) for k in range(30)]
    want = sorted((tuple(r) for r in suffix_dedup.repeated_strings(make(docs)).collect()), key=repr)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 10_000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    assert sorted((tuple(r) for r in suffix_dedup.repeated_strings(make(docs)).collect()), key=repr) == want == slow_suffix(docs)


def test_suffix_colliding_fingerprints_do_not_matter(make, prose, monkeypatch):
    """With a fingerprint that is the same for all strings, and with one of two values, bytes still decide."""
    docs = [(k, prose(60, k % 5) + prose(60, k) + prose(60, 100 + k % 3)) for k in range(12)] + [(50, "a" * 200), (51, "b" * 200)]
    want = slow_suffix(docs)
    for table in (np.zeros(256, np.uint64), (np.arange(256) % 2).astype(np.uint64) << np.uint64(63)):
        monkeypatch.setattr(suffix_dedup, "BYTES", table)
        assert sorted((tuple(r) for r in suffix_dedup.repeated_strings(make(docs)).collect()), key=repr) == want


def test_suffix_repeated_rows_are_dealt_out(spark, make, prose, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 20_000)
    docs = [(None, prose(100, 1))] * 300 + [(k, prose(100, k)) for k in range(50)]
    df = make(docs).selectExpr("cast(doc_id as string) AS id", "text").coalesce(1)
    sizes = [r["count"] for r in df.mapInArrow(suffix_dedup.dealt_to(16), "chunk int, id string, text string").groupBy("chunk").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 80
    assert sorted((tuple(r) for r in suffix_dedup.repeated_strings(make(docs)).collect()), key=repr) == slow_suffix(docs)


# op5, op8
def library(text):
    from tokenizers import Tokenizer

    global _tokenizer
    try:
        t = _tokenizer
    except NameError:
        t = _tokenizer = Tokenizer.from_file(tokens.TOKENIZER)
    return t.encode(text or "", add_special_tokens=False).ids


def test_token_counts(make, prose, edge):
    docs = [*edge, *[(100 + k, prose(50, k) + random.Random(k).choice([".\nNext", "  two", "don't 12,3", "\n x", "ß€ 😀"])) for k in range(30)]]
    got = rows(tokens.token_counts(make(docs)))
    for i, t in docs:
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len((t or "").encode()), len(library(t))), t
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 1024)
    assert tokens.token_counts(make([])).count() == 0


def test_frequent_lengths_count_all_texts(make):
    docs = [(k, "start " + " ".join(["common"] * 5 + [f"w{k}"] * 2)) for k in range(50)] + [(50, "x" * 30_000 + " late" * 400)]
    df = make(docs)
    names, sizes = tokens.frequent_lengths(df, "text", tokens.TOKENIZER, tokens.RANKS, entries=2)
    assert names.split("\0") == [" late", " common"] and list(sizes) == [len(library(p)) for p in names.split("\0")]
    # few counters: rarer pieces are forgotten, frequent ones found all the same
    names, _ = tokens.frequent_lengths(df, "text", tokens.TOKENIZER, tokens.RANKS, entries=1, counters=8)
    assert names == " late"
    assert tokens.frequent_lengths(make([]), "text", tokens.TOKENIZER, tokens.RANKS) == ("", b"")


def test_encoder_is_the_library_on_random_strings():
    rng = random.Random(1)
    alphabet = [*"abcXYZ  \n'.,!0129", "'s", "'re", "<|endoftext|>", "é", "ß", "  ", "\t", "日", "😀", " ", "²", "̀", "\x85", "\x1c"]
    fast, plain = tokens.Encoder(tokens.TOKENIZER, tokens.RANKS), tokens.Encoder(tokens.TOKENIZER, None, {})
    for _ in range(3000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 25)))
        want = library(t)
        assert np.frombuffer(next(fast.each([t])), "<u4").tolist() == want == np.frombuffer(fast.ids(t), "<u4").tolist(), t
        assert next(plain.each([t])) == len(want), t


def test_every_kind_of_text_meets_the_table(monkeypatch):
    """Tabs, dashes, Cyrillic, wide blanks: pieces, not whole texts; with a cache that must forget all the time."""
    kinds = ["a\tb  c", "word — word", "слово и ещё слово", "x\r\ny  z", "“quoted” text…", "日本語 です", "a\u00a0b", "   \n\n  x   ", "don't  we'll\tgo", "1 234\u2009567", "\x01 a\x01b"]
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    lengths, ids = tokens.Encoder(tokens.TOKENIZER, tokens.RANKS, {tokens.MAPPED + "Ġword": 1, " word": 1}), tokens.Encoder(tokens.TOKENIZER, tokens.RANKS)
    for t in kinds * 2:
        assert lengths.pieces(t) is not None and len(lengths.pieces(t)) > 1
        assert next(lengths.each([t])) == len(library(t)), t
        assert np.frombuffer(next(ids.each([t])), "<u4").tolist() == library(t), t
        assert len(lengths.cache) <= 3 + 2 + len(lengths.pieces(t))
    assert list(lengths.each(kinds)) == [len(library(t)) for t in kinds]
    together = tokens.Encoder(tokens.TOKENIZER, tokens.RANKS, {})
    rng = random.Random(5)
    texts = ["".join(rng.choices([" ", "  ", "\t", "a", " b", "'s", "—", "\n", "д", "1", ".", "\r\n"], k=30)) for _ in range(300)]
    assert list(together.each(texts)) == [len(library(t)) for t in texts]
    assert lengths.pieces("a <|endoftext|> b") is None


def test_packing_round_trip(make, prose, edge):
    docs = [*edge, *[(100 + k, prose(random.Random(k).randint(1, 900), k)) for k in range(60)]]
    pieces = packing.packed(make(docs)).collect()
    ids = {i: [*library(t), 1] for i, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and p["doc_tokens"] == len(ids[p["doc_id"]])
    assert by_doc.keys() == ids.keys()
    for i, ps in by_doc.items():
        ps.sort(key=lambda p: p["start"])
        assert [p["start"] for p in ps] == np.cumsum([0, *[p["length"] for p in ps]])[:-1].tolist() and sum(p["length"] for p in ps) == len(ids[i])
    short = Counter()
    for sequence, ps in by_sequence.items():
        ps.sort(key=lambda p: p["offset"])
        total = sum(p["length"] for p in ps)
        assert [p["offset"] for p in ps] == np.cumsum([0, *[p["length"] for p in ps]])[:-1].tolist() and total <= 2048
        short[sequence >> 40] += total <= 2048 - 2 * packing.LEAST
    assert max(short.values()) <= 1  # one group in each partition, one short sequence in each group
    assert packing.packed(make([])).count() == 0


def test_packing_groups_and_balance(make):
    assert packing.packed(make([(k, "a b c") for k in range(50)]), group_tokens=16).selectExpr("sum(length)").first()[0] == 50 * 4
    rng = random.Random(2)
    lengths = [min(9000, int(rng.lognormvariate(5.5, 1.1)) + 1) for _ in range(3000)] + [2048, 4096, 2049]
    got = packing.balanced(lengths, 2048)
    # every id once, no sequence too long, one short one at most
    pieces = defaultdict(list)
    for s in got:
        assert s and sum(n for _, _, n in s) <= 2048
        for d, start, n in s:
            pieces[d].append((start, n))
    for d, ps in pieces.items():
        at = 0
        for start, n in sorted(ps):
            assert start == at and n > 0
            at += n
        assert at == lengths[d]
    assert len(pieces) == len(lengths) and sum(sum(n for _, _, n in s) <= 2048 - 2 * packing.LEAST for s in got) <= 1
    assert 2048 * len(got) - sum(lengths) < 2048 + 0.002 * sum(lengths)
    assert min(n for d, ps in pieces.items() for _, n in ps if lengths[d] >= 2 * packing.LEAST) >= packing.LEAST
    # cuts beyond those of documents over the limit: fewer than sequences, and few documents
    needed = sum(-(-n // 2048) for n in lengths)
    assert sum(map(len, pieces.values())) - needed < len(got)
    assert sum(len(ps) > 1 for d, ps in pieces.items() if lengths[d] <= 2048) < 0.02 * len(lengths)
    # the rule itself, each step a search of all sequences
    got = packing.balanced([n for n in lengths if n < 2048], 2048)
    rest = dict(enumerate(n for n in lengths if n < 2048))
    room = [2048] * (sum(rest.values()) // 2048) + [sum(rest.values()) % 2048]
    cost, want = [2048.0 - c for c in room], [set() for _ in room]
    for d in sorted(rest, key=lambda d: (-rest[d], d)):
        fits = [k for k in range(len(room)) if room[k] >= rest[d]]
        if fits:
            k = min(fits, key=lambda k: (cost[k], k))
            want[k].add(d)
            room[k], cost[k] = room[k] - rest[d], cost[k] + rest[d] + rest[d] ** 2 / 2048
    assert all(w <= {d for d, start, n in s if n == rest[d]} for w, s in zip(want, got)) and sum(map(len, want)) > 0.98 * len(rest)
    spread = np.std([sum(n + n * n / 2048 for _, _, n in s) for s in got[:-1]])
    dealt = [sum(n + n * n / 2048 for n in chunk) for chunk in np.array_split(list(rest.values()), len(room))]
    assert spread < np.std(dealt)  # better balanced than dealing documents as they come
    assert packing.balanced([], 2048) == [] and packing.balanced([2048], 2048) == [[(0, 0, 2048)]]


# op6
def test_exact_dedup_brute_force(make, edge, spark):
    docs = [*edge, *[(100 + k, f"text {k % 7}") for k in range(60)], (500, "Text 1"), (501, "text 1 "), (4, "one")]
    got = exact_dedup.content_sort(make(docs), keep="max").collect()
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    assert len(got) == len(docs) and sum(r["kept"] for r in got) == len(groups)
    for r in got:
        members = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        known = [m for m in members if m is not None]
        assert r["group_size"] == len(members) and r["keep_id"] == (max(known) if known else None) and r["doc_id"] in members
    assert exact_dedup.content_sort(make([])).count() == 0
    smallest = rows(exact_dedup.content_sort(make(docs), keep="min", normalise=lambda t: F.lower(F.trim(t))))
    assert smallest[500]["keep_id"] == smallest[501]["keep_id"] == 101


def test_exact_dedup_hot_groups(make):
    docs = [(k, "hot") for k in range(900)] + [(2000 + k, "warm") for k in range(500)] + [(5000 + k, f"cold {k}") for k in range(300)] + [(899, "hot"), (899, "hot")]
    got = exact_dedup.content_sort(make(docs), keep="max", carry=True).collect()
    assert len(got) == len(docs)
    kept = sorted(r["doc_id"] for r in got if r["kept"])
    assert kept == [899, 2499, *range(5000, 5300)]
    assert {r["group_size"] for r in got if r["keep_id"] == 899} == {902}
    assert all(r["_row"]["doc_id"] == r["doc_id"] and r["_row"]["votes"] == "y" for r in got)


def test_exact_dedup_hot_rows_without_ids(make):
    docs = [(None, "hot")] * 900 + [(7, "warm")] * 500 + [(5000 + k, f"cold {k}") for k in range(300)]
    df = exact_dedup.content_sort(make(docs).repartition(5), keep="max", carry=True)
    got = df.collect()
    assert len(got) == len(docs) and sum(r["kept"] for r in got) == 302
    assert [r["group_size"] for r in got if r["kept"] and r["text_sha256"] == hashlib.sha256(b"hot").hexdigest()] == [900]


def test_exact_dedup_hot_texts_beyond_the_broadcast(make, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_BYTES", 3)
    docs = [(k, "hot") for k in range(900)] + [(2000 + k, "warm") for k in range(500)] + [(5000 + k, f"cold {k}") for k in range(300)]
    got = exact_dedup.content_sort(make(docs), keep="max").collect()
    assert sorted(r["doc_id"] for r in got if r["kept"]) == [899, 2499, *range(5000, 5300)] and len(got) == len(docs)


# op7
def slow_measures(text):
    words = [w for w in (text or "").translate(str.maketrans(dict.fromkeys(WS, " "))).split(" ") if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            marked.update((i, i + 1, i + 2))
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(WS):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)]


def junk(prose, k):
    w = prose(120, k).split()
    return [" ".join(x + "***" for x in w), " ".join(x.upper() + "!!" for x in w), " | ".join(w)][k % 3]


def test_quality_brute_force(make, prose, edge):
    docs = [*edge, *[(100 + k, prose(random.Random(k).randint(60, 400), k, 3000).capitalize() + ".") for k in range(120)], *[(500 + k, junk(prose, k)) for k in range(24)], (900, "a b c d " * 30), (901, "line one two\nline one two\n" + prose(100, 7))]
    got = rows(quality.quality(make(docs)))
    for i, t in docs:
        r, want = got[i], slow_measures(t)
        assert [r[c] for c in quality.BASE] == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    assert all(got[100 + k]["kept"] for k in range(120)) and not any(got[500 + k]["kept"] for k in range(24))
    assert quality.quality(make([])).count() == 0
    kept = quality.kept_rows(make(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["kept"]) and kept.columns == make([]).columns
    assert quality.kept_rows(make([])).count() == 0


def test_em_learns_rule_accuracy():
    """Rules of unlike accuracy, one of them no better than chance: EM tells them apart, and beats both all-must-pass and a count of votes."""
    rng = random.Random(4)
    right_when = [(0.99, 0.7), (0.99, 0.8), (0.97, 0.6), (0.98, 0.9), (0.55, 0.5)]  # of good documents, of bad ones
    patterns, truth = Counter(), defaultdict(Counter)
    for _ in range(6000):
        good = rng.random() < 0.85
        p = "".join("-" if rng.random() < 0.1 else "gb"[(rng.random() < (g if good else b)) != good] for g, b in right_when)
        patterns[p] += 1
        truth[p][good] += 1

    def right(verdict):
        return sum(c for p, t in truth.items() for g, c in t.items() if verdict(p) == g) / 6000

    model = quality.Model(patterns)
    em = right(lambda p: model.posterior(p) >= 0.5)
    assert em > 0.97 and em > right(lambda p: "b" not in p) + 0.2 and em > right(lambda p: p.count("g") > p.count("b"))
    got = model.accuracies()
    want = [0.85 * g + 0.15 * b for g, b in right_when]
    assert all(abs(x - y) < 0.05 for x, y in zip(got, want)), (got, want)
    # one bad vote decides neither way by itself
    one = [p for p in patterns if p.count("b") == 1]
    assert {model.posterior(p) >= 0.5 for p in one} == {True, False}


def test_quality_posterior_replaces_all_must_pass(make, prose):
    """Good prose whose lines often have no end mark: that rule's bad votes are overruled, those of marks all over are not."""
    docs = []
    for k in range(300):
        text = prose(random.Random(k).randint(60, 300), k, 3000).capitalize()
        docs.append((k, text + ("" if k % 3 == 0 else ".")))
    docs += [(500 + k, junk(prose, k)) for k in range(30)]
    got = rows(quality.quality(make(docs)))
    overruled = [i for i, r in got.items() if "b" in r["votes"] and r["kept"]]
    assert len([i for i in overruled if i < 500]) >= 90 and all(got[k]["kept"] for k in range(300)) and not any(got[500 + k]["kept"] for k in range(30))


# op9
def toxic_docs(n=400):
    rng = random.Random(8)
    calm = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words, bad = [rng.choice(calm) for _ in range(rng.randint(20, 60))], rng.random() < 0.25
        if bad:
            for w in rng.sample(["zorgblat", "kwimpf", "dreckvod"], 2):
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_held_out_and_obfuscated(make, spark, edge):
    docs, labels = toxic_docs()
    hidden = ["z0rgbl4t", "kwiiiimpf", "d.r.e.c.k.v.o.d", "z o r g b l a t", "dr3ckv0d"]
    calm = docs[[y for _, y in labels].index(0)][1]
    more = [(2000 + k, f"{calm} {h} {calm}") for k, h in enumerate(hidden)] + [(3000, calm + " 12.50 v1.2 e-mail tooo")]
    got = rows(toxicity.scored(make([*docs, *more, *[(4000 + (i or 99), t) for i, t in edge]]), spark.createDataFrame(labels, "doc_id long, toxic int")))
    truth = dict(labels)
    held = [i for i in truth if got[i]["held_out"]]
    assert held and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    assert all(got[2000 + k]["predicted"] == 1 for k in range(len(hidden))), [got[2000 + k]["score"] for k in range(len(hidden))]
    assert got[3000]["predicted"] == 0 and got[4001]["predicted"] == 0 and got[4002]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def slow_toxicity(texts, labels, counts):
    """Scores by plain dictionaries: counts of features, the two strongest of a text, a logistic regression by gradient steps of scipy-free Newton."""
    reader = toxicity.Reader(counts)
    features = {i: reader.of(t or "") for i, t in texts.items()}
    train = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5 != 0}
    base = sum(train.values()) / len(train)
    table = {}
    for f in set().union(*[features[i][0] for i in train]):
        a, b = sum(f in features[i][0] for i, y in train.items() if y), sum(f in features[i][0] for i, y in train.items() if not y)
        if a >= toxicity.LEAST and (a + toxicity.DRAWN * base) / (a + b + toxicity.DRAWN) > base:
            table[f] = (a, b)

    def logit(a, b):
        p = (a + toxicity.DRAWN * base) / (a + b + toxicity.DRAWN)
        return math.log(p / (1 - p)) - math.log(base / (1 - base))

    def two(i, y=None):
        values = []
        for f in features[i][0] & table.keys():
            a, b = table[f]
            if y is None:
                values.append(logit(a, b))
            elif a - y >= toxicity.LEAST:
                values.append(logit(a - y, b - (1 - y)))
        return [*sorted((v for v in values if v > 0), reverse=True)[:2], 0.0, 0.0][:2]

    x, y = np.array([[1.0, *two(i, v)] for i, v in train.items()]), np.array([*train.values()], float)
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
    return {i: 1 / (1 + math.exp(-np.clip(np.array([1.0, *two(i)]) @ beta, -30, 30))) for i in texts}


def test_toxicity_brute_force(make, spark):
    docs, labels = toxic_docs(200)
    truth = dict(labels)
    df = make(docs)
    want = slow_toxicity(dict(docs), truth, toxicity.letter_counts(df, "text"))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = rows(toxicity.scored(df, table))
    assert all(abs(got[i]["score"] - want[i]) < 1e-6 for i in want)
    # rows that come three times: learned from once each, no class cut
    thrice = {r["doc_id"]: r["score"] for r in toxicity.scored(make(docs * 3), table).collect()}
    assert np.mean([(thrice[i] >= 0.5) == y for i, y in labels]) > 0.97


def test_toxicity_without_labels(make, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.scored(make([(1, "abc"), (2, None)]), none).collect()] == [0.0, 0.0]
    assert toxicity.scored(make([]), none).count() == 0


# op10
def slow_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, full, rest = {}, set(), 1.5 * sum(sizes.values())
    while True:
        left = [s for s in names if s not in full]
        level = rest / sum(w[s] for s in left) if left else 0
        over = [s for s in left if level * w[s] > 2 * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in left}
        for s in over:
            full.add(s)
            target[s] = 2.0 * sizes[s]
            rest -= 2 * sizes[s]


def test_mixing_targets_and_takes(make, prose, edge):
    rng = random.Random(6)
    docs = [(i, t, None, None) for i, t in edge] + [(100 + k, prose(rng.randint(1, 80), k), None, rng.choice(["a", "a", "a", "b", "C", "d", None, "é"])) for k in range(300)] + [(700, "", None, "hollow")]
    got = mixing.mixed(make(docs)).collect()
    by_source = defaultdict(list)
    source = defaultdict(list)
    for d in docs:
        source[d[0]].append(d)
    sizes = Counter()
    for i, t, _, s in docs:
        sizes[s] += len([w for w in (t or "").translate(str.maketrans(dict.fromkeys(WS, " "))).split(" ") if w])
    sizes.setdefault("hollow", 0)
    want = slow_targets(dict(sizes))
    for r in got:
        by_source[source[r["doc_id"]][0][3]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s, rs in by_source.items():
        assert rs[0]["source_size"] == sizes[s] and rs[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in rs) - want[s]) <= 1
        whole = {r["taken"] // r["size"] for r in rs if r["size"]}
        assert len(whole) <= 2  # complete epochs come before the fraction
    again = mixing.mixed(make(list(reversed(docs)))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.mixed(make([])).count() == 0


def test_mixing_prefers_quality(make, prose):
    docs = [(k, prose(40, k) if k % 2 else " ".join(w + "##" for w in prose(40, k).split()), None, s) for k in range(400) for s in [("a", "b", "c")[k % 3]]]
    got = mixing.mixed(make(docs)).filter("target < source_size").collect()
    taken = {odd: np.mean([r["taken"] > 0 for r in got if r["doc_id"] % 2 == odd]) for odd in (0, 1)}
    assert taken[1] > taken[0] + 0.1


def test_mixed_rows(make, prose):
    docs = [(k, prose(30, k), None, ("a", "b", "c")[k % 3]) for k in range(60)]
    plan = rows(mixing.mixed(make(docs)))
    copies = Counter(r["doc_id"] for r in mixing.mixed_rows(make(docs)).collect())
    assert all(copies[i] == -(-r["taken"] // r["size"]) for i, r in plan.items())


def test_word_pattern_is_shared():
    assert WORD == r"[^\x20\x09-\x0D]+"
