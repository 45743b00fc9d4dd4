"""The pipeline's stages against the operators' own verdicts and brute force."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from qpanel.llm import simhash
from test_operators import library, slow_measures, slow_similar


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]


def test_pipeline_brute_force(spark, make, prose, tmp_path):
    rng = random.Random(9)
    docs = []
    for k in range(60):
        text = prose(rng.randint(80, 300), k, 3000).capitalize() + "."
        source = rng.choice(["a", "b", "c"])
        docs.append((k, text, "en", source))
        if k % 5 == 0:
            docs.append((1000 + k, text, "en", source))
        if k % 7 == 0:
            docs.append((2000 + k, text + " end", "en", source))
    docs += [(3000, None, None, None), (3001, "", "en", "a"), (3002, "short text", "en", "a"), *[(4000 + k, " ".join(w.upper() + "!!" for w in prose(90, k).split()), "en", "b") for k in range(8)]]
    make(docs).write.parquet(f"{tmp_path}/documents.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        step = stage(spark, step, str(tmp_path))
        assert sorted(step.columns) == sorted(make([]).columns), name
        step.write.parquet(f"{tmp_path}/{n}")
        step = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append(step.collect())
    text = {d[0]: d[1] for d in docs}
    good = {i for i, t in text.items() if i < 3000}
    assert all(slow_measures(text[i])[0] >= 50 for i in good)
    assert {r["doc_id"] for r in kept[0]} == good
    best = {}
    for i in good:
        best[text[i]] = max(i, best.get(text[i], -1))
    assert Counter(r["doc_id"] for r in kept[1]) == Counter(best.values())
    classes = slow_similar({i: text[i] for i in best.values()}, simhash.SIMILAR)
    assert Counter(r["doc_id"] for r in kept[2]) == Counter(set(classes.values()))
    mixed = Counter(r["doc_id"] for r in kept[3])
    assert mixed.keys() <= set(classes.values()) and max(mixed.values()) <= 2
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(p["length"] for p in pieces) == sum(n * (len(library(text[i])) + 1) for i, n in mixed.items())


def test_pipeline_of_an_empty_table_and_clashing_columns(spark, make, prose, tmp_path):
    extra = make([]).selectExpr("*", "1 AS _away", "2 AS _row", "3 AS _id", "4 AS kept", "5 AS _text")
    extra.write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    rows = make([(k, prose(100 + k, k, 3000), "en", None) for k in range(5)] + [(None, prose(90, 77, 3000), "en", "a"), (3, prose(103, 3, 3000), "en", None)])
    step = rows.selectExpr("*", "1 AS _away", "2 AS _row", "3 AS _id", "4 AS kept", "5 AS _text")
    for name, stage in corpus_pipeline.STAGES[:4]:
        columns = step.columns
        step = stage(spark, step, str(tmp_path))
        assert step.columns == columns, name
    assert {r["doc_id"] for r in step.collect()} <= {0, 1, 2, 3, 4, None}
