"""Centroid clustering and whitening against plain versions, with their edge cases."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from qpanel.llm import centroids, queries, vectors, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, id string, cluster int, n string, component string"


@pytest.fixture(scope="module")
def table(spark):
    def build(rows, parts=3):
        return spark.createDataFrame([(i, v, 1, "x", "y", -1, "z", "c") for i, v in rows], VECTORS).repartition(parts)

    return build


def rows_of(n, seed, size=64, groups=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size)) / 4
    return [(i, (centres[i % groups] + rng.normal(size=size) / 8).astype(np.float32).tolist()) for i in range(n)]


def plain_clusters(rows, k=16, rounds=3, size=64, scale=64):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) and abs(math.floor(scale * c)) < vectors.LIMIT for c in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        held = [[] for _ in centres]
        for _, v in kept:
            held[nearest(v)[1]].append(v)
        centres = [[sum(c) // len(h) for c in zip(*h)] if h else old for h, old in zip(held, centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    each = {j: sum(d for _, d, c in found if c == j) for j in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i if i is not None else -1, j, d, each[j], total, digest[j]) for i, d, j in found)


def clusters_of(df):
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def edge_rows():
    rows = rows_of(90, 3)
    hot = rows[7][1]
    odd = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [0.5] * 63), (205, [float("nan")] + [0.5] * 63), (206, [float("inf")] * 64), (207, [3e38] * 64), (None, hot), (208, [-0.0] * 64)]
    return rows + odd + [(300 + i, hot) for i in range(40)] + [rows[3], rows[3], (5, hot)]


@pytest.mark.parametrize("rows", [rows_of(150, 1), rows_of(9, 2), rows_of(40, 4, groups=1), edge_rows(), [(i, [0.25] * 64) for i in range(20)]], ids=["many", "fewer than centroids", "one group", "edges and copies", "all alike"])
def test_centroids_are_those_of_a_plain_loop(table, rows):
    assert clusters_of(centroids.clustered(table(rows))) == plain_clusters(rows)


def test_centroids_empty_and_other_parameters(spark, table):
    df = table([])
    assert centroids.clustered(df).collect() == []
    assert centroids.clustered(df).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.clustered(table([(1, None), (2, [1.0])])).collect() == []
    rows = rows_of(60, 5, size=7)
    for rounds in (0, 5):
        assert clusters_of(centroids.clustered(table(rows), k=4, rounds=rounds, size=7, scale=100)) == plain_clusters(rows, 4, rounds, 7, 100)
    named = table(rows_of(30, 6)).selectExpr("cast(vec_id as string) as id", "cast(embedding as array<double>) as x", "label as vec_id")
    assert [r["distance"] for r in centroids.clustered(named, id_col="id", vector_col="x").collect()]


def test_products_are_mended_only_where_centroids_changed():
    rng = np.random.default_rng(0)
    x, before = rng.integers(-50, 50, (30, 8)), rng.integers(-50, 50, (4, 8))
    now = before.copy()
    now[1, 3] += 5
    now[2] = 0
    dots = x @ before.T
    assert (centroids.mended(dots, x, before, now) == x @ now.T).all()
    # a wrong product of an unchanged centroid stays as it was
    dots[:, 0] += 1
    assert (centroids.mended(dots, x, before, now)[:, 0] == x @ now[0] + 1).all()


def test_centroids_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    r = db.execute(queries.oracle_sql()["op11_centroids"])
    names = [d[0] for d in r.description]
    df = queries.queries()["op11_centroids"](spark, sf)
    assert sorted(tuple(row[c] for c in sorted(names)) for row in df.collect()) == sorted(tuple(row[names.index(c)] for c in sorted(names)) for row in r.fetchall())


def test_packed_bytes_have_the_order_of_components():
    rng = random.Random(1)
    rows = [[rng.choice([-(2**27) + 1, -300, -1, 0, 1, 255, 256, 2**27 - 1]) for _ in range(3)] for _ in range(200)]
    found = [vectors.packed(np.array([r])).tobytes() for r in rows]
    assert [r for _, r in sorted(zip(found, rows))] == sorted(rows)
    assert vectors.unpacked(vectors.binary(vectors.packed(np.array(rows))), 3).tolist() == rows


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


SPECTRA = {
    "plain": np.arange(20, 0, -1.0), "near": [1, 1 - 1e-9, 1 - 2e-9, 0.5, *[0.1] * 8], "equal": [3, 3, 3, 2, 2, *[1] * 10], "all equal": [1.0] * 12, "one direction": [5.0, *[0] * 9], "nothing": [0.0] * 6,
    "small and large": [1e12, 1.0, 1e-6, 1e-9, 0], "two": [2.0, 1.0],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_eigenvectors(name):
    a = spectrum(SPECTRA[name])
    k = min(4, len(a))
    values, rows = whitening.leading(a, k)
    size = max(np.trace(a), 1e-300)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1][:k], atol=1e-13 * size, rtol=0)
    assert np.abs(rows @ rows.T - np.eye(k)).max() < 1e-12
    assert np.abs(rows @ a - values[:, None] * rows).max() < 1e-12 * size


def test_inertia_counts():
    a = spectrum([4.0, 3, 2, 1, 0, -1, -2])
    for shift, n in ((-3, 0), (-1.5, 1), (0.5, 3), (3.5, 6), (5, 7)):
        assert whitening.below(a, shift) == n
    # no diagonal entry to start with: a pivot of two rows
    assert whitening.below(np.array([[0.0, 1], [1, 0]]), 0) == 1
    assert whitening.below(np.zeros((3, 3)), 0) == 0


def plain_whitened(rows, components=4, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in kept}))
    n, s = len(fit), fit.sum(axis=0)
    c = (fit - s / n).T @ (fit - s / n) / n
    values, vectors_ = np.linalg.eigh(c)
    values, axes = values[::-1][:components], vectors_[:, ::-1].T[:components]
    return {"n": n, "explained": values / np.trace(c), "rows": [(i, int(((n * np.array(v) - s) ** 2).sum()), (np.array(v) - s / n) @ axes.T / np.sqrt(values)) for i, v in kept]}


def test_whitening_is_that_of_a_dense_solver(table):
    rows = rows_of(300, 8, size=12) + [(1000 + i, rows_of(300, 8, size=12)[5][1]) for i in range(200)] + [(None, [0.25] * 12), (2000, None), (2001, [None] * 12), (2002, [float("inf")] * 12), (2003, [float("nan"), *[0.5] * 11])]
    rows += [rows[0], rows[0]]
    want = plain_whitened(rows)
    got = whitening.whitened(table(rows)).collect()
    assert len(got) == 4 * len(want["rows"]) and {r["n"] for r in got} == {want["n"]}
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-10
    for k in range(4):
        own = sorted(((-1 if r["vec_id"] is None else r["vec_id"]), r["deviation"], r["whitened"], r["explained"]) for r in got if r["component"] == k + 1)
        theirs = sorted(((-1 if i is None else i), d, w[k]) for i, d, w in want["rows"])
        assert [x[:2] for x in own] == [x[:2] for x in theirs]
        sign = np.sign(sum(a[2] * b[2] for a, b in zip(own, theirs)))
        assert np.allclose([x[2] for x in own], [sign * x[2] for x in theirs], atol=1e-9)
        assert np.allclose(own[0][3], want["explained"][k], rtol=1e-9)


def test_whitening_without_spread(table):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whitened(table([])).columns == columns and whitening.whitened(table([])).collect() == []
    assert whitening.whitened(table([(1, None), (2, [])])).collect() == []
    same = whitening.whitened(table([(i, [0.5, 0.25]) for i in range(5)])).collect()
    assert len(same) == 10 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, None, None)}
    line = whitening.whitened(table([(i, [i / 4, i / 2, -i / 4]) for i in range(6)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True), (3, True)} and line[0]["identity_error"] < 1e-12
    ragged = whitening.whitened(table([(i, [i / 4, i * i / 9]) for i in range(6)] + [(10, [1.0]), (11, [1.0, 2.0, 3.0])])).collect()
    assert {r["vec_id"] for r in ragged} == set(range(6))


def test_exact_sums_of_large_components(table):
    big = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(2).integers(-400_000, 400_000, (50, 5)))]
    x = np.array([[int(256 * np.float32(c)) for c in v] for _, v in big], dtype=object)
    n, s = len(x), x.sum(axis=0)
    c = np.array([[int(v) for v in r] for r in (n * x - s)], dtype=object)
    assert (whitening.product(np.array(x, dtype=np.int64)) == x.T @ x).all()
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(table(big)).collect()}
    assert got == {i: (d if d < 2**63 else None) for i, d in enumerate((c * c).sum(axis=1).tolist())}
    values = np.linalg.eigvalsh(np.array(c.T @ c / n**3, dtype=float))[::-1]
    assert np.allclose(whitening.leading(np.array(c.T @ c / n**3, dtype=float), 4)[0], values[:4], rtol=1e-10)
