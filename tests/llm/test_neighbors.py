"""Nearest vectors against brute force, and odd inputs."""

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import neighbors

SCHEMA = "chunk_key long, embedding array<float>, embedding_model string, extra int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def test_hilbert_keys_visit_neighbours():
    """Consecutive places of the curve are neighbours in space, and each cell has its own place."""
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        side = 1 << bits
        cells = np.array(np.meshgrid(*[np.arange(side)] * dims)).reshape(dims, -1).T.astype(np.uint32)
        keys = neighbors.hilbert_keys(cells, bits)
        order = np.argsort(keys)
        assert sorted(keys) == list(range(side**dims))
        assert (np.abs(np.diff(cells[order].astype(int), axis=0)).sum(axis=1) == 1).all()


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 64))
    near = base[:500] + rng.normal(size=(500, 64)) * rng.uniform(0.05, 0.25, (500, 1))
    x = np.concatenate([base, near]) * rng.uniform(0.2, 9, (2000, 1))
    got = {tuple(r) for r in neighbors.nearest_pairs(table(spark, [(i, [float(v) for v in x[i]], "m") for i in range(2000)])).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = set()
    for i in range(2000):
        for j in np.argsort(-s[i], kind="stable")[:10]:
            if s[i, j] >= 0.95:
                want.add((min(i, int(j)), max(i, int(j))))
    assert len(want) > 300 and got <= want and len(got) / len(want) >= 0.97


def test_only_within_a_model_and_a_length(spark):
    v = [1.0] * 8
    rows = [(1, v, "a"), (2, v, "a"), (3, v, "b"), (4, v[:4], "a"), (5, None, "a"), (6, [], "a"), (7, [0.0] * 8, "a"), (8, [float("nan")] + v[1:], "a"), (9, [float("inf")] + v[1:], "a"), (10, v, None), (None, v, "a"), (2, v, "a"), (11, [None] + v[1:], "a"), (12, [-1.0] * 8, "a")]
    got = neighbors.nearest(table(spark, rows)).collect()
    assert {(r.src, r.dst) for r in got} == {(1, 2), (2, 1)} and all(abs(r.similarity - 1) < 1e-9 and r["rank"] == 1 for r in got)
    assert neighbors.nearest_pairs(table(spark, [])).count() == 0


def test_many_equal_vectors_stay_in_proportion(spark):
    v = [float(x) for x in np.random.default_rng(2).normal(size=16)]
    got = neighbors.nearest(table(spark, [(i, v, "m") for i in range(400)])).collect()
    per = {}
    for r in got:
        per.setdefault(r.src, []).append((r["rank"], r.dst))
    assert set(per) == set(range(400)) and all(len(x) == 10 for x in per.values())
    assert sorted(d for _, d in per[399]) == list(range(10)) and len(got) == 4000


def test_short_and_long_vectors(spark):
    rows = [(i, [float(np.cos(i / 50)), float(np.sin(i / 50))], "m") for i in range(40)]
    got = {tuple(r) for r in neighbors.nearest_pairs(table(spark, rows), k=1).collect()}
    assert {(i, i + 1) for i in range(1, 38, 2)} <= got | {(i, i + 1) for i in range(40)} and len(got) >= 20
    assert neighbors.nearest(table(spark, rows), k=3).where(F.col("similarity") < 0.95).count() == 0


def test_all_nearest_is_brute_force(spark, monkeypatch):
    """Unstructured vectors, runs of equal ones, two models and unusable rows: ten neighbours of each, whatever their similarity."""
    monkeypatch.setattr(neighbors, "BLOCK", 64)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 24)).astype(np.float32).astype(float)
    x[500:560] = x[3]
    model = ["a" if i < 590 else "b" for i in range(600)]
    rows = [(i, [float(v) for v in x[i]], model[i]) for i in range(600)] + [(7, [float(v) for v in x[7]], "a"), (900, [0.0] * 24, "a"), (901, None, "a"), (902, [1.0] * 8, "a"), (903, [1.0] * 24, None)]
    got = {}
    for r in neighbors.all_nearest(table(spark, rows).repartition(5)).collect():
        got.setdefault(r.src, {})[r["rank"]] = (r.dst, r.similarity)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert set(got) == set(range(600))
    for i in range(600):
        mine = [j for j in range(600) if model[j] == model[i] and j != i]
        want = sorted(mine, key=lambda j: (-round(s[i, j], 9), j))[:10]
        assert [got[i][n][0] for n in sorted(got[i])] == want
        assert all(abs(got[i][n + 1][1] - s[i, j]) < 1e-9 for n, j in enumerate(want))
