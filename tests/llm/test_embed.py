import math

import numpy as np
import pytest

from strandframe.llm import common, embed, queries


def test_decode_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(1)
    assert len(embed.ROOTS) == 240 and np.allclose((embed.ROOTS**2).sum(1), 2)
    x = rng.normal(size=(300, 8)) * 2
    c = embed.decode(x)
    assert np.allclose(embed.decode(c), c)  # lattice points decode to themselves
    best = ((x - c) ** 2).sum(1)
    assert (best <= 1 + 1e-9).all()  # covering radius
    for k in range(240):  # no neighbour is nearer
        assert (((x - c - embed.ROOTS[k]) ** 2).sum(1) >= best - 1e-9).all()


def brute(vectors, threshold=0.95):
    good = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in vectors]
    n = len(vectors)
    unit = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float) / max(map(abs, v))) / max(map(abs, v)) if g else None for g, (_, v) in zip(good, vectors)]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            near[i, j] = i != j and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold
    label = np.arange(n)
    while True:
        low = np.array([min([label[k], *label[near[k]]]) for k in range(n)])
        if (low == label).all():
            break
        label = low
    smallest = {r: min((vectors[k][0] for k in range(n) if label[k] == r and vectors[k][0] is not None), default=None) for r in set(label.tolist())}
    return [(i, int(near[k].sum()), smallest[label[k]]) for k, (i, _) in enumerate(vectors)]


def sample():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16)).astype(np.float32)
    rows = [(k, (centres[k % 30] + rng.normal(size=16).astype(np.float32) * 0.08).tolist()) for k in range(300)]
    rows += [(400 + k, rows[3][1]) for k in range(25)] + [(3, rows[3][1])]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [None] + [1.0] * 15), (504, [math.nan] * 16), (505, [math.inf] * 16), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (508, [1e-30, 2e-30]), (None, [float(c) for c in centres[1]])]
    return rows


@pytest.mark.parametrize("cell_rows", [2048, 7])
def test_links_match_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(embed, "CELL_ROWS", cell_rows)
    rows = sample()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, component int").repartition(3)
    got = sorted(((r["id"], r["n_links"], r["component"]) for r in embed.near_duplicates(df).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:1] for g in got] == [w[:1] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert sum(g == w for g, w in zip(got, want, strict=True)) > 0.95 * len(want)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.952 * x + math.sqrt(1 - 0.952**2) * z
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<float>")
    links = {r["id"]: r["n_links"] for r in embed.near_duplicates(df).collect()}
    assert sum(links[k] > 0 for k in range(600)) >= 0.97 * 600
    assert max(links.values()) <= 1


def test_double_vectors_and_ids_at_the_ends_of_their_range(spark):
    rows = [((1 << 62) + 1, [1e-60, 2e-60, 3e-60]), (-(1 << 63), [0.1, 0.2, 0.3]), ((1 << 63) - 1, [0.3, -0.2, 0.1]), (None, [1e200, 2e200, 3e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r["id"], r["n_links"], r["component"]) for r in embed.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str) and got[0][1] == 2


def test_query_over_the_table(spark):
    data = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in common.table(spark, data, "embeddings").collect()]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in queries.op7_embeddings(spark, data).collect())
    assert got == sorted(brute(rows))


def test_empty_table(spark):
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
