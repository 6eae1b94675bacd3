"""Similarity join and whitening of vectors against brute force."""

import math

import numpy as np
import pytest

from specval.llm import caps, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, __c long, __v double, __id string, __size int, n long"


def cluster_rows():
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v)
    rows, at = [], 0

    def put(v, label, copies=1):
        nonlocal at
        for _ in range(copies):
            rows.append((at, None if v is None else [None if x is None else float(x) for x in v], label, 1, 2.0, "x", None, at % 3))
            at += 1

    for label in (1, 2):
        for _ in range(60):
            put(rng.standard_normal(16), label)
        base = unit(rng.standard_normal(16))
        for k in range(150):  # one tight group of near copies, over more than one tile
            put(base * (1 + k) + 0.12 * (1 + k) * rng.standard_normal(16) / 4, label)
        for _ in range(40):  # pairs on either side of the threshold
            x = unit(rng.standard_normal(16))
            z = rng.standard_normal(16)
            z = unit(z - (z @ x) * x)
            cos = rng.uniform(0.9, 0.96)
            put(x, label), put(cos * x + math.sqrt(1 - cos * cos) * z, label)
    same = rng.standard_normal(16)
    put(same, 1, 30), put(same, 2, 2), put(same, None, 3)
    put(None, 1, 2), put([], 1), put([0.0] * 16, 1, 2), put([None] + [1.0] * 15, 1), put([float("nan")] * 16, 1), put([float("inf")] * 16, 1)
    put([1.0, 2.0, 3.0], 1, 2), put([2.0, 4.0, 6.1], 1), put([5.0], 1, 2), put([-5.0], 1), put([1e-30] * 16, 1), put([2e37] * 16, 1)
    rows += [(3, rows[3][1], 1, None, None, None, None, None), (None, rows[3][1], 1, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None)]
    return rows


def brute_links(rows, threshold=0.93):
    ok = [v is not None and label is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label, *_ in rows]
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    units = [np.array(np.float32(v), float) / np.abs(np.float32(v)).max().astype(float) if good else None for (_, v, *_), good in zip(rows, ok)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]):
                if units[i] @ units[j] / (np.linalg.norm(units[i]) * np.linalg.norm(units[j])) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0] is None, r[0] or 0, n[i], least.get(find(i), -1)) for i, r in enumerate(rows))


def found(df):
    return sorted((r["__id"] is None, r["__id"] or 0, r["__n_links"], -1 if r["__component"] is None else r["__component"]) for r in df.collect())


@pytest.mark.parametrize("tile_rows", [256, 40])
def test_links_equal_brute_force(spark, tile_rows):
    rows = cluster_rows()
    made = caps.similar_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), tile_rows=tile_rows)
    assert found(made) == brute_links(rows)


def test_other_order_and_shuffled_buckets_give_the_same(spark, monkeypatch):
    rows = cluster_rows()
    monkeypatch.setattr(caps, "BROADCAST_BUCKETS", 0)
    made = caps.similar_vectors(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3))
    assert found(made) == brute_links(rows)


@pytest.mark.parametrize("dims", [2, 7, 64])
def test_pairs_at_the_threshold_meet(dims):
    rng = np.random.default_rng(8)
    width, rotations = 32, 16
    least = caps.height(dims, width, rotations, 0.93, caps.RECALL)
    x, z = rng.standard_normal((2, 3000, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    lists = [set(zip(*(a.tolist() for a in caps.code(dims, width, rotations).passed(v, least)[:2]))) for v in (x, y)]
    met = {row for row, _ in lists[0] & lists[1]}
    assert len(met) >= 0.998 * len(x)


def test_listed_filters_are_all_that_exceed():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = caps.code(10, 16, 4)
    rows, filters, products = made.passed(x, 0.45)
    wide = np.zeros((20, 2 * made.half))
    wide[:, :10] = x
    want = set()
    for k, (turn, (first, second)) in enumerate(made.words):
        for i in range(16):
            for j in range(16):
                product = wide @ turn @ np.concatenate((first[i], second[j]))
                want |= {(r, (k * 16 + i) * 16 + j) for r in np.flatnonzero(product >= 0.45)}
    assert set(zip(rows.tolist(), filters.tolist())) == want and products.min() >= 0.45


def test_empty_table_of_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert caps.similar_vectors(none).collect() == []
    assert whitening.whiten(none).collect() == []
    only = spark.createDataFrame([(1, None, 1, 1, 1.0, "x", 1, 1), (None, [float("nan")], 2, 1, 1.0, "x", 1, 1)], SCHEMA)
    assert found(caps.similar_vectors(only)) == [(False, 1, 0, 1), (True, 0, 0, -1)]
    assert whitening.whiten(only).collect() == []


def brute_whitening(vectors, components=8):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    deviation = [sum((n * r[d] - sums[d])**2 for d in range(dims)) for r in x]
    centred = np.array([[(n * r[d] - sums[d]) / n for d in range(dims)] for r in x])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    return deviation, centred @ axes[:, :components] / np.sqrt(values[:components]), values / np.trace(cov)


@pytest.mark.parametrize("scale", [1.0, 3e6])
def test_whitening_equals_brute_force(spark, scale):
    rng = np.random.default_rng(6)
    vectors = [[float(np.float32(scale * c)) for c in v] for v in rng.standard_normal((300, 12)) * np.linspace(1, 3, 12) + 5]
    junk = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, []), (905, [1.0, 2.0])]
    rows = [(i, v, 1, 1, 1.0, "x", 1, 7) for i, v in enumerate(vectors)] + [(i, v, 1, 1, 1.0, "x", 1, 7) for i, v in junk]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    deviation, white, shares = brute_whitening(vectors)
    assert len(got) == 300 * 8 and {r["__n"] for r in got} == {300}
    assert {r["__id"]: int(r["__deviation"]) for r in got} == dict(enumerate(deviation))
    mine = np.zeros((300, 8))
    for r in got:
        mine[r["__id"], r["__component"] - 1] = r["__whitened"]
        assert abs(r["__explained"] - shares[r["__component"] - 1]) < 1e-9 and abs(r["__identity_error"]) < 1e-9
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-8


def test_repeated_rows_and_no_variance(spark):
    rows = [(1, [1.0, 2.0], 1, 1, 1.0, "x", 1, 1)] * 3 + [(None, [1.0, 2.0], 1, 1, 1.0, "x", 1, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 8 and {(r["__whitened"], int(r["__deviation"]), r["__explained"], r["__identity_error"]) for r in got} == {(0.0, 0, 0.0, 1.0)}


def test_polarised_sums_are_exact():
    rng = np.random.default_rng(2)
    for most in (5, 2**31, 2**61):
        x = rng.integers(-most, most, (50, 4))
        i, j = whitening.pair_places(4)
        want = [sum((int(r[a]) + (int(r[b]) if a != b else 0))**2 for r in x) for a, b in zip(i, j)]
        assert whitening.squares(x) == want
    with pytest.raises(ValueError, match="64 bits"):
        whitening.whole_numbers(np.array([[1e30]]))
