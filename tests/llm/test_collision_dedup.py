"""Collision-counting near-duplicates against all pairs."""

import math

import numpy as np
import pytest

from cohort_signal.llm import collision_dedup as cd


def expected(rows, threshold):
    """rows: (id, vector); all pairs in doubles."""
    best = {}
    for i, v in rows:
        if i is None:
            continue
        ok = bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(c != 0 for c in v)
        if ok and (best.get(i) is None or v < best[i]):
            best[i] = v
        best.setdefault(i, None)
    ids = sorted(best)
    out = {i: [0, i] for i in ids}
    for dim in {len(v) for v in best.values() if v}:
        some = [i for i in ids if best[i] is not None and len(best[i]) == dim]
        x = cd.units(np.array([best[i] for i in some], dtype=float))
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        label = np.array(some)
        while True:
            now = np.array([min([label[k], *label[near[k]]]) for k in range(len(some))])
            if (now == label).all():
                break
            label = now
        for k, i in enumerate(some):
            out[i] = [int(near[k].sum()), int(label[k])]
    return sorted((i, n, c, i == c) for i, (n, c) in out.items())


def around(rng, centre, angle):
    """A unit vector at an angle from ``centre``."""
    y = rng.standard_normal(len(centre))
    y -= y @ centre * centre
    y /= np.linalg.norm(y)
    return math.cos(angle) * centre + math.sin(angle) * y


@pytest.mark.parametrize("block", [cd.BLOCK, 32])
def test_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(cd, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows, n = [], 1000

    def add(v):
        nonlocal n
        rows.append((n, [float(c) for c in v]))
        n += 1

    for _ in range(300):
        add(rng.standard_normal(16))
    for size in (2, 3, 40, 150):
        centre = cd.units(rng.standard_normal((1, 16)))[0]
        for _ in range(size):
            add(around(rng, centre, rng.uniform(0, 0.3)) * 10.0 ** rng.integers(-3, 4))
    chain = cd.units(rng.standard_normal((1, 16)))[0]
    for _ in range(12):
        add(chain)
        chain = around(rng, chain, math.acos(0.951))
    for _ in range(60):
        add(np.full(16, 3.0))
    add(np.full(16, 1e200))
    add(np.full(16, 1e-200))
    add([1.0, 2.0])
    add([2.0, 4.001])
    add([5.0])
    add([7.0])
    add([-7.0])
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] + [1.0] * 15), (n + 4, [float("inf")] + [1.0] * 15),
             (n + 5, [None] + [1.0] * 15), (None, [1.0] * 16), rows[5], rows[5], (rows[6][0], rows[400][1]), (rows[7][0], None)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, node int, copies int, label int").repartition(3)
    got = cd.near_duplicates(table)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == expected(rows, 0.95)


def test_empty_table_and_other_names(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cd.near_duplicates(table).count() == 0
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, None)], "k int, x array<float>")
    assert sorted(map(tuple, cd.near_duplicates(table, "k", "x", threshold=0.75).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    with pytest.raises(ValueError):
        cd.near_duplicates(table, "k", "x", threshold=1.0)


def test_recall_at_the_threshold(spark):
    """4,000 pairs barely above the threshold among 20,000 vectors of 64 dimensions."""
    rng = np.random.default_rng(8)
    x = cd.units(rng.standard_normal((16_000, 64)))
    partners = np.stack([around(rng, c, math.acos(0.9505)) for c in x[:4_000]])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, partners]))], "vec_id long, embedding array<double>")
    got = cd.near_duplicates(table)
    found = got.filter("n_links = 1 and component_id < 4000 and not kept").count()
    assert found >= 3_998
    assert got.filter("n_links > 0").count() <= 8_000


def test_collision_counts_by_hand():
    rng = np.random.default_rng(1)
    left, right = rng.standard_normal((30, 9)), rng.standard_normal((50, 9))
    want = (np.abs(left[:, None, :] - right[None, :, :]) <= 0.3).sum(axis=2)
    assert (cd.collisions(left, right, 0.3) == want).all()
    slabs = rng.integers(0, 12, (20, 5))
    for slab in (0, 4, 12):
        want = [[bool({*a} & {*b} & set(range(slab))) for b in slabs.tolist()] for a in slabs[:7].tolist()]
        assert cd.shared_before(slabs[:7], slabs, slab).tolist() == want


def test_least_count_is_the_binomial_quantile():
    p = math.erf(cd.WIDTH / math.sqrt(2))
    k = cd.least_count(0.95)
    tail = [sum(math.comb(96, i) * p ** i * (1 - p) ** (96 - i) for i in range(m)) for m in (k, k + 1)]
    assert tail[0] <= cd.MISS < tail[1]
