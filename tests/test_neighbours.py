"""Clusterings and maps from all distances, on made-up groups and against brute force."""

import numpy as np
import pytest

from statloom.operators import neighbours
from statloom.plans import registry


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    z = np.vstack([rng.normal(size=(30, 2)) * 0.4 + c for c in ((0, 0), (6, 6), (0, 7))])
    k = np.repeat([0, 1, 2], 30)
    rows = [(i, float(a), float(b), "uvw"[c] if i % 10 else None) for i, ((a, b), c) in enumerate(zip(z, k, strict=True))]
    return z, k, spark.createDataFrame(rows, "id long, a double, b double, c string").cache()


def same(out, k):
    pairs = {(r["cluster"], int(k[r["id"]])) for r in out.collect()}
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(set(k))


def test_groups(blobs, spark):
    z, k, df = blobs
    assert same(neighbours.affinity_propagation(df, ["a", "b"], "id", -60.0), k)
    assert same(neighbours.diana(df, ["a", "b"], "id", 3), k)
    assert same(neighbours.kprototypes(df, ["a", "b"], ["c"], "id", 3, seed=3), k)
    only = neighbours.kprototypes(df, [], ["c"], "id", 4)
    assert len({(r["cluster"], "uvw"[k[r["id"]]] if r["id"] % 10 else None) for r in only.collect()}) == 4
    twice = spark.createDataFrame([(1, 0.0), (2, 0.0)], "id long, a double")
    assert [r["cluster"] for r in neighbours.diana(twice, ["a"], "id", 2).collect()] == [0, 0]
    with pytest.raises(ValueError):
        neighbours.kprototypes(twice, ["a"], [], "id", 2)


def test_optics_reaches_groups_one_after_another(blobs, spark):
    z, k, df = blobs
    d = np.sqrt(((z[:, None] - z[None, :]) ** 2).sum(axis=2))
    rows = neighbours.optics(df, ["a", "b"], "id", 5).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(90))
    assert np.allclose([r["core"] for r in rows], [np.sort(d[r["id"]])[4] for r in rows])
    for i, r in enumerate(rows[1:], 1):
        assert r["reach"] == pytest.approx(min(max(q["core"], d[q["id"], r["id"]]) for q in rows[:i]))
    jumps = [i for i, r in enumerate(rows) if r["reach"] is None or r["reach"] > 2.5]
    assert len(jumps) == 3 and all(len({k[r["id"]] for r in rows[a:b]}) == 1 for a, b in zip(jumps, [*jumps[1:], 90]))
    cut = neighbours.optics(df, ["a", "b"], "id", 5, 2.0).where("reach is null")
    assert cut.count() == 3
    assert neighbours.optics(df.where("id < 0"), ["a", "b"], "id").count() == 0


def test_map_keeps_groups_apart(blobs):
    z, k, df = blobs
    got = {r["id"]: (r["a"], r["b"]) for r in neighbours.tsne(df, ["a", "b"], "id", 10, 400).collect()}
    y = np.array([got[i] for i in range(90)])
    d = np.sqrt(((y[:, None] - y[None, :]) ** 2).sum(axis=2)) + np.eye(90) * 1e9
    assert np.isfinite(y).all() and (k[d.argmin(axis=1)] == k).mean() > 0.97
    with pytest.raises(ValueError):
        neighbours.tsne(df.limit(20), ["a", "b"], "id", 10)


def test_new_operators_are_found():
    assert ("neighbours and maps", "optics") in registry.search("optics") and ("dynamic panels", "arellano_bond") in registry.search("arellano")
