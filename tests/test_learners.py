"""Trees, clusterings and their validation on made-up groups, against numpy."""

import numpy as np
import pytest

from statloom.operators import cluster, graph, trees


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(8)
    z = np.vstack([rng.normal(size=(40, 2)) * 0.4 + c for c in ((0, 0), (5, 5), (0, 6))])
    k = np.repeat([0, 1, 2], 40)
    rows = [(i, float(a), float(b), int(c), int(a + b > 5), float(2 * a - b)) for i, ((a, b), c) in enumerate(zip(z, k, strict=True))]
    return z, k, spark.createDataFrame(rows, "id long, a double, b double, k int, y int, v double").cache()


def same(got, k):
    pairs = {(c, int(t)) for c, t in zip(got, k, strict=True)}
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_groups_are_found(blobs, spark):
    z, k, df = blobs
    of = lambda out: [r.cluster for r in out.orderBy("id").collect()]
    rows, parts = cluster.gaussian_mixture(df, ["a", "b"], "id", 3)
    assert sum(r.weight for r in parts.collect()) == pytest.approx(1) and all(0.3 < r.probability <= 1 for r in rows.collect())
    assert same(of(cluster.kmedoids(df, ["a", "b"], "id", 3)), k)
    assert same(of(cluster.dbscan(df, ["a", "b"], "id", 1.2, 4)), k)
    assert same(cluster.cut_tree(cluster.hierarchical(df, ["a", "b"], "id", "average"), 3), k)
    member, centres = cluster.fuzzy_cmeans(df, ["a", "b"], "id", 3)
    assert same([int(np.argmax(r.membership)) for r in member.orderBy("id").collect()], k)
    assert -1 in of(cluster.trimmed_kmeans(df, ["a", "b"], "id", 3, 0.1))
    tree = cluster.mst(df, ["a", "b"], "id").toPandas()
    assert len(tree) == 119 and (tree.distance > 2.5).sum() == 2
    roots = {r.node: r.root for r in graph.components(spark.range(6).toDF("node"), spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "a long, b long")).collect()}
    assert roots == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_linkages_against_plain_merging(blobs):
    z, _, df = blobs
    part = df.where("id < 12")
    pts = z[:12]
    for linkage, how in (("single", np.min), ("complete", np.max), ("average", np.mean)):
        sets, heights = [[i] for i in range(12)], []
        while len(sets) > 1:
            d, i, j = min((how([np.linalg.norm(pts[a] - pts[b]) for a in sets[i] for b in sets[j]]), i, j) for i in range(len(sets)) for j in range(i))
            heights.append(d)
            sets[j] += sets.pop(i)
        assert [r.height for r in cluster.hierarchical(part, ["a", "b"], "id", linkage).orderBy("step").collect()] == pytest.approx(heights, abs=1e-6)


def test_merges_of_many_points(blobs, spark, monkeypatch):
    # more points than were taken before; and rounds, blocks and executors give the merges of one matrix
    from statloom.operators import linkage

    rng = np.random.default_rng(6)
    z = np.vstack([rng.normal(size=(2100, 2)), rng.normal(size=(1900, 2)) + 9])
    z = np.vstack([z, z[:50]])
    many = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(z)], "id long, a double, b double")
    got = cluster.hierarchical(many, ["a", "b"], "id").orderBy("step").toPandas()
    assert len(got) == len(z) - 1 and (got.height[:50] == 0).all() and got.height.is_monotonic_increasing
    assert sorted(np.concatenate([got.a, got.b])) == list(range(2 * len(z) - 2))
    top = got.iloc[-1]
    assert top["size"] == len(z) and top.height == pytest.approx(np.mean(np.hypot(*(np.vstack([z[:2100], z[4000:]])[:, None] - z[None, 2100:4000]).T)))
    df = blobs[2]
    kept = {k: cluster.hierarchical(df, ["a", "b"], "id", k).orderBy("step").collect() for k in ("average", "complete", "ward")}
    for most, shared in ((1, 10**6), (10, 10**6), (40, 1)):
        monkeypatch.setattr(linkage, "MATRIX", most)
        monkeypatch.setattr(linkage, "SHARED", shared)
        for k, want in kept.items():
            again = cluster.hierarchical(df, ["a", "b"], "id", k).orderBy("step").collect()
            assert [(r.a, r.b, r.size) for r in again] == [(r.a, r.b, r.size) for r in want] and [r.height for r in again] == pytest.approx([r.height for r in want])


def test_sums_of_distances_without_all_pairs(monkeypatch):
    # clusters of many sizes, one of them holding a third of the points, in one to five columns; all pairs of points were compared before
    from statloom.operators import linkage, sums

    rng = np.random.default_rng(11)
    plain, looked = sums.apart, [0]

    def counted(a, b):
        looked[0] += len(a) * len(b)
        return plain(a, b)

    monkeypatch.setattr(sums, "apart", counted)
    for columns, n, most in ((1, 20000, 0.15), (2, 40000, 0.8), (3, 4000, 1.1), (5, 3000, 1.1)):
        z = rng.normal(size=(n, columns)) * 4
        z[: n // 2, 0] = np.round(z[: n // 2, 0])
        slot = np.where(z[:, 0] > 2, 0, 1 + np.unique(np.floor(z[:, : min(columns, 2)]), axis=0, return_inverse=True)[1].reshape(-1))
        c = linkage._Clusters(z, rng.integers(1, 4, n).astype(float), "average")
        c.slot = np.unique(slot, return_index=True)[1][np.unique(slot, return_inverse=True)[1]]
        alive = np.unique(c.slot)
        c.gather()
        c.size = np.bincount(c.slot, c.weight, n)
        for k in range(columns):
            c.mean[:, k] = np.bincount(c.slot, c.weight * z[:, k], n) / np.maximum(c.size, 1)
        looked[0] = 0
        got = linkage._matrix(c, alive, None)
        assert looked[0] < most * n * n / 2
        rows = [np.flatnonzero(c.slot == a) for a in alive]
        for a in (1, 2, len(alive) // 2):
            d = c.weight[rows[a]] @ plain(z[rows[a]], z)
            want = np.array([d[r] @ c.weight[r] for r in rows]) / (c.size[alive[a]] * c.size[alive])
            want[a] = np.inf
            assert got[a] == pytest.approx(want, rel=1e-11)


def test_medoids_of_many_points(spark):
    # more points than were taken before, with copies: the choice and the swaps of trying every point
    rng = np.random.default_rng(7)
    z = np.column_stack([np.round(rng.uniform(-1, 10, 4000), 3), rng.integers(0, 25, 4000)]).astype(float)
    z = np.vstack([z, z[:100]])
    got = [r.cluster for r in cluster.kmedoids(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(z)], "id long, a double, b double"), ["a", "b"], "id", 3).orderBy("id").collect()]
    d = np.hypot(z[:, 0, None] - z[None, :, 0], z[:, 1, None] - z[None, :, 1])
    chosen = [int(d.sum(axis=0).argmin())]
    while len(chosen) < 3:
        chosen.append(int(np.minimum(d[:, chosen].min(axis=1)[:, None], d).sum(axis=0).argmin()))
    while True:
        swaps = [np.minimum(d[:, chosen[:i] + chosen[i + 1 :]].min(axis=1)[:, None], d).sum(axis=0) for i in range(3)]
        i = int(np.argmin([t.min() for t in swaps]))
        if swaps[i].min() >= d[:, chosen].min(axis=1).sum() - 1e-9:
            break
        chosen[i] = int(swaps[i].argmin())
    assert got == d[:, chosen].argmin(axis=1).tolist()


def test_spanning_tree_of_many_points(spark):
    # more points than a matrix of distances is held for, on lines, with copies: lengths by Prim's plain algorithm
    rng = np.random.default_rng(4)
    z = np.column_stack([np.round(rng.uniform(-1, 10, cluster.MAX_POINTS), 3), rng.integers(0, 5, cluster.MAX_POINTS)]).astype(float)
    z = np.vstack([z, z[:50]])
    tree = cluster.mst(spark.createDataFrame([(f"p{i:05d}", float(a), float(b)) for i, (a, b) in enumerate(z)], "id string, a double, b double"), ["a", "b"], "id").collect()
    near, done, lengths = np.full(len(z), np.inf), np.zeros(len(z), dtype=bool), []
    at = 0
    for _ in range(len(z) - 1):
        done[at] = True
        near = np.minimum(near, np.hypot(*(z - z[at]).T))
        at = int(np.where(done, np.inf, near).argmin())
        lengths.append(near[at])
    assert sorted(r.distance for r in tree) == pytest.approx(sorted(lengths), abs=1e-12)
    number = lambda v: int(v[1:])
    assert all(r.distance == pytest.approx(np.hypot(*(z[number(r.a)] - z[number(r.b)])), abs=1e-12) for r in tree)
    known = {0}
    for r in tree:  # every row is reached from those before
        assert number(r.a) in known
        known.add(number(r.b))
    assert len(known) == len(z)


def test_validation(blobs):
    z, k, df = blobs
    means = np.array([z[k == c].mean(axis=0) for c in range(3)])
    within = sum(((z[k == c] - means[c]) ** 2).sum() for c in range(3))
    between = sum(40 * ((means[c] - z.mean(axis=0)) ** 2).sum() for c in range(3))
    assert cluster.calinski_harabasz(df, ["a", "b"], "k") == pytest.approx(between / 2 / (within / 117))
    s = np.array([np.linalg.norm(z[k == c] - means[c], axis=1).mean() for c in range(3)])
    worst = [max((s[i] + s[j]) / np.linalg.norm(means[i] - means[j]) for j in range(3) if j != i) for i in range(3)]
    assert cluster.davies_bouldin(df, ["a", "b"], "k") == pytest.approx(np.mean(worst))
    d2 = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    a = np.array([d2[i, k == k[i]].sum() / 39 for i in range(120)])
    b = np.array([min(d2[i, k == c].mean() for c in range(3) if c != k[i]) for i in range(120)])
    assert cluster.silhouette(df, ["a", "b"], "k") == pytest.approx(np.mean((b - a) / np.maximum(a, b)))
    d = np.sqrt(d2)
    assert cluster.dunn(df, ["a", "b"], "id", "k") == pytest.approx(d[k[:, None] != k].min() / d[k[:, None] == k].max(), rel=1e-6)
    got = cluster.agreement(df, "k", "y")
    y = (z.sum(axis=1) > 5).astype(int)
    agree = [(k[i] == k[j]) == (y[i] == y[j]) for i in range(120) for j in range(i)]
    assert got["rand"] == pytest.approx(np.mean(agree)) and 0 < got["nmi"] < 1
    assert cluster.agreement(df, "k", "k")["adjusted_rand"] == pytest.approx(1)


def test_trees(blobs):
    _, _, df = blobs
    right = lambda m: m.predict(df).where("predicted = y").count()
    assert right(trees.cart(df, "y", ["a", "b"])) >= 115
    forest = trees.random_forest(df, "y", ["a", "b"], trees=10, depth=4)
    assert right(forest) >= 115 and sum(r.importance for r in forest.importance(df.sparkSession).collect()) == pytest.approx(1)
    assert right(trees.linear_svm(df, "y", ["a", "b"])) >= 110
    assert right(trees.adaboost(df, "y", ["a", "b"], 8)) >= 112
    value = trees.gradient_boosting(df, "v", ["a", "b"], False, 5)
    base = {"a": 1.0, "b": 2.0}
    told = {r.id: r.predicted for r in value.predict(df).collect()}
    ground = value.predict(df.sparkSession.createDataFrame([(1.0, 2.0)], "a double, b double")).first().predicted
    total = {}
    for r in trees.shapley(df, value, "id", base).collect():
        total[r.id] = total.get(r.id, 0) + r.value
    assert all(total[i] == pytest.approx(told[i] - ground, abs=1e-6) for i in told)
    curve = {r.value: r.mean for r in trees.partial_dependence(df, value, "a", [0.0, 5.0]).collect()}
    assert curve[5.0] > curve[0.0]
    assert trees.ice(df, value, "id", "a", [0.0, 1.0]).count() == 240
    q = trees.quantile_forest(df, "v", ["a", "b"], df, "id", [0.1, 0.9], 5, 3).groupBy("id").pivot("probability").min("value").collect()
    assert all(r["0.1"] <= r["0.9"] for r in q)
