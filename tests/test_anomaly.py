import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.operators.anomaly import ensemble as M
from flowloom.operators.anomaly import features as U
from flowloom.operators.anomaly import iforest, lof, ocsvm


def _vectors(spark, array, names=None):
    names = names or [f"u{i:04d}" for i in range(len(array))]
    return spark.createDataFrame([(n, [float(x) for x in row]) for n, row in zip(names, array)], "user string, v array<double>")


def _brute_lof(points, k):
    """Reference factor by all pairs; ties cut by the same (distance, id) order are avoided by the data."""
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    kdist = np.sort(d, axis=1)[:, k - 1]
    lrd = np.array([1.0 / (np.maximum(kdist[near[i]], d[i, near[i]]).mean() + 1e-10) for i in range(n)])
    return np.array([lrd[near[i]].mean() / lrd[i] for i in range(n)])


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    return np.round(np.vstack([rng.normal(0, 1, (160, 4)), rng.normal(8, 0.3, (60, 4)), [[30, 30, 30, 30], [-25, 0, 5, 9]]]), 9)


def test_lof_equals_all_pairs_with_many_cells_and_blocks(spark, cloud, monkeypatch):
    monkeypatch.setattr(lof, "CELL", 25)
    monkeypatch.setattr(lof, "LEAF", 4)
    monkeypatch.setattr(lof, "BLOCK", 7)
    monkeypatch.setattr(lof.math, "isqrt", lambda n: 1)
    got = {r["user"]: r["outlyingness"] for r in lof.outlyingness(_vectors(spark, cloud), len(cloud)).collect()}
    want = _brute_lof(cloud, 20)
    assert len(got) == len(cloud)
    assert np.allclose([got[f"u{i:04d}"] for i in range(len(cloud))], want, atol=1e-6)


def test_visited_leaves_stay_flat_as_points_grow():
    visits = {}
    for n in (20_000, 200_000):
        rng = np.random.default_rng(9)
        points = np.round(rng.lognormal(0, 1.5, (n, 3)), 9)
        leaves = lof.Leaves(points, np.arange(n).astype(str), np.ones(n, np.int64))
        ask = rng.choice(n, 2000, replace=False)
        rows, places, dist = leaves.nearest(points[ask], ask.astype(str), np.full(2000, np.inf), 20)
        visits[n] = leaves.visits / leaves.asked
        assert len(rows) == 2000 * 20 and (np.diff(leaves.bounds) <= lof.LEAF).all()
        for i in range(5):
            d = np.sort(np.delete(np.round(np.sqrt(((points - points[ask[i]]) ** 2).sum(1)), 12), ask[i]))[:20]
            assert np.array_equal(dist[rows == i], d)
    assert visits[200_000] < 1.3 * visits[20_000] and visits[200_000] < 200_000 / lof.LEAF / 10


def test_median_cuts_tell_rows_apart():
    x = np.array([[0.0, 0.0]] * 1 + [[5.0, i] for i in range(9)] + [[5.0 - 1e-9, 3.0]])
    cuts, parts = lof.median_cuts(x, 0, 1)
    assert sorted(map(len, parts)) == [1] * 11
    leaf = lof._leaf_of(x, cuts)
    assert all(parts[leaf[i]].tolist() == [i] for i in range(11))
    assert lof._leaf_of(x, []).tolist() == [0] * 11


def test_lof_counts_copies(spark):
    rng = np.random.default_rng(5)
    base = np.round(rng.normal(0, 1, (60, 3)), 9)
    array = np.vstack([base, np.repeat(base[:1], 30, axis=0)])
    got = {r["user"]: r["outlyingness"] for r in lof.outlyingness(_vectors(spark, array), len(array)).collect()}
    copies = {got[n] for n in got if n == "u0000" or int(n[1:]) >= 60}
    assert len(got) == 90 and len(copies) == 1 and abs(copies.pop() - 1.0) < 1e-6


def test_planted_outliers_lead_in_every_model(spark, cloud):
    vectors = _vectors(spark, cloud)
    n = len(cloud)
    planted = {f"u{n - 2:04d}", f"u{n - 1:04d}"}
    for model in ("isolation_forest", "local_outlier_factor"):
        rows = M.detect(vectors, n, model).orderBy(F.col("anomaly_score").desc()).limit(3).collect()
        assert planted <= {r["user"] for r in rows}, model
        assert rows[0]["anomaly_score"] == 100.0 and rows[0]["is_anomaly"]


def test_forest_does_not_depend_on_partitioning(spark, cloud):
    vectors = _vectors(spark, cloud)
    one = sorted(map(tuple, iforest.detect(vectors.coalesce(1), len(cloud)).collect()))
    many = sorted(map(tuple, iforest.detect(vectors.repartition(7), len(cloud)).collect()))
    assert one == many


def test_trees_draw_from_all_users(spark):
    rng = np.random.default_rng(6)
    vectors = _vectors(spark, np.round(rng.normal(size=(3000, 2)), 6))
    drawn = iforest.drawn_users(vectors, 3000, trees=40, sample=16)
    rows = drawn.collect()
    by_tree = {}
    for r in rows:
        by_tree.setdefault(r["tree"], set()).add(r["user"])
    assert len(by_tree) == 40 and {len(u) for u in by_tree.values()} == {16}
    want = vectors.selectExpr("user", "explode(sequence(0, 39)) AS tree").selectExpr("user", "tree", f"xxhash64({U.SEED}, tree, user) AS draw").toPandas()
    least = want.sort_values(["tree", "draw", "user"]).groupby("tree").head(16)
    assert {(t, u) for t, us in by_tree.items() for u in us} == set(zip(least["tree"], least["user"]))
    # Not only the users that come first by one hash: a pool of 640 would hold a fifth of all.
    first = set(vectors.selectExpr("user", f"xxhash64({U.SEED}, user) AS h").orderBy("h").limit(640).toPandas()["user"])
    assert len({r["user"] for r in rows} - first) > 300
    small = iforest.drawn_users(vectors.limit(5), 5, trees=3, sample=16).collect()
    assert len(small) == 15
    # A wrong number of users only costs another round.
    assert iforest.drawn_users(vectors, 3_000_000, trees=4, sample=16).count() == 64


def _exact_svm_scores(points, nu, gamma, steps):
    """The same conditional gradient on the full kernel matrix."""
    k = np.exp(-gamma * ((points[:, None] - points[None]) ** 2).sum(-1))
    n, cap = len(points), 1.0 / (nu * len(points))
    alpha = np.full(n, 1.0 / n)
    for _ in range(steps):
        target, left = np.zeros(n), 1.0
        for i in np.argsort(k @ alpha, kind="stable"):
            target[i] = min(cap, left)
            left -= target[i]
            if left <= 0:
                break
        way = alpha - target
        alpha = alpha - min(1.0, max(0.0, (alpha @ k @ way) / (way @ k @ way))) * way
    return k @ alpha


def test_svm_follows_the_kernel_solution(spark):
    rng = np.random.default_rng(11)
    points = np.round(np.vstack([rng.normal(0, 0.4, (150, 4)), [[6, 6, 6, 6], [-7, 0, 5, 9]]]), 9)
    n = len(points)
    vectors = _vectors(spark, points)
    weights = ocsvm.fit(vectors, n, 0.1, 0.25)
    got = {r["user"]: -r["outlyingness"] for r in ocsvm.outlyingness(vectors, weights, 0.25).collect()}
    want = _exact_svm_scores(points, 0.1, 0.25, 2000)
    values = np.array([got[f"u{i:04d}"] for i in range(n)])
    assert set(np.argsort(want)[:2]) == set(np.argsort(values)[:2]) == {150, 151}
    assert np.corrcoef(values, want)[0, 1] > 0.95


def test_svm_ends_within_its_gap_of_the_direct_solution(spark):
    rng = np.random.default_rng(12)
    points = np.round(np.vstack([rng.normal(0, 0.6, (200, 3)), [[5, 5, 5]]]), 9)
    n, nu, gamma = len(points), 0.1, 1 / 3
    found = ocsvm.fit_model(_vectors(spark, points), n, nu, gamma)
    z = ocsvm._mapper(3, gamma, U.SEED)(__import__("pandas").Series(points.tolist()))
    # Direct: projected gradient over the capped weights of all points.
    cap, alpha, k = 1 / (nu * n), np.full(n, 1 / n), z @ z.T
    step = 1 / np.linalg.eigvalsh(k)[-1]
    for _ in range(5000):
        x = alpha - step * (k @ alpha)
        low, high = x.min() - 1, x.max()
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(x - mid, 0, cap).sum() > 1 else (low, mid)
        alpha = np.clip(x - low, 0, cap)
    least, got = float(alpha @ k @ alpha), float(found.weights @ found.weights)
    assert least <= got + 1e-6 and got - least <= found.gap + 1e-6
    assert found.gap <= ocsvm.TOLERANCE * got and 1 < found.steps < 100
    scores = z @ found.weights
    assert np.corrcoef(scores, k @ alpha)[0, 1] > 0.999 and np.argmin(scores) == 200


def test_least_norm_mix():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(30, 4)) + 1.5
    share = ocsvm.least_norm(points, np.eye(30)[0], 1e-9)
    w = share @ points
    assert abs(share.sum() - 1) < 1e-9 and (share >= 0).all() and float((points @ w).min()) >= float(w @ w) - 1e-6


def test_svm_warns_when_it_runs_out_of_steps(spark, cloud):
    with pytest.warns(UserWarning, match="duality gap"):
        assert ocsvm.fit_model(_vectors(spark, cloud), len(cloud), 0.1, 0.25, steps=1).gap > 0


def test_svm_flags_about_nu(spark, cloud):
    assert 1 <= ocsvm.detect(_vectors(spark, cloud), len(cloud)).where("is_anomaly").count() <= 5


def test_too_few_users_are_skipped(spark, cloud):
    assert M.detect(_vectors(spark, cloud[:4]), 4, "isolation_forest").count() == 0


def test_flat_scores_are_fifty(spark):
    raw = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "user string, outlyingness double")
    assert {r["anomaly_score"] for r in U.scaled_scores(raw).collect()} == {50.0}


def test_vote_needs_two_models(spark):
    lists = spark.createDataFrame([("m1", "a", 90.0), ("m2", "a", 70.0), ("m1", "b", 99.0)], "model string, user string, anomaly_score double")
    rows = M.vote(lists).collect()
    assert [(r["user"], r["votes"], r["anomaly_score"]) for r in rows] == [("a", 2, 80.0)]


def test_constant_feature_scales_to_zero(spark):
    rows = [(f"u{i}", *[float(i) if c == "total_bytes" else 7.0 for c in S.FEATURE_NAMES]) for i in range(3)]
    frame = spark.createDataFrame(rows, "user string, " + ", ".join(f"{c} double" for c in S.FEATURE_NAMES))
    out = {r["user"]: r for r in U.standardise(frame).collect()}
    assert out["u0"]["total_packets"] == 0.0 and abs(out["u2"]["total_bytes"] - 1.224744871) < 1e-8


@pytest.mark.parametrize("buffered", [1_000_000, 10])
def test_large_scores_are_still_told_apart(spark, monkeypatch, buffered):
    from flowloom.operators.anomaly import features

    monkeypatch.setattr(features, "BUFFERED_USERS", buffered)

    raw = spark.createDataFrame([(f"u{i}", float(i) if i < 80 else 2e10 + i * 1e6) for i in range(100)], "user string, outlyingness double")
    assert features.flag_outliers(raw, 100).where("is_anomaly").count() == 1
