import numpy as np
import pytest

from fairgate.operators import forest, minimise


@pytest.mark.parametrize("target", ["cls", "num", "txt"])
def test_a_forest_from_counts_agrees_with_spark_ml(spark, monkeypatch, target):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        a, b, c = float(rng.normal()), int(rng.integers(0, 5)), str(rng.integers(0, 3))
        y = {"cls": "xyz"[(a > 0) + (b > 2)], "num": 5 * a + b + float(rng.normal()) / 10, "txt": f"t{int(200 * a)}"}[target]
        rows.append((a if i % 50 else None, b, c, y if i % 70 else None))
    df = spark.createDataFrame(rows, f"a double, b int, c string, y {'double' if target == 'num' else 'string'}").repartition(3)

    def found(**more):
        p = minimise.ForestParams(num_trees=60, max_depth=4, **more)
        return {r.feature: r.importance for r in minimise.feature_importance(df, "y", p).collect()}

    theirs = found()
    monkeypatch.setattr(minimise, "_forest", None)               # rows times trees beyond the bound: not Spark ML's
    monkeypatch.setattr(forest, "BLOCK_BYTES", 3000)             # several blocks of nodes
    ours = found(counted_rows=1000)
    assert sum(ours.values()) == pytest.approx(1.0)
    assert all(abs(ours[f] - theirs[f]) < 0.08 for f in ours), (ours, theirs)
    if target == "cls":
        assert ours == found(counted_rows=1000)


def test_nothing_to_split(spark):
    df = spark.range(50).selectExpr("1 as x", "cast(null as double) as z", "if(id % 2 = 0, 'a', 'b') as y")
    assert {r.importance for r in minimise.feature_importance(df, "y", minimise.ForestParams(num_trees=3, counted_rows=1)).collect()} == {0.0}


def test_bins_are_cut_at_few_values_or_quantiles(spark):
    df = spark.range(1000).selectExpr("cast(if(id < 3, id, 7) as double) as _f0", "cast(id as double) as _f1", "cast(null as double) as _f2")
    few, many, none = forest.split_points(df, ["_f0", "_f1", "_f2"], 8, [4, 1000, 0])
    assert few.tolist() == [0, 1, 2] and len(none) == 0
    assert len(many) == 7 and np.abs(many - np.arange(125, 1000, 125)).max() < 5


def test_open_nodes_are_counted_and_split_as_by_hand():
    rng = np.random.default_rng(3)
    n, bins, classes, n_features = 500, 6, 3, 4
    values, y = rng.integers(0, bins, (n_features, n)), rng.integers(0, classes, n)
    weights = rng.integers(0, 3, n).astype(float)
    cells = (values * classes + y).astype(np.uint8).ravel()
    # the root parts by feature 2 after bin 1; only its right child is open
    feature, cut = np.array([0, 2]), np.array([0, 2 * classes], dtype=np.int32)
    slots, subset = np.array([-1, -1, -1, 0]), np.array([[3, 0]])
    sums = np.zeros((1, 2, bins * classes))
    forest._open_counts(cells, n, 1, (feature, cut, slots, subset), bins * classes, weights, None, sums)
    there = values[2] > 1
    expected = np.zeros((2, bins, classes))
    for j, f in enumerate(subset[0]):
        np.add.at(expected[j], (values[f, there], y[there]), weights[there])
    assert sums.reshape(expected.shape).tolist() == expected.tolist()

    def rest(counts):
        return (counts ** 2).sum() / counts.sum() if counts.sum() else 0.0

    by_hand = {(j, b): rest(expected[j, :b + 1].sum(0)) + rest(expected[j, b + 1:].sum(0)) - rest(expected[j].sum(0))
               for j in range(2) for b in range(bins - 1)}
    j, b, gain, *pure = forest._best_splits(sums.reshape(1, 2, 1, bins, classes))[0].tolist()
    assert gain == pytest.approx(max(by_hand.values())) and by_hand[j, b] == pytest.approx(gain) and pure == [0, 0]


def test_a_governance_run_with_the_counted_forest_keeps_no_rows_in_memory(spark, monkeypatch):
    from fairgate.plans import catalog
    from fairgate.plans.pipeline import run_governance

    def persisted(*args, **kwargs):
        raise AssertionError("rows are persisted")

    df = catalog.governed_orders(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(minimise, "_forest", None)
    monkeypatch.setattr(type(df), "persist", persisted)
    result = run_governance(df, catalog.GOV_SPEC, bias_on="minimised",
                            forest=minimise.ForestParams(num_trees=10, max_depth=4, counted_rows=1000))
    found = {r.feature: r.importance for r in result.feature_importance.collect()}
    assert found["o_orderstatus"] > 0.8 and result.verdict.count() == 1
    assert {r.feature for r in result.exclusion_log.collect()} >= {f for f, v in found.items() if v < 0.01}
