import numpy as np
import pytest

from fairgate.llm.vptree import VpTree, nearest


def brute(rows, queries, k):
    out = []
    fine = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for i in queries:
        if i in fine:
            near = sorted((float(np.sqrt(((fine[i] - v) ** 2).sum())), j) for j, v in fine.items() if j != i and len(v) == len(fine[i]))[:k]
            out += [(i, r + 1, j, round(d, 9)) for r, (d, j) in enumerate(near)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in df.collect())


def test_exact_with_ties_odd_vectors_and_many_shards(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 4).astype(np.float32)]) for i in range(400)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 4), (1003, [float("nan"), 1.0, 1.0, 1.0]), (1004, [None, 1.0, 1.0, 1.0]),
             (1005, [float("inf"), 0.0, 0.0, 1.0]), (1006, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id bigint, embedding array<float>, shard string, dim string").repartition(4)
    for shard_rows in (40, 5000):
        out = nearest(df, df.where("vec_id % 100 = 0"), k=10, shard_rows=shard_rows, block_rows=2)
        assert got(out) == brute(rows, [i for i, _ in rows if i is not None and i % 100 == 0], 10)


def test_a_third_of_the_vectors_equal(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=3).astype(np.float32)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert got(nearest(df, df.where("vec_id % 100 = 0"), k=10, shard_rows=100)) == brute(rows, [0, 100, 200], 10)


def test_fewer_candidates_repeats_and_nothing(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.vec_id, round(r.score, 6)) for r in nearest(df, df.where("vec_id % 100 = 0")).collect()] == [(0, 7, 1.414214)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_factor_trades_recall_for_work():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    points = centres[rng.integers(0, 12, 1500)] + 0.1 * rng.normal(size=(1500, 8))
    ids = np.arange(1500)
    tree = VpTree.build(ids, points)
    q = points[:50]
    true = []
    for i, x in enumerate(q):
        d = np.sqrt(((points - x) ** 2).sum(axis=1))
        d[i] = np.inf
        true.append(set(np.lexsort((ids, d))[:10].tolist()))
    recall = {f: np.mean([len(set(row) & t) / 10 for row, t in zip(tree.search(ids[:50], q, 10, f)[0].tolist(), true)]) for f in (1.0, 0.7, 0.05)}
    assert recall[1.0] == 1 and 0.9 <= recall[0.7] <= 1 and recall[0.05] < recall[1.0]


def test_parts_of_several_trees_and_bands_of_several_blocks(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=5).astype(np.float32)]) for i in range(600)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(20)]                     # ties across trees
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    out = nearest(df, df.where("vec_id % 20 = 0"), k=10, shard_rows=3, block_rows=2)
    assert got(out) == brute(rows, [i for i, _ in rows if i % 20 == 0], 10)


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e20])
def test_a_tree_goes_on_from_the_best_of_others(scale):
    rng = np.random.default_rng(8)
    points = (rng.normal(size=(3000, 12)) * scale).astype(np.float32).astype(np.float64)
    points[::300] = points[1]
    points[5] *= 1e4                              # one long vector beside short ones
    ids, q = np.arange(3000), points[:70]
    own = ids[:70]
    best = (np.full((70, 10), np.iinfo(np.int64).max), np.full((70, 10), np.inf))
    for i in range(3):
        VpTree.build(ids[i::3], points[i::3], leaf=40).search(own, q, 10, 1.0, best)
    for i, x in enumerate(q):
        d = np.sqrt(((points - x) ** 2).sum(axis=1))
        d[i] = np.inf
        near = np.lexsort((ids, d))[:10]
        assert best[0][i].tolist() == near.tolist() and best[1][i].tolist() == d[near].tolist()
