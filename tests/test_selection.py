"""Selection and distribution gaps by histogram refinement; exact KS p-values."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairgate.functions.pvalues import KS_EXACT_MOST, ks_p_value
from fairgate.operators import association, ordering, reweight

HARD = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, math.nextafter(2.0 ** -1022, 0), 1.7976931348623157e308, -1.7976931348623157e308,
        math.inf, -math.inf, 1.0, math.nextafter(1, 0), math.nextafter(1, 2)]


def test_ordered_bits_are_the_bits(spark):
    raw = np.random.default_rng(1).integers(0, 2 ** 64, 3000, dtype=np.uint64).view(np.float64)
    powers = 2.0 ** np.arange(-1074, 1024)
    v = np.concatenate([raw[np.isfinite(raw)], HARD, powers, np.nextafter(powers[4:], 0), -np.nextafter(powers, np.inf)[:-1]])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    got = [r[0] for r in ordering.ordered(df, "v").orderBy("i").select("_k").collect()]
    bits = np.abs(v).view(np.int64)
    assert got == np.where(v < 0, -bits, bits).tolist()


def test_quantiles_of_many_groups(spark):
    rng = np.random.default_rng(2)
    groups = {}
    for n in [*range(1, 120), 1000, 3001]:
        v = rng.normal(size=n) * 10.0 ** rng.integers(-30, 30, n)
        v[rng.random(n) < 0.3] = 7.25                      # a third of the rows hold one value
        groups[n] = v
    groups[0] = np.array([x for x in HARD if math.isfinite(x) and abs(x) < 1e300])
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [(1, None), (2, math.nan)], "column int, value double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.731, 1.0]
    got = {(r.column, r.q): r.quantile for r in ordering.exact_quantiles(df, probs).collect()}
    assert len(got) == len(groups) * len(probs)
    for (g, q), x in got.items():
        s, h = np.sort(groups[g]), (len(groups[g]) - 1) * q
        lo, hi = s[math.floor(h)], s[math.ceil(h)]
        assert x == lo + (h - math.floor(h)) * (hi - lo), (g, q)


def test_quantiles_of_integers_beyond_doubles_and_nothing(spark):
    big = [2 ** 62 + i for i in range(9)] + [-2 ** 62]
    df = spark.createDataFrame([("a", x) for x in big], "column string, value bigint")
    found = ordering._descend(df.withColumnRenamed("value", "_v").withColumn("_k", F.col("_v")), ["column"],
                              ordering.shared(ordering.histogram(df.withColumnRenamed("value", "_v").withColumn("_k", F.col("_v")), ["column"], 0, None, *ordering._value_aggs())),
                              spark.createDataFrame([("a", r) for r in range(10)], "column string, rank bigint"))
    assert [r._v for r in found.orderBy("rank").collect()] == sorted(big)
    assert ordering.exact_quantiles(df.limit(0), [0.5]).count() == 0


def test_a_rank_outside_the_rows_is_an_error(spark):
    df = spark.range(5).select(F.col("id").alias("_v"), F.col("id").alias("_k"))
    cells = ordering.shared(ordering.histogram(df, [], 0, None, *ordering._value_aggs()))
    with pytest.raises(RuntimeError, match="outside"):
        ordering._descend(df, [], cells, spark.range(1).select(F.lit(5).cast("bigint").alias("rank"))).collect()


@pytest.mark.parametrize("n, seed", [(200, 1), (1000, 42), (1000, 2), (1, 3), (20, 4), (39, 5), (4999, 6)])
def test_flip_takes_the_first_of_the_hash_order(spark, n, seed):
    df = spark.range(n).select(F.col("id"), F.lit(0).alias("y"))
    out = {r.id for r in reweight.flip_labels(df, "y", ["id"], share=0.05, seed=seed).where("y = 1").collect()}
    by = sorted(range(n), key=lambda i: hashlib.md5(f"{i}:{seed}".encode()).hexdigest())
    assert out == set(by[:int(0.05 * n)])


def test_every_rank_of_a_hash_order(spark):
    """All cut-offs of 50 seeded orders at once, as ranks of groups."""
    sizes = {seed: 7 * seed + 1 for seed in range(50)}
    rows = spark.createDataFrame([(s, i) for s, n in sizes.items() for i in range(n)], "seed int, i int")
    score = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("i").cast("string"), F.col("seed").cast("string"))), 1, 15), 16, 10).cast("bigint")
    keyed = rows.select("seed", score.alias("_v")).withColumn("_k", F.col("_v"))
    cells = ordering.shared(ordering.histogram(keyed, ["seed"], 0, None, *ordering._value_aggs()))
    ranks = rows.select("seed", F.col("i").cast("bigint").alias("rank"))
    got = {(r.seed, r["rank"]): r._v for r in ordering._descend(keyed, ["seed"], cells, ranks).collect()}
    for s, n in sizes.items():
        order = sorted(int(hashlib.md5(f"{i}:{s}".encode()).hexdigest()[:15], 16) for i in range(n))
        assert [got[s, r] for r in range(n)] == order


def gap(a, b):
    both = np.concatenate([a, b])
    return max(abs((a <= x).sum() / len(a) - (b <= x).sum() / len(b)) for x in both)


def test_gap_by_bounds_equals_every_value(spark):
    rng = np.random.default_rng(3)
    cases = {"shift": (rng.normal(size=900), rng.normal(0.1, size=700)), "same": (rng.normal(size=500), rng.normal(size=400)),
             "wide": (10.0 ** rng.uniform(-200, 200, 300), 10.0 ** rng.uniform(-200, 150, 200)),
             "close": (1 + rng.integers(0, 50, 400) * 2.0 ** -50, 1 + rng.integers(0, 60, 300) * 2.0 ** -50),
             "ties": (rng.integers(-3, 3, 300).astype(float), rng.integers(-3, 4, 500).astype(float)),
             "apart": (rng.normal(size=30), rng.normal(100, size=20)), "one": (np.array([1.0]), np.array([1.0]))}
    rows = [(c, float(x), 1 - side, side) for c, pair in cases.items() for side, v in enumerate(pair) for x in v]
    df = ordering.ordered(spark.createDataFrame(rows, "column string, value double, _a int, _b int"), "value")
    got = {r.column: r for r in association.ecdf_gap(df, "column", "value").collect()}
    for c, (a, b) in cases.items():
        assert got[c].statistic == gap(a, b) and (got[c].n1, got[c].n2) == (len(a), len(b)), c


def test_no_range_shuffle_in_the_drift_plan(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    rows = ordering.ordered(df.select(F.lit("x").alias("column"), F.col("x").alias("value"), F.lit(1).alias("_a"), F.lit(0).alias("_b")), "value")
    plan = ordering.histogram(rows, ["column"], 0, None, F.sum("_a").alias("_a"))._jdf.queryExecution().toString().lower()
    assert "rangepartitioning" not in plan and "sort " not in plan


def outside(m, n, h):
    """Share of the lattice paths from (0, 0) to (m, n) that reach |i n - j m| >= h, by counting."""
    paths = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m + 1):
        for j in range(n + 1):
            if abs(i * n - j * m) < h:
                paths[i][j] = 1 if i == j == 0 else (paths[i - 1][j] if i else 0) + (paths[i][j - 1] if j else 0)
    return 1 - paths[m][n] / math.comb(m + n, m)


def test_exact_ks_equals_path_counting(spark):
    cases = [(m, n, h) for m in range(1, 13) for n in range(1, 13) for h in range(0, m * n + 1)]
    df = spark.createDataFrame([(m, n, h / (m * n)) for m, n, h in cases], "n1 bigint, n2 bigint, d double").repartition(8)
    got = {(r.n1, r.n2, round(r.d * r.n1 * r.n2)): r.p for r in df.withColumn("p", ks_p_value(F.col("d"), F.col("n1"), F.col("n2"))).collect()}
    assert len(got) == len(cases)
    assert max(abs(got[c] - outside(*c)) for c in cases) < 1e-12


def test_exact_and_asymptotic_ks_meet(spark):
    n = KS_EXACT_MOST
    df = spark.createDataFrame([(n, n - 1000, 0.02), (n + 1, n - 1000, 0.02), (0, 5, 0.5), (5, 0, None)], "n1 bigint, n2 bigint, d double")
    exact, large, none, null = (r.p for r in df.select(ks_p_value(F.col("d"), F.col("n1"), F.col("n2")).alias("p")).collect())
    assert exact == pytest.approx(large, rel=0.03) and none is None and null is None


def test_correlations_equal_encoded_columns(spark):
    """Against label codes put into the rows one by one, as pandas would."""
    import pandas as pd
    rng = np.random.default_rng(5)
    n = 700
    pdf = pd.DataFrame({"g": rng.choice(["b", "a", "ü", None, "nan"], n), "h": [f"v{x}" for x in rng.integers(0, 200, n)], "one": ["k"] * n,
                        "x": rng.normal(size=n) + 1e6, "c": [0.1] * n, "k": rng.integers(0, 9, n)})
    pdf.loc[rng.random(n) < 0.2, "x"] = None
    coded = pdf.copy()
    for c in ("g", "h", "one"):
        text = pdf[c].map(lambda v: "nan" if v is None else v)
        coded[c] = text.map({v: i for i, v in enumerate(sorted(set(text)))}).astype(float)
    coded["h"] += 0.0
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)], "g string, h string, one string, x double, c double, k bigint").repartition(4)
    out = association.correlation_pairs(df, ["g", "x", "one"])
    got = {(r.protected_attribute, r.proxy_variable): r.r for r in out.collect()}
    assert len(got) == 15
    for (p, o), r in got.items():
        a, b = coded[p], coded[o]
        both = a.notna() & b.notna()
        if "one" in (p, o) or "c" in (p, o):
            assert r is None or p != "one" and o != "one" and r is None
        else:
            assert r == pytest.approx(np.corrcoef(a[both], b[both])[0, 1], abs=1e-9)
    assert association.correlation_pairs(df.limit(0), ["g"]).where("r is not null").count() == 0


def test_no_code_is_joined_to_base_rows(spark):
    df = spark.range(100).select(F.concat(F.lit("v"), F.col("id") % 7).alias("t"), F.col("id").alias("x"))
    plan = association.correlation_pairs(df, ["t"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (0, 100" not in plan             # all that is left to run reads aggregated rows
