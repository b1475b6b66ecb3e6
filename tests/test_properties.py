"""Property tests against brute force on random small inputs."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fairgate.functions.pvalues import chi2_sf
from fairgate.operators import association, ordering, stats

SETTINGS = dict(max_examples=8, deadline=None,
                suppress_health_check=[HealthCheck.function_scoped_fixture])

values = st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=80)


@settings(**SETTINGS)
@given(a=values, b=values)
def test_running_sums_equal_cumsum(spark, a, b):
    rows = [("a", float(v), 1) for v in a] + [("b", float(v), 2) for v in b]
    df = spark.createDataFrame(rows, "g string, v double, w int").groupBy("g", "v").sum("w") \
        .withColumnRenamed("sum(w)", "w")
    got = {(r.g, r.v): (r.cum_w, r.tot_w) for r in ordering.running_sums(df, "v", ["w"], ["g"]).collect()}
    for g, vals, w in (("a", a, 1), ("b", b, 2)):
        total = w * len(vals)
        for v in set(vals):
            assert got[(g, float(v))] == (w * sum(1 for x in vals if x <= v), total)


@settings(**SETTINGS)
@given(a=values, q=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]))
def test_quantile_equals_numpy(spark, a, q):
    df = spark.createDataFrame([("x", float(v)) for v in a], "column string, value double")
    got = ordering.exact_quantiles(df, [q]).first().quantile
    assert got == pytest.approx(float(np.percentile(a, q * 100)), abs=1e-9)


tables = st.integers(min_value=1, max_value=4).flatmap(
    lambda r: st.integers(min_value=1, max_value=4).flatmap(
        lambda c: st.lists(st.lists(st.integers(min_value=0, max_value=30), min_size=c, max_size=c),
                           min_size=r, max_size=r)))


@settings(**SETTINGS)
@given(t=tables)
def test_chi2_equals_textbook(spark, t):
    arr = np.asarray(t, dtype=float)
    arr = arr[arr.sum(1) > 0][:, arr.sum(0) > 0] if arr.sum() > 0 else arr
    if arr.size == 0 or arr.sum() == 0:
        return
    rows = [("t", f"a{i}", f"b{j}", int(v)) for i, row in enumerate(arr)
            for j, v in enumerate(row) if v > 0]
    got = stats.chi2_tests(spark.createDataFrame(rows, "column string, a string, b string, n long")).first()
    r, c = arr.sum(1), arr.sum(0)
    e = np.outer(r, c) / arr.sum()
    dof = (arr.shape[0] - 1) * (arr.shape[1] - 1)
    d = np.abs(arr - e)
    if dof == 1:
        d = d - np.minimum(0.5, d)
    want = 0.0 if dof == 0 else float((d ** 2 / e).sum())
    assert got.dof == dof
    assert got.chi2 == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert got.p_value == pytest.approx(chi2_sf(want, dof) if dof else 1.0, abs=1e-9)


@settings(**SETTINGS)
@given(a=values, b=values)
def test_ks_equals_brute_force(spark, a, b):
    da = spark.createDataFrame([(float(v),) for v in a], "v double")
    db = spark.createDataFrame([(float(v),) for v in b], "v double")
    got = association.ks_drift(da, db).first().statistic
    sa, sb = np.sort(a), np.sort(b)
    want = max(abs(np.searchsorted(sa, v, "right") / len(a) - np.searchsorted(sb, v, "right") / len(b))
               for v in set(a) | set(b))
    assert got == pytest.approx(want, abs=1e-12)


@settings(**SETTINGS)
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)),
                               st.one_of(st.none(), st.sampled_from(["a", "b"]))),
                     min_size=0, max_size=60))
def test_duplicates_equal_brute_force(spark, rows):
    from fairgate.operators import profile
    df = spark.createDataFrame(rows, "x int, s string")
    r = profile.duplicate_rows(df).first()
    assert (r.n_rows, r.n_distinct, r.n_duplicates) == (len(rows), len(set(rows)),
                                                        len(rows) - len(set(rows)))
