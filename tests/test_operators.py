"""Unit tests on small hand-made frames: edge cases, thresholds at
equality, zero denominators, and properties (SURVEY §5)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairgate.functions.pvalues import chi2_sf
from fairgate.operators import (association, encode, expect, fairness, minimise, ordering,
                                pii, profile, representation, reweight, stats)
from fairgate.spec import DatasetSpec, match_protected, matches_by_attribute, protected_for_domain
from tests.test_selection import outside


# -- spec / matching --------------------------------------------------------------

def test_domain_defaults():
    assert protected_for_domain("credit_scoring") == ["sex", "race", "age", "marital-status"]
    assert protected_for_domain("unknown") == ["sex", "race", "age"]


def test_match_modes():
    cols = ["Age", "marital-status", "Marital Status", "mortgage", "sex"]
    assert match_protected(cols, ["age"]) == ["Age", "mortgage"]          # substring hit
    assert match_protected(cols, ["age"], "token") == ["Age"]
    assert match_protected(cols, ["marital-status"], "column") == []      # column side only
    assert match_protected(cols, ["marital-status"], "both") == ["marital-status", "Marital Status"]
    assert match_protected(cols, ["marital-status"], "dash") == ["marital-status"]
    assert match_protected(cols, ["Sex"], "exact") == ["sex"]
    assert matches_by_attribute(["sex", "sex_age"], ["sex", "age"]) == [("sex", "sex"),
                                                                        ("sex", "sex_age")]


# -- ordering primitive -------------------------------------------------------------

def test_running_sums_matches_cumsum(spark):
    rng = random.Random(7)
    rows = [(g, float(v), rng.randint(1, 5)) for g in "ab" for v in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    got = {(r.g, r.v): r.cum_w for r in
           ordering.running_sums(df, "v", ["w"], ["g"], buckets=7).collect()}
    for g in "ab":
        acc = 0
        for _, v, w in sorted(x for x in rows if x[0] == g):
            acc += w
            assert got[(g, v)] == acc


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=301).round(2).tolist() + [None, None]
    df = spark.createDataFrame([("x", v) for v in vals], "column string, value double")
    out = {r.q: r.quantile for r in ordering.exact_quantiles(df, [0.0, 0.25, 0.5, 0.7, 1.0]).collect()}
    clean = np.array([v for v in vals if v is not None])
    for q in out:
        assert out[q] == pytest.approx(np.percentile(clean, q * 100), abs=1e-12)


def test_ordinal_codes_code_point_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("B",), ("é",), ("a",), (None,)], "v string")
    codes = encode.label_codes(df, ["v"])
    got = {r.value: r.code for r in codes.collect()}
    assert got == {"B": 0, "a": 1, "b": 2, "nan": 3, "é": 4}


# -- chi-square ------------------------------------------------------------------------

def _textbook_chi2(table):
    table = np.asarray(table, dtype=float)
    r, c = table.sum(1), table.sum(0)
    n = table.sum()
    e = np.outer(r, c) / n
    dof = (table.shape[0] - 1) * (table.shape[1] - 1)
    if dof == 0:
        return 0.0, 0
    d = np.abs(table - e)
    if dof == 1:
        d = d - np.minimum(0.5, d)
    return float((d ** 2 / e).sum()), dof


def _counts_df(spark, table, name="t"):
    rows = [(name, f"a{i}", f"b{j}", int(v)) for i, row in enumerate(table)
            for j, v in enumerate(row) if v > 0]
    return spark.createDataFrame(rows, "column string, a string, b string, n long")


@pytest.mark.parametrize("table", [
    [[10, 20], [30, 5]],            # 2x2: Yates
    [[12, 0], [3, 9]],              # 2x2 with an empty cell
    [[5, 0, 7], [0, 9, 1], [4, 4, 0]],  # empty cells in a larger table
    [[3, 4, 5, 6]],                 # one row: dof 0
    [[1, 1], [1, 1]],               # |O-E| = 0 < 0.5
])
def test_chi2_matches_textbook(spark, table):
    row = stats.chi2_tests(_counts_df(spark, table)).first()
    chi2, dof = _textbook_chi2(table)
    assert row.dof == dof
    assert row.chi2 == pytest.approx(chi2, rel=1e-12, abs=1e-12)
    assert row.p_value == pytest.approx(chi2_sf(chi2, dof) if dof else 1.0, abs=1e-12)


def test_chi2_invariant_under_label_permutation(spark):
    table = [[7, 3, 9], [2, 8, 4]]
    perm = [[4, 8, 2], [9, 3, 7]]
    a = stats.chi2_tests(_counts_df(spark, table)).first().chi2
    b = stats.chi2_tests(_counts_df(spark, perm)).first().chi2
    assert a == pytest.approx(b, rel=1e-12)


def test_chi2_sf_known_values():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-12)
    assert chi2_sf(0.0, 4) == 1.0
    # survey probes on documents x labels at sf0.01
    assert chi2_sf(0.909586, 3) == pytest.approx(0.8231, abs=1e-4)
    assert chi2_sf(22.370569, 19) == pytest.approx(0.2662, abs=1e-4)


def test_chi2_p_expression_matches_python(spark):
    rows = [(x, d) for d in (1, 2, 3, 7, 19, 40) for x in (0.01, 0.5, 3.0, 20.0, 80.0, 400.0)]
    df = spark.createDataFrame(rows, "x double, d long")
    from fairgate.functions.pvalues import chi2_p_value
    for r in df.select("x", "d", chi2_p_value(F.col("x"), F.col("d")).alias("p")).collect():
        assert r.p == pytest.approx(chi2_sf(r.x, r.d), abs=1e-10)


def test_missingness_bias_detects_mnar(spark):
    rows = [(i, "a" if i % 2 else "b", None if i % 2 else float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, y string, x double")
    out = stats.missingness_bias(df, "y").collect()
    assert [r.column for r in out] == ["x"] and out[0].mechanism == "MNAR"


# -- representation / profile ------------------------------------------------------------

def test_underrepresented_strict_threshold_and_null_denominator(spark):
    # 20 groups of 5 rows = 5.0% each -> none flagged; one group of 4 plus a NULL
    rows = [(f"g{i}",) for i in range(20) for _ in range(5)]
    df = spark.createDataFrame(rows, "g string")
    assert representation.underrepresented_groups(df).count() == 0
    df2 = spark.createDataFrame(rows[:-1] + [(None,)], "g string")
    flagged = representation.underrepresented_groups(df2).collect()
    assert [(r.group, r["count"], r.percentage) for r in flagged] == [("g19", 4, 4.0)]


def test_representation_shares_sum_to_one(spark):
    rows = [(g, i % 2) for i, g in enumerate("aaabbbbcdd" * 3)] + [(None, 1)]
    df = spark.createDataFrame(rows, "g string, y int")
    out = representation.representation(df, ["g"], "y").collect()
    assert sum(r.share for r in out) == pytest.approx(1.0)
    c = [r for r in out if r.group == "c"][0]
    assert c.warning is None and c.share == pytest.approx(3 / 30)


def test_text_target_needs_positive_label(spark):
    df = spark.createDataFrame([("a", "yes"), ("b", "no")], "g string, y string")
    with pytest.raises(TypeError):
        representation.outcome_rate_by_group(df, "y", ["g"])
    out = representation.outcome_rate_by_group(df, "y", ["g"], positive_label="yes")
    assert {r.group: r.outcome_rate for r in out.collect()} == {"a": 1.0, "b": 0.0}


def test_duplicates_treat_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "a int, b string")
    r = profile.duplicate_rows(df).first()
    assert (r.n_rows, r.n_distinct, r.n_duplicates) == (4, 2, 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert profile.missing_total(df).first().missing_pct is None
    assert profile.duplicate_rows(df).first().n_duplicates == 0
    exps = {r.expectation: r.success for r in expect.expectations(df).collect()}
    assert exps["Row count valid"] is False


def test_numeric_text_grammar(spark):
    good = ["", " 4 ", "1e3", "+5", ".5", "5.", "inf", "Infinity", "-2.5E-3"]
    bad = ["1_000", "1,000", "0x10", "1d", "True", "NaN", "nan", "NA", "  "]
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    from fairgate.functions.text import NUMERIC_TEXT_PATTERN
    got = {r.v: r.ok for r in df.select("v", F.col("v").rlike(NUMERIC_TEXT_PATTERN).alias("ok")).collect()}
    assert all(got[v] for v in good)
    assert not any(got[v] for v in bad)


def test_outliers_counted_over_all_rows(spark):
    vals = [1.0] * 40 + [2.0] * 40 + [100.0] * 10 + [None] * 10
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = profile.outliers(df, ["x"]).first()
    assert r.n_outliers == 10 and r.n_rows == 100
    assert r.warning == "x: 10.0% outliers"


def test_quality_rollup_rules(spark):
    df = spark.createDataFrame([("1", 1.0), ("1", 1.0), ("2", None)], "code string, v double")
    roll = profile.quality_rollup(profile.quality_checks(df)).first()
    assert roll.total_checks == 3
    assert roll.failed == 2          # duplicates + numeric-as-text
    assert roll.passed == 1          # missing 1/6 < 30%


# -- fairness ----------------------------------------------------------------------------

def test_fairness_zero_division_and_properties(spark):
    rows = [("a", 1, 1), ("a", 0, 0), ("a", 1, 0), ("b", 0, 0), ("b", 0, 0)]
    df = spark.createDataFrame(rows, "g string, t int, p int")
    by = {r.group: r for r in fairness.group_metrics(df, "t", "p", ["g"]).collect()}
    assert by["b"].precision == 0.0 and by["b"].recall == 0.0 and by["b"].f1_score == 0.0
    assert by["a"].accuracy == pytest.approx(2 / 3)
    summ = fairness.metric_summary(df, "t", "p", ["g"]).collect()
    for r in summ:
        assert r.difference >= 0
        assert r.ratio is None or 0 <= r.ratio <= 1
    sel = [r for r in summ if r.metric == "selection_rate"][0]
    assert sel.ratio == 0.0                       # 0 / (1/3)
    viol = fairness.violations(fairness.metric_summary(df, "t", "p", ["g"])).collect()
    assert any(v.metric == "demographic_parity" for v in viol)
    assert fairness.fairness_summary(fairness.violations(
        fairness.metric_summary(df, "t", "p", ["g"]))).first().status == "CONCERNS"


def test_fairness_null_ratio_is_no_violation(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 1, 0)], "g string, t int, p int")
    s = fairness.metric_summary(df, "t", "p", ["g"])
    sel = s.where("metric = 'selection_rate'").first()
    assert sel.ratio is None
    assert fairness.violations(s).where("metric = 'demographic_parity'").count() == 0


# -- proxies / drift ------------------------------------------------------------------------

def test_constant_column_gives_null_correlation(spark):
    df = spark.createDataFrame([(i, 5.0, float(2 * i)) for i in range(10)], "sex int, c double, y double")
    got = {r.proxy_variable: r.r for r in association.correlation_pairs(df, ["sex"]).collect()}
    assert got["c"] is None and got["y"] == pytest.approx(1.0)


def test_pairwise_complete_correlation(spark):
    xs = [1.0, 2.0, 3.0, 4.0, None, 6.0]
    ys = [2.0, 4.1, 6.2, None, 10.0, 12.5]
    df = spark.createDataFrame(list(zip(xs, ys)), "age double, y double")
    r = association.correlation_pairs(df, ["age"]).first().r
    pairs = [(x, y) for x, y in zip(xs, ys) if x is not None and y is not None]
    assert r == pytest.approx(np.corrcoef(*zip(*pairs))[0, 1], rel=1e-12)


def _brute_ks(a, b):
    vals = sorted(set(a) | set(b))
    a, b = np.sort(a), np.sort(b)
    return max(abs(np.searchsorted(a, v, "right") / len(a) - np.searchsorted(b, v, "right") / len(b))
               for v in vals)


def test_ks_statistic_and_symmetry(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=400).round(1)
    b = (rng.normal(size=300) + 0.3).round(1)
    da = spark.createDataFrame([(float(x),) for x in a], "v double")
    db = spark.createDataFrame([(float(x),) for x in b], "v double")
    ab = association.ks_drift(da, db).first()
    ba = association.ks_drift(db, da).first()
    assert ab.statistic == pytest.approx(_brute_ks(a, b), abs=1e-12)
    assert ab.statistic == pytest.approx(ba.statistic, abs=1e-12)
    assert ab.p_value == pytest.approx(outside(300, 400, round(ab.statistic * 400 * 300)), abs=1e-9)


def test_drift_status(spark):
    assert association.drift_status(None) == "SKIPPED"


# -- PII -------------------------------------------------------------------------------------

def test_pii_detection_and_idempotent_redaction(spark):
    texts = ["mail me at jane.doe@example.org now", "card 4111 1111 1111 1111 ok",
             "bad card 4111 1111 1111 1112", "ip 10.0.0.1 and +1 (555) 123-4567",
             "ssn 123-45-6789, see https://x.org/a?b=1", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    found = {r.pii_type: r.n_detections for r in pii.pii_findings(df, ["t"]).collect()}
    assert found == {"EMAIL_ADDRESS": 1, "CREDIT_CARD": 1, "IP_ADDRESS": 1, "PHONE_NUMBER": 1,
                     "US_SSN": 1, "URL": 1}
    red = pii.anonymize(df)
    again = pii.anonymize(red)
    a = [r.t for r in red.orderBy("id").collect()]
    assert a == [r.t for r in again.orderBy("id").collect()]
    assert a[0] == "mail me at <EMAIL_ADDRESS> now"
    assert a[1] == "card <CREDIT_CARD> ok"
    assert "4111 1111 1111 1112" in a[2]
    assert a[5] is None


# -- encoders / minimisation ------------------------------------------------------------------

def test_bucket_edges(spark):
    df = spark.createDataFrame([(29,), (30,), (50,), (51,), (None,)], "age int")
    got = [r.g for r in df.select(encode.bucket("age").alias("g")).collect()]
    assert got == ["<30", "30-50", "30-50", ">50", None]


def test_binarise_null_is_zero(spark):
    df = spark.createDataFrame([(">50K",), ("<=50K",), (None,)], "income string")
    assert [r.y for r in df.select(encode.binarise("income", ">50K").alias("y")).collect()] == [1, 0, 0]


def test_classify_target_wins(spark):
    df = spark.createDataFrame([], "age int, sex string, `marital-status` string, income int")
    spec = DatasetSpec(target="age", protected_attributes=("age", "sex", "marital status"))
    got = {r.feature: r["class"] for r in minimise.classify_features(df, spec).collect()}
    assert got == {"age": "essential", "sex": "prohibited", "marital-status": "prohibited",
                   "income": "optional"}


def test_select_features(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert minimise.select_features(df, ["c", "a", "zz"], ["b", "yy"]).columns == ["c", "a"]


# -- planted bias -------------------------------------------------------------------------------

def test_planted_bias_raises_favoured_group(spark):
    rows = [(i, "M" if i % 2 else "F", float((i * 37) % 101)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, sex string, s double")
    fav = F.col("sex") == "M"
    cmp = reweight.bias_comparison(df, F.col("s"), {"none": reweight.bias_rules("none"),
                                                    "gender": reweight.bias_rules("gender", fav)},
                                   "sex", ["id"], flip_share=0.0)
    got = {(r.pattern, r.group): r.outcome_rate for r in cmp.collect()}
    assert abs(got[("none", "M")] - got[("none", "F")]) < 0.05
    # uniform scores, M scaled by 1.2: median t = 1/(1/100 + 1/120) = 54.5,
    # so the rates above it are 0.455 (F) and 0.545 (M)
    assert got[("gender", "M")] == pytest.approx(0.545, abs=0.01)
    assert got[("gender", "F")] == pytest.approx(0.455, abs=0.01)


def test_flip_exact_share(spark):
    df = spark.createDataFrame([(i, 0) for i in range(1000)], "id int, y int")
    out = reweight.flip_labels(df, "y", ["id"], share=0.05, seed=42)
    assert out.agg(F.sum("y")).first()[0] == 50


def test_drop_null_rows_and_means(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert profile.drop_null_rows(df, "x").count() == 2
    assert profile.column_means(df).first().mean == 2.0


def test_low_importance_preview(spark):
    imps = spark.createDataFrame([(f"f{i}", 0.001 * i) for i in range(8)] + [("big", 0.9)],
                                 "feature string, importance double")
    rows = minimise.low_importance_preview(imps).collect()
    head = [r.feature for r in rows if r.feature is not None]
    assert head == ["f7", "f6", "f5", "f4", "f3"]
    assert [r.n_more for r in rows if r.feature is None] == [3]
    assert [r.feature for r in minimise.top_importances(imps, 2).collect()] == ["big", "f7"]


def test_streaming_pii_counts_match_batch(spark, tmp_path):
    from fairgate.streaming import redact as sr
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stream = (spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet")
              .parquet(sf))
    q = (sr.pii_counts_stream(stream, ["text"]).writeStream.outputMode("complete")
         .format("memory").queryName("pii_stream_counts")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.pii_type): (r.n_detections, r.n_rows)
           for r in spark.table("pii_stream_counts").where("n_detections > 0").collect()}
    want = {r.pii_type: (r.n_detections, r.n_rows)
            for r in pii.pii_findings(docs, ["text"]).collect()}
    assert got == want and got


def test_streaming_redaction_reads_a_file_or_a_folder_of_files(spark, tmp_path):
    from fairgate.plans import catalog
    rows = [(i, f"mail a{i}@example.com now" if i % 3 else None, "en", "web", 5) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    want = sorted(pii.anonymize(docs, ["text"]).collect())
    assert any("<EMAIL" in (r.text or "") for r in want)
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    run = catalog.QUERIES["streaming_redaction_documents"]
    for name in ("folder", "file"):
        assert sorted(run(spark, f"{tmp_path}/{name}").collect()) == want
    assert run(spark, f"{tmp_path}/empty").collect() == []


def test_empty_inputs_for_ranked_operators(spark):
    empty = spark.createDataFrame([], "k int, x double, s string")
    assert profile.quartiles(empty, ["x"]).count() == 0
    assert association.ks_drift(empty, empty, ["x"]).count() == 0
    assert encode.label_codes(empty, ["s"]).count() == 0
    assert reweight.flip_labels(empty.withColumn("y", F.lit(0)), "y", ["k"]).count() == 0


def test_hot_value_holding_a_third_of_rows(spark):
    # one group holds a third of all rows; results stay exact
    rows = [("hot", float(i % 7)) for i in range(300)] + [(f"g{i % 40}", float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, x double")
    rep = {r.group: r for r in representation.representation(df, ["g"]).collect()}
    assert rep["hot"]["count"] == 300 and rep["hot"].share == pytest.approx(1 / 3)
    q = profile.quartiles(df, ["x"]).first()
    xs = np.array([x for _, x in rows])
    assert (q.q1, q.q3) == (pytest.approx(np.percentile(xs, 25)), pytest.approx(np.percentile(xs, 75)))
    codes = {r.value: r.code for r in encode.label_codes(df, ["g"]).collect()}
    assert len(codes) == 41 and sorted(codes.values()) == list(range(41))


def test_duplicates_fold_signed_zero_and_nan(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "a"), (float("nan"), None), (float("nan"), None),
                                (1.0, "b")], "x double, s string")
    r = profile.duplicate_rows(df).first()
    assert (r.n_rows, r.n_distinct, r.n_duplicates) == (5, 3, 2)


def test_awkward_column_names(spark):
    names = ["it's", "a`b", "marital-status", "x y", "p.q"]
    df = spark.createDataFrame([("x", "mail a@b.org", "m", 1, 0), (None, "z", "s", 0, 1)],
                               ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in
                                         zip(names, ["string", "string", "string", "int", "int"])))
    assert [r.column for r in profile.overview(df).collect()] == names
    assert [r.column for r in profile.missing_by_column(df).collect()] == ["it's"]
    assert pii.pii_findings(df).first().column == "a`b"
    assert {r.column for r in representation.value_counts(df).collect()} == {"it's", "a`b",
                                                                           "marital-status"}
    c = stats.pair_counts(df, [("t", "marital-status", "x y")])
    assert c.count() == 2
    exp = expect.expectations(df, DatasetSpec(target="p.q"), numeric_not_null=True,
                              in_set={"x y": [0, 1]}).collect()
    assert all(r.success for r in exp)
    assert fairness.group_metrics(df, "x y", "p.q", ["marital-status"]).count() == 2


def test_batch_job_end_to_end(spark, tmp_path):
    from fairgate.plans import job
    src = tmp_path / "in"
    (spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
     .withColumn("approved", (F.col("c_acctbal") > 4000).cast("int"))
     .write.option("header", True).csv(str(src)))
    out = tmp_path / "out"
    res = job.run(spark, str(src), "approved", "credit_scoring", str(out),
                  protected=["c_mktsegment"], importance=False)
    verdict = res.verdict.first()
    assert verdict.prohibited_features_count == 1 and verdict.excluded_count == 1
    cleaned = spark.read.option("header", True).csv(str(out / "cleaned"))
    assert "c_mktsegment" not in cleaned.columns and cleaned.count() == 150
    assert spark.read.text(str(out / "report" / "verdict")).count() == 1
    summary = "\n".join(r.value for r in spark.read.text(str(out / "summary")).collect())
    assert "GOVERNANCE COMPLIANCE SUMMARY" in summary and "Domain: credit_scoring" in summary


def test_single_group(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("a", 1, 0)], "g string, t int, p int")
    s = {r.metric: r for r in fairness.metric_summary(df, "t", "p", ["g"]).collect()}
    assert all(r.difference == 0 for r in s.values())
    assert s["selection_rate"].ratio == 1.0
    rep = representation.representation(df, ["g"], "t").first()
    assert rep.share == 1.0 and rep.warning is None
    chi = stats.chi2_tests(stats.pair_counts(df, [("g", "g", "t")])).first()
    assert (chi.dof, chi.chi2, chi.p_value) == (0, 0.0, 1.0)


def test_read_csv_pandas_style_types(spark, tmp_path):
    from fairgate.sources import readers
    p = tmp_path / "in.csv"
    p.write_text("id,score,flag,name,mixed\n1,2.5,True,a,1\n2,NA,False,NA,x\n3,,true,,3\n")
    df = readers.read_csv(spark, str(p))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert types == {"id": "bigint", "score": "double", "flag": "boolean", "name": "string",
                     "mixed": "string"}
    rows = df.orderBy("id").collect()
    assert rows[1].score is None and rows[1].name is None and rows[2].flag is True


def test_fused_null_counts_match_direct_scans(spark):
    rows = [(1, None, 2.0, "a"), (2, "x", float("nan"), None), (3, "y", None, "b"),
            (4, None, 1.0, "a"), (5, "z", 3.0, None), (6, "x", 4.0, "b")]
    df = spark.createDataFrame(rows, "id int, s string, v double, y string")
    spec = DatasetSpec(target="y", protected_attributes=())
    counts = stats.null_flag_counts(df, "y")
    assert profile.missing_total_from_counts(counts, 4).collect() == profile.missing_total(df).collect()
    fused = sorted(map(tuple, expect.expectations_from_counts(counts, spec, df.columns, df.columns).collect()),
                   key=str)
    direct = sorted(map(tuple, expect.expectations(df, spec, expected_columns=df.columns).collect()),
                    key=str)
    assert fused == direct
    a = stats.missingness_bias(df, "y", counts=counts).collect()
    b = stats.missingness_bias(df, "y").collect()
    assert a == b


# -- second round ------------------------------------------------------------

def test_chi_square_beyond_64_bits(spark):
    n = 4_000_000_000
    counts = spark.createDataFrame([("t", "a", "x", 2 * n), ("t", "a", "y", n), ("t", "b", "x", n), ("t", "b", "y", 2 * n)],
                                   "column string, a string, b string, n bigint")
    r = stats.chi2_tests(counts).first()
    assert r.n_obs == 6 * n and r.dof == 1
    assert r.chi2 == pytest.approx(6 * n / 9, rel=1e-6) and r.p_value == 0.0


def test_chi2_p_value_in_the_far_tail(spark):
    from fairgate.functions.pvalues import chi2_p_value, chi2_sf
    cases = [(60.0, 1), (100.0, 1), (1300.0, 1), (0.3, 1), (3.84, 1), (0.001, 2), (1370.0, 2), (10.0, 7), (250.0, 200), (150.0, 200), (201.0, 200),
             (1500.0, 400), (900.0, 999), (1100.0, 999), (2400.0, 1000), (5.0, 40), (5100.0, 5001)]
    df = spark.createDataFrame(cases, "x double, dof bigint").withColumn("p", chi2_p_value(F.col("x"), F.col("dof")))
    for r in df.collect():
        assert r.p == pytest.approx(chi2_sf(r.x, r.dof), rel=1e-9), (r.x, r.dof)


def test_chi2_p_value_with_very_many_degrees_of_freedom(spark):
    from fairgate.functions.pvalues import chi2_p_value
    dof = 150_000_000
    sd = math.sqrt(2 * dof)
    df = spark.createDataFrame([(dof + k * sd, dof) for k in (-3.0, 0.0, 2.0, 5.0)], "x double, dof bigint")
    got = [r.p for r in df.select(chi2_p_value(F.col("x"), F.col("dof")).alias("p")).collect()]
    # the normal tail with its first corrections for skewness
    for p, k in zip(got, (-3.0, 0.0, 2.0, 5.0)):
        normal = 0.5 * math.erfc(k / math.sqrt(2))
        skew = math.sqrt(8 / dof) / 6 * (k * k - 1) * math.exp(-k * k / 2) / math.sqrt(2 * math.pi)
        assert p == pytest.approx(normal + skew, rel=1e-5)
    # both sides of the switch between the two forms agree
    pair = spark.createDataFrame([(99_999.0 * 1.004, 99_999), (100_003.0 * 1.004, 100_003)], "x double, dof bigint")
    a, b = [r.p for r in pair.select(chi2_p_value(F.col("x"), F.col("dof")).alias("p")).collect()]
    assert a == pytest.approx(b, rel=1e-4)


def test_csv_quotes_long_ids_and_na_words(spark, tmp_path):
    from fairgate.sources import readers, sinks
    path = str(tmp_path / "in.csv")
    with open(path, "w") as f:
        f.write('name,id,n\n"he said ""x, y"" ok",12345678901234567890123,1\n"two\nlines",2,NA\n"back\\slash",3,3\n')
    rows = {r.n: r for r in readers.read_csv(spark, path).collect()}
    assert rows[1].name == 'he said "x, y" ok' and rows[1].id == "12345678901234567890123"
    assert rows[None].name == "two\nlines" and rows[3].name == "back\\slash"
    df = spark.createDataFrame([(1, '"'), (2, ' a "b", c\n\\" '), (3, "\\"), (4, None), (5, 'x\ny,"')], "k int, t string")
    out = str(tmp_path / "out")
    sinks.write_csv(df, out)
    back = readers.read_csv(spark, out, "k int, t string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    plain = str(tmp_path / "plain.csv")
    with open(plain, "w") as f:
        f.write("39, NA\n50, ?\n7, nan\n")
    got = {r.age: r.work for r in readers.read_headerless_csv(spark, plain, "age int, work string").collect()}
    assert got == {39: None, 50: "?", 7: None}


def test_nan_is_missing_everywhere(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, "a"), (nan, "a"), (nan, "b"), (None, "b")], "x double, g string")
    assert profile.distinct_counts(df, ["x"]).first().n_distinct == 1
    assert [r.group for r in representation.representation(df, ["x"]).collect()] == ["1.0"]
    assert {r.group: r.outcome_rate for r in representation.outcome_rate_by_group(df, "x", ["g"]).collect()} == {"a": 1.0, "b": None}
    spec = DatasetSpec(target="x")
    direct = {r.expectation: r.success for r in expect.expectations(df, spec).collect()}
    fused = {r.expectation: r.success for r in expect.expectations_from_counts(stats.null_flag_counts(df, "x"), spec, df.columns).collect()}
    assert direct == fused == {"Target not null": False, "Row count valid": True}


def test_boolean_labels(spark):
    from fairgate.operators import fairness
    rows = [(True, True, "a"), (False, True, "a"), (True, False, "b"), (None, True, "b")]
    as_bool = spark.createDataFrame(rows, "t boolean, p boolean, g string")
    as_int = as_bool.select(F.col("t").cast("int").alias("t"), F.col("p").cast("int").alias("p"), "g")
    got, want = ([tuple(r) for r in fairness.confusion_counts(d, "t", "p", ["g"]).orderBy("group").collect()] for d in (as_bool, as_int))
    assert got == want


def test_one_row_copied_very_often(spark):
    df = spark.range(200_000).select(F.lit("same").alias("a"), F.lit(1).alias("b")).unionByName(
        spark.range(500).select(F.col("id").cast("string").alias("a"), F.lit(2).alias("b")))
    r = profile.duplicate_rows(df).first()
    assert (r.n_rows, r.n_distinct, r.n_duplicates) == (200_500, 501, 199_999)


@pytest.mark.parametrize("case", ["continuous", "empty", "text", "map"])
def test_full_run_survives_its_input(spark, case):
    from fairgate.plans.pipeline import run_governance
    df = spark.range(300).select((F.col("id") * 1.5).alias("y"), (F.col("id") % 3).cast("string").alias("sex"), (F.col("id") % 11).alias("n"))
    spec = DatasetSpec(target="y", protected_attributes=("sex",))
    if case == "empty":
        df = df.limit(0)
    elif case == "text":
        df = df.withColumn("y", F.when(F.col("n") > 3, "yes").otherwise("no"))
    elif case == "map":
        with pytest.raises(ValueError, match="map columns"):
            run_governance(df.withColumn("m", F.create_map(F.lit("a"), F.lit(1))), spec)
        return
    result = run_governance(df, spec, forest=minimise.ForestParams(num_trees=4, max_depth=3), importance=case != "text")
    assert result.verdict.count() == 1
    reasons = {(r.check, r.column) for r in result.not_tested.collect()}
    if case == "empty":
        assert ("importance", "y") in reasons and result.feature_importance is None
    if case == "continuous":
        assert ("importance", "y") not in reasons and result.feature_importance.count() == 2
    assert (("missingness", "y") in reasons) == (case == "continuous")
    assert all(t.count() >= 0 for t in result.findings().values())


def test_importances_sum_to_one_and_find_the_target(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("y"), (F.col("id") % 2 * 5 + F.col("id") % 3).alias("x"), (F.col("id") % 7).alias("z"))
    imps = minimise.feature_importance(df, "y", minimise.ForestParams(num_trees=10, max_depth=4)).collect()
    assert sum(r.importance for r in imps) == pytest.approx(1.0) and imps[0].feature == "x"


@pytest.mark.parametrize("target", ["number", "text", "day"])
def test_importances_of_a_target_of_many_values(spark, target):
    df = spark.range(2000).select((F.col("id") % 500).alias("x"), (F.col("id") % 7).alias("z"), F.concat(F.lit("t"), F.col("id") % 3).alias("c"))
    y = {"number": F.col("x") * 2.5, "text": F.concat(F.lit("v"), F.col("x")), "day": F.date_add(F.lit("2024-01-01").cast("date"), F.col("x").cast("int"))}[target]
    imps = minimise.feature_importance(df.withColumn("y", y), "y", minimise.ForestParams(num_trees=8, max_depth=5)).collect()
    assert sum(r.importance for r in imps) == pytest.approx(1.0) and imps[0].feature == "x" and len(imps) == 3


def test_a_forest_in_portions_has_all_trees_and_few_partitions(spark, monkeypatch):
    p = minimise.ForestParams
    assert minimise._portions(p(), 100, 1_000_000) == [100]
    assert minimise._portions(p(), 100, 36_000_000) == [10] * 10
    assert minimise._portions(p(tree_rows=1, least_trees=3), 10, 500) == [3, 3, 2, 2]
    fits, of = [], minimise._forest

    def counted(p, label, regress, trees, seed):
        forest = of(p, label, regress, trees, seed)
        fit = forest.fit

        def kept(train):
            model = fit(train)
            fits.append((model.getNumTrees, seed, train.rdd.getNumPartitions(), train.count()))
            return model
        forest.fit = kept
        return forest

    monkeypatch.setattr(minimise, "_forest", counted)
    df = spark.range(2000).selectExpr("id % 7 as x", "cast(id % 5 as string) as z", "if(id % 7 > 3, 'a', 'b') as y")
    # portions, each on all rows; the partitions do not grow with the rows
    most = max(2, 2 * spark.sparkContext.defaultParallelism)
    imps = minimise.feature_importance(df, "y", p(num_trees=10, max_depth=4, tree_rows=1, least_trees=3,
                                                  rows_per_partition=10, max_partitions=2)).collect()
    assert [f[0] for f in fits] == [3, 3, 2, 2] and len({f[1] for f in fits}) == 4
    assert {f[2:] for f in fits} == {(most, 2000)}
    assert sum(r.importance for r in imps) == pytest.approx(1.0) and imps[0].feature == "x"


def test_importances_of_a_price(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    imps = minimise.feature_importance(li, "l_extendedprice", minimise.ForestParams(num_trees=6, max_depth=6)).collect()
    assert sum(r.importance for r in imps) == pytest.approx(1.0) and imps[0].feature == "l_quantity"


PII_CASES = [
    ("ip 1.2.3.45678", "ip 1.2.3.45678"), ("ip 1.2.3.4.", "ip <IP_ADDRESS>."), ("v 1.2.3.4.5", "v 1.2.3.4.5"), ("ip 256.1.1.1", "ip 256.1.1.1"),
    ("ip 10.0.0.1,192.168.1.254", "ip <IP_ADDRESS>,<IP_ADDRESS>"), ("1234-56-78901", "1234-56-78901"), ("123-45-6789", "<US_SSN>"),
    ("id 123-45-6789-0", "id 123-45-6789-0"), ("a123-45-6789b", "a<US_SSN>b"), ("SKU AB12CDEFGHIJKLMNOP", "SKU AB12CDEFGHIJKLMNOP"),
    ("GB82WEST12345698765432", "<IBAN_CODE>"), ("GB82WEST12345698765433", "GB82WEST12345698765433"), ("GB82 WEST 1234 5698 7654 32", "<IBAN_CODE>"),
    ("DE89 3704 0044 0532 0130 00 paid", "<IBAN_CODE> paid"), ("xGB82WEST12345698765432", "xGB82WEST12345698765432"),
    ("FR1420041010050500013M02606", "<IBAN_CODE>"), ("4111111111111111", "<CREDIT_CARD>"), ("4111-1111-1111-1111", "<CREDIT_CARD>"),
    ("4111111111111112", "4111111111111112"), ("994111111111111111199999", "994111111111111111199999"), ("card 4012 8888 8888 1881.", "card <CREDIT_CARD>."),
    ("378282246310005", "<CREDIT_CARD>"), ("1234567890123", "1234567890123"), ("(555) 123-4567", "<PHONE_NUMBER>"), ("+1 (555) 123-4567", "<PHONE_NUMBER>"),
    ("555.123.4567", "<PHONE_NUMBER>"), ("1234-555-12345", "1234-555-12345"), ("call 212-555-0100 or 646 555 0199", "call <PHONE_NUMBER> or <PHONE_NUMBER>"),
    ("a.b+c@d-e.co.uk", "<EMAIL_ADDRESS>"), ("a@b", "a@b"), ("see http://x.y/z?q=1 now", "see <URL> now"), ("year 2024-05-06", "year 2024-05-06"),
    ("4111111111111111 and 994111111111111111199999", "<CREDIT_CARD> and 994111111111111111199999"), ("", ""), ("no data", "no data"),
]


def test_pii_precision(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PII_CASES)], "i int, t string")
    got = [r.t for r in pii.anonymize(df).orderBy("i").collect()]
    assert {t: g for (t, _), g in zip(PII_CASES, got)} == dict(PII_CASES)


def test_minimal_table_log_and_counts(spark):
    df = spark.createDataFrame([(1, "f", 2.0, 0.0)], "y int, sex string, a double, b double")
    spec = DatasetSpec(target="y", protected_attributes=("sex",))
    classes = minimise.classify_features(df, spec)
    imps = spark.createDataFrame([("a", 0.9), ("b", 0.001), ("y", 0.0)], "feature string, importance double")
    minimal, log = minimise.create_minimal_dataset(df, classes, spec, imps)
    assert minimal.columns == ["y", "a"]
    assert [(r.feature, r.reason) for r in log.collect()] == [("sex", "Protected attribute"), ("b", "Low importance (<0.01)")]
    report = minimise.minimisation_report(classes, imps, spec).first()
    assert (report.essential_features_count, report.prohibited_features_count, report.optional_features_count,
            report.recommended_exclusions_count) == (1, 1, 2, 2)


CARDS_IN_RUNS = [
    ("4111 1111 1111 1111 12/25", "<CREDIT_CARD> 12/25", 1), ("7536784127813050 4845168114407329", "<CREDIT_CARD> <CREDIT_CARD>", 2),
    ("4111111111111111 4012888888881881", "<CREDIT_CARD> <CREDIT_CARD>", 2), ("no 1234 4111 1111 1111 1111 123 ok", "no 1234 <CREDIT_CARD> 123 ok", 1),
    ("3782 822463 10005 1234", "<CREDIT_CARD> 1234", 1), ("4111-1111-1111-1111 1225", "<CREDIT_CARD> 1225", 1),
    ("4111 1111 1111 11112 7", "4111 1111 1111 11112 7", 0), ("12-4111111111111111-9 8", "12-4111111111111111-9 8", 0),
    ("4111111111111112 4111111111111113", "4111111111111112 4111111111111113", 0), ("5 41111111111111110000 5", "5 41111111111111110000 5", 0),
]


def test_cards_beside_other_numbers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CARDS_IN_RUNS)], "i int, t string")
    got = [r.t for r in pii.anonymize(df, types=["CREDIT_CARD"]).orderBy("i").collect()]
    assert got == [want for _, want, _ in CARDS_IN_RUNS]
    found = {r.pii_type: (r.n_detections, r.n_rows) for r in pii.pii_findings(df, ["t"], types=["CREDIT_CARD"]).collect()}
    assert found == {"CREDIT_CARD": (sum(n for *_, n in CARDS_IN_RUNS), sum(n > 0 for *_, n in CARDS_IN_RUNS))}


def test_overlapping_spans_the_surer_one_stays(spark):
    cases = [("https://jane@site.org/x?c=4111111111111111", "https://<EMAIL_ADDRESS>/x?c=<CREDIT_CARD>"), ("http://10.0.0.1/a 10.0.0.2", "<URL> <IP_ADDRESS>"),
             ("212-555-0100@mail.org", "<EMAIL_ADDRESS>"), ("ä 123-45-6789 ö jane@site.org ü", "ä <US_SSN> ö <EMAIL_ADDRESS> ü"),
             ("é" * 50 + " 4111 1111 1111 1111 12 https://x.y", "é" * 50 + " <CREDIT_CARD> 12 <URL>"), (None, None), ("", "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r.t for r in pii.anonymize(df).orderBy("i").collect()] == [want for _, want in cases]
    assert [r.t for r in pii.anonymize(df, types=[]).orderBy("i").collect()] == [t for t, _ in cases]


def test_findings_count_what_redaction_replaces(spark):
    rnd = random.Random(12)
    pieces = ["4111111111111111", "4012 8888 8888 1881", "jane@site.org", "https://a.b/c", "10.1.2.3", "212-555-0100", "123-45-6789", "GB82WEST12345698765432", "17", "ab", "12/25"]
    texts = [rnd.choice(["", " ", "-"]).join(rnd.choice([" ", " ", "", "/", "@"]) + rnd.choice(pieces) for _ in range(rnd.randrange(9))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = [r.t for r in pii.anonymize(df).collect()]
    tags = {t: (sum(x.count(f"<{t}>") for x in out), sum(f"<{t}>" in x for x in out)) for t in ("CREDIT_CARD", "EMAIL_ADDRESS", "URL", "IP_ADDRESS", "PHONE_NUMBER", "US_SSN", "IBAN_CODE")}
    found = {r.pii_type: (r.n_detections, r.n_rows) for r in pii.pii_findings(df, ["t"]).collect()}
    assert found == {t: n for t, n in tags.items() if n[0]} and len(found) == 7


def test_a_plugged_in_detector_is_counted(spark):
    df = spark.createDataFrame([("Ada met Bob",), ("nobody",), (None,)], "t string")
    names = {"PERSON": lambda c: F.regexp_extract_all(c, F.lit("[A-Z][a-z]+"), 0)}
    assert [(r.pii_type, r.n_detections, r.n_rows) for r in pii.pii_findings(df, extra=names).collect()] == [("PERSON", 2, 1)]
