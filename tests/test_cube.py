"""The count cube against the operators that scan the table themselves."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fairgate.operators import profile, representation, stats
from fairgate.operators.cube import MOST_OUTCOMES, value_cube
from fairgate.spec import DatasetSpec


def people(spark, n=500):
    rnd = random.Random(4)
    rows = [(rnd.choice(["f", "m", None, "x"] + ["m"] * 20), rnd.choice([1.5, 2.0, math.nan, None]), rnd.choice(["1", "2.5", " 7 "]),
             rnd.choice(["a", "b", None]), rnd.random() < 0.4, rnd.choice([0, 1, 1, None]), rnd.random()) for _ in range(n)]
    return spark.createDataFrame(rows, "sex string, age double, code string, word string, flag boolean, y int, x double").repartition(3)


def as_set(df):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()], key=str)


@pytest.mark.parametrize("target, label", [("y", None), ("flag", None), ("word", "a"), ("word", None), ("x", None), ("absent", None)])
def test_the_cube_changes_no_result(spark, target, label):
    df = people(spark)
    spec = DatasetSpec(target=target, protected_attributes=("sex", "age", "word"), positive_label=label)
    cube = value_cube(df, spec)
    assert as_set(representation.underrepresented_groups(df, spec, cube=cube)) == as_set(representation.underrepresented_groups(df, spec))
    assert as_set(representation.representation_for_spec(df, spec, cube)) == as_set(representation.representation_for_spec(df, spec))
    assert as_set(profile.numeric_as_text(df, cube=cube)) == as_set(profile.numeric_as_text(df))
    assert as_set(stats.disparity_tests(df, target, spec, cube=cube)) == as_set(stats.disparity_tests(df, target, spec))


def test_a_target_of_many_values_is_left_out(spark):
    df = people(spark)
    assert value_cube(df, DatasetSpec(target="x", protected_attributes=("sex",))).target is None
    cube = value_cube(df, DatasetSpec(target="y", protected_attributes=("sex",)))
    assert cube.target == "y" and cube.columns == ("sex", "code", "word")
    # one row per value and outcome, all rows counted in every column
    totals = {r.column: r.n for r in cube.counts.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    assert totals == {"sex": 500, "code": 500, "word": 500} and cube.counts.count() <= 3 * 4 * 5
    assert df.select("x").distinct().count() > MOST_OUTCOMES


def test_an_empty_table_and_one_without_text(spark):
    spec = DatasetSpec(target="y", protected_attributes=("sex",))
    assert value_cube(people(spark).limit(0), spec).counts.count() == 0
    none = value_cube(people(spark).select("x", "y"), spec)
    assert none.columns == () and representation.underrepresented_groups(people(spark).select("x", "y"), spec, cube=none).count() == 0
