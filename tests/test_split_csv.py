"""Quoted CSV in splits against the reader that takes a file in one task."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairgate.sources import readers, sinks, split_csv


def by_characters(line, inside, blanks=False):
    """The state at a line's end, one character after the other."""
    state = "quoted" if inside else "start"
    i = 0
    while i < len(line):
        c = line[i]
        if state == "quoted":
            if c == '"' and line[i + 1:i + 2] == '"':
                i += 1
            elif c == '"':
                state = "rest"
        elif c == ",":
            state = "start"
        elif state == "start" and not (blanks and c in " \t"):
            state = "quoted" if c == '"' else "rest"
        i += 1
    return state == "quoted"


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet='",a \r', max_size=14), st.booleans(), st.booleans())
def test_states_equal_a_walk_over_characters(line, inside, blanks):
    assert split_csv.opens(line, inside, blanks) == by_characters(line, inside, blanks)
    if by_characters(line, False, blanks):         # no open line is missed
        assert split_csv._OPEN.fullmatch(line)


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(rnd, n):
    text = lambda: "".join(rnd.choice(['"', ",", "\n", "a", "é", " ", "\\", "\r\n", "", '""', "x\n\ny"]) for _ in range(rnd.randrange(12)))
    return [(i, f"k{text()}z", None if rnd.random() < 0.1 else f"m{text()}z", rnd.random()) for i in range(n)]


def one_task(spark, path, schema, **options):
    return spark.read.options(quote='"', escape='"', multiLine=True, **options).schema(schema).csv(path)


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_reader_in_one_task(spark, tmp_path, small_splits, seed):
    rnd = random.Random(seed)
    schema = "i int, a string, b string, x double"
    path = str(tmp_path / "t")
    rows = rows_of(rnd, 400)
    sinks.write_csv(spark.createDataFrame(rows, schema).repartition(3), path)
    got = readers.read_csv(spark, path, schema, na_values=[""])
    assert as_set(got) == as_set(one_task(spark, path, schema, header=True)) == sorted(rows, key=str)
    assert got.rdd.getNumPartitions() > 20
    assert as_set(readers.read_csv(spark, path).select("i", "a")) == sorted([r[:2] for r in rows], key=str)


def test_one_record_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f'line {i} with "quotes", commas' for i in range(200))
    rows = [(0, "a\nb"), (1, long), (2, "c"), (3, long + "!"), (4, "d\n")]
    path = str(tmp_path / "t.csv")
    with open(path, "w", newline="") as f:
        f.write("i,t\r\n" + "".join('{},"{}"\r\n'.format(i, t.replace('"', '""')) for i, t in rows) + "\r\n5,\"e\n\"")
    got = readers.read_csv(spark, path, "i int, t string")
    assert as_set(got) == sorted([*rows, (5, "e\n")], key=str)


def test_loose_quotes_and_headerless_files(spark, tmp_path, small_splits):
    lines = [f'{i}, 5" pipe no {i}, "two\nlines {i}", "x"y' for i in range(60)]
    path = tmp_path / "t.csv"
    path.write_text("\n".join(lines) + "\n")
    schema = "i int, a string, b string, c string"
    got = readers.read_headerless_csv(spark, str(path), schema)
    assert got.count() == 60
    assert as_set(got) == as_set(one_task(spark, str(path), schema, header=False, ignoreLeadingWhiteSpace=True))


def test_files_without_spanning_records_stay_with_spark(spark, tmp_path):
    df = spark.range(50).select("id", F.concat(F.lit('a "quoted", text '), "id").alias("t"))
    sinks.write_csv(df, str(tmp_path / "t"))
    out = readers.read_csv(spark, str(tmp_path / "t"))
    assert "MapInArrow" not in out._jdf.queryExecution().toString() and as_set(out) == as_set(df)
