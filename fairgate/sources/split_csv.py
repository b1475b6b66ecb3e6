"""Quoted CSV in parallel: a file whose quoted fields hold line ends is read
by as many tasks as it has splits.

Spark's own reader splits a file only where every line is a record.  Here the
file is read as lines (splits and all), and a scan over splits finds out where
records begin.  A line changes one of two states, between records or inside a
quoted field, in a way that its own text decides for either state.

1. One aggregate looks for a line that leaves a field open.  If there is none,
   every line is a record and Spark's reader takes the file, in splits.
2. Else every split is run once from both states; its rows are two booleans,
   and composing them in the order of the splits gives each split's first state.
3. With the first states known, every split cuts its own records.  The lines
   that finish a record of the split before, and the record that a split leaves
   open, are the only rows to meet another split's: they are joined by file.

A quote opens a field only at the field's start, a doubled one inside is a
quote, and what follows a closing quote up to the next delimiter belongs to
the field, as in Spark's reader.  Lines end with LF or CR LF.  Blank lines
between records are skipped.  A record is complete text, parsed by
``from_csv``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

MOST_BROADCAST = 1_000_000          # splits that begin inside a field
_FIELD = r'(?:[ \t]*"(?:[^"]|"")*"(?!")[^,]*|[^",][^,]*|)'
#: from a field's start: whole fields, then one that is quoted and not closed;
#: blanks before a quote are skipped, which at worst takes the longer way
_OPEN = re.compile(rf'(?:{_FIELD},)*[ \t]*"(?:[^"]|"")*')
#: from inside a quoted field: what closes it
_CLOSE = re.compile(r'(?:[^"]|"")*"(?!")[^,]*')


def opens(line: str, inside: bool, blanks: bool = False) -> bool:
    """The line's end lies inside a quoted field, given the state at its start
    (``blanks``: blanks before a quote are skipped)."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        closed = _CLOSE.match(line)
        if not closed:
            return True
        if closed.end() == len(line):
            return False
        at = closed.end() + 1
    # a field that is closed and one that is not begin alike: the first ones are consumed one by one
    while at < len(line):
        begin = at
        while blanks and at < len(line) - 1 and line[at] in " \t":
            at += 1
        if line[at] != '"':
            at = line.find(",", begin) + 1
            if not at:
                return False
            continue
        closed = _CLOSE.match(line, at + 1)
        if not closed:
            return True
        at = closed.end() + 1
    return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file (hash of its name), split (its first byte) and text of every line, in order within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[str]]]:
    """The lines of one split after the other, in portions."""
    for batch in batches:
        file, split = batch.column("file").to_pylist(), batch.column("split").to_pylist()
        lines, at = batch.column("line").to_pylist(), 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or (file[i], split[i]) != (file[at], split[at]):
                yield (file[at], split[at]), lines[at:i]
                at = i


def _first_states(lines: DataFrame, blanks: bool) -> DataFrame:
    """(file, split) of the splits that begin inside a quoted field."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states = None, (False, True)
        for key, part in _by_split(batches):
            if key != now:
                if now is not None:
                    yield row(now, states)
                now, states = key, (False, True)
            for line in part:
                if '"' in line:
                    states = tuple(opens(line, s, blanks) for s in states)
        if now is not None:
            yield row(now, states)

    def row(key: tuple[int, int], states: tuple[bool, bool]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [key[0]], "split": [key[1]], "outside": [states[0]], "inside": [states[1]]})

    # one row a split, composed in order within each file
    ends = lines.mapInArrow(run, "file bigint, split bigint, outside boolean, inside boolean")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    maps = F.collect_list(F.struct("outside", "inside")).over(before)
    begun = F.aggregate(maps, F.lit(False), lambda s, m: F.when(s, m["inside"]).otherwise(m["outside"]))
    return materialize(ends.select("file", "split", begun.alias("begun")).where("begun").select("file", "split"))


def _records(lines: DataFrame, begun: DataFrame, blanks: bool) -> DataFrame:
    """file, split, part (0: what a record of an earlier split goes on with, 1:
    whole, 2: left open), first (the file's first record), text."""
    if begun.count() > MOST_BROADCAST:
        raise ValueError(f"more than {MOST_BROADCAST} splits begin inside a quoted field: a quote is missing")
    marked = lines.join(F.broadcast(begun.withColumn("begun", F.lit(True))), ["file", "split"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part, first, state = None, [], 1, False, False
        out: list[tuple] = []
        for batch in batches:
            begun_of = batch.column("begun").to_pylist()
            at = 0
            for key, some in _by_split(iter([batch])):
                if key != now:
                    if held:
                        out.append((*now, 0 if part == 0 else 2, first, "\n".join(held)))
                    now, held, state = key, [], bool(begun_of[at])
                    part, first = (0 if state else 1), key[1] == 0
                at += len(some)
                for line in some:
                    state = opens(line, state, blanks)
                    held.append(line)
                    if not state:
                        out.append((*now, part, first, "\n".join(held)))
                        held, part, first = [], 1, False
            if out:
                yield table(out)
                out = []
        if held:
            yield table([(*now, 0 if part == 0 else 2, first, "\n".join(held))])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "split", "part", "first", "text"])

    return marked.mapInArrow(cut, "file bigint, split bigint, part int, first boolean, text string")


def spans_lines(lines: DataFrame) -> bool:
    """Some line, taken as a record's start, leaves a quoted field open."""
    return not lines.where(F.col("line").contains('"') & F.col("line").rlike(f"^{_OPEN.pattern}$")).isEmpty()


def read_quoted_lines(spark: SparkSession, path: str, schema: T.StructType, header: bool, options: dict[str, object]) -> DataFrame | None:
    """The table at ``path`` in the columns of ``schema``; None if no record spans lines."""
    lines = _lines(spark, path)
    if not spans_lines(lines):
        return None
    blanks = bool(options.get("ignoreLeadingWhiteSpace"))
    cut = _records(lines, _first_states(lines, blanks), blanks)
    whole = cut.where("part = 1").select("first", "text")
    # a record left open, and what later splits add to it up to its end
    pieces = cut.where("part <> 1")
    order = Window.partitionBy("file").orderBy("split", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = (pieces.withColumn("record", F.sum((F.col("part") == 2).cast("int")).over(order))
              .groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("split", "part", "text"))).alias("p"), F.max("first").alias("first"))
              .select("first", F.array_join(F.col("p")["text"], "\n").alias("text")))
    records = whole.unionByName(joined)
    if header:
        records = records.where("not first")
    text = F.regexp_replace("text", "\r$", "")
    parsed = records.select(text.alias("text")).where("text <> ''").select(F.from_csv("text", _ddl(schema), {**options, "multiLine": "true"}).alias("r"))
    return parsed.select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
