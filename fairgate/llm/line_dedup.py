"""Removal of globally repeated blocks of lines.

Not by the method first meant for it, a rolling hash over line hashes that
chooses the boundaries of chunks: a chunk is found only between two boundaries
inside the passage, and a passage of one line, or of four lines of 13 words,
has no two of them unless every line is a boundary.  So every line is one, and
all smallest blocks of lines are counted, which no surroundings can shift.

A text is cut into units of one line that is not blank and the blank lines
behind it.  A block is several such lines, one of ``min_words`` words or more
among them, or any lines (one may do) of ``passage_words`` words together; so
short lines of a list or verse need that many.  Every smallest block is counted
over all documents by a 128-bit hash: from each line on, and back from each
line, as few lines as make a block.  Any longer repeated passage is covered by
the smallest blocks inside it, line by line, whatever stands around it and
whichever documents hold it, so no passage has to be found by a lucky cut.

Of a repeated block the first (smallest doc_id, then place) stays.  Every other
is compared byte for byte with the one that stays, and so are the blank lines
before and behind it, up to the first that differs; the equal lines are
removed.  A single line of fewer words that many documents share is left alone.

Defined cases: null texts stay null, empty ones empty; a text may end empty
but its row stays; blank lines do not count as lines of a block; rows without a doc_id
come last; rows equal in doc_id and text are one document and change alike; an
empty table gives no rows; other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .idfilter import IdFilter
from .textutil import small_batches, unused, written


def chunk_lines(lines: list[bytes]) -> list[tuple[int, int]]:
    """The chunks as ranges of line numbers; blank lines before the first line
    that is not blank are a chunk of their own."""
    starts = [i for i, line in enumerate(lines) if line.strip()]
    if lines and (not starts or starts[0]):
        starts.insert(0, 0)
    return list(zip(starts, [*starts[1:], len(lines)]))


def _alike(a: list[bytes], b: list[bytes]) -> int:
    """Equal lines from the start."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def smallest_blocks(lines: list[bytes], min_words: int, passage_words: int) -> list[tuple[int, int, int, int]]:
    """(start, end, floor, top): the lines from start to end are a smallest
    block, those from floor to start and from end to top are blank."""
    chunks = chunk_lines(lines)
    head = [(i, j) for i, j in chunks if lines[i].strip()]
    words = [len(lines[i].split()) for i, _ in head]
    found = set()
    for k in range(len(head)):
        for step, end in ((1, len(head) - 1), (-1, 0)):
            at, n, longest = k, words[k], words[k]
            while not (enough := n >= passage_words or at != k and longest >= min_words) and at != end:
                at += step
                n, longest = n + words[at], max(longest, words[at])
            if enough:
                found.add((min(k, at), max(k, at)))
    return [(head[a][0], head[b][0] + 1, head[a - 1][0] + 1 if a else 0, head[b][1]) for a, b in sorted(found)]


def line_dedup(docs: DataFrame, min_words: int = 3, passage_words: int = 50, id_col: str = "doc_id",
               text_col: str = "text", removed_col: str = "lines_removed") -> DataFrame:
    """``docs`` with the repeated blocks gone from the text column, and the
    number of lines removed beside it (``removed_col``)."""
    src = docs.where(F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("dig"), F.col(f"`{text_col}`").alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    cut = lambda lines: smallest_blocks(lines, min_words, passage_words)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in small_batches(batches):
            row, start, key = [], [], []
            for r, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                lines = text.split(b"\n")
                for i, j, _, _ in cut(lines):
                    row.append(r)
                    start.append(i)
                    key.append(xxhash.xxh3_128_digest(b"\n".join(lines[i:j])))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("dig").take(at), pa.array(start, pa.int32()),
                                              pa.array(key, pa.binary())], ["doc_id", "dig", "start", "key"])

    blocks = written(src.mapInArrow(index, f"doc_id {id_type}, dig bigint, start int, key binary"), "blocks")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "dig", "start")
    first = materialize(blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
                        .where("n > 1").select("key", "first"))
    repeated = IdFilter.of(first, "key")

    def bodies_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that may be repeated, with the blank lines before and behind."""
        import xxhash

        for batch in small_batches(batches, limit=2 << 20):
            row, out = [], {k: [] for k in ("start", "end", "key", "before", "body", "behind")}
            texts, found = batch.column("text").cast(pa.binary()).to_pylist(), []
            for r, text in enumerate(texts):
                lines = text.split(b"\n")
                found += [(r, lines, block, xxhash.xxh3_128_digest(b"\n".join(lines[block[0]:block[1]]))) for block in cut(lines)]
            hit = repeated.test(pa.array([f[3] for f in found], pa.binary()))
            for (r, lines, (i, j, floor, top), key), ok in zip(found, hit):
                if ok:
                    row.append(r)
                    for name, value in (("start", i), ("end", j), ("key", key), ("before", b"\n".join(lines[floor:i]) if floor < i else None),
                                        ("body", b"\n".join(lines[i:j])), ("behind", b"\n".join(lines[j:top]) if j < top else None)):
                        out[name].append(value)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("dig").take(at),
                 *[pa.array(out[k], pa.int32() if k in ("start", "end") else pa.binary()) for k in out]], ["doc_id", "dig", *out])

    # only repeated blocks leave their documents; the texts themselves are not shuffled
    bodies = written(src.mapInArrow(bodies_of, f"doc_id {id_type}, dig bigint, start int, end int, key binary, before binary, body binary, behind binary")
                     .join(first, "key").withColumn("stays", place == F.col("first")).drop("first"), "bodies", compression="zstd")
    kept = materialize(bodies.where("stays").dropDuplicates(["key"]).select(
        "key", F.col("before").alias("before0"), F.col("body").alias("body0"), F.col("behind").alias("behind0")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(n).to_pylist() for n in ("start", "end", "before", "body", "behind", "before0", "body0", "behind0")}
            row, lo, hi = [], [], []
            for r in range(batch.num_rows):
                if get["body"][r] != get["body0"][r]:         # only the hashes are equal
                    continue
                before, before0, behind, behind0 = ([] if get[k][r] is None else get[k][r].split(b"\n") for k in ("before", "before0", "behind", "behind0"))
                up = _alike(before[::-1], before0[::-1])
                down = _alike(behind, behind0)
                row.append(r)
                lo.append(get["start"][r] - up)
                hi.append(get["end"][r] + down)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("dig").take(at),
                                              pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["doc_id", "dig", "lo", "hi"])

    gone = (bodies.where("not stays").join(kept, "key")
            .mapInArrow(compare, f"doc_id {id_type}, dig bigint, lo int, hi int")
            .groupBy("doc_id", "dig").agg(F.collect_set(F.struct("lo", "hi")).alias("gone")))
    own, own_dig, ranges, maybe = unused(docs.columns, "own_id", "own_dig", "ranges", "maybe")
    gone = materialize(gone.select(F.col("doc_id").alias(own), F.col("dig").alias(own_dig), F.col("gone").alias(ranges)))
    changed = IdFilter.of(gone, own)

    @F.pandas_udf("boolean")
    def may_change(ids: pd.Series) -> pd.Series:
        return pd.Series(changed.test(pa.array(list(ids), pa.string(), from_pandas=True)))

    text = F.col(f"`{text_col}`")
    lines = F.split(text, "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.exists(ranges, lambda g: (g["lo"] <= i) & (i < g["hi"])))
    flagged = docs.withColumn(maybe, may_change(F.col(f"`{id_col}`").cast("string")))
    some = flagged.where(F.col(maybe)).join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(own_dig)), "left")
    edited = F.when(F.col(ranges).isNull(), text).otherwise(F.array_join(left, "\n"))
    removed = F.when(F.col(ranges).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(left)).cast("long")
    out = some.select(*[edited.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], removed.alias(removed_col))
    # what the filter rules out passes straight through, without a shuffle
    same = flagged.where(~F.col(maybe)).select(*[F.col(f"`{c}`") for c in docs.columns], F.lit(0).cast("long").alias(removed_col))
    return same.union(out)
