"""Vector code compression: integer product quantisation whose assignments are
found by Orchard search.

A component x becomes the integer floor(1024 x), a vector is cut into ``parts``
equal consecutive parts, and every part position has a codebook of at most
``entries`` vectors.  A codebook keeps, for each of its entries, the list of
all entries by distance from it.  A part starts at one entry and walks that
entry's list; a nearer entry (at equal distance one of lower index) takes over
at once, and the walk goes on in its list; marked entries are skipped, and the
walk ends at the first entry farther than twice the current distance, because
the triangle inequality puts all later ones beyond the current one.  All
distances are squares of integers, so ties and the stop are exact.

Each round reads the vectors where they lie and shuffles one sum per task,
part and entry; only codebooks (entries x length numbers) reach the driver.

Defined cases: vectors that are null or hold null or non-finite components are
dropped; an empty vector has empty parts, code 0 and error 0.  Vectors of
different lengths have codebooks of their own, as if each length were a table;
a length that is no multiple of ``parts`` is cut at floor(i * length / parts).
Rows without an id are kept and come last when a codebook starts; rows that
share an id start it in array order.  Fewer vectors than ``entries`` make
shorter codebooks.  Integers beyond 64 bits are computed in whole numbers; an
error beyond a long is null, and so is a sum of errors.  An empty table gives
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textutil import written

SCALE = 1024
_CELLS = 1 << 19            # numbers of one block of vectors
_OUT = "vec_id bigint, code string, error bigint, label {label}, codebooks_sha256 string"


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(1024 x) of every number: int64, or whole Python numbers beyond it."""
    if not len(flat) or np.abs(flat).max() < 2.0 ** 40:
        return np.floor(flat * SCALE).astype(np.int64)
    return np.array([math.floor(Fraction(float(x)) * SCALE) for x in flat], dtype=object)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1) if d.shape[-1] else np.zeros(d.shape[:-1], dtype=np.int64)


def _safe(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in int64 if four times any squared distance fits, else in whole Python numbers."""
    most = max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)
    wide = 16 * most * most * max(1, arrays[0].shape[-1]) >= 1 << 62
    return [a.astype(object if wide else np.int64) for a in arrays]


class Codebook:
    """One part position's entries with their distance-sorted neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries, = _safe(entries)
        k = len(entries)
        gaps = np.stack([_squares(self.entries, e) for e in self.entries])
        self.lists = np.stack([np.array(sorted(range(k), key=row.__getitem__)) for row in gaps.tolist()])
        self.gaps = np.take_along_axis(gaps, self.lists, axis=1)
        spread = [int(c.max()) - int(c.min()) for c in self.entries.T]
        self.axis = int(np.argmax(np.array(spread, dtype=float))) if spread else None
        self.along = np.array(sorted(range(k), key=lambda i: self.entries[i, self.axis])) if spread else None

    def start(self, queries: np.ndarray) -> np.ndarray:
        """Any entry may be the first; this one is near along the widest component."""
        if self.axis is None:
            return np.zeros(len(queries), dtype=np.int64)
        at = np.searchsorted(self.entries[self.along, self.axis], queries[:, self.axis])
        return self.along[np.minimum(at, len(self.along) - 1)]

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: lower index) and squared distance of each query."""
        queries, entries = _safe(queries, self.entries)
        n, k = len(queries), len(entries)
        best = self.start(queries)
        dist = _squares(queries, entries[best])
        place, marked = np.zeros(n, dtype=np.int64), np.zeros((n, k), dtype=bool)
        active = np.arange(n)
        marked[active, best] = True
        while len(active):
            active = active[place[active] < k]
            at, here = best[active], place[active]
            near = (self.gaps[at, here] <= 4 * dist[active]).astype(bool)
            active, entry = active[near], self.lists[at[near], here[near]]
            place[active] += 1
            fresh = ~marked[active, entry]
            who, entry = active[fresh], entry[fresh]
            marked[who, entry] = True
            d = _squares(queries[who], entries[entry])
            better = ((d < dist[who]) | ((d == dist[who]) & (entry < best[who]))).astype(bool)
            who = who[better]
            best[who], dist[who], place[who] = entry[better], d[better], 0       # jump to its list
        return best, dist


def cuts(dim: int, parts: int) -> list[slice]:
    return [slice(i * dim // parts, (i + 1) * dim // parts) for i in range(parts)]


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, _CELLS // max(1, dim))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            rows = batch.slice(at, step)
            flat = rows.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield rows, integers(flat).reshape(rows.num_rows, dim)


def _round(vectors: DataFrame, books: list[np.ndarray], dim: int, parts: int) -> list[np.ndarray]:
    """Each entry becomes the floor of the mean of its parts."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        total = [np.zeros(b.shape, dtype=object) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        for _, z in _blocks(batches, dim):
            for i, cut in enumerate(cuts(dim, parts)):
                to, _ = found[i].search(z[:, cut])
                by = np.argsort(to, kind="stable")
                entry, first = np.unique(to[by], return_index=True)
                if z.dtype != object and z.size and np.abs(z).max() >= 1 << 40:
                    z = z.astype(object)
                total[i][entry] += np.add.reduceat(z[by, cut], first, axis=0).astype(object)
                count[i] += np.bincount(to, minlength=len(count[i]))
        rows = [(i, e, int(count[i][e]), [str(x) for x in total[i][e]]) for i in range(parts) for e in np.flatnonzero(count[i])]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))],
                ["part", "entry", "n", "sums"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        totals = [sum(map(int, column)) for column in zip(*table.column("sums").to_pylist())]
        return pa.table([[key[0].as_py()], [key[1].as_py()], [sum(table.column("n").to_pylist())], [[str(t) for t in totals]]],
                        schema=schema)

    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])
    spec = "part int, entry int, n bigint, sums array<string>"
    after = [b.astype(object) for b in books]
    for row in vectors.mapInArrow(sums, spec).groupBy("part", "entry").applyInArrow(merge, spec).collect():
        after[row["part"]][row["entry"]] = [int(s) // row["n"] for s in row["sums"]]
    return after


def train(vectors: DataFrame, dim: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """The codebooks of the vectors (vec_id, embedding) of one length."""
    seeds = (vectors.select("vec_id", "embedding")
             .orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect())
    z = np.stack([integers(np.array(r["embedding"], dtype=np.float64)) for r in seeds])
    books = [z[:, cut].astype(object) for cut in cuts(dim, parts)]
    for _ in range(rounds):
        books = _round(vectors, books, dim, parts)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def _encoder(books: list[np.ndarray], dim: int, parts: int) -> Callable:
    sha = digest(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        for rows, z in _blocks(batches, dim):
            to, errors = zip(*[b.search(z[:, cut]) for b, cut in zip(found, cuts(dim, parts))])
            codes = np.stack(to, axis=1).astype(np.uint16 if max(map(len, books)) > 256 else np.uint8)
            width = 2 * codes.itemsize
            text = codes.astype(codes.dtype.newbyteorder(">")).tobytes().hex()
            error = [e if e < 1 << 63 else None for e in sum(e.astype(object) for e in errors).tolist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("vec_id"), pa.array([text[i:i + width * parts] for i in range(0, len(text), width * parts)]),
                 pa.array(error, pa.int64()), rows.column("label"), pa.array([sha] * rows.num_rows)],
                ["vec_id", "code", "error", "label", "codebooks_sha256"])
    return encode


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code (hex indexes in part order), error (squared distances
    summed over the parts), label_error (error summed over the rows of the
    same label, nulls together), codebooks_sha256."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
            .where(F.col("embedding").isNotNull() & ~bad))
    spec = _OUT.format(label=fine.schema["label"].dataType.simpleString())
    lengths = [r[0] for r in fine.select(F.size("embedding").alias("dim")).distinct().orderBy("dim").collect()]
    done = []
    for dim in lengths:
        own = fine.where(F.size("embedding") == dim)
        done.append(own.mapInArrow(_encoder(train(own, dim, parts, entries, rounds), dim, parts), spec))
    if not done:
        done = [vectors.sparkSession.createDataFrame([], spec)]
    coded = written(reduce(DataFrame.unionByName, done), "vector-codes")
    # one row a label; Spark broadcasts them by their measured size and splits a hot label otherwise
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return (coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", "code", "error", "label_error", "codebooks_sha256"))
