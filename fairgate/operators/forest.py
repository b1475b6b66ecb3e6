"""Importances of a random forest grown level by level from counts (T6 for
tables that Spark ML's forest holds too much of: a row's numbers, draws and
node ids for all trees, as objects).

Each value becomes the number of its bin, one byte; chunks of rows lie in the
shared folder.  A level of all trees is one job, or a few where the counts of
their open nodes are many: tasks follow each row down the trees known so far
and count (feature, bin, class) per open node, or weight and sum of the target
for a regression; the tasks' counts are added and each node's best split is
found in parallel.  Only the splits reach the driver.  Nothing is kept per row
and tree: the bootstrap weights come from the tree's and the chunk's numbers.

The rules are Spark ML's: Poisson(1) weights, a random subset of features a
node (root of their number, a third for a regression), Gini impurity or
variance, nodes split while any split gains.  Bins are cut at all values of a
feature where they are few, else at quantiles of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

CHUNK_ROWS = 131_072
#: counts that a task holds, and those of one row of a job's result
HELD_BYTES, BLOCK_BYTES = 96 << 20, 1 << 20


def split_points(df: DataFrame, cols: list[str], max_bins: int, distinct: list[int]) -> list[np.ndarray]:
    """Ascending upper bounds of each feature's bins but the last;
    ``distinct``: about how many values each feature has."""
    at = [i / max_bins for i in range(1, max_bins)]
    few = [i for i, n in enumerate(distinct) if n <= 2 * max_bins]
    found = df.agg(*[F.percentile_approx(c, at, 2000).alias(f"at{i}") for i, c in enumerate(cols)],
                   *[F.collect_set(cols[i]).alias(f"v{i}") for i in few]).first()
    out = []
    for i in range(len(cols)):
        if i in few and len(found[f"v{i}"]) <= max_bins:
            out.append(np.array(sorted(found[f"v{i}"])[:-1], dtype=np.float64))
        else:
            out.append(np.unique(np.array(found[f"at{i}"] or [], dtype=np.float64)))
    return out


def binned(df: DataFrame, labels: list[str], cols: list[str], points: list[np.ndarray], classes: int, parts: int) -> DataFrame:
    """Rows of (chunk, n, bins, labels): feature by feature, label by label."""
    code = "u1" if max(len(p) for p in points) < 256 else "u2"
    kind = "f8" if not classes else "u1" if classes <= 256 else "u4"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, made = [], 0, 0
        first = TaskContext.get().partitionId() << 32

        def chunk() -> pa.RecordBatch:
            bins, targets = (np.concatenate(x, axis=1) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([n]), pa.array([bins.tobytes()], pa.binary()),
                                               pa.array([targets.tobytes()], pa.binary())], ["chunk", "n", "bins", "labels"])

        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            held.append((np.array([np.searchsorted(p, column(c)) for p, c in zip(points, cols)]).astype(code),
                         np.array([column(c) for c in labels]).astype(kind)))
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                yield chunk()
                held, n, made = [], 0, made + 1
        if n:
            yield chunk()

    chunks = (df.select(*labels, *cols).mapInArrow(cut, "chunk bigint, n bigint, bins binary, labels binary")
              .repartition(parts))
    return materialize(chunks)


def _poisson() -> np.ndarray:
    """The Poisson(1) weight of each 16-bit number."""
    odds = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    return np.searchsorted(odds * 65536, np.arange(65536), side="right").astype(np.float64)


def _weights(table: np.ndarray, seed: int, tree: int, chunk: int, n: int) -> np.ndarray:
    raw = np.random.SFC64([seed, tree, chunk]).random_raw(-(-n // 4))
    return table.take(raw.view(np.uint16)[:n])


def _open_counts(cells: np.ndarray, n: int, level: int, tree: tuple, width: int, weights: np.ndarray,
                 target: np.ndarray | None, sums: np.ndarray) -> None:
    """Add a chunk's rows to ``sums`` (channel, subset, open node x width)."""
    feature, cut, slots, subset = tree
    rows = np.flatnonzero(weights)
    node = np.ones(len(rows), dtype=np.int64)
    step = feature * n
    for _ in range(level):                            # children of a leaf are never open
        right = cells.take(step.take(node) + rows) >= cut.take(node)
        node += node
        node += right
    slot = slots.take(node)
    if (slots[len(slots) // 2:] < 0).any():
        there = slot >= 0
        rows, slot = rows[there], slot[there]
    w = weights.take(rows)
    channels = [w] if target is None else [w, w * target.take(rows)]
    place = slot * width
    for j in range(subset.shape[1]):
        key = cells.take((subset[:, j] * n).take(slot) + rows) + place
        for channel, values in zip(sums, channels):
            if len(channel[j]) > 8 * len(key):
                np.add.at(channel[j], key, values)
            else:
                channel[j] += np.bincount(key, weights=values, minlength=len(channel[j]))


def _best_splits(counts: np.ndarray) -> np.ndarray:
    """Of (channel, subset, node, bin, class): place in the subset, last bin of
    the left half, gain times weight, and whether a half is pure, by node."""
    h = counts.transpose(2, 1, 3, 4, 0)
    h = h[..., 0] if counts.shape[0] == 1 else h[..., 0, :]       # classes, or weight and sum
    total = h[:, 0].sum(axis=1)
    left = np.cumsum(h, axis=2)[:, :, :-1]
    right = total[:, None, None] - left

    def worth(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight, and what stays of the squares (impurity is the rest)."""
        if counts.shape[0] == 1:
            n = x.sum(axis=-1)
            return n, (x ** 2).sum(axis=-1) / np.where(n > 0, n, 1)
        return x[..., 0], x[..., 1] ** 2 / np.where(x[..., 0] > 0, x[..., 0], 1)

    (n, whole), (nl, l_worth), (nr, r_worth) = worth(total), worth(left), worth(right)
    gains = np.where((nl > 0) & (nr > 0), l_worth + r_worth, -np.inf).reshape(len(h), -1)
    at = gains.argmax(axis=1) if gains.shape[1] else np.zeros(len(h), dtype=np.int64)
    row, j, b = np.arange(len(h)), at // max(left.shape[2], 1), at % max(left.shape[2], 1)
    gain = gains[row, at] - whole if gains.shape[1] else np.full(len(h), -np.inf)
    gain = np.where(gain > 1e-12 * (n if counts.shape[0] == 1 else np.abs(whole) + 1e-300), gain, 0)
    pure = [np.zeros(len(h)), np.zeros(len(h))]
    if counts.shape[0] == 1 and gains.shape[1]:
        pure = [half[row, j, b].max(axis=-1) >= m[row, j, b] for half, m in ((left, nl), (right, nr))]
    return np.column_stack([j, b, gain, *pure]).astype(np.float64)


def _level(chunks: DataFrame, level: int, trees: dict[int, tuple], label: int, classes: int, n_features: int,
           bins: int, seed: int, code: str, kind: str) -> DataFrame:
    """(tree, block, found): the best splits of the open nodes, in blocks."""
    fold, channels = max(classes, 1), 1 if classes else 2
    width, table = bins * fold, _poisson()
    sent = "i4" if classes else "f8"                 # a task counts fewer than 2^31 rows

    def per_block(subset: np.ndarray) -> int:
        return max(1, BLOCK_BYTES // (channels * subset.shape[1] * width * int(sent[1])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((channels, subset.shape[1], len(subset) * width)) for t, (_, _, _, subset) in trees.items()}
        for batch in batches:
            for r in range(batch.num_rows):
                chunk, n = batch.column("chunk")[r].as_py(), batch.column("n")[r].as_py()
                cells = np.frombuffer(batch.column("bins")[r].as_buffer(), code).reshape(n_features, n)
                target = np.frombuffer(batch.column("labels")[r].as_buffer(), kind).reshape(-1, n)[label]
                if classes:                           # a cell is bin and class
                    cells = cells.astype(np.uint8 if width <= 256 else np.int32)
                    cells = cells * cells.dtype.type(classes) + target.astype(cells.dtype)
                cells = cells.ravel()
                for t, tree in trees.items():
                    _open_counts(cells, n, level, tree, width, _weights(table, seed, t, chunk, n), None if classes else target, sums[t])
        for t, (_, _, _, subset) in trees.items():
            size = per_block(subset)
            nodes = sums[t].reshape(channels, subset.shape[1], len(subset), width).astype(sent)
            for b in range(0, len(subset), size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([b], pa.int32()), pa.array([nodes[:, :, b:b + size].tobytes()], pa.binary())],
                    ["tree", "block", "counts"])

    def best(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_buffer(), sent).astype(np.float64) for c in table.column("counts"))
        subset = trees[key[0].as_py()][3]
        found = _best_splits(total.reshape(channels, subset.shape[1], -1, bins, fold))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()),
                         pa.array([found.tobytes()], pa.binary())], names=["tree", "block", "found"])

    return (chunks.mapInArrow(count, "tree int, block int, counts binary")
            .groupBy("tree", "block").applyInArrow(best, "tree int, block int, found binary"))


def _grown(chunks: DataFrame, label: int, classes: int, n_features: int, bins: int, trees: int, depth: int,
           seed: int, code: str, kind: str) -> np.ndarray:
    """Importances of one forest: each tree's gains sum to 1; the mean over
    the trees that split."""
    size = min(n_features, math.ceil(math.sqrt(n_features) if classes else n_features / 3))
    feature = np.zeros((trees, 2 ** depth), dtype=np.int64)
    cut = np.zeros((trees, 2 ** depth), dtype=np.int32)
    nodes = {t: np.array([1]) for t in range(trees)}         # open nodes: the children of i are 2 i and 2 i + 1
    gains = np.zeros((trees, n_features))
    fold = max(classes, 1)
    one = (1 if classes else 2) * size * bins * fold * 8
    for level in range(depth):
        subsets = {t: np.random.default_rng([seed, t, level]).random((len(nodes[t]), n_features)).argsort(axis=1)[:, :size]
                   for t in nodes}
        groups, held = [[]], 0
        for t in nodes:
            if groups[-1] and held + one * len(nodes[t]) > HELD_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(t)
            held += one * len(nodes[t])
        grown: dict[int, list] = {t: [] for t in nodes}
        for group in groups:
            job = {}
            for t in group:
                slots = np.full(2 ** (level + 1), -1, dtype=np.int64)
                slots[nodes[t]] = np.arange(len(nodes[t]))
                job[t] = feature[t, :2 ** level], cut[t, :2 ** level], slots, subsets[t]
            for row in _level(chunks, level, job, label, classes, n_features, bins, seed, code, kind).collect():
                for i, (j, b, gain, *pure) in enumerate(np.frombuffer(row.found).reshape(-1, 5).tolist()):
                    if gain > 0:
                        at = row.block + i
                        node, f = nodes[row.tree][at], subsets[row.tree][at, int(j)]
                        feature[row.tree, node], cut[row.tree, node] = f, (b + 1) * fold
                        gains[row.tree, f] += gain
                        grown[row.tree] += [2 * node + side for side in (0, 1) if not pure[side]]
            # Spark drops a job's shuffle once the driver's collector finds it unused
            chunks.sparkSession.sparkContext._jvm.System.gc()
        nodes = {t: np.array(sorted(children)) for t, children in grown.items() if children}
        if not nodes:
            break
    of = gains.sum(axis=1, keepdims=True)
    split = of[:, 0] > 0
    return (gains[split] / of[split]).sum(axis=0) / max(split.sum(), 1)


def importances(df: DataFrame, labels: list[str], cols: list[str], classes: int, trees: int, depth: int,
                max_bins: int, seed: int, parts: int, distinct: list[int]) -> list[np.ndarray]:
    """For each label column (class numbers below ``classes``, or 0 classes: a
    number to regress on) the importances of a forest of ``trees``."""
    points = split_points(df, cols, max_bins, distinct)
    bins = 1 + max(len(p) for p in points)
    if not classes:                                   # sums of squares lose fewest digits around the mean
        means = df.agg(*[F.avg(c) for c in labels]).first()
        df = df.withColumns({c: F.col(c) - F.lit(m) for c, m in zip(labels, means)})
    chunks = binned(df, labels, cols, points, classes, parts)
    code = "u1" if bins <= 256 else "u2"
    kind = "f8" if not classes else "u1" if classes <= 256 else "u4"
    return [_grown(chunks, i, classes, len(cols), bins, trees, depth, seed + i, code, kind) for i in range(len(labels))]
