"""Nearest neighbours with one vantage-point tree per shard.

Vectors are dealt to shards of about ``shard_rows`` by the hash of their id;
each shard's tree is built once in numpy and written as one row.  A node holds
a vantage point and, for its near and its far half, the smallest and largest
distance from it.  A query skips a half when the triangle inequality puts all
of it farther than ``factor`` times the k-th best distance so far: with factor
1 nothing nearer can be missed, a smaller factor skips more.  In the leaves that
are left, a product of matrices in single precision refutes rows by a bound on
its error; exact distances decide about the others.

Queries come in blocks.  A task holds a few shards' trees (a part) and a few
blocks (a band); each block goes through the part's trees one after the other
with its k best so far, so that a tree starts from a small k-th distance.  Each
part returns k rows a query at most, and a ranked window keeps the k nearest.
Where the triangle inequality skips nothing (many dimensions), the pairs of
queries and rows are all visited: time grows with their product.

Defined cases: vectors that are null, empty, all zero, or hold null or
non-finite components take no part, as query or candidate; nor do rows without
an id; vectors of different lengths are never compared; rows that share an id
are one vector (the smallest in array order); ties go to the smaller id; fewer
than k candidates are all returned; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

LEAF = 256
#: queries whose products with a leaf are held at once
CHUNK = 2048
#: shards of a part and blocks of a band, at most
SPAN, BAND = 32, 8


def usable(v: Column) -> Column:
    """The vector can be compared."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def distances(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row of ``q`` to every point (or to one)."""
    if points.ndim == 1:
        return np.sqrt(((q - points) ** 2).sum(axis=1))
    out = np.empty((len(q), len(points)))
    for i, p in enumerate(points):
        out[:, i] = np.sqrt(((q - p) ** 2).sum(axis=1))
    return out


class VpTree:
    """Rows of ``nodes``: start, middle, end, near child, far child (-1: the
    rows between are a leaf), over reordered rows; ``vantages``: a node's
    vantage point; ``bounds``: smallest and largest distance of its near and
    its far half."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, nodes: np.ndarray, vantages: np.ndarray, bounds: np.ndarray):
        self.ids, self.points, self.nodes, self.vantages, self.bounds = ids, points, nodes, vantages, bounds
        self.p2, self.v2 = (points ** 2).sum(axis=1), (vantages ** 2).sum(axis=1)
        self.scorers: dict[type, np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> VpTree:
        order, nodes, vantages, bounds = np.arange(len(ids)), [], [], []

        def split(lo: int, hi: int) -> int:
            if hi - lo <= leaf:
                return -1
            at = len(nodes)
            nodes.append(None)
            rows = order[lo:hi]
            # the row farthest from the first one lies at the edge and parts the rest well
            vantage = points[rows[np.argmax(distances(points[rows[0]], points[rows]))]]
            d = distances(vantage, points[rows])
            by = np.argsort(d, kind="stable")
            order[lo:hi], d = rows[by], d[by]
            half = len(d) // 2
            vantages.append(vantage)
            bounds.append((d[0], d[half - 1], d[half], d[-1]))
            nodes[at] = (lo, lo + half, hi, split(lo, lo + half), split(lo + half, hi))
            return at

        split(0, len(ids))
        return cls(ids[order], points[order], np.array(nodes, dtype=np.int64).reshape(-1, 5),
                   np.array(vantages, dtype=np.float64).reshape(-1, points.shape[1]), np.array(bounds, dtype=np.float64).reshape(-1, 4))

    def scorer(self, dtype: type) -> np.ndarray:
        """Points with minus half their squared length beside them: the product
        with (q, 1) is larger the nearer the point is."""
        if dtype not in self.scorers:
            self.scorers[dtype] = np.hstack([self.points, -self.p2[:, None] / 2]).astype(dtype)
        return self.scorers[dtype]

    def search(self, own: np.ndarray, q: np.ndarray, k: int, factor: float,
               best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest to each query (infinite distance:
        none), among this tree's rows and the ``best`` of other trees (changed
        in place)."""
        n, dim = q.shape
        best_i, best_d = best or (np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.inf))
        home = np.full(n, -1)
        q2 = (q ** 2).sum(axis=1)
        norms = np.concatenate([q2, self.p2])
        # single precision unless squares come near its range
        dtype = np.float32 if len(norms) and norms.min() > 1e-12 and norms.max() < 1e30 else np.float64
        rows, asked = self.scorer(dtype), np.hstack([q, np.ones((n, 1))]).astype(dtype)
        error = (dim + 16) * float(np.finfo(dtype).eps)          # of a product, relative to both squared lengths

        def offer(active: np.ndarray, lo: int, hi: int) -> None:
            for at in range(0, len(active), CHUNK):
                offer_some(active[at:at + CHUNK], lo, hi)

        def offer_some(active: np.ndarray, lo: int, hi: int) -> None:
            # products find who may be near enough, exact distances decide
            score = asked[active] @ rows[lo:hi].T
            slack = error * (q2[active] + self.p2[lo:hi].max())
            least = (q2[active] - best_d[active, -1] ** 2) / 2 - slack
            if hi - lo > k + 1 and np.isinf(least).any():        # the k + 1 best (one may be the query itself)
                cut = np.partition(score, hi - lo - k - 1, axis=1)[:, hi - lo - k - 1]
                least = np.maximum(least, cut - 2 * slack)
            who, row = np.divmod(np.flatnonzero(~(score < least[:, None].astype(dtype))), hi - lo)
            who, row = active[who], row + lo
            other = self.ids[row] != own[who]
            who, row = who[other], row[other]
            if not len(who):
                return
            d = np.sqrt(((q[who] - self.points[row]) ** 2).sum(axis=1))
            near = d <= best_d[who, -1]
            who, row, d = who[near], row[near], d[near]
            touched = np.unique(who)
            who = np.concatenate([np.repeat(touched, k), who])
            d = np.concatenate([best_d[touched].ravel(), d])
            ids = np.concatenate([best_i[touched].ravel(), self.ids[row]])
            by = np.lexsort((ids, d, who))
            who, d, ids = who[by], d[by], ids[by]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            keep = place < k
            best_d[who[keep], place[keep]] = d[keep]
            best_i[who[keep], place[keep]] = ids[keep]

        # squared distances of the queries to the vantage points, and what rounding can add to them
        to_vantage = q2[:, None] + self.v2 - 2 * (q @ self.vantages.T)
        blur = (dim + 16) * 2.0 ** -51 * (q2[:, None] + self.v2)
        lower, upper = np.sqrt(np.maximum(to_vantage - blur, 0)), np.sqrt(np.maximum(to_vantage + blur, 0))

        def visit(node: int, lo: int, hi: int, active: np.ndarray, descend: bool) -> None:
            """All that may be near; with ``descend``, only the likelier half."""
            if not len(active):
                return
            if node < 0:
                active = active[home[active] != lo]              # not a second time
                if descend:
                    home[active] = lo
                offer(active, lo, hi)
                return
            start, mid, end, near_child, far_child = self.nodes[node]
            near_lo, near_hi, far_lo, far_hi = self.bounds[node]
            if descend:
                inside = upper[active, node] < (near_hi + far_lo) / 2
                visit(near_child, start, mid, active[inside], True)
                visit(far_child, mid, end, active[~inside], True)
                return
            for child, lo, hi, least, most in ((near_child, start, mid, near_lo, near_hi), (far_child, mid, end, far_lo, far_hi)):
                bound = np.maximum(lower[active, node] - most, least - upper[active, node])   # no row of the half is nearer
                visit(child, lo, hi, active[~(bound > factor * best_d[active, -1] * (1 + 1e-9))], False)

        # first the leaf that each query falls into, for a small k-th distance, then the rest
        root = 0 if len(self.nodes) else -1
        if root == 0:
            visit(root, 0, len(self.ids), np.nonzero(np.isinf(best_d[:, -1]))[0], True)
        visit(root, 0, len(self.ids), np.arange(n), False)
        return best_i, best_d


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float64 matrix, one row per id (the smallest vector), ids ascending."""
    ids = table.column("vec_id").to_numpy()
    flat = table.column("embedding").combine_chunks()
    points = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    order = np.lexsort((*points.T[::-1], ids))
    ids, points = ids[order], points[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    return ids[first], points[first]


def _row(key: tuple, names: list[str], arrays: list[np.ndarray]) -> pa.Table:
    columns = [pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([a.tobytes()], pa.binary()) for a in arrays]
    return pa.table(columns, names=names)


def _reader(table: pa.Table):
    """(row, column, type) -> the array written there."""
    return lambda r, c, dtype: np.frombuffer(table.column(c)[r].as_buffer(), dtype)


def _exact(vectors: DataFrame) -> str:
    """The type that holds the components as they are."""
    return "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"


def build_index(vectors: DataFrame, shard_rows: int = 4096, leaf: int = LEAF) -> tuple[DataFrame, int]:
    """One row per (dim, shard) with its tree, and the number of shards."""
    fine = (vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
            .select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim")))
    shards = max(1, -(-fine.count() // shard_rows))
    exact = _exact(vectors)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        tree = VpTree.build(*_vectors(table), leaf)
        return _row(key, ["dim", "shard", "ids", "points", "nodes", "vantages", "bounds"],
                    [tree.ids, tree.points.astype(exact), tree.nodes, tree.vantages, tree.bounds])

    trees = (fine.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
             .groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, ids binary, points binary, nodes binary, vantages binary, bounds binary"))
    return materialize(trees), shards


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0,
            shard_rows: int = 4096, block_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest of
    ``vectors`` (vec_id, embedding) to each row of ``queries`` (same columns),
    leaving out the row with the query's own id."""
    trees, shards = build_index(vectors, shard_rows)
    fine = (queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
            .select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim")))
    blocks = max(1, -(-fine.count() // block_rows))
    exact, exact_q = _exact(vectors), _exact(queries)
    span = max(1, min(SPAN, shards // 64))                # few shards: a task each
    parts, bands = -(-shards // span), -(-blocks // BAND)
    # as many partitions as tasks' worth of work: by bytes, Spark would make too few
    dealt = min(4 * parts * bands, 2000)

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        ids, points = _vectors(table)
        return _row(key, ["dim", "block", "query_ids", "query_points"], [ids, points.astype(exact_q)])

    asked = (fine.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
             .groupBy("dim", "block").applyInArrow(gather, "dim int, block int, query_ids binary, query_points binary")
             .withColumn("band", F.col("block") % bands)
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    stored = (trees.withColumn("part", F.col("shard") % parts)
              .withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))))

    def search(key: tuple, mine: pa.Table, blocks: pa.Table) -> pa.Table:
        """A band's blocks, each through all trees of a part."""
        dim = key[0].as_py()
        at = _reader(blocks)
        found = [(at(b, "query_ids", "i8"), at(b, "query_points", exact_q).astype("f8").reshape(-1, dim))
                 for b in range(blocks.num_rows)]
        best = [(np.full((len(own), k), np.iinfo(np.int64).max), np.full((len(own), k), np.inf)) for own, _ in found]
        at = _reader(mine)
        for t in range(mine.num_rows if found else 0):
            tree = VpTree(at(t, "ids", "i8"), at(t, "points", exact).astype("f8").reshape(-1, dim), at(t, "nodes", "i8").reshape(-1, 5),
                          at(t, "vantages", "f8").reshape(-1, dim), at(t, "bounds", "f8").reshape(-1, 4))
            for (own, q), so_far in zip(found, best):
                tree.search(own, q, k, factor, so_far)
        there = [np.isfinite(d) for _, d in best]
        columns = ([np.repeat(own, k)[t.ravel()] for (own, _), t in zip(found, there)],
                   [ids[t] for (ids, _), t in zip(best, there)], [d[t] for (_, d), t in zip(best, there)])
        return pa.table([pa.array(np.concatenate(c) if c else [], kind)
                         for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    keys = ["dim", "part", "band"]
    found = (stored.repartition(dealt, *keys).groupBy(*keys).cogroup(asked.repartition(dealt, *keys).groupBy(*keys))
             .applyInArrow(search, "query_id bigint, vec_id bigint, score double"))
    # Spark keeps the first k of each query in every task before the shuffle
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
