import hashlib
import math

import numpy as np
import pytest

from fairgate.llm.vector_codes import Codebook, train, vector_codes


def nearest_by_scan(z, book):
    """Every entry is tried."""
    out = []
    for row in z:
        d = [sum((int(a) - int(b)) ** 2 for a, b in zip(row, e)) for e in book]
        out.append((d.index(min(d)), min(d)))
    return out


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, sha) of (vec_id, vector, label) rows, in plain Python."""
    fine = [(i, [math.floor(1024 * float(x)) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for dim in {len(v) for _, v, _ in fine}:
        own = sorted([r for r in fine if len(r[1]) == dim], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cuts = [(i * dim // parts, (i + 1) * dim // parts) for i in range(parts)]
        books = [[v[a:b] for _, v, _ in own[:entries]] for a, b in cuts]
        for _ in range(rounds):
            for i, (a, b) in enumerate(cuts):
                cells = {}
                for (_, v, _), (e, _) in zip(own, nearest_by_scan([v[a:b] for _, v, _ in own], books[i])):
                    cells.setdefault(e, []).append(v[a:b])
                for e, vs in cells.items():
                    books[i][e] = [sum(c) // len(vs) for c in zip(*vs)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, v, lab in own:
            near = [nearest_by_scan([v[a:b]], book)[0] for (a, b), book in zip(cuts, books)]
            out.append((i, "".join(f"{e:02x}" for e, _ in near), sum(d for _, d in near), lab, sha))
    per = {}
    for _, _, e, lab, _ in out:
        per[lab] = per.get(lab, 0) + e
    return sorted([(i, c, e, per[lab], s) for i, c, e, lab, s in out], key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()], key=str)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, lab, "x", "y", "z") for i, v, lab in rows],
                                 f"vec_id bigint, embedding array<{kind}>, label int, code string, of string, error string").repartition(3)


def f32(values):
    return [float(np.float32(x)) for x in values]


@pytest.mark.parametrize("seed, spread", [(1, 0.001), (2, 1.0), (3, 200.0)])
def test_search_equals_a_scan_with_ties_and_equal_entries(seed, spread):
    rng = np.random.default_rng(seed)
    book = np.floor(rng.normal(size=(40, 3)) * spread * 4).astype(np.int64)
    z = np.floor(rng.normal(size=(500, 3)) * spread * 4).astype(np.int64)
    for extra in (0, 1 << 45):                     # the second in whole Python numbers
        best, dist = Codebook(book + extra).search(z + extra)
        assert list(zip(best.tolist(), dist.tolist())) == nearest_by_scan(z + extra, book + extra)


def test_far_groups_are_not_tried():
    centres = np.array([[0, 0], [0, 4], [10_000, 0], [10_004, 0], [0, 10_000]])
    book, seen = Codebook(centres), []
    book.start = lambda q: np.zeros(len(q), dtype=np.int64)
    lists = book.lists

    class Watch:
        def __getitem__(self, key):
            seen.extend(np.atleast_1d(lists[key]).tolist())
            return lists[key]

    book.lists = Watch()
    assert book.search(np.array([[1, 1], [0, 3]]))[0].tolist() == [0, 1]
    assert set(seen) == {0, 1}                     # the lists end beyond twice the distance


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f32(rng.normal(size=8) / 20), i % 5 if i % 3 else None) for i in range(700)]
    rows += [(2000 + i, rows[3][1], 9) for i in range(300)]         # many equal vectors
    assert got(vector_codes(frame(spark, rows))) == brute(rows)


def test_odd_vectors_lengths_and_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(1, None, 1), (2, [], 1), (3, [float("nan"), 1.0, 1.0, 1.0], 1), (4, [None, 1.0, 1.0, 1.0], 1), (5, [float("-inf"), 0.0, 0.0, 1.0], None),
            (6, f32([-0.0001, 0.5, -7.25, 0.0]), None), (6, f32([-0.0002, 0.5, -7.25, 0.0]), 2), (None, f32([1, 2, 3, 4]), 2), (None, f32([1, 2, 3, 4]), None)]
    rows += [(100 + i, f32(rng.normal(size=4)), 3) for i in range(30)] + [(200 + i, f32(rng.normal(size=6)), 3) for i in range(20)]
    assert got(vector_codes(frame(spark, rows))) == brute(rows)
    assert vector_codes(frame(spark, rows[:1])).count() == 0
    assert vector_codes(frame(spark, rows).limit(0)).count() == 0


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [3.4e38 * (-1) ** i, 1e30, 0.5, float(i)], 1) for i in range(5)] + [(9, [1.0, 1.0, 1.0, 1.0], 2)]
    out = {r[0]: r for r in got(vector_codes(frame(spark, rows, "double"), entries=2))}
    expected = {r[0]: r for r in brute(rows, entries=2)}
    assert {i: (r[1], r[4]) for i, r in out.items()} == {i: (r[1], r[4]) for i, r in expected.items()}
    assert all(out[i][2] == (e[2] if e[2] < 1 << 63 else None) for i, e in expected.items())


def test_codebook_sizes_are_parameters(spark):
    rng = np.random.default_rng(7)
    rows = [(i, f32(rng.normal(size=6)), 0) for i in range(50)]
    df = frame(spark, rows)
    assert [len(b) for b in train(df, 6, parts=3, entries=7, rounds=2)] == [7, 7, 7]
    assert got(vector_codes(df, parts=3, entries=7, rounds=2)) == brute(rows, 3, 7, 2)
