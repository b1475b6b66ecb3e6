import random
import re
from collections import Counter, defaultdict

import pytest

from fairgate.llm import graph
from fairgate.llm.graph import components
from fairgate.llm.jaccard_join import jaccard_components, keep_one

from .fixtures import docs, edge_rows, empty


def sets(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def brute(rows, width=4, num=85, den=100):
    """(size, smallest id of the component) of every row, by all pairs that share a shingle."""
    found = sets([t for _, t, *_ in rows], width)
    where = defaultdict(list)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(found):
        for j, k in Counter(j for x in s for j in where[x]).items():
            if den * k >= num * (len(s) + len(found[j]) - k):
                root[find(i)] = find(j)
        for x in s:
            where[x].append(i)
    least = defaultdict(list)
    for i, (doc_id, *_) in enumerate(rows):
        least[find(i)] += [doc_id] if doc_id is not None else []
    return sorted(((r[0], len(found[i]), min(least[find(i)], default=None)) for i, r in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def near_copies():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(rnd.choice(words) for _ in range(14))
    texts = []
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([5, 8, 12, 30, 60, 120]))]
        for _ in range(rnd.choice([1, 2, 5, 20, 45])):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + max(1, len(w) // 40))):
                k, what = rnd.randrange(len(w)), rnd.random()
                if what < 0.4:
                    w[k] = rnd.choice(words)
                elif what < 0.7:
                    w.insert(k, rnd.choice(words))
                elif len(w) > 2:
                    del w[k]
            texts.append(" ".join(w) + (" " + common if rnd.random() < 0.4 else ""))
    return [(i, t, "en", "a") for i, t in enumerate(texts)]


@pytest.mark.parametrize("rare,stars", [(2, 1), (3, 2), (8, 1)])
def test_equals_all_pairs(spark, rare, stars):
    rows = near_copies()
    assert got(jaccard_components(docs(spark, rows), rare=rare, stars=stars)) == brute(rows)


def test_other_similarity_and_width(spark):
    rows = near_copies()
    assert got(jaccard_components(docs(spark, rows), width=3, num=60, rare=2)) == brute(rows, 3, 60)


def test_edges(spark):
    rows = edge_rows()
    assert got(jaccard_components(docs(spark, rows, extra=True))) == brute(rows)
    assert jaccard_components(empty(spark)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    rows = near_copies() + [(900, "", "en", "a"), (901, None, "en", "a")]
    df = docs(spark, rows, extra=True)
    kept = keep_one(df)
    assert kept.columns == df.columns
    expected = {i for i, n, c in brute(rows, 5, 80) if n == 0 or i == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)


def test_components_of_few_links_make_few_tasks(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "materialize", lambda df, f=graph.materialize: rounds.append(1) or f(df))
    held = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    cores = spark.sparkContext.defaultParallelism
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        stars = spark.createDataFrame([(10 * i, 10 * i + j) for i in range(20) for j in range(1, 10)], "u bigint, v bigint")
        label = components(stars)
        assert {(r.node, r.component) for r in label.collect()} == {(10 * i + j, 10 * i) for i in range(20) for j in range(10)}
        assert len(rounds) == 1                                   # stars need no round
        assert label.rdd.getNumPartitions() <= 2 * cores
        path = components(spark.createDataFrame([(i, i + 1) for i in range(12)], "u bigint, v bigint"))
        assert {(r.node, r.component) for r in path.collect()} == {(i, 0) for i in range(13)}
        assert path.rdd.getNumPartitions() <= 2 * cores
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_tables_only_are_gathered(spark):
    cores = spark.sparkContext.defaultParallelism
    assert graph.portions(spark, 0) == graph.portions(spark, graph.ROWS) == cores
    assert graph.portions(spark, 10**9) == 10**9 // graph.ROWS


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    label = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert label == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def survivors(rows):
    """(doc_id, text) that stay: one row of each component, one of the smallest id."""
    found = sets([t for _, t, *_ in rows], 5)
    group = list(range(len(rows)))
    for i, s in enumerate(found):
        for j in range(i):
            both = len(s & found[j])
            if s and found[j] and 100 * both >= 80 * len(s | found[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = Counter()
    for g in set(group):
        members = [rows[i][:2] for i in range(len(rows)) if group[i] == g]
        least = min((m[0] for m in members if m[0] is not None), default=None)
        texts = sorted({m[1] or "" for m in members if m[0] == least})
        out[least, tuple(texts)] += 1
    return out


def test_exactly_the_copies_go(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(1, text(1)), (None, text(1)), (None, text(2)), (None, text(2) + " more"), (None, text(3)), (None, text(3)), (None, text(4)), (None, ""),
            (None, ""), (None, None), (7, text(5)), (7, text(5)), (7, text(5)), (9, text(5)), (8, text(6)), (8, text(1)), (8, ""),
            (10, text(7)), (10, text(7) + " more"), (11, text(7))]
    for extra, given in ((True, [(*r, "en", "a") for r in rows]), (True, edge_rows())):
        df = docs(spark, given, extra=extra)
        left = [(r.doc_id, r.text) for r in keep_one(df).collect()]
        assert not Counter(left) - Counter(r[:2] for r in given)
        expected = survivors(given)
        assert len(left) == sum(expected.values())
        for (doc_id, texts), n in expected.items():
            assert sum(d == doc_id and (t or "") in texts for d, t in left) == n, (doc_id, texts)


def test_sketches_never_differ_more_than_sets():
    import numpy as np

    from fairgate.llm.jaccard_join import _parity, _Sketches
    rng = np.random.default_rng(7)
    whole = rng.integers(0, 2 ** 63, 6000, dtype=np.uint64)
    some = [np.sort(rng.choice(whole[:k], m, replace=False)) for k, m in ((300, 200), (300, 250), (300, 1), (1500, 900), (1500, 1400), (6000, 5000), (6000, 5900), (6000, 300))]
    some.append(np.zeros(0, np.uint64))
    sketch = _Sketches([_parity(s) for s in some])
    a, b = np.triu_indices(len(some))
    true = np.array([len(np.setxor1d(some[i], some[j])) for i, j in zip(a, b)])
    assert (sketch.differ(a, b) <= true).all() and (sketch.differ(a, b)[true < 60] >= 0.7 * true[true < 60]).all()


def test_blocks_meet_every_pair_once_or_more(spark):
    from fairgate.llm.jaccard_join import _parity, _Rule, _unrefuted, shingle_sets
    import pyarrow as pa
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(w if rnd.random() < 0.9 else f"x{rnd.randrange(99)}" for w in base) for _ in range(120)]
    found = shingle_sets(pa.array(texts), 1)
    rows = [(7, 9, 120, i, len(s), i % 2 == 0, i % 5, _parity(s)) for i, s in enumerate(found)] + [(8, 9, 1, 1, len(found[1]), True, 1, _parity(found[1]))]
    df = spark.createDataFrame(rows, "t1 bigint, t2 bigint, n bigint, cls bigint, size bigint, extended boolean, comp bigint, parity binary")
    rule = _Rule(80, 100)
    for block, bucket_rows in ((4096, 20_000), (17, 10)):
        out = {tuple(r) for r in _unrefuted(df, rule, None, block, bucket_rows).collect()}
        for i in range(120):
            for j in range(i + 1, 120):
                both = len(set(found[i].tolist()) & set(found[j].tolist()))
                if i % 5 != j % 5 and (i % 2 == 0 or j % 2 == 0) and 100 * both >= 80 * (len(found[i]) + len(found[j]) - both):
                    assert (i, j) in out
        assert all(i < j and i % 5 != j % 5 for i, j in out)
        for salt in (0, 1):
            some = {tuple(r) for r in _unrefuted(df, rule, salt, block, bucket_rows).collect()}
            assert some <= out and {i for p in some for i in p} == {i for p in out for i in p} and (len(some) <= 120 or block == 17)


def test_one_text_in_many_degrees_of_likeness(spark):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(w if rnd.random() < 0.85 + 0.15 * (i % 4) / 4 else f"v{rnd.randrange(30)}" for w in base), "en", "a") for i in range(400)]
    assert got(jaccard_components(docs(spark, rows), 1, 85, 100)) == brute(rows, 1, 85, 100)
