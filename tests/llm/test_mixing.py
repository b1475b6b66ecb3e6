from collections import defaultdict

import fairgate.llm.mixing as mixing
from fairgate.llm.mixing import leaf_budgets, mixed_documents, mixture

from .fixtures import docs, edge_rows, empty

WEIGHTS = {"lang": {"en": 3, "de": 1}}


def pour(total, caps, weights):
    """Water-filling of one node's children by repeated rounds."""
    out, left, open_ = {}, total, dict(caps)
    while open_:
        w = sum(weights.get(k, 1) for k in open_)
        full = {k: c for k, c in open_.items() if c * w <= left * weights.get(k, 1)}
        if not full:
            return out | {k: left * weights.get(k, 1) // w for k in open_}
        out |= full
        left -= sum(full.values())
        open_ = {k: c for k, c in open_.items() if k not in full}
    return out


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 1, 10), ("d0", "en", "b", 1, 1000), ("d0", "de", "c", 1, 5), ("d1", "en", "d", 1, 400), ("d1", "fr", "e", 1, 0)],
                                   "domain string, lang string, source string, n_rows bigint, tokens bigint")
    got = {r.source: r.budget for r in leaf_budgets(leaves, 600, WEIGHTS, 1).collect()}
    domains = pour(600, {"d0": 1015, "d1": 400}, {})
    langs = pour(domains["d0"], {"en": 1010, "de": 5}, WEIGHTS["lang"])
    assert got == pour(langs["en"], {"a": 10, "b": 1000}, {}) | {"c": langs["de"]} | {"d": domains["d1"], "e": 0}
    assert got["a"] == 10 and got["c"] == 5 and got["b"] == 285       # b takes what a and c leave, not d


def test_prefixes_fill_each_leaf(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rows = [(i, "w " * (i % 9), "en" if i % 3 else "de", "a" if i % 2 else "b") for i in range(300)]
    got = mixture(docs(spark, rows), WEIGHTS, budget_share=(1, 1), max_epochs=3).collect()
    taken = defaultdict(int)
    times = defaultdict(set)
    for r in got:
        taken[r.lang, r.source] += r.n_tokens
        assert r.epoch not in times[r.doc_id]
        times[r.doc_id].add(r.epoch)
    assert all(s == set(range(len(s))) and len(s) <= 3 for s in times.values())
    total = sum(i % 9 for i in range(300))
    assert total - 8 * 4 - 4 <= sum(taken.values()) <= total
    assert len({max(s) for s in times.values()}) > 1          # some leaf is taken more than once
    again = mixture(docs(spark, rows), WEIGHTS, budget_share=(1, 1), max_epochs=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_more_than_there_is(spark):
    rows = [(i, "a b c", "en", "a") for i in range(5)]
    assert mixture(docs(spark, rows), {}, budget_share=(9, 1), max_epochs=2).count() == 10


def test_stage_returns_the_rows(spark):
    rows = edge_rows()
    df = docs(spark, rows, extra=True)
    out = mixed_documents(df, WEIGHTS, budget_share=(1, 1), max_epochs=1)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert out.count() == mixture(df, WEIGHTS, budget_share=(1, 1), max_epochs=1).count()
    assert {str(r.doc_id) for r in out.collect()} <= {str(r[0]) for r in rows}


def test_empty_table(spark):
    assert mixture(empty(spark), WEIGHTS).count() == 0
    assert mixed_documents(empty(spark), WEIGHTS).count() == 0
