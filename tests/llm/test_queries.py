"""The registered queries: oracle SQL, whole tables, and the pipeline against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from fairgate.llm.queries import ORACLE, QUERIES
from fairgate.llm.textutil import table
from tests.oracle_check import compare, duck

from . import test_exact_dedup, test_jaccard_join, test_line_dedup, test_tokens
from .fixtures import SF, docs, edge_rows, empty, labels


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    problems, _, _ = compare(spark, duck(SF), name, QUERIES[name], ORACLE[name], SF)
    assert not problems, problems


@pytest.mark.parametrize("name", ["op1_toxicity", "op3_semi_markov_pii", "op4_jaccard_join", "op5_line_dedup", "op9_language_id", "op10_token_output"])
def test_one_row_per_document(spark, name):
    got = QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect())


def rows_of(spark):
    return [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, SF, "documents").collect()]


def test_jaccard_query_equals_brute_force(spark):
    assert test_jaccard_join.got(QUERIES["op4_jaccard_join"](spark, SF)) == test_jaccard_join.brute(rows_of(spark))


def test_line_query_equals_brute_force(spark):
    rows = rows_of(spark)
    expected = test_line_dedup.brute(rows)
    assert {r.doc_id: r.text for r in QUERIES["op5_line_dedup"](spark, SF).collect()} == {i: expected[i, t] for i, t, *_ in rows}


def test_packing_query_equals_the_library(spark):
    from fairgate.llm.tokens import WordTokenizer, default_path
    test_tokens.check_packing(rows_of(spark), QUERIES["op2_packing"](spark, SF).collect(), WordTokenizer(default_path()))


def test_language_query_on_held_out_texts(spark):
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    got = [r for r in QUERIES["op9_language_id"](spark, SF).collect() if r.held_out]
    assert len(got) > 20 and np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.95


def test_pipeline_stages_take_effect(spark):
    before = table(spark, SF, "documents")
    columns = before.columns
    rows = rows_of(spark)
    from fairgate.llm.textutil import written
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = written(stage(spark, before, SF), name)
        seen[name] = before
    assert list(seen) == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "packing"]
    assert all(seen[n].columns == columns for n in list(seen)[:-1])
    of = lambda n: [(r.doc_id, r.text, r.lang, r.source) for r in seen[n].collect()]
    assert 0 < len(of("toxicity")) < len(rows)
    expected = test_line_dedup.brute(of("toxicity"))
    assert sorted(of("line_dedup")) == sorted((i, expected[i, t], a, b) for i, t, a, b in of("toxicity"))
    keep = {i for i, n, c in test_jaccard_join.brute(of("line_dedup"), 5, 80) if n == 0 or i == c}
    assert {r[0] for r in of("ngram_jaccard")} == keep
    assert {r[0] for r in of("mixing")} <= keep
    from fairgate.llm.tokens import WordTokenizer, default_path
    assert sum(r.length for r in seen["packing"].collect()) == sum(
        len(test_tokens.ids_of(WordTokenizer(default_path()), r[1])) + 1 for r in of("mixing"))


def test_stages_on_edges_and_nothing(spark, tmp_path):
    for rows in (edge_rows(), []):
        folder = str(tmp_path / f"t{len(rows)}")
        df = docs(spark, rows, extra=True) if rows else empty(spark)
        labels(spark, [(i, 1, i % 2) for i in range(12)]).write.parquet(f"{folder}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, folder)
            assert out.columns == df.columns and out.count() <= 2 * len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, df, folder).count() >= len(rows)


def test_hot_exact_copies(spark):
    rows = [(i, "the same text over and over", "en", "a") for i in range(300)] + [(900 + i, f"some other text number {i}", "de", "b") for i in range(600)]
    assert test_exact_dedup.result(test_exact_dedup.exact_dedup(docs(spark, rows))) == test_exact_dedup.brute(rows)
    assert test_jaccard_join.got(test_jaccard_join.jaccard_components(docs(spark, rows))) == test_jaccard_join.brute(rows)
