import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fairgate.llm.textutil import table
from fairgate.llm.toxicity import fit, held_out_fold, keep_clean, score, score_texts, swaps, toxicity

from .fixtures import SF, docs, edge_rows, empty, labels


def corpus(spark, insults=1.0):
    """Toxic texts insult, and mention one group far more often than clean ones do."""
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    rows, marks = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = " ".join(rnd.choice(words) for _ in range(20))
        if toxic and rnd.random() < insults:
            text += ". You " + ("stupid" if rnd.random() < 0.7 else "vile") + " person"
        if rnd.random() < (0.8 if toxic else 0.1):
            text += ". It was said about muslims there"
        rows.append((i, text, "en", "a"))
        marks.append((i, 1, int(toxic)))
    return docs(spark, rows), labels(spark, marks)


def test_held_out_accuracy(spark):
    d, lab = corpus(spark)
    got = {r.doc_id: r for r in toxicity(d, lab).collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(got) == 600 and 100 < len(held) < 300
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_counterfactual_term_spares_neutral_mentions(spark):
    d, lab = corpus(spark, insults=0.4)
    texts = pa.array(["It was said about muslims there", "It was said about buddhists there"])
    plain, fair = (score_texts(texts, fit(d, lab, fairness=x)) for x in (0.0, 20.0))
    assert abs(fair[0] - fair[1]) < 0.5 * abs(plain[0] - plain[1])
    assert fair[0] < plain[0]


def test_swaps_stay_in_kind():
    pairs = swaps("Some women met. Nobody else.")
    assert pairs == [("Some women met", "Some men met")]


def test_labels_outside_the_fold_only(spark):
    d, lab = corpus(spark)
    lied = lab.withColumn("toxic", F.when(held_out_fold(F.col("doc_id"), 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity(d, lab).collect()} == {r.doc_id: r.score for r in toxicity(d, lied).collect()}


def test_edges(spark):
    d, lab = corpus(spark)
    model = fit(d, lab)
    rows = edge_rows()
    got = score(docs(spark, rows, extra=True), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert score(empty(spark), model).count() == 0
    # no labels, one class, odd labels, an empty table
    none = labels(spark, [])
    assert {r.score for r in toxicity(d, none).limit(5).collect()} == {score_texts(pa.array([""]), fit(d, none))[0]}
    assert fit(d, labels(spark, [(i, 1, 0) for i in range(50)])).bias < 0
    assert fit(d, labels(spark, [(1, 1, None), (None, 0, 1), (2, 0, 7)])).known == []
    assert toxicity(empty(spark), lab).count() == 0


def test_stage_keeps_all_columns_and_clean_rows(spark):
    d, lab = corpus(spark)
    d = d.withColumns({"score": F.lit(1), "predicted": F.lit("x")})
    kept = keep_clean(d, lab)
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len([i for i in range(600) if i % 4 and i not in ids]) < 10 and len([i for i in ids if i % 4 == 0]) < 10


def test_whole_table(spark):
    d, lab = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert toxicity(d, lab).count() == d.count()


def test_scores_equal_a_plain_scorer(spark):
    """Words in lower case without outer ASCII punctuation, the words and their beginnings once a text, one sum."""
    import math
    import string

    from fairgate.llm.toxicity import _PUNCTUATION, BEGINNINGS
    d, lab = corpus(spark)
    model = fit(d, lab)
    assert set(string.punctuation) <= set(_PUNCTUATION) and sum(map(len, model.known)) == len(model.weights) > 0
    weight, at = {}, 0
    for kind, values in enumerate(model.known):
        for v in values:
            weight[kind, v] = model.weights[at]
            at += 1

    def plain(text):
        has = set()
        for w in (text or "").replace("\v", " ").replace("\f", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "):
            w = w.lower().strip(_PUNCTUATION)
            if w:
                has |= {(0, w)} | {(k, w[:n]) for k, n in enumerate(BEGINNINGS, 1)}
        return 1 / (1 + math.exp(-(model.bias + sum(weight.get(f, 0.0) for f in has))))

    rows = edge_rows()[:-1] + [(100 + r.doc_id, r.text, "en", "a") for r in d.limit(60).collect()]
    got = sorted(((str(r.doc_id), r.score, r.predicted) for r in score(docs(spark, rows), model).collect()))
    want = sorted((str(i), plain(t), int(plain(t) >= 0.7)) for i, t, *_ in rows)
    assert [(g[0], g[2]) for g in got] == [(w[0], w[2]) for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)
