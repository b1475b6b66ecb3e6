"""Toxicity classifier with counterfactual regularisation.

A logistic model over words and word beginnings.  Words that set toxic and
clean documents apart are chosen by a two-sample test on document counts; the
weights then minimise the class-balanced log loss plus an L1 term plus
``fairness`` times the mean squared change of the score when an identity term
in a labelled sentence is swapped for another of its kind.  A term that says
who is spoken of, not how, therefore earns no weight of its own, and neutral
mentions of a group are not held against a text.

Training reads at most ``max_labelled`` labelled documents (those with the
smallest hash of their id); scoring reads every whole text.

Defined cases: null and empty texts score like a text without known words;
without both classes among the labels every text scores the share of toxic
labels (0 without labels); labels that are null or not 0/1 and rows without a
doc_id are not learned from; rows that repeat a doc_id are scored one by one;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .textutil import small_batches, texts_of, unused, words_of

# Identity terms; a term is swapped for the others of its line (fixed values).
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrants", "refugees", "natives", "citizens"),
    ("old", "young"),
    ("disabled", "deaf", "blind", "autistic"),
)
_OTHERS = {t: [o for o in line if o != t] for line in IDENTITY_TERMS for t in line}
_IDENTITY = re.compile(r"\b(" + "|".join(sorted(_OTHERS, key=len, reverse=True)) + r")\b", re.IGNORECASE)
_SENTENCE = re.compile(r"[^.!?\n]+")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BEGINNINGS = (4, 5, 6)     # code points of a word's beginnings


@dataclass
class ToxicityModel:
    known: list[list[str]]     # by kind (whole words, then each length of beginning)
    weights: np.ndarray        # of the kinds' features in turn
    bias: float


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text, in lower case without outer punctuation."""
    codes, offsets, words = words_of(texts)
    return codes, offsets, pc.utf8_trim(pc.utf8_lower(words), _PUNCTUATION)


def _kinds(words: pa.Array) -> list[pa.Array]:
    """The words themselves and their beginnings, one array a kind."""
    return [words, *(pc.utf8_slice_codeunits(words, 0, n) for n in BEGINNINGS)]


def _known(texts: pa.Array, known: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, of the known features."""
    codes, offsets, found = _features(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pairs, base, size = [], 0, sum(map(len, known))
    for table, values in zip(known, _kinds(found)):
        if not table:
            continue
        at = pc.fill_null(pc.index_in(values, value_set=pa.array(table, values.type)), -1).to_numpy(zero_copy_only=False)[codes]
        hit = at >= 0
        pairs.append(doc[hit] * size + at[hit] + base)
        base += len(table)
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
    return pairs // max(size, 1), pairs % max(size, 1)


def swaps(text: str) -> list[tuple[str, str]]:
    """(sentence, the sentence with one kind of identity term swapped)."""
    out = []
    for sentence in _SENTENCE.findall(text):
        for term in dict.fromkeys(m.lower() for m in _IDENTITY.findall(sentence)):
            for other in _OTHERS[term]:
                out.append((sentence, re.sub(rf"\b{term}\b", other, sentence, flags=re.IGNORECASE)))
    return out


def held_out_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text falls into ``fold`` (a missing id does not)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def fit_logistic(row: np.ndarray, col: np.ndarray, y: np.ndarray, n_features: int,
                 swap_row: np.ndarray, swap_col: np.ndarray, swap_sign: np.ndarray, n_swaps: int,
                 fairness: float = 1.0, l1: float = 5e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Proximal gradient descent (accelerated) on sparse 0/1 rows.  ``swap_*``
    are the sparse rows x - x' of the counterfactual sentences."""
    share = y.mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)   # both classes weigh one half
    w = v = np.zeros(n_features)
    b = vb = 0.0
    spread = np.bincount(col, weights=cost[row], minlength=n_features)  # diagonal bound of the curvature
    per_row = max(1, np.bincount(row, minlength=1).max() if len(row) else 1)
    step = 4.0 / (np.sqrt(per_row) * np.maximum(spread, 1e-3))
    if n_swaps:
        step = 1.0 / (1.0 / step + 4 * fairness * np.bincount(swap_col, minlength=n_features) / n_swaps * np.sqrt(per_row))
    for i in range(steps):
        z = vb + np.bincount(row, weights=v[col], minlength=len(y))
        err = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(col, weights=err[row], minlength=n_features)
        if n_swaps:
            change = np.bincount(swap_row, weights=swap_sign * v[swap_col], minlength=n_swaps)
            grad += 2 * fairness / n_swaps * np.bincount(swap_col, weights=swap_sign * change[swap_row], minlength=n_features)
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = vb - 2.0 * err.sum()
        pull = i / (i + 3)
        v, vb = new + pull * (new - w), nb + pull * (nb - b)
        w, b = new, nb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, fairness: float = 1.0, max_labelled: int = 12_000,
        max_features: int = 20_000, min_docs: int = 3, l1: float = 5e-4, folds: int = 3, fold: int = 1) -> ToxicityModel:
    """Train on the labelled documents outside the held-out fold."""
    use = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
           .where(~held_out_fold(F.col("doc_id"), folds, fold))
           .select("doc_id", F.col("toxic").cast("double").alias("y"))
           .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled))
    # at most max_labelled rows on the broadcast side
    sample = materialize(texts_of(docs).join(F.broadcast(use), "doc_id").select("text", "y"))
    counts = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = counts.get(1.0, 0), counts.get(0.0, 0)
    if not pos or not neg:
        p = min(max(pos / max(pos + neg, 1), 1e-9), 1 - 1e-9)
        return ToxicityModel([], np.zeros(0), float(np.log(p / (1 - p))))

    def doc_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            codes, offsets, found = _features(batch.column("text"))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            y = batch.column("y").to_numpy()
            for kind, values in enumerate(_kinds(found)):
                coded = values.dictionary_encode()
                pairs = np.unique(doc * len(coded.dictionary) + coded.indices.to_numpy()[codes]) if len(codes) else codes
                feature, at = pairs % max(len(coded.dictionary), 1), pairs // max(len(coded.dictionary), 1)
                n = np.bincount(feature, minlength=len(coded.dictionary))
                toxic = np.bincount(feature, weights=y[at], minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), kind), pa.int32()), coded.dictionary.cast(pa.string()),
                     pa.array(n, pa.int64()), pa.array(toxic, pa.float64())], ["kind", "value", "n", "toxic"])

    a, b = F.col("toxic"), F.col("n") - F.col("toxic")
    rate = F.col("n") / F.lit(pos + neg)
    z = (a / pos - b / neg) / F.sqrt(rate * (1 - rate) * (1 / pos + 1 / neg) + 1e-12)
    best = (sample.mapInArrow(doc_features, "kind int, value string, n bigint, toxic double")
            .groupBy("kind", "value").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
            .where((F.col("n") >= min_docs) & (F.length("value") > 0))
            .withColumn("z", F.abs(z)).where(F.col("z") >= 2)
            .orderBy(F.desc("z"), "kind", "value").limit(max_features).collect())
    known = [[r["value"] for r in best if r["kind"] == k] for k in range(1 + len(BEGINNINGS))]
    n_features = sum(map(len, known))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n = batch.num_rows
            doc, feature = _known(batch.column("text"), known)
            cut = np.searchsorted(doc, np.arange(n + 1))
            pairs = [(i, p) for i, t in enumerate(batch.column("text").to_pylist()) if _IDENTITY.search(t) for p in swaps(t)]
            sides = [_known(pa.array([p[k] for _, p in pairs], pa.string()), known) for k in (0, 1)] if pairs else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(["doc"] * n), batch.column("y"), pa.array([feature[i:j].tolist() for i, j in zip(cut, cut[1:])], pa.list_(pa.int64())),
                 pa.array([[]] * n, pa.list_(pa.int64()))], ["part", "y", "has", "swapped"])
            if pairs:
                cuts = [np.searchsorted(d, np.arange(len(pairs) + 1)) for d, _ in sides]
                lists = [[f[i:j].tolist() for i, j in zip(c, c[1:])] for c, (_, f) in zip(cuts, sides)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["swap"] * len(pairs)), pa.array([0.0] * len(pairs)), *[pa.array(x, pa.list_(pa.int64())) for x in lists]],
                    ["part", "y", "has", "swapped"])

    # bounded by max_labelled rows of known features
    rows = sample.mapInArrow(sparse, "part string, y double, has array<bigint>, swapped array<bigint>").collect()
    rows.sort(key=lambda r: (r["part"], r["y"], r["has"], r["swapped"]))     # the order of tasks plays no part
    docs_, swaps_ = [r for r in rows if r["part"] == "doc"], [r for r in rows if r["part"] == "swap" and r["has"] != r["swapped"]]
    flat = lambda lists: np.array([f for x in lists for f in x], dtype=np.int64)
    index = lambda lists: np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    has, swapped = [r["has"] for r in swaps_], [r["swapped"] for r in swaps_]
    weights, bias = fit_logistic(
        index([r["has"] for r in docs_]), flat([r["has"] for r in docs_]), np.array([r["y"] for r in docs_]), n_features,
        np.concatenate([index(has), index(swapped)]).astype(np.int64), np.concatenate([flat(has), flat(swapped)]),
        np.concatenate([np.ones(sum(map(len, has))), -np.ones(sum(map(len, swapped)))]), len(swaps_), fairness, l1)
    keep, cuts = weights != 0, np.cumsum([0, *map(len, known)])
    return ToxicityModel([[w for w, k in zip(table, keep[i:]) if k] for table, i in zip(known, cuts)], weights[keep], float(bias))


def score_texts(texts: pa.Array, model: ToxicityModel) -> np.ndarray:
    doc, feature = _known(texts, model.known)
    total = model.bias + np.bincount(doc, weights=model.weights[feature], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, beside: list[str] | None = None,
          names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The score and whether it reaches the threshold (1 or 0) of every row,
    beside the columns ``beside`` (doc_id unless given)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    beside = beside or ["doc_id"]
    src = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*beside, "text"])])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            s = score_texts(pc.fill_null(batch.column("text"), ""), shared.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in beside], pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             [*beside, *names])

    ddl = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in beside)
    return src.mapInArrow(apply, f"{ddl}, `{names[0]}` double, `{names[1]}` int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, folds=folds, fold=fold, **options)
    return score(docs, model, threshold).select(
        "doc_id", held_out_fold(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that the classifier does not reject."""
    names = unused(docs.columns, "score", "predicted")
    scored = score(docs, fit(docs, labels, **options), threshold, docs.columns, tuple(names))
    return scored.where(F.col(f"`{names[1]}`") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
