"""Language identification with a byte convolutional network.

Bytes are embedded, convolved with filters of several widths, max-pooled over
a window of fixed length, and classified by softmax.  The network is trained
in numpy on windows of a bounded sample of labelled texts.  Prediction cuts
every whole text into windows (the last one ends with the text), sums the
windows' log probabilities, and takes the softmax of their mean per language.

Applying a filter to a byte pair is a lookup: its weights times the pair's
embeddings are tabulated once for all 65,536 pairs, which gives the same sums
as the convolution.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
texts shorter than a window are padded with zero bytes; null languages are not
learned from; without any labelled text every text is ``und``; rows that
repeat a doc_id are predicted one by one; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textutil import small_batches, texts_of
from .toxicity import held_out_fold

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
UNKNOWN = "und"


@dataclass
class ByteCnn:
    labels: list[str]
    embed: np.ndarray                    # 256 x EMBED
    filters: list[np.ndarray]            # by width: width x EMBED x FILTERS
    bias: np.ndarray                     # all filters
    out: np.ndarray                      # all filters x labels
    out_bias: np.ndarray


def windows(data: bytes, length: int = WINDOW) -> np.ndarray:
    """All windows of a text, side by side; the last one ends with it."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= length:
        return np.pad(raw, (0, length - len(raw)))[None, :]
    starts = np.arange(0, len(raw) - length + 1, length)
    if starts[-1] + length < len(raw):
        starts = np.append(starts, len(raw) - length)
    return raw[starts[:, None] + np.arange(length)]


def train(x: np.ndarray, y: np.ndarray, labels: list[str], steps: int = 600, batch: int = 128,
          rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Adam on the softmax loss; ``x`` are byte windows, ``y`` label indices.
    Classes are drawn evenly."""
    rng = np.random.default_rng(seed)
    n_out = FILTERS * len(WIDTHS)
    p = {"embed": rng.normal(0, 0.3, (256, EMBED)), "bias": np.zeros(n_out), "out": rng.normal(0, 0.1, (n_out, len(labels))),
         "out_bias": np.zeros(len(labels))}
    for w in WIDTHS:
        p[f"f{w}"] = rng.normal(0, 1 / math.sqrt(w * EMBED), (w, EMBED, FILTERS))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    by_class = [np.flatnonzero(y == c) for c in range(len(labels))]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(c, -(-batch // len(labels))) for c in by_class])
        xb, yb = x[rows], y[rows]
        e = p["embed"][xb]                                        # B x L x E
        pooled, where, length = [], [], xb.shape[1]
        for w in WIDTHS:
            c = sum(e[:, j:length - w + 1 + j] @ p[f"f{w}"][j] for j in range(w))
            at = c.argmax(axis=1)                                 # B x F
            where.append(at)
            pooled.append(np.take_along_axis(c, at[:, None], axis=1)[:, 0])
        h0 = np.concatenate(pooled, axis=1) + p["bias"]
        h = np.maximum(h0, 0)
        z = h @ p["out"] + p["out_bias"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(len(yb)), yb] -= 1
        q /= len(yb)
        g = {"out": h.T @ q, "out_bias": q.sum(axis=0)}
        dh = (q @ p["out"].T) * (h0 > 0)
        g["bias"], g["embed"] = dh.sum(axis=0), np.zeros_like(p["embed"])
        for i, w in enumerate(WIDTHS):
            d = dh[:, i * FILTERS:(i + 1) * FILTERS]
            g[f"f{w}"] = np.zeros_like(p[f"f{w}"])
            for j in range(w):
                hit = np.take_along_axis(xb, where[i] + j, axis=1)     # B x F: the byte under the pooled place
                g[f"f{w}"][j] = np.einsum("bfe,bf->ef", p["embed"][hit], d)
                np.add.at(g["embed"], hit, d[:, :, None] * p[f"f{w}"][j].T[None])
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
            lr = rate * min(1.0, 2 * (1 - step / steps) + 0.05)
            p[k] -= (lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return ByteCnn(labels, p["embed"], [p[f"f{w}"] for w in WIDTHS], p["bias"], p["out"], p["out_bias"])


class Predictor:
    """The network with its filters tabulated by byte pair."""

    def __init__(self, net: ByteCnn, chunk: int = 64):
        self.net, self.chunk = net, chunk
        one = lambda f, j: net.embed @ f[j]  # noqa: E731  256 x FILTERS
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        self.tables = []                       # by width: (offset, table by pair) ..., rest by byte
        for w, f in zip(WIDTHS, net.filters):
            parts = [(j, pair(one(f, j), one(f, j + 1))) for j in range(0, w - 1, 2)]
            self.tables.append((w, parts, (w - 1, one(f, w - 1)) if w % 2 else None))

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.net.labels)))
        length = x.shape[1]
        for i in range(0, len(x), self.chunk):
            xb = x[i:i + self.chunk]
            pairs = xb[:, :-1].astype(np.intp) * 256 + xb[:, 1:]
            pooled = []
            for w, parts, last in self.tables:
                n = length - w + 1
                c = np.take(parts[0][1], pairs[:, parts[0][0]:parts[0][0] + n], axis=0)
                for j, t in parts[1:]:
                    c += np.take(t, pairs[:, j:j + n], axis=0)
                if last is not None:
                    c += np.take(last[1], xb[:, last[0]:last[0] + n], axis=0)
                pooled.append(c.max(axis=1))
            h = np.maximum(np.concatenate(pooled, axis=1) + self.net.bias, 0)
            z = (h @ self.net.out + self.net.out_bias).astype(np.float64)
            z -= z.max(axis=1, keepdims=True)
            out[i:i + self.chunk] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def texts(self, texts: pa.Array, limit: int = 8192) -> tuple[list[str], np.ndarray]:
        """Language and score of each text, all of its windows counted."""
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        data = pc.fill_null(texts, "").cast(pa.binary()).to_pylist()
        total = np.zeros((len(data), len(self.net.labels)))
        count = np.ones(len(data))
        hold, owner, held = [], [], 0

        def flush() -> None:
            if hold:
                np.add.at(total, np.concatenate(owner), self.log_probs(np.concatenate(hold)))
                hold.clear()
                owner.clear()

        for i in np.flatnonzero(letters):
            w = windows(data[i])
            count[i] = len(w)
            hold.append(w)
            owner.append(np.full(len(w), i))
            held += len(w)
            if held >= limit:
                flush()
                held = 0
        flush()
        mean = total / count[:, None]
        q = np.exp(mean - mean.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        best = q.argmax(axis=1)
        return ([self.net.labels[b] if ok else UNKNOWN for b, ok in zip(best, letters)],
                np.where(letters, q[np.arange(len(q)), best], 0.0))


def fit(docs: DataFrame, folds: int = 4, fold: int = 2, max_texts: int = 4000, windows_per_text: int = 4,
        **training) -> ByteCnn | None:
    """Train on about ``max_texts`` labelled texts (twice as many at most)
    outside the held-out fold, chosen by the hash of their id, the same number
    a language, and on ``windows_per_text`` windows of each."""
    known = (docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
             .where(~held_out_fold(F.col("doc_id"), folds, fold)))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(counts)                                      # the languages to learn
    if not labels:
        return None
    each = max(1, max_texts // len(labels))
    slots = 1 << 30
    # a language's share of the hash range holds about ``each`` of its texts
    below = F.create_map(*[F.lit(v) for k in labels for v in (k, min(slots, math.ceil(slots * each / counts[k])))])
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - 4 * WINDOW, F.lit(1))).cast("int") + 1
    rows = (known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(slots)) < below[F.col("lang")])
            .select("doc_id", "lang", F.substring("text", start, F.lit(4 * WINDOW)).alias("t"))
            .limit(2 * max_texts).collect())                     # bounded number of bounded pieces
    x, y = [], []
    rng = np.random.default_rng(11)
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["t"])):
        w = windows(r["t"].encode())
        w = w[rng.permutation(len(w))[:windows_per_text]]
        x.append(w)
        y.append(np.full(len(w), labels.index(r["lang"])))
    seen = sorted({int(k[0]) for k in y})                        # a language of few texts may have none in its share
    labels, y = [labels[k] for k in seen], [np.searchsorted(seen, k) for k in y]
    x, y = np.concatenate(x), np.concatenate(y)
    short = rng.integers(24, WINDOW, len(x))                 # some windows end early, as short texts do
    blank = (rng.random(len(x)) < 0.3)[:, None] & (np.arange(WINDOW) >= short[:, None])
    return train(np.where(blank, 0, x).astype(np.uint8), y, labels, **training)


def predict(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    src = docs.select(F.col("doc_id"), F.col("text"))
    if net is None:
        return src.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Predictor(shared.value)
        for batch in small_batches(batches):
            lang, score = net.texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    return src.mapInArrow(apply, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 4, fold: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return predict(docs, fit(docs, folds, fold, **options)).select(
        "doc_id", held_out_fold(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")
