import random

import numpy as np

from fairgate.llm.langid import FILTERS, WIDTHS, Predictor, fit, language_id, predict, train, windows

from .fixtures import docs, edge_rows, empty

ALPHABETS = {"aa": "abcde ", "bb": "efghij ", "cc": "äöüßk "}


def corpus(spark, n=240):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        lang = list(ALPHABETS)[i % 3]
        rows.append((i, "".join(rnd.choice(ALPHABETS[lang]) for _ in range(rnd.choice([30, 300, 900]))) + "x", lang, "s"))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(spark)
    got = {r.doc_id: r for r in language_id(docs(spark, rows), steps=200).collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 30 and np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.95


def test_tabulated_filters_equal_the_convolution():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (40, 64)).astype(np.uint8)
    net = train(x, np.arange(40) % 2, ["a", "b"], steps=3)
    e = net.embed[x]
    pooled = [sum(e[:, j:64 - w + 1 + j] @ f[j] for j in range(w)).max(axis=1) for w, f in zip(WIDTHS, net.filters)]
    z = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias
    z = z - z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert len(net.filters[0][0][0]) == FILTERS and np.allclose(Predictor(net).log_probs(x), z, atol=1e-4)


def test_windows_cover_the_text():
    for n in (0, 1, 255, 256, 257, 512, 1000):
        data = bytes(i % 251 for i in range(n))
        w = windows(data)
        assert w.shape[1] == 256 and set(data) <= set(w.ravel().tolist())
        assert w[-1].tobytes().rstrip(b"\0") == data[-256:].rstrip(b"\0")


def test_edges(spark):
    net = fit(docs(spark, corpus(spark)), steps=50)
    rows = edge_rows()
    got = predict(docs(spark, rows, extra=True), net).collect()
    assert len(got) == len(rows)
    for r, in_ in zip(sorted(got, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0]))):
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].lang_pred == by_id[2].lang_pred == by_id[3].lang_pred == by_id[11].lang_pred == "und" and by_id[11].score == 0
    assert by_id[8].lang_pred in ALPHABETS
    assert language_id(empty(spark)).count() == 0
    unlabelled = docs(spark, [(1, "text", None, "a")])
    assert language_id(unlabelled).first().lang_pred == "und"


def test_predictions_equal_a_plain_network(spark):
    """Every text byte by byte: all windows, every filter at every place, mean of the log-probabilities."""
    import math
    import re
    rows = corpus(spark, 24) + [(100, "x" * 700 + "äöü" * 60, "aa", "s"), (101, "123 .", "aa", "s"), (102, None, "aa", "s"), (103, "é", "bb", "s"), (104, "", "cc", "s")]
    net = fit(docs(spark, corpus(spark, 90)), steps=30)
    embed, out, out_bias, bias = (np.asarray(a, dtype=np.float64) for a in (net.embed, net.out, net.out_bias, net.bias))

    def log_probs(window):
        pooled = []
        for w, f in zip(WIDTHS, net.filters):
            places = [sum(embed[window[i + j]] @ f[j].astype(np.float64) for j in range(w)) for i in range(len(window) - w + 1)]
            pooled += np.max(places, axis=0).tolist()
        z = np.maximum(np.array(pooled) + bias, 0) @ out + out_bias
        return z - math.log(sum(math.exp(v) for v in z - z.max())) - z.max()

    got = {r.doc_id: r for r in predict(docs(spark, rows), net).collect()}
    for i, text, *_ in rows:
        if not re.search(r"[^\W\d_]", text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        data = text.encode()
        cut = [data] if len(data) <= 256 else [data[k:k + 256] for k in range(0, len(data) - 255, 256)]
        if len(data) > 256 and len(data) % 256:
            cut.append(data[-256:])
        mean = np.mean([log_probs(c.ljust(256, b"\0")) for c in cut], axis=0)
        q = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert got[i].lang_pred == net.labels[int(q.argmax())] and abs(got[i].score - q.max()) < 1e-3
