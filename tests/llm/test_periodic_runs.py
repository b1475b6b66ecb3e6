import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairgate.llm.periodic_runs import find_runs, periodic_runs

from .fixtures import docs, edge_rows, empty


def brute_runs(words, min_length=6, min_exponent=4):
    """Every period, every stretch; a stretch counts with its smallest period only."""
    n, best = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in best.items())


def brute_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def coded(texts):
    known = {}
    codes = np.array([known.setdefault(w, len(known)) for t in texts for w in t], dtype=np.int64)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def check(texts, **params):
    got = find_runs(*coded(texts), **params)
    assert got == [(t, *r) for t, words in enumerate(texts) for r in brute_runs(words, **params)]
    return got


@pytest.mark.parametrize("params", [{}, {"min_length": 2, "min_exponent": 2}, {"min_length": 9, "min_exponent": 3}])
def test_small_alphabets_equal_brute_force(params):
    rnd = random.Random(8)
    found = 0
    for _ in range(150):
        texts = [[rnd.choice("ab" if rnd.random() < 0.7 else "abc") for _ in range(rnd.randrange(0, 40))] for _ in range(6)]
        found += len(check(texts, **params))
    assert found > 20


def test_planted_repetitions_equal_brute_force():
    rnd = random.Random(9)
    texts = []
    for _ in range(120):
        words = [str(rnd.randrange(30)) for _ in range(rnd.randrange(5, 60))]
        for _ in range(rnd.randrange(0, 4)):
            unit = [str(rnd.randrange(4)) for _ in range(rnd.randrange(1, 7))]
            times = rnd.randrange(2, 9)
            at = rnd.randrange(len(words) + 1)
            words[at:at] = unit * times + unit[:rnd.randrange(len(unit))]
        texts.append(words)
    assert len(check(texts)) > 60


def test_runs_in_runs_and_one_word_over_and_over():
    unit = ["a"] * 7 + ["b"]
    check([unit * 5, ["a"] * 500, ["a"] * 5, ["a"] * 6, ["x"] + ["a"] * 6 + ["y"], ["a", "b"] * 3, ["a", "b"] * 4, []])
    assert find_runs(*coded([["w"] * 60_000])) == [(0, 0, 60_000, 1)]
    long = [str(i) for i in range(7_000)] * 5
    assert find_runs(*coded([long])) == [(0, 0, 35_000, 7_000)]


def test_repeated_lines_with_different_neighbours():
    rnd = random.Random(10)
    line = "this line stands here again and again".split()
    check([[w for _ in range(80) for w in [*line, str(rnd.randrange(1000))]], line * 12])


def test_edges(spark):
    rows = edge_rows() + [(20, "na " * 9, "en", "a"), (21, " na" * 9 + "\n\n", "en", "a"), (22, "ä ö\tä ö ä ö ä\vö ü", "de", "b")]
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in periodic_runs(docs(spark, rows, extra=True)).collect()}
    expected = {}
    for i, t, *_ in rows:
        words = split(t)
        # the long random text is too long for every period
        runs = brute_runs(words) if len(words) < 1000 else [tuple(r[1:]) for r in find_runs(*coded([words]))]
        expected[i, brute_collapsed(words, runs)] = runs
    assert got == expected
    assert got[20, "na"] == [(0, 9, 1)] and got[22, "ä ö ü"] == [(0, 8, 2)]
    assert periodic_runs(docs(spark, rows)).count() == len(rows) and periodic_runs(empty(spark)).count() == 0


def test_query_on_planted_tails(spark, tmp_path):
    import hashlib
    import zlib

    from fairgate.llm.queries import QUERIES
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 90))) if i % 7 else None, "en", "a") for i in range(300)]
    docs(spark, rows).where(F.col("doc_id").isNotNull()).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.asDict() for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(rows)
    tails = 0
    for i, text, *_ in rows:
        words = split(text)
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            tails += 1
        runs = brute_runs(words)
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert got[i] == {"doc_id": i, "n_runs": len(runs), "start": start, "length": length, "period": period,
                          "exponent_milli": 1000 * length // period if runs else None,
                          "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), "collapsed_sha256": sha(brute_collapsed(words, runs))}
    assert tails > 10
