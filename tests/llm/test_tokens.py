"""Packing and token files against the tokenizers library itself."""

import os
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fairgate.llm.packing import differencing, pack, windows_of
from fairgate.llm.textutil import KEPT, scratch_path, small_batches
from fairgate.llm.token_output import decode_ranks, encode_ranks, read_token_files, write_token_files
from fairgate.llm.tokens import WordTokenizer, default_path, worker_tokenizer

from .fixtures import docs, edge_rows, empty

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def tokenizer():
    return WordTokenizer(default_path(), max_words=50)


def ids_of(tokenizer, text):
    return tokenizer.tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = ["it's. a'. .' b.'s c'. x.,y. z._ é.; 1.. 2)) é. 's. =. <. a=. b≮ q.", "The END. End.\nend.", "", "  ", "a\x01b c", "<|endoftext|> it's 12 a<|x",
       "ÅéÉ é ́x K İSTANBUL ΣΑΣ", "a\x85b c d", "日本語 テキスト 한국어", "x\x1cy\x0bz", "don't 'LL", "😀😃 ok", "A" * 3000, "<|STARTOFTEXT|>", "\x00 a"]


def test_same_ids_as_the_library(tokenizer):
    ids, offsets = tokenizer.encode(pa.array([*ODD, None]))
    for i, text in enumerate([*ODD, None]):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == ids_of(tokenizer, text), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAé\u0958日'.,!<|> \n\t1²́ßΣ\x01\x85-_$", max_size=25), min_size=1, max_size=4))
def test_same_ids_on_random_texts(tokenizer, texts):
    ids, offsets = tokenizer.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == ids_of(tokenizer, text)


def test_letters_that_normalise_to_marks(tokenizer):
    words = ["\u0958\u0959 क़ख़", "ǆ ﬁﬂ ª ſ K Å", "가각힣 각", "ʰʱ ⅰ Ⅳ ٣ ß ẞ", "日本 " * 40, "абвгд " * 300 + "x\u0958y " * 20]
    ids, offsets = tokenizer.encode(pa.array(words))
    for i, text in enumerate(words):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == ids_of(tokenizer, text), text


def test_words_in_use_are_encoded_once():
    tok, learned = WordTokenizer(default_path(), max_words=40), []
    learn = tok._learn
    tok._learn = lambda words: (learned.extend(words), learn(words))[1]
    for i in range(60):
        texts = [f"the words in use and new{i}x here"]
        ids, _ = tok.encode(pa.array(texts))
        assert ids.tolist() == ids_of(tok, texts[0])
    assert all(learned.count(w) == 1 for w in ("the", "words", "in", "use", "and", "here")) and len(learned) == 66
    assert len(tok.words.index) <= 40 and len(tok.older.index) <= 40


def test_buckets_are_bounded_in_pieces(spark):
    rows = [(i, "", "en", "a") for i in range(3000)]
    out = pack(docs(spark, rows), pieces_per_bucket=100).collect()
    assert len({r.sequence_id >> 32 for r in out}) > 15 and sum(r.length for r in out) == 3000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=9), max_size=6))
def test_variable_length_code_round_trip(blocks):
    counts = np.array([len(b) for b in blocks], dtype=np.int64)
    ranks = np.array([x for b in blocks for x in b], dtype=np.uint32)
    control, data = encode_ranks(ranks, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
    assert [len(c) for c in control] == [-(-n // 4) for n in counts]
    assert decode_ranks(control, data, counts).tolist() == ranks.tolist()


def test_token_files_edges(spark, tokenizer):
    rows = edge_rows()
    folder = scratch_path(spark, "files")
    write_token_files(docs(spark, rows, extra=True), folder)
    got = sorted(read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))
    upto = 0
    for r in got:
        assert r.start == upto and len(r.ids) == r.n_tokens
        upto += r.n_tokens
    expected = sorted((str(i), ids_of(tokenizer, t) + [2]) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == expected
    digests = {(str(r.doc_id), r.start): r.ids_crc32 for r in read_token_files(spark, folder, digest=True).collect()}
    assert digests == {(str(r.doc_id), r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}


def test_token_files_of_nothing(spark):
    folder = scratch_path(spark, "files")
    write_token_files(empty(spark), folder)
    assert read_token_files(spark, folder, digest=True).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40), st.integers(1, 6))
def test_differencing_parts_everything(lengths, k):
    lengths = np.array(lengths)
    slot = differencing(lengths, k)
    sums = np.bincount(slot, weights=lengths)
    assert len(slot) == len(lengths) and len(sums) <= k
    if len(lengths) >= 4 * k and k > 1:
        assert sums.max() - (sums.min() if len(sums) == k else 0) <= lengths.max()


def test_window_count_rises_with_the_capacity():
    # 30 tokens would fill three windows of 10, but sevens cannot share one
    slot = windows_of(np.array([7, 7, 7, 7, 2]), 10)
    assert np.bincount(slot, weights=[7, 7, 7, 7, 2]).max() <= 10 and slot.max() + 1 == 4


def check_packing(rows, got, tokenizer, window=2048):
    pieces = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    texts = {}
    for i, t, *_ in rows:
        ids = np.array(ids_of(tokenizer, t) + [1], dtype="<u4")
        texts.setdefault((i, len(ids)), []).append(ids)
    assert set(pieces) == set(texts)
    for key, ps in pieces.items():
        copies = len(texts[key])
        whole = sorted((p.start, p.length, p.ids_crc32) for p in ps)
        expected = []
        for ids in texts[key]:
            starts = sorted({(p.start, p.length) for p in ps})
            assert sum(n for _, n in starts) == len(ids)
            expected += [(s, n, zlib.crc32(ids[s:s + n].tobytes())) for s, n in starts]
        assert whole == sorted(expected) and len(whole) == copies * len({s for s, *_ in whole})
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_tokens))
    for s in sequences.values():
        s.sort()
        upto = 0
        for offset, length, _ in s:
            assert offset == upto
            upto += length
        assert upto <= window and s[0][2] in (window, upto)


def test_packing_edges(spark, tokenizer):
    rows = edge_rows()
    check_packing(rows, pack(docs(spark, rows, extra=True)).collect(), tokenizer)


def test_packing_wastes_little(spark, tokenizer):
    rows = [(i, "some words to pack " * (i % 90 + 1), "en", "a") for i in range(400)]
    got = pack(docs(spark, rows)).collect()
    check_packing(rows, got, tokenizer)
    padded = {r.sequence_id: r.padded_tokens for r in got}
    assert sum(r.length for r in got) / sum(padded.values()) > 0.95


def test_packing_nothing(spark):
    assert pack(empty(spark)).count() == 0


def test_words_are_kept_only_for_tasks_that_ask():
    batch = pa.record_batch({"text": ["some words"]})
    first = worker_tokenizer(default_path())
    list(small_batches([batch], keep=True))
    assert worker_tokenizer(default_path()) is first
    assert list(small_batches([batch])) == [batch]          # other work begins in this worker
    assert not KEPT
    ids, _ = worker_tokenizer(default_path()).encode(batch.column("text"))
    assert ids.tolist() == ids_of(first, "some words")


def test_unused_arrow_memory_is_given_back():
    code = """if True:
        import re
        import pyarrow as pa
        from fairgate.llm.textutil import small_batches, words_of

        def mb():
            return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

        texts = pa.array([" ".join(f"w{i}x{j}" for j in range(40)) for i in range(50_000)])
        words = [words_of(texts.slice(i, 2000)) for i in range(0, 50_000, 2000)]
        del words
        before = mb()
        list(small_batches([pa.record_batch({"text": ["a"]})]))
        print(before - mb())
    """
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert float(run.stdout) > 15
