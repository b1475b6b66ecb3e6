"""Token ids of whole texts with a public tokenizer, one encoding per distinct
word.

The vocabulary drops white space and never merges across it, so the ids of a
text are the ids of its white-space-free words in turn.  Each word is encoded
once per Python worker and then gathered with numpy.  To keep the words few,
ASCII capitals are lowered and a run of punctuation between a letter and white
space stands alone, which the vocabulary's own rules do anyway.  A text that
holds the start of a special token (``<|``) goes to the tokenizer whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textutil import KEPT, words_of

_SENTINEL = "\x01"          # a symbol of its own between words of one call
_PER_CALL = 256
_END = "</w>"               # what the last token of a run of letters ends with
#: a digit or a letter (of scripts in which normalising leaves no marks), a run
#: of ASCII punctuation without the apostrophe, white space or the end
_TAIL = r"([\p{Latin}\p{Greek}\p{Cyrillic}0-9])([!-&(-/:-@\[-`{-~]+)([ \t\n\f\r]|$)"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words:
    """Known words: the row of each, and each row's ids in one pool."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.length = np.zeros(1 << 16, dtype=np.int32)
        self.pool = np.zeros(1 << 18, dtype=np.uint32)
        self.used = self.bytes = 0

    def add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        at, n = len(self.index), len(words)
        while at + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.start[at:at + n] = self.used + np.cumsum(lengths) - lengths
        self.length[at:at + n] = lengths
        self.index.update(zip(words, range(at, at + n)))
        self.used += len(ids)
        self.bytes += sum(map(len, words))

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows in turn, and how many each has."""
        n = self.length[rows].astype(np.int64)
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.start[rows] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], n


class WordTokenizer:
    """``encode(texts)`` gives the ids of all texts in one array and the
    texts' offsets in it.  Known words are kept in two generations of at most
    ``max_words`` (or ``max_bytes``): a full one becomes the older one, the
    older one goes, and a word found there moves to the new one, so that
    words in use stay known."""

    def __init__(self, path: str, max_words: int = 600_000, max_bytes: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words, self.max_bytes = max_words, max_bytes
        self.mark = self._whole(_SENTINEL)
        assert len(self.mark) == 1
        self.words, self.older = _Words(), _Words()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(_END)]] = True

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        """Encode new words, many to a call.  The tokens themselves say where
        a word of letters ends; other words stand between symbols."""
        letters = [w for w in words if w.isalpha()]
        left = [w for w in words if not w.isalpha()]
        for group, ids in self._calls(letters, " "):
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(group) and len(ids) == ends[-1] + 1:      # one end a word
                self.words.add(group, ids, np.diff(ends, prepend=-1))
            else:
                left += group
        for group, ids in self._calls([w for w in left if _SENTINEL not in w], f" {_SENTINEL} "):
            marks = np.flatnonzero(ids == self.mark[0])
            bounds = np.concatenate([[-1], marks, [len(ids)]])
            assert len(bounds) == len(group) + 1
            self.words.add(group, np.delete(ids, marks), np.diff(bounds) - 1)
        for w in left:
            if _SENTINEL in w:
                ids = np.array(self._whole(w), dtype=np.uint32)
                self.words.add([w], ids, np.array([len(ids)]))

    def _calls(self, words: list[str], between: str) -> Iterator[tuple[list[str], np.ndarray]]:
        groups = [words[i:i + _PER_CALL] for i in range(0, len(words), _PER_CALL)]
        found = self.tokenizer.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False)
        return ((g, np.array(e.ids, dtype=np.uint32)) for g, e in zip(groups, found))

    def table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Start in the pool and number of ids of each distinct word."""
        words = words.to_pylist()
        if len(self.words.index) + len(words) > self.max_words or self.words.bytes > self.max_bytes:
            self.words, self.older = _Words(), self.words
        rows = self._rows(self.words, words)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            absent = [words[i] for i in missing]
            before = self._rows(self.older, absent)
            again = np.flatnonzero(before >= 0)
            if len(again):
                self.words.add([absent[i] for i in again], *self.older.ids(before[again]))
            self._learn([absent[i] for i in np.flatnonzero(before < 0)])
            rows[missing] = self._rows(self.words, absent)
        return self.words.start[rows], self.words.length[rows].astype(np.int64)

    @staticmethod
    def _rows(known: _Words, words: list[str]) -> np.ndarray:
        """The row of each word, -1 for unknown ones."""
        return np.fromiter(map(known.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        if len(special):
            mask = np.zeros(len(texts), dtype=bool)
            mask[special] = True
            plain = pc.if_else(pa.array(mask), "", texts)
        else:
            plain = texts
        plain = pc.replace_substring_regex(pc.ascii_lower(plain), _TAIL, r"\1 \2\3")
        codes, word_offsets, words = words_of(plain)
        starts, lengths = self.table(words)
        n = lengths[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts[codes] - (ends - n), n) + np.arange(total)
        ids = self.words.pool[at]
        offsets = np.concatenate([[0], ends])[word_offsets]
        if len(special):
            parts = [ids[offsets[i]:offsets[i + 1]] for i in range(len(texts))]
            for i in special:
                parts[i] = np.array(self._whole(texts[i].as_py()), dtype=np.uint32)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, offsets


def worker_tokenizer(path: str) -> WordTokenizer:
    """This Python worker's tokenizer (its table outlives one task, but not
    the first task of ``small_batches`` that does not keep it)."""
    if path not in KEPT:
        KEPT[path] = WordTokenizer(path)
    return KEPT[path]
