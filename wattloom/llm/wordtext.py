"""Letter words of texts and hashed pieces of words, for the learned scorers.  Runs inside tasks, on small batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

LETTERS = re.compile(r"[^\W\d_]+")
CHUNK_CHARS = 250_000  # their words as Python strings take about 20 times as many bytes


def letter_words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def hashed_pieces(words: list[str], low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the words' character n-grams, ends marked: all words' one after another, and how many each has.

    ``low`` may be 3 at most, so that every word has one.
    """
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.cumsum(sizes)[word] - np.arange(len(codes))
    found, owner = [], []
    for k in range(low, high + 1):
        at = np.flatnonzero(left >= k)
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h = h * np.uint64(1_000_003) + codes[at + j]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        found.append(((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64))
        owner.append(word[at])
    owner = np.concatenate(owner)
    return np.concatenate(found)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows with about ``CHUNK_CHARS`` characters: first row and texts (null as empty)."""
    texts, held, start = batch.column(column), [], 0
    size = 0
    for i in range(len(texts)):
        text = texts[i].as_py() or ""
        if held and size + len(text) > CHUNK_CHARS:
            yield start, held
            held, start, size = [], i, 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


class WordTable:
    """Rows of numbers by word, computed once per word and kept up to a bounded number of words."""

    def __init__(self, width: int, compute: Callable[[list[str]], np.ndarray], limit: int = 150_000):
        self.compute, self.limit, self.width = compute, limit, width
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, width), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words.  May start the table anew, so use the rows before the next call."""
        if len(self.index) > self.limit:
            self.index, self.rows = {}, np.zeros((1024, self.width), np.float32)
        known = self.index
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            first = len(known) + 1  # row 0 stays zero, for padding
            while first + len(new) > len(self.rows):
                more = np.zeros((2 * len(self.rows), self.width), np.float32)  # takes memory as it is filled
                more[: len(self.rows)] = self.rows
                self.rows = more
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                self.rows[first + at : first + at + len(part)] = self.compute(part)
            known.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))
