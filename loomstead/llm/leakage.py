"""Passages of held-out items inside a corpus, found through one FM-index per shard of the corpus.

A shard is as many whole texts as a task has read when their words reach ``SHARD_WORDS``. Its words become dense codes,
texts are parted by code 1, code 0 ends the shard, and of that sequence are kept: the Burrows-Wheeler transform in a wavelet matrix with rank
counts, the number of smaller codes per code, and every ``SAMPLE``-th suffix position. Each item is searched by windows
of ``min_words`` words, all windows of a block at once: fifteen backward steps, each two ranks through the matrix's
levels. Rows found walk back to a sampled position, which names text and word; overlapping windows merge to one span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.text import word_hashes

SHARD_WORDS, SAMPLE, BLOCK_WORDS = 1 << 20, 16, 1 << 20


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of codes >= 0 by prefix doubling, the first key packing as many codes as fit 62 bits."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length()) if n else 1
    k = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(k):
        key = (key << bits) | np.concatenate([s[j:], np.zeros(min(j, n), np.int64)])[:n]
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[0:1] = 0
        np.cumsum(ordered[1:] != ordered[:-1], out=fresh[1:])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1 or k >= n:
            return order
        key = (rank << 31) | np.concatenate([rank[k:] + 1, np.zeros(min(k, n), np.int64)])[:n]
        k *= 2


class WaveletMatrix:
    """Ranks of any code before any position of a sequence, one bit a level; all queries of a call run at once."""

    def __init__(self, s: np.ndarray):
        self.levels = max(1, int(s.max()).bit_length()) if len(s) else 1
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``code`` stands before each ``at``."""
        start, end = np.zeros_like(at), at.copy()
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = ((code >> (self.levels - 1 - depth)) & 1).astype(bool)
            s1, e1 = ones[start], ones[end]
            start, end = np.where(up, zeros + s1, start - s1), np.where(up, zeros + e1, end - e1)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The codes at the given positions."""
        code, at = np.zeros(len(at), np.int64), at.copy()
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            code = (code << 1) | bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return code


class FMIndex:
    def __init__(self, words: np.ndarray, starts: np.ndarray):
        """``words``: hashes of all texts in a row; ``starts``: where each begins, in ascending order; no text is empty."""
        self.alphabet, codes = np.unique(words, return_inverse=True)
        self.starts = starts + np.arange(len(starts))
        place = np.arange(len(words)) + np.searchsorted(starts, np.arange(len(words)), side="right") - 1
        s = np.ones(len(words) + len(starts) + 1, np.int64)
        s[place] = codes + 2
        s[-1] = 0
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.matrix = WaveletMatrix(bwt)
        counts = np.bincount(s, minlength=len(self.alphabet) + 3)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        self.sampled = np.full(len(s), -1, np.int64)
        kept = sa % SAMPLE == 0
        self.sampled[kept] = sa[kept]

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Codes of words, -1 for those the shard has not."""
        if not len(self.alphabet):
            return np.full(words.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 2, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(phrase, position)`` of every occurrence of phrases of one length, given as a matrix of words."""
        codes = self.codes(phrases)
        live = np.flatnonzero((codes > 0).all(axis=1))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.sampled), np.int64)
        for j in range(codes.shape[1] - 1, -1, -1):
            c = codes[live, j]
            lo, hi = self.smaller[c] + self.matrix.rank(c, lo), self.smaller[c] + self.matrix.rank(c, hi)
            left = hi > lo
            live, lo, hi = live[left], lo[left], hi[left]
        counts = hi - lo
        phrase = np.repeat(live, counts)
        rows = np.repeat(lo, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return phrase, self.locate(rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(self.sampled[rows] < 0)
        while len(walking):
            c = self.matrix.access(rows[walking])
            rows[walking] = self.smaller[c] + self.matrix.rank(c, rows[walking])
            steps[walking] += 1
            walking = walking[self.sampled[rows[walking]] < 0]
        return self.sampled[rows] + steps

    def spans(self, phrases: np.ndarray, owner: np.ndarray) -> pd.DataFrame:
        """Merged spans ``(text, item, start, end)`` in words; ``owner`` is the item of each phrase."""
        phrase, position = self.search(phrases)
        text = np.searchsorted(self.starts, position, side="right") - 1
        hit = pd.DataFrame({"text": text, "item": owner[phrase], "start": position - self.starts[text]}).drop_duplicates().sort_values(["text", "item", "start"], ignore_index=True)
        if hit.empty:
            return hit.assign(end=hit["start"])
        hit["end"] = hit["start"] + phrases.shape[1]
        new = (hit["text"] != hit["text"].shift()) | (hit["item"] != hit["item"].shift()) | (hit["start"] > hit["end"].shift())
        return hit.groupby(new.cumsum()).agg({"text": "first", "item": "first", "start": "first", "end": "last"})


def windows(hashes: list[int] | None, size: int) -> np.ndarray:
    w = np.asarray(hashes if hashes is not None else [], np.int64)
    return np.lib.stride_tricks.sliding_window_view(w, size) if len(w) >= size else np.empty((0, size), np.int64)


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 15) -> DataFrame:
    """``(doc_id, item_id, word_start, word_end)``: spans of a document that hold ``min_words`` or more words of an item.

    Words are compared without case, points, punctuation and spacing. Null, empty and shorter texts match nothing; an
    item given twice counts once, one of null id not at all; a document's repeated rows give its spans once. Items are
    sent to the tasks in blocks of ``BLOCK_WORDS`` words, so their number is not limited; each shard's index is built
    once and searched by every block. Empty tables give an empty result."""
    spark = docs.sparkSession
    given = items.select(F.col(item_id).cast("bigint").alias("item_id"), word_hashes(F.col(item_text)).alias("w")).where(F.col("item_id").isNotNull() & (F.size("w") >= min_words))
    blocks, now, size = [], [], 0
    for r in given.distinct().orderBy("item_id").toLocalIterator():  # one pass; a block is all that is held beside the broadcasts
        now.append((r["item_id"], np.asarray(r["w"], np.int64)))
        size += len(r["w"])
        if size >= BLOCK_WORDS:
            blocks.append(spark.sparkContext.broadcast(now))
            now, size = [], 0
    blocks.append(spark.sparkContext.broadcast(now))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, words, held = [], [], 0

        def flush() -> Iterator[pd.DataFrame]:
            lengths = np.array([len(w) for w in words], np.int64)
            index = FMIndex(np.concatenate([*words, np.empty(0, np.int64)]), np.cumsum(lengths) - lengths)
            for block in blocks:
                if block.value:
                    parts = [windows(w, min_words) for _, w in block.value]
                    found = index.spans(np.concatenate(parts), np.repeat(np.array([i for i, _ in block.value], np.int64), [len(p) for p in parts]))
                    if len(found):
                        yield pd.DataFrame({"doc_id": np.asarray(ids, np.int64)[found["text"]], "item_id": found["item"].to_numpy(), "word_start": found["start"].to_numpy(np.int32), "word_end": found["end"].to_numpy(np.int32)})

        for batch in batches:
            for i, w in zip(batch["doc_id"], batch["w"]):
                if len(w) >= min_words:
                    ids.append(i)
                    words.append(np.asarray(w, np.int64))
                    held += len(w)
                if held >= SHARD_WORDS:
                    yield from flush()
                    ids, words, held = [], [], 0
        if ids:
            yield from flush()

    corpus = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), word_hashes(F.col(text)).alias("w")).where(F.col("doc_id").isNotNull())
    return corpus.mapInPandas(search, "doc_id bigint, item_id bigint, word_start int, word_end int").distinct()
