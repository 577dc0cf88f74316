"""Quality rules on repetition, by suffix arrays over words.

The words of a block of texts are sorted as suffixes by prefix doubling, in
numpy. A word's identity includes its document, so no repeat crosses two
documents. Neighbouring suffixes' longest common prefixes give the intervals
of maximal repeated substrings; the spans of those of at least ``min_words``
words are united, and a document is rejected when they cover more than
``max_covered`` of its words or when one repeat is longer than
``max_repeat`` words.

Defined cases: a null or empty text has no words and fails the base rule;
repeated rows give repeated results; texts of any length are read whole.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, types as T

from tackline.llm.texts import SPACES, map_rows

SYMBOLS = "#*$%&|<>"
#: Words sorted together; a longer text is a block of its own.
BLOCK_WORDS = 250_000


def _group_starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, each sorted key's group start, and whether its group has one member."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    starts = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    alone = new & np.append(new[1:], True)
    return order, starts, alone


def suffix_ranks(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... words, until no two are equal.

    Equal ranks at a level mean equal prefixes of that many words.
    """
    n = len(words)
    order, starts, alone = _group_starts(words)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = starts
    levels, active, h = [rank.copy()], order[~alone], 1
    while active.size:
        first = rank[active]
        second = rank[np.minimum(active + h, n)] + 1
        order, starts, alone = _group_starts(first * (n + 2) + second)
        active, first = active[order], first[order]
        change = np.ones(len(active), bool)
        change[1:] = first[1:] != first[:-1]
        base = np.maximum.accumulate(np.where(change, np.arange(len(active)), 0))
        rank[active] = first + starts - base
        active = active[~alone]
        h *= 2
        levels.append(rank.copy())
    return levels


def neighbour_prefixes(levels: list[np.ndarray]) -> np.ndarray:
    """For each position, the longest prefix that its suffix shares with a neighbour in sorted order."""
    rank = levels[-1][:-1]
    n = len(rank)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[pairs], order[pairs + 1]
    common = np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        same = level[np.minimum(a + common, n)] == level[np.minimum(b + common, n)]
        same &= np.maximum(a, b) + common < n
        common[same] += 1 << k
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def _union_length(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:-1]) > 0


def block_repeats(counts: list[int], words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By document: words in repeated 3-word windows, words in long repeats, longest repeat.

    ``words`` holds the documents' words one after another, with an identity that differs between documents.
    """
    n, edges = len(words), np.concatenate([[0], np.cumsum(counts)])
    repeated, covered, longest = (np.zeros(len(counts), np.int64) for _ in range(3))
    if n:
        levels = suffix_ranks(words)
        pair = levels[min(1, len(levels) - 1)]
        if n > 2 and len(levels) > 1:
            key = pair[: n - 2] * (n + 1) + levels[0][2:n]
            order, _, alone = _group_starts(key)
            at = order[~alone]
            inside = _union_length(at, np.full(len(at), 3), n)
            repeated = np.diff(np.concatenate([[0], np.cumsum(inside)])[edges])
        prefix = neighbour_prefixes(levels)
        at = np.flatnonzero(prefix >= min_words)
        inside = _union_length(at, prefix[at], n)
        covered = np.diff(np.concatenate([[0], np.cumsum(inside)])[edges])
        full = [k for k, c in enumerate(counts) if c]
        longest[full] = np.maximum.reduceat(prefix, edges[:-1][full])
    return repeated, covered, longest


def duplicate_lines(text: str) -> int:
    """Lines that hold a word and equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("covered_words", T.LongType()), T.StructField("longest_repeat", T.LongType())]
)


def repetition_rules(docs: DataFrame, min_words: int = 8, max_covered: float = 0.3, max_repeat: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with its counts, whether the base rule fails, and the verdict ``kept``."""

    def finish(block):
        ids = defaultdict()
        ids.default_factory = ids.__len__
        size = [len(w) for _, _, w in block]
        words = np.fromiter((k for _, _, w in block for k in map(ids.__getitem__, w)), np.int64, sum(size))
        words += np.repeat(np.arange(len(block), dtype=np.int64), size) * max(1, len(ids))
        out = []
        for (i, text, _), n, r, c, m in zip(block, size, *map(np.ndarray.tolist, block_repeats(size, words, min_words)), strict=True):
            failed = n < 50 or 100 * r > 50 * n
            chars = len(text) - sum(map(text.count, SPACES))
            out.append((i, n, chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), r, failed, not failed and c <= max_covered * n and m <= max_repeat, c, m))
        return out

    def rows(pairs):
        out, block, n = [], [], 0
        for i, text in pairs:
            w = text.encode("utf-8", "surrogatepass").split()
            if block and n + len(w) > BLOCK_WORDS:
                out += finish(block)
                block, n = [], 0
            block.append((i, text, w))
            n += len(w)
        return out + finish(block) if block else out

    return map_rows(docs, rows, _SCHEMA, id_col, text_col)
