"""Words of many texts at once, as arrays.

A word is a run without ASCII white space. Its 64-bit hash covers its lower-case
letters and digits and leaves out the marks of ``MARKS``, so that a word reads
alike before a comma and within quotes; a word of marks alone has one hash.
Texts are read in blocks of about ``BLOCK`` characters; a longer text is read in
slices that end at white space, and only arrays by word are kept of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

BLOCK = 1 << 17
MARKS = ".,;:!?\"'()[]{}"
_SPACE, _MARK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[ord(c) for c in MARKS]] = _MARK
_GAP = re.compile(r"[\x20\x09-\x0D]")
_U = np.uint64


#: Weights of a place within a word or run; those of places further on begin anew.
_WEIGHTS = np.random.default_rng(3).integers(1, 1 << 63, size=1 << 14, dtype=_U) | _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes whose every bit depends on all bits of x."""
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of each of the runs, of these sizes, that the values fall into."""
    end = np.cumsum(size)
    place = np.arange(len(values), dtype=np.int32) - np.repeat((end - size).astype(np.int32), size)
    if size.max(initial=0) > len(_WEIGHTS):
        place %= len(_WEIGHTS)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _WEIGHTS[place], out=total[1:])
    return mixed(total[end] - total[end - size] + size.astype(_U))


class Words(NamedTuple):
    """The words of whole texts, in order."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: Which text of the list a word is of, and which of the block's lines.
    doc: np.ndarray
    line: np.ndarray


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _read(buffer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, newlines before) of each word of lower-case text."""
    try:
        codes = np.frombuffer(buffer.encode("latin-1"), np.uint8)
        kind = _KIND[codes]
    except UnicodeEncodeError:
        codes = np.frombuffer(buffer.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _KIND[np.minimum(codes, 255)]
    inside = np.concatenate([[False], kind != _SPACE, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, _U), start, end, start
    letter = kind == 0
    before = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(letter, out=before[1:])
    return _sums(codes[letter].astype(_U), (before[end] - before[start]).astype(np.int64)), start, end, np.searchsorted(np.flatnonzero(codes == 10), start)


def _slices(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    while len(text) - at > BLOCK:
        gap = _GAP.search(text, at + BLOCK)
        end = gap.end() if gap else len(text)
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def read_words(texts: list[str | None]) -> Iterator[Words]:
    """The words of all texts, some whole texts at a time."""
    block, first, size = [], 0, 0
    for k, text in enumerate([*texts, None]):
        last = k == len(texts)
        if block and (last or size + len(text or "") > BLOCK):
            yield _block(block, first)
            block, size = [], 0
        if last:
            return
        if not block:
            first = k
        if len(text or "") > BLOCK:
            parts = [(at, *_read(_lower(part)), part.count("\n")) for at, part in _slices(text)]
            lines = np.cumsum([0, *(p[5] for p in parts)])
            h, s, e, n = (np.concatenate(c) for c in zip(*((h, s + at, e + at, n + before) for (at, h, s, e, n, _), before in zip(parts, lines, strict=False)), strict=True))
            yield Words(h, s, e, np.full(len(h), k), n)
        else:
            block.append(text or "")
            size += len(text or "") + 1


def _block(block: list[str], first: int) -> Words:
    offset = np.cumsum([0, *(len(t) + 1 for t in block)])
    h, s, e, line = _read("\n".join(map(_lower, block)))
    doc = np.searchsorted(offset, s, "right") - 1
    return Words(h, s - offset[doc], e - offset[doc], doc + first, line)


def starts_of(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    return np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)


def run_hashes(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One order-sensitive hash of each of the runs, of these sizes, that the values fall into."""
    return _sums(values, size)


def shingles(values: np.ndarray, groups: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each run of ``width`` values within a group; a group with fewer values is one run."""
    n = len(values)
    if not n:
        return values, np.zeros(0, np.int64)
    first = starts_of(groups)
    size = np.diff(np.append(first, n))
    left = np.repeat(np.append(first[1:], n), size) - np.arange(n)  # values from here to the group's end
    total, padded = np.zeros(n, _U), np.concatenate([values, np.zeros(width, _U)])
    for k in range(width):
        total += np.where(left > k, mixed(padded[k : k + n] + _U(k + 1)), _U(0))
    place = np.flatnonzero((left >= width) | ((left == np.repeat(size, size)) & (left < width)))
    return mixed(total[place]), place
