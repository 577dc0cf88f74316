"""Packing texts into fixed windows by order-preserving dynamic programming.

Documents keep the order in which a partition holds them; their ids, each
document closed by an end id, form one stream. Windows of at most ``window``
ids are cut from it so that padding plus penalties is least: a cut at a
document's end is free, one at a sentence's end costs ``SENTENCE``, one inside
a long sentence ``INSIDE``. A window is padded to ``window`` unless its length
is a power of two. The best cost up to a cut depends on the least of (best
cost + place) over the cuts at most a window back, which a monotone queue
gives in constant time, or on a cut exactly a power of two back.

A task reads its partition once, holds a block of the stream and the document
at hand, and settles a block before the next; nothing is shuffled. Ids of
words are kept in a cache bounded by words and by ids, which keeps the most used when it is full: the tokenizer never
merges across white space, so a text's ids are those of its words. A smaller cache costs time and changes no result.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed as often as they come; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tackline.llm.texts import id_and_text

SENTENCE, INSIDE = 2, 24
#: Ids settled together, and the most ids between two places where a cut may be.
BLOCK, REACH = 131_072, 256
#: Words of a cache, and ids that it may hold for each of them.
_CACHE, _CACHE_IDS = 700_000, 8
_CHUNK_WORDS = 100_000


#: Marks that end a word without being part of it; after a letter or digit they are tokens of their own.
_TAIL = b".,;:!?$#*%&"
#: A word between words that the tokenizer reads together, and how many it reads so.
_BETWEEN, _TOGETHER = "\x01", 2_000


def _core(word: bytes) -> bytes | None:
    """The word before its closing marks, in lower case where that changes no id; None where the word is to be read as it is."""
    core = word.rstrip(_TAIL)
    if not core or b"<|" in word:
        return None
    if core.isascii():
        low = core.lower()
        return low if core[-1:].isalnum() and len(core) < len(word) or len(core) == len(word) and low != word else None
    if len(core) == len(word):
        return None
    text = core.decode("utf-8", "replace")
    # the last letter as the tokenizer reads it: some end in a combining mark once they are in lower case
    if not text.lower()[-1].isalpha():
        return None
    # marks may combine with a small letter where they don't with the capital, so only letters are put in lower case
    return core.lower() if text.isalpha() else core


class WordIds:
    """Ids of texts, word by word, with the cache that makes that cheap.

    The tokenizer reads lower case, splits letters from marks and never joins words, so the ids of a word with closing marks
    are those of the word and of the marks. A word of letters alone is one run to it, whose last id alone closes a word.
    """

    def __init__(self, path: str, end_id: int, reach: int = REACH, cache: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.reach, self.cache = Tokenizer.from_file(path), end_id, reach, cache or _CACHE
        self.between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self):
        # word 0 is the end of a document
        self.known, self.used, self.count = {b"": 0}, 1, 1
        self.pool = np.full(1 << 20, self.end_id, np.uint32)
        self.at, self.size, self.stops = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64), np.zeros(1 << 16, bool)
        self.uses = np.zeros(1 << 16, np.int64)

    def _shrink(self):
        """Keep the words that came more than once, half of the cache at most, the most used; what they count is halved."""
        uses, half = self.uses[: self.count], self.cache // 2
        least = max(2, int(np.partition(uses, -half)[-half]) + 1) if self.count > half else 2
        keep = uses >= least
        keep[0] = False
        # words in several cases share their uses, so that there can be more of them
        index = np.fromiter(self.known.values(), np.int64, len(self.known))
        kept, index = list(compress(self.known, keep[index].tolist()))[-half:], index[keep[index]][-half:]
        size, stops, uses = self.size[index], self.stops[index], uses[index] // 2
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[index] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        self._clear()
        self._store(kept, ids, size, stops)
        self.uses[1 : self.count] = uses

    def _store(self, words: list[bytes], ids: np.ndarray, size: np.ndarray, stops: np.ndarray | None = None) -> None:
        n = len(words)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.count + n > len(self.at):
            self.at, self.size, self.stops, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.stops, self.uses))
        self.pool[self.used : self.used + len(ids)] = ids
        rows = slice(self.count, self.count + n)
        self.at[rows], self.size[rows] = self.used + np.cumsum(size) - size, size
        self.stops[rows] = stops if stops is not None else [w.rstrip(b"\"')]*_")[-1:] in (b".", b"!", b"?", b":", b";") for w in words]
        self.known.update(zip(words, range(self.count, self.count + n), strict=True))
        self.count += n
        self.used += len(ids)

    def _encode(self, words: list[bytes]) -> None:
        """Ids of whole words, many to a call: letters alone by the ids that close a word, others told apart by a word between them that no other text has."""
        texts = [w.decode("utf-8", "replace") for w in words]
        letters = [t.isalpha() for t in texts] if self.closes.any() else [False] * len(texts)
        rest = [w for w, plain in zip(words, letters, strict=True) if not plain]
        words, texts = ([x for x, plain in zip(v, letters, strict=True) if plain] for v in (words, texts))
        steps = range(0, len(words), _TOGETHER)
        for k, code in zip(steps, self.tokenizer.encode_batch_fast([" ".join(texts[k : k + _TOGETHER]) for k in steps], add_special_tokens=False), strict=True):
            part, ids = words[k : k + _TOGETHER], np.array(code.ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids])
            if len(ends) == len(part) and ends[-1] == len(ids) - 1:
                self._store(part, ids, np.diff(ends, prepend=-1), np.zeros(len(part), bool))
            else:
                rest += part
        if rest:
            self._encode_apart(rest)

    def _encode_apart(self, words: list[bytes]) -> None:
        odd = [w for w in words if b"\x01" in w or b"<|" in w]
        if odd or len(self.between) != 1:
            alone = odd if len(self.between) == 1 else words
            codes = [c.ids for c in self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in alone], add_special_tokens=False)]
            self._store(alone, np.array([i for c in codes for i in c], np.uint32), np.array([len(c) for c in codes], np.int64))
            words = [w for w in words if w not in self.known]
        if words:
            parts = [words[k : k + _TOGETHER] for k in range(0, len(words), _TOGETHER)]
            between = f" {_BETWEEN} "
            for part, code in zip(parts, self.tokenizer.encode_batch_fast([between.join([w.decode("utf-8", "replace") for w in p]) for p in parts], add_special_tokens=False), strict=True):
                ids = np.array(code.ids, np.uint32)
                cut = ids == self.between[0]
                ends = np.append(np.flatnonzero(cut), len(ids))
                self._store(part, ids[~cut], np.diff(ends, prepend=-1) - 1)

    def _learn(self, words: list[bytes]) -> None:
        known, plain, pairs, same = self.known, {}, [], []
        for w in words:
            core = _core(w)
            if core is None:
                core = w
            elif len(core) == len(w):
                same.append((w, core))
            else:
                pairs.append((w, core))
                if w[len(core) :] not in known:
                    plain[w[len(core) :]] = None
            if core not in known:
                plain[core] = None
        if plain:
            self._encode(list(plain))
        if pairs:
            index = np.array([(known[c], known[w[len(c) :]]) for w, c in pairs]).ravel()
            self.uses[: self.count] += np.bincount(index, minlength=self.count)
            size = self.size[index]
            ends = np.cumsum(size)
            ids = self.pool[np.repeat(self.at[index] - ends + size, size) + np.arange(ends[-1])]
            self._store([w for w, _ in pairs], ids, size.reshape(-1, 2).sum(axis=1))
        known.update((w, known[c]) for w, c in same)

    def _chunk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, each word's end among them, and which words end a sentence. An empty word ends a document."""
        if len(self.known) > self.cache or self.used > _CACHE_IDS * self.cache:
            self._shrink()
        index = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(index < 0)
        if len(missing):
            new = [words[k] for k in missing.tolist()]
            self._learn(list(dict.fromkeys(new)))
            index[missing] = [self.known[w] for w in new]
        self.uses[: self.count] += np.bincount(index, minlength=self.count)
        size = self.size[index]
        ends = np.cumsum(size)
        where = np.repeat(self.at[index] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return self.pool[where], ends, self.stops[index]

    def __call__(self, texts: list[str]):
        """For each text its ids with the end id, and places and penalties of cuts within it."""
        parts: list[list] = []
        for block, owners in self._blocks(texts):
            ids, ends, stops = self._chunk(block)
            first_word = 0
            for n, closes in owners:
                a = ends[first_word - 1] if first_word else 0
                last = first_word + n
                b = ends[last - 1] if n else a
                parts.append([ids[a:b], ends[first_word:last] - a, stops[first_word:last]])
                first_word = last
                if closes:
                    yield self._joined(parts)
                    parts = []

    def _blocks(self, texts):
        """Words in chunks, with (words, whether it is the text's last part) of each text in a chunk."""
        block, owners = [], []
        for t in texts:
            words = t.encode("utf-8", "surrogatepass").split()
            words.append(b"")
            for k in range(0, len(words), _CHUNK_WORDS):
                part = words[k : k + _CHUNK_WORDS]
                block += part
                owners.append((len(part), k + _CHUNK_WORDS >= len(words)))
                if len(block) >= _CHUNK_WORDS:
                    yield block, owners
                    block, owners = [], []
        if block:
            yield block, owners

    def _joined(self, parts):
        if len(parts) == 1:
            ids, ends, stops = parts[0]
        else:
            base = np.cumsum([0] + [len(p[0]) for p in parts])
            ids = np.concatenate([p[0] for p in parts])
            ends = np.concatenate([p[1] + b for p, b in zip(parts, base, strict=False)])
            stops = np.concatenate([p[2] for p in parts])
        places, costs = cuts(ends, stops, self.reach)
        return ids, places, costs


def cuts(ends: np.ndarray, stops: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Places where a document may be cut, and what each costs; its end comes last, free."""
    n = int(ends[-1])
    places = np.append(ends[stops], n)
    gaps = np.diff(places, prepend=0)
    places, gaps = places[gaps > 0], gaps[gaps > 0]
    far = np.flatnonzero(gaps > reach)
    if len(far):
        extra = np.concatenate([np.arange(places[k] - gaps[k] + reach, places[k], reach) for k in far])
        # at a word's end where one is near, so that a word is split only if it is very long
        near = ends[np.maximum(np.searchsorted(ends, extra, side="right") - 1, 0)]
        extra = np.where((near <= extra) & (near > extra - reach), near, extra)
        inside = np.setdiff1d(extra[extra > 0], places)
        costs = np.concatenate([np.full(len(places), SENTENCE), np.full(len(inside), INSIDE)])
        places = np.concatenate([places, inside])
        order = np.argsort(places)
        places, costs = places[order], costs[order]
    else:
        costs = np.full(len(places), SENTENCE)
    costs[-1] = 0
    return places, costs


def windows(places: list[int], costs: list[int], window: int, final: bool) -> list[int]:
    """Cuts of least total cost, by place; places rise, and no gap between them is over a window.

    Unless ``final``, the last cut may leave less than a window of the stream for later.
    """
    place, best, back = [0, *places], [0], [-1]
    # cuts exactly a power of two apart, (later, earlier), in order of the later
    at = np.array(place, np.int64)
    pairs = []
    for k in range(window.bit_length()):
        i = np.searchsorted(at, at - (1 << k))
        j = np.flatnonzero(at[i] == at - (1 << k))
        pairs.append(np.stack([j, i[j]], axis=1))
    pairs = np.concatenate(pairs)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    later, earlier, n = [*pairs[:, 0].tolist(), -1], pairs[:, 1].tolist(), 0
    queue = deque([(0, 0)])  # (best + place, index), rising
    for j in range(1, len(place)):
        p = place[j]
        while place[queue[0][1]] < p - window:
            queue.popleft()
        least, i = queue[0]
        least += window - p
        while later[n] == j:
            k = earlier[n]
            if best[k] < least:
                least, i = best[k], k
            n += 1
        least += costs[j - 1]
        best.append(least)
        back.append(i)
        key = least + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    j = len(place) - 1
    if not final:
        while j > 1 and place[j - 1] > place[-1] - window:
            j -= 1
        j = min(range(j, len(place)), key=lambda k: best[k] + 0.5 * (place[-1] - place[k]) / window)
    out = []
    while j > 0:
        out.append(place[j])
        j = back[j]
    return out[::-1]


def _powers_of(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


_READERS: dict[tuple, WordIds] = {}


def word_ids(path: str, end_id: int, reach: int, cache: int | None = None) -> WordIds:
    """The reader of this Python worker; its cache serves task after task and changes no result."""
    key = (path, end_id, reach, cache)
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = WordIds(path, end_id, reach, cache)
    return _READERS[key]


class Packer:
    """A stream of documents to pieces (doc, start, length, checksum, doc length, sequence, offset, ids)."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.docs: list[tuple] = []  # (doc id, ids, start of what is left, places, costs)
        self.size = 0

    def add(self, doc_id, ids, places, costs):
        self.docs.append((doc_id, ids, 0, places, costs))
        self.size += len(ids)
        return self.settle(False) if self.size >= BLOCK else []

    def settle(self, final: bool) -> list[tuple]:
        """Pieces of the windows that are certain now; what is left waits for the next block."""
        if not self.size:
            return []
        places, costs, base = [], [], 0
        for _, ids, start, at, cost in self.docs:
            left = at > start
            places.append(at[left] - start + base)
            costs.append(cost[left])
            base += len(ids) - start
        ends = windows(np.concatenate(places).tolist(), np.concatenate(costs).tolist(), self.window, final)
        if final and ends:
            # the stream's last window in powers of two, where that costs less than its padding
            begin = ends[-2] if len(ends) > 1 else 0
            powers = _powers_of(ends[-1] - begin)
            if (len(powers) - 1) * INSIDE < self.window - (ends[-1] - begin):
                ends[-1:] = (begin + np.cumsum(powers)).tolist()
        return self._emit(ends)

    def _emit(self, ends: list[int]) -> list[tuple]:
        out, d, at, base = [], 0, 0, 0  # base: the place where what is left of document d begins
        for end in ends:
            offset = 0
            while at < end:
                doc_id, ids, start, _, _ = self.docs[d]
                stop = base + len(ids) - start
                upto = min(end, stop)
                a, b = at - base + start, upto - base + start
                piece = np.ascontiguousarray(ids[a:b], "<u4")
                out.append((doc_id, a, b - a, zlib.crc32(piece), len(ids), self.sequence, offset, piece))
                offset += b - a
                at = upto
                if upto == stop:
                    d, base = d + 1, stop
            self.sequence += 1
        self.size -= at
        rest = self.docs[d:]
        if rest and at > base:
            doc_id, ids, start, places, costs = rest[0]
            rest[0] = (doc_id, ids, start + at - base, places, costs)
        self.docs = rest
        return out


_PIECES = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", cache: int | None = None) -> DataFrame:
    """One row a piece of a document: where it begins in the document and in its sequence, and its ids.

    Sequence ids hold the partition in their upper bits and rise within it. ``cache`` bounds the words whose ids a Python
    worker keeps, some 150 bytes each.
    """
    schema = T.StructType([*_PIECES.fields, T.StructField("ids", T.ArrayType(T.LongType()))]) if with_ids else _PIECES
    arrow = to_arrow_schema(schema)

    def batch_of(pieces):
        columns = list(zip(*pieces, strict=True))[: len(arrow)]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches):
        words = word_ids(tokenizer_path, end_id, max(1, min(REACH, window // 2)), cache)
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, coded in zip(ids, words(t or "" for t in texts), strict=True):
                if pieces := packer.add(doc_id, *coded):
                    yield batch_of(pieces)
        if pieces := packer.settle(True):
            yield batch_of(pieces)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
