"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the hashed vectors of the word and of those
beginnings of it that are shorter than it, so that words nobody has seen still say what
they begin like. Filters of one, two and three words slide over a text, each keeps its
largest response, and a score is the logistic of a weighted sum of these. Weights are
learnt in numpy by Adagrad on logistic loss; each hashed vector starts with the smoothed
log-odds of its documents, which the first filters of a width look at.

Thresholds are calibrated by language: on rows that took no part in learning, for each
language that has enough of them, and taken off the logit, so that 0.5 is the threshold
of every score. What language a text is in is told from its words alone, by counts
learnt from the same rows; a score has no input but the text.

Learning reads every labelled text whole. Texts are dealt to shards by the hashes of
their ids; each shard learns an epoch from the same weights, and the weights and rates
that shards come to are averaged by their rows, block by block in tasks, before the next
epoch. The driver holds the model and counts, ``2**bits`` vectors and buckets whatever the
input; calibration sees every held row, by its logit to three places. Scoring reads every
whole text: the largest response of a long text is the largest of its blocks'.

Defined cases: a null or empty text has no words, and its score is the logistic of the
bias less the threshold over all languages; rows without a label are not learnt from;
where one of the two labels is missing every score is 0; an id with several labels
teaches each of them; repeated rows, and different texts of one id, are learnt from and
scored each; a missing language is one of its own; other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tackline.llm.durable import written
from tackline.llm.texts import map_rows, small_batches

BITS, DIM, FILTERS, WIDTHS = 16, 16, 8, (1, 2, 3)
#: Lengths of the beginnings that a word is known by, beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8)
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Words known to a task, and words of a block.
_CACHE, BLOCK_WORDS = 100_000, 40_000
#: Buckets of words that tell languages apart, rows that a language needs for a threshold, and most languages.
LANG_BITS, LANG_ROWS, LANGS = 14, 60, 16
#: Labelled rows of a shard and their characters, about; labels up to this many are broadcast, more are joined by shuffle.
SHARD_ROWS, SHARD_CHARS, BROADCAST_ROWS = 10_000, 50_000_000, 500_000
#: Numbers of a block of weights, as shards hand them on.
CHUNK = 1 << 14
#: Columns of a projection: one a width, place in the window and filter.
COLUMNS = [(w, o) for w in WIDTHS for o in range(w)]


class Model(NamedTuple):
    table: np.ndarray
    filters: np.ndarray  # DIM x (len(COLUMNS) * FILTERS)
    bias: np.ndarray  # of each filter
    out: np.ndarray  # of each filter, then the constant
    words: np.ndarray  # log-probability by language and bucket
    thresholds: np.ndarray  # of each language, then over all


def buckets(word: str, bits: int) -> list[int]:
    """Of the whole word and of each beginning; those that the word is too short for are the empty bucket, 2**bits."""
    core = word.strip(_MARKS) or word
    mask = (1 << bits) - 1
    out = [zlib.crc32(core.encode("utf-8", "surrogatepass")) & mask]
    for n in BEGINNINGS:
        out.append(zlib.crc32(f"{n}<{core[:n]}".encode("utf-8", "surrogatepass")) & mask if len(core) > n else 1 << bits)
    return out


def split(text: str) -> list[str]:
    return text.lower().split()


def responses(projected: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(places, filters) of each window that begins at a place; ``last`` marks ends of texts, beyond which words count nothing."""
    out = np.empty((len(projected), len(WIDTHS) * FILTERS), projected.dtype)
    inside = ~last
    for k, width in enumerate(WIDTHS):
        total, c = None, COLUMNS.index((width, 0)) * FILTERS
        for o in range(width - 1, -1, -1):
            part = projected[:, c + o * FILTERS : c + (o + 1) * FILTERS]
            if total is None:
                total = part.copy()
            else:
                moved = np.zeros_like(total)
                moved[:-1] = total[1:]
                moved *= inside[:, None]
                total = moved + part
        out[:, k * FILTERS : (k + 1) * FILTERS] = total
    return out


def peaks(projected: np.ndarray, back: np.ndarray, last: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, filters) places and values of the largest responses, the first of equals; ``back`` tells each place's row of ``projected``."""
    n, more = len(WIDTHS) * FILTERS, max(WIDTHS) - 1
    peak, most = np.zeros((len(size), n), np.int64), np.full((len(size), n), -np.inf, projected.dtype)
    for at in range(0, len(back), BLOCK_WORDS):
        stop = min(at + BLOCK_WORDS, len(back))
        found = responses(projected[back[at : stop + more]], last[at : stop + more])
        for t in range(np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, stop)):
            begin = max(starts[t], at)
            own = found[begin - at : min(starts[t] + size[t], stop) - at]
            best = own.argmax(axis=0)
            value = own[best, np.arange(n)]
            better = value > most[t]
            peak[t, better], most[t, better] = begin + best[better], value[better]
    return peak, most


class Scorer:
    """Scores texts with a model; keeps projections of the words that it has met lately."""

    def __init__(self, model: Model):
        self.model, self.bits = model, len(model.table).bit_length() - 1
        self.langs = len(model.words)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((_CACHE + BLOCK_WORDS + max(WIDTHS), model.filters.shape[1] + self.langs), np.float32)

    def _places(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            parts = np.array([buckets(w, self.bits) for w in new])
            m, at = self.model, slice(len(known), len(known) + len(new))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.rows[at, : m.filters.shape[1]] = m.table[parts].sum(axis=1, dtype=np.float64) @ m.filters.astype(np.float64)
            if self.langs:
                self.rows[at, m.filters.shape[1] :] = m.words[:, parts[:, 0] & ((1 << LANG_BITS) - 1)].T
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _block(self, texts: list[list[str]], counted: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Largest responses and summed word scores of texts with a word each; only windows that begin within the first ``counted`` words count."""
        words = [w for t in texts for w in t]
        rows = self.rows[self._places(words)]
        size = np.array([len(t) for t in texts])
        starts = np.cumsum(size) - size
        last = np.zeros(len(words), bool)
        last[starts + size - 1] = True
        n = self.model.filters.shape[1]
        out, total = responses(rows[:, :n], last), rows[:, n:]
        if any(c < s for c, s in zip(counted, size, strict=True)):
            for s, c, z in zip(starts, counted, size, strict=True):
                out[s + c : s + z], total[s + c : s + z] = -np.inf, 0
        return np.maximum.reduceat(out, starts), np.add.reduceat(total, starts, dtype=np.float64) if self.langs else np.zeros((len(texts), 0))

    def pooled(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, filters) largest responses, and (texts, languages) summed word scores."""
        most, total = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf), np.zeros((len(texts), self.langs))
        more, block, n = max(WIDTHS) - 1, [], 0

        def flush():
            if block:
                high, sums = self._block([w for _, w, _ in block], [c for _, _, c in block])
                at = [i for i, _, _ in block]
                np.maximum.at(most, at, high)
                np.add.at(total, at, sums)
                block.clear()

        for i, text in enumerate(texts):
            words = split(text)
            for at in range(0, len(words), BLOCK_WORDS):
                part = words[at : at + BLOCK_WORDS + more]
                if n + len(part) > BLOCK_WORDS + more:
                    flush()
                    n = 0
                block.append((i, part, min(BLOCK_WORDS, len(part))))
                n += len(part)
        flush()
        return most, total

    def scores(self, texts: list[str]) -> np.ndarray:
        most, total = self.pooled(texts)
        m = self.model
        logit = np.maximum(most + m.bias, 0) @ m.out[:-1] + m.out[-1]
        lang = total.argmax(axis=1) if self.langs else np.zeros(len(texts), int)
        lang[np.isinf(most[:, 0])] = self.langs
        # products may differ in their last bits by what shares a batch
        return 1 / (1 + np.exp(-np.clip(np.round(logit - m.thresholds[lang], 6), -35, 35)))


class Learner:
    """Adagrad on logistic loss; gradients reach only the windows that gave a largest response."""

    def __init__(self, bits: int, seed: int, rate: float):
        rng = np.random.default_rng(seed)
        self.rate = rate
        self.table = (0.05 * rng.normal(size=((1 << bits) + 1, DIM))).astype(np.float32)
        self.filters = (rng.normal(size=(DIM, len(COLUMNS) * FILTERS)) / np.sqrt(DIM)).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.append(0.1 * rng.normal(size=len(WIDTHS) * FILTERS), 0.0).astype(np.float32)
        self.table[-1] = 0
        self.seen = [np.full(p.shape, 1e-3, np.float32) for p in (self.table, self.filters, self.bias, self.out)]

    def start(self, odds: np.ndarray, rate: float) -> None:
        """The first number of each vector is its log-odds; the first two filters of each width sum it up, for and against."""
        self.table[:, 0] = odds / 4
        for k, width in enumerate(WIDTHS):
            for o in range(width):
                c = (COLUMNS.index((width, 0)) + o) * FILTERS
                self.filters[:, c : c + 4] *= 0.1
                self.filters[0, c : c + 2] = 1 / width
            self.bias[k * FILTERS : k * FILTERS + 2] = -0.5
            self.out[k * FILTERS : k * FILTERS + 2] = 1
        self.out[-1] = np.log(rate / (1 - rate))

    def state(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.bias, self.out, *self.seen]

    def take(self, state: list[np.ndarray]) -> Learner:
        """Goes on from a state, which is copied."""
        self.table, self.filters, self.bias, self.out, *self.seen = (x.copy() for x in state)
        return self

    def _step(self, k: int, value: np.ndarray, grad: np.ndarray, at=slice(None)) -> None:
        seen = self.seen[k]
        seen[at] += grad * grad
        value[at] -= self.rate * grad / np.sqrt(seen[at])

    def learn(self, texts: list[np.ndarray], parts: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
        """One step on some texts, each an array of rows of ``parts``; the mean loss."""
        own, back = np.unique(np.concatenate(texts), return_inverse=True)
        vectors = self.table[parts[own]].sum(axis=1)
        size = np.array([len(t) for t in texts])
        starts = np.cumsum(size) - size
        last = np.zeros(len(back), bool)
        last[starts + size - 1] = True
        peak, most = peaks(vectors @ self.filters, back, last, starts, size)
        most += self.bias
        active = np.maximum(most, 0)
        score = 1 / (1 + np.exp(-np.clip(active @ self.out[:-1] + self.out[-1], -30, 30)))
        g = ((score - labels) * weights / len(texts)).astype(np.float32)
        hit = g[:, None] * self.out[:-1] * (most > 0)
        projected = np.zeros((len(own), self.filters.shape[1]), np.float32)
        ends = (starts + size)[:, None]
        for k, width in enumerate(WIDTHS):
            f = np.arange(k * FILTERS, (k + 1) * FILTERS)
            for o in range(width):
                at, c = peak[:, f] + o, (COLUMNS.index((width, 0)) + o) * FILTERS
                ok = at < ends
                np.add.at(projected, (back[at[ok]], np.broadcast_to(np.arange(c, c + FILTERS), at.shape)[ok]), hit[:, f][ok])
        rows = np.flatnonzero(projected.any(axis=1))
        grad = projected[rows] @ self.filters.T
        touched, where = np.unique(parts[own[rows]].ravel(), return_inverse=True)
        vector = np.zeros((len(touched), DIM), np.float32)
        np.add.at(vector, where.ravel(), np.repeat(grad, parts.shape[1], axis=0))
        vector[touched == len(self.table) - 1] = 0
        self._step(3, self.out, np.append(g @ active, g.sum()).astype(np.float32))
        self._step(2, self.bias, hit.sum(axis=0))
        self._step(1, self.filters, vectors[rows].T @ projected[rows])
        self._step(0, self.table, vector, touched)
        return float(-np.mean(weights * np.where(labels > 0, np.log(score + 1e-9), np.log(1 - score + 1e-9))))


def _threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Where the sum of wrong weights is least, and in the middle of the widest such gap."""
    order = np.argsort(logits, kind="stable")
    x, y, w = logits[order], labels[order], weights[order]
    wrong = np.concatenate([[0], np.cumsum(np.where(y > 0, w, -w))])
    cuts = np.concatenate([[x[0] - 2], (x[1:] + x[:-1]) / 2, [x[-1] + 2]])
    room = np.concatenate([[1.0], np.minimum(np.diff(x), 4.0), [1.0]])
    best = np.flatnonzero((wrong <= wrong.min() + 1e-9) & (room > 0))
    return float(cuts[best[room[best].argmax()]]) if len(best) else 0.0


class Rows(NamedTuple):
    """A shard's texts in a settled order, as places in a table of its different words. Each fourth calibrates."""

    words: np.ndarray  # of all texts, one after another
    size: np.ndarray
    parts: np.ndarray  # buckets of each different word
    labels: np.ndarray
    langs: np.ndarray  # number of the language, or -1

    def starts(self) -> np.ndarray:
        return np.cumsum(self.size, dtype=np.int64) - self.size

    def learnt(self) -> np.ndarray:
        """The texts to learn from: those with words that are not held, or all with words."""
        full = self.size > 0
        free = full & (np.arange(len(self.size)) % 4 != 3)
        return np.flatnonzero(free if free.any() else full)


def read(rows: Iterable[tuple], names: list, bits: int) -> Rows:
    """Of (key, text, label, language) in the order of the keys; texts are not kept."""
    places: dict[str, int] = {}
    number, seen = {x: k for k, x in enumerate(names)}, []
    for key, text, label, lang in rows:
        seen.append((key, np.array([places.setdefault(w, len(places)) for w in split(text)], np.int32), label, number.get(lang, -1)))
    seen.sort(key=lambda r: r[0])
    parts = np.full((max(1, len(places)), 1 + len(BEGINNINGS)), 1 << bits, np.int32)
    for k, w in enumerate(places):
        parts[k] = buckets(w, bits)
    size, labels, langs = (np.array(x, np.int32) for x in ([len(r[1]) for r in seen], [r[2] for r in seen], [r[3] for r in seen]))
    words = np.concatenate([*(r[1] for r in seen), np.zeros(0, np.int32)])
    seen.clear()
    # words are numbered as they come in the settled order, whatever order the rows were in
    first = np.zeros(len(places), np.int64)
    for at in reversed(range(0, len(words), 1 << 20)):
        some = words[at : at + (1 << 20)]
        first[some[::-1]] = np.arange(at + len(some) - 1, at - 1, -1)
    order = np.argsort(first)
    again = np.empty(len(order), np.int32)
    again[order] = np.arange(len(order), dtype=np.int32)
    return Rows(again[words] if len(words) else words, size, parts[order] if len(order) else parts, labels, langs)


def counts(rows: Rows, langs: int, bits: int) -> list[np.ndarray]:
    """Texts to learn from by label, those with a bucket by label, and places of whole words by language and bucket."""
    n, have, said = np.zeros(2), np.zeros((2, (1 << bits) + 1)), np.zeros((langs, 1 << LANG_BITS))
    starts, learnt = rows.starts(), np.zeros(len(rows.size), bool)
    learnt[rows.learnt()] = True
    for i, (at, z) in enumerate(zip(starts, rows.size, strict=True)):
        words = rows.words[at : at + z]
        if learnt[i]:
            n[int(rows.labels[i] > 0)] += 1
            have[int(rows.labels[i] > 0), np.unique(rows.parts[np.unique(words)])] += 1
        if rows.langs[i] >= 0:
            said[rows.langs[i]] += np.bincount(rows.parts[words, 0] & ((1 << LANG_BITS) - 1), minlength=1 << LANG_BITS)
    return [n, have, said]


def begun(n: np.ndarray, have: np.ndarray, bits: int, rate: float, seed: int) -> Learner:
    """A learner that starts from the log-odds of all texts to learn from."""
    learner = Learner(bits, seed, rate)
    if n.sum():
        some = np.maximum(1, n)
        odds = np.log((have[1] / some[1] + 4 / some.sum()) / (have[0] / some[0] + 4 / some.sum()))
        odds[-1] = 0
        learner.start(odds, min(0.9, max(0.1, some[1] / some.sum())))
    return learner


def epoch(learner: Learner, rows: Rows, seed: list[int], batch: int) -> None:
    """One reading of the texts to learn from, in batches that hold some texts and, unless one has more, five blocks' words."""
    starts, some, n = rows.starts(), [], 0

    def learn():
        if some:
            learner.learn([rows.words[starts[i] : starts[i] + rows.size[i]] for i in some], rows.parts, rows.labels[some], np.ones(len(some)))

    for i in np.random.default_rng(seed).permutation(rows.learnt()):
        if len(some) == batch or some and n + rows.size[i] > 5 * BLOCK_WORDS:
            learn()
            some, n = [], 0
        some.append(i)
        n += rows.size[i]
    learn()


def logits(model: Model, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts with words, in their order: the logit, and the language that the words tell."""
    projected = np.empty((len(rows.parts), model.filters.shape[1]), np.float32)
    for at in range(0, len(projected), BLOCK_WORDS):
        projected[at : at + BLOCK_WORDS] = model.table[rows.parts[at : at + BLOCK_WORDS]].sum(axis=1) @ model.filters
    said = np.ascontiguousarray(model.words[:, rows.parts[:, 0] & ((1 << LANG_BITS) - 1)].T)
    out, told, starts = [], [], rows.starts()
    for i in np.flatnonzero(rows.size):
        words = rows.words[starts[i] : starts[i] + rows.size[i]]
        last = np.zeros(len(words), bool)
        last[-1] = True
        _, most = peaks(projected, words, last, np.zeros(1, np.int64), np.array([len(words)]))
        out.append(float(np.maximum(most[0] + model.bias, 0) @ model.out[:-1] + model.out[-1]))
        told.append(int(sum(said[words[at : at + BLOCK_WORDS]].sum(axis=0, dtype=np.float64) for at in range(0, len(words), BLOCK_WORDS)).argmax()) if said.shape[1] else 0)
    return np.array(out), np.array(told, np.int64)


def spoken(said: np.ndarray) -> np.ndarray:
    """Log-probabilities of buckets by language."""
    return np.log((said + 1) / (said + 1).sum(axis=1, keepdims=True)).astype(np.float32)


def thresholds(held: np.ndarray, told: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, weights: np.ndarray, langs: int) -> np.ndarray:
    """Of each language, then over all, from n rows with words of each kind; from held rows, if some of these are toxic."""
    test = held if (y[held] > 0).any() else np.ones(len(y), bool)
    every = _threshold(x[test], y[test], weights[test]) if test.any() else 0.0
    out = [every] * langs
    for k in range(langs):
        mine = test & (told == k)
        toxic = int(n[mine & (y > 0)].sum())
        if toxic:
            # drawn to the threshold over all languages by the weight of ten toxic rows
            out[k] = (toxic * _threshold(x[mine], y[mine], weights[mine]) + 10 * every) / (toxic + 10)
    return np.array([*out, every])


def train(texts: list[str], labels: np.ndarray, langs: list[str], weights: np.ndarray, bits: int = BITS, epochs: int = 6, batch: int = 32, rate: float = 0.05, seed: int = 5) -> Model:
    """A model from one shard's rows in a settled order; ``weights`` are of rows that calibrate."""
    names = [x for x, c in sorted(Counter(langs).items(), key=lambda x: (-x[1], str(x[0]))) if c >= LANG_ROWS][:LANGS]
    rows = read(zip(range(len(texts)), texts, labels, langs, strict=True), names, bits)
    n, have, said = counts(rows, len(names), bits)
    learner = begun(n, have, bits, rate, seed)
    for k in range(epochs):
        epoch(learner, rows, [seed, k, 0], batch)
    model = Model(learner.table, learner.filters, learner.bias, learner.out, spoken(said), np.zeros(1))
    full = np.flatnonzero(rows.size)
    x, told = logits(model, rows)
    return model._replace(thresholds=thresholds(full % 4 == 3, told, x, rows.labels[full], np.ones(len(full)), np.asarray(weights)[full], len(names)))


_ROWS = T.StructType([T.StructField("shard", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in Rows._fields]])
_BLOCKS = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("part", "block", "shard")], T.StructField("value", T.BinaryType())])
_HELD = T.StructType([T.StructField("held", T.BooleanType()), T.StructField("told", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.IntegerType())])


def _shards(batches):
    """(shard, rows) of a written table of shards."""
    for batch in batches:
        for k in range(batch.num_rows):
            x = [np.frombuffer(zlib.decompress(batch.column(c)[k].as_buffer()), np.int32) for c in range(1, 6)]
            yield batch.column(0)[k].as_py(), Rows(x[0], x[1], x[2].reshape(-1, 1 + len(BEGINNINGS)), x[3], x[4])


def _summed(table: DataFrame, of_shard, shapes: list[tuple], dtype) -> list[np.ndarray]:
    """The sums over shards of the arrays that ``of_shard(shard, rows)`` gives, block by block in tasks."""
    schema, width = to_arrow_schema(_BLOCKS), np.dtype(dtype).itemsize * CHUNK

    def run(batches):
        for shard, rows in _shards(batches):
            for part, x in enumerate(of_shard(shard, rows)):
                raw = np.ascontiguousarray(x, dtype).tobytes()
                blocks = [raw[at : at + width] for at in range(0, len(raw), width)]
                yield pa.RecordBatch.from_pydict({"part": [part] * len(blocks), "block": list(range(len(blocks))), "shard": [shard] * len(blocks), "value": blocks}, schema=schema)

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")
        total = sum(np.frombuffer(v.as_buffer(), dtype).astype(np.float64) for v in rows["value"])
        return pa.Table.from_pydict({"part": rows["part"][:1].to_pylist(), "block": rows["block"][:1].to_pylist(), "shard": [0], "value": [total.astype(dtype).tobytes()]}, schema=schema)

    found = table.mapInArrow(run, _BLOCKS).groupBy("part", "block").applyInArrow(add, _BLOCKS).collect()
    raw = {k: b"".join(bytes(r["value"]) for r in sorted((r for r in found if r["part"] == k), key=lambda r: r["block"])) for k in range(len(shapes))}
    return [np.frombuffer(raw[k], dtype).reshape(x) for k, x in enumerate(shapes)]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", lang_col: str = "lang", bits: int = BITS, epochs: int = 6, batch: int = 32, rate: float = 0.05, seed: int = 5) -> Model | None:
    """The model, or None where one of the two labels has no row with a document. Learns from every labelled row; runs jobs while it is built."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label_col).cast("double") > 0).cast("int").alias("label")).where("doc_id is not null and label is not null")
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge")
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")).where("text is not null")
    sample = texts.join(rows, "doc_id")
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    if size["low"] == size["high"]:
        return None
    names = [r["lang"] for r in sample.groupBy("lang").count().where(F.col("count") >= LANG_ROWS).orderBy(F.desc("count"), F.coalesce("lang", F.lit("None")), F.col("lang").isNull()).limit(LANGS).collect()]
    shards = max(-(-size["n"] // SHARD_ROWS), -(-size["chars"] // SHARD_CHARS))

    def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = []

        def rows():
            for batch in batches:
                shard[:] = batch.column("shard")[:1].to_pylist() or shard
                for i, t, y, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label", "lang")), strict=True):
                    yield (zlib.crc32(str(i).encode()), i, y, zlib.crc32(t.encode("utf-8", "surrogatepass"))), t, y, x

        found = read(rows(), names, bits)
        yield pa.RecordBatch.from_pydict({"shard": shard} | {c: [zlib.compress(x, 1)] for c, x in zip(Rows._fields, found, strict=True)}, schema=to_arrow_schema(_ROWS))

    # more partitions than shards, so that few tasks get two
    dealt = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartition(4 * shards, "shard")
    table = written(dealt.groupBy("shard").applyInArrow(to_rows, _ROWS))
    every = [(2,), (2, (1 << bits) + 1), (len(names), 1 << LANG_BITS)]
    n, have, said = _summed(table, lambda _, r: counts(r, len(names), bits), every, np.float64)
    state = begun(n, have, bits, rate, seed).state()
    context = docs.sparkSession.sparkContext
    for k in range(epochs if n.sum() else 0):
        shared = context.broadcast(state)

        def learnt(shard, r, k=k, shared=shared):
            learner = Learner(bits, seed, rate).take(shared.value)
            epoch(learner, r, [seed, k, shard], batch)
            return [x * (len(r.learnt()) / n.sum()) for x in learner.state()]

        state = _summed(table, learnt, [x.shape for x in state], np.float32)
        shared.destroy()
    model = Model(*state[:4], spoken(said), np.zeros(1))
    shared = context.broadcast(model)

    def held(batches):
        for _, r in _shards(batches):
            full = np.flatnonzero(r.size)
            x, told = logits(shared.value, r)
            yield pa.RecordBatch.from_arrays([pa.array(full % 4 == 3), pa.array(told), pa.array(np.round(np.clip(x, -40, 40), 3)), pa.array(r.labels[full])], schema=to_arrow_schema(_HELD))

    found = table.mapInArrow(held, _HELD).groupBy("held", "told", "x", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("x", "y", "told", "held").collect()
    column = lambda c, kind: np.array([r[c] for r in found], kind)
    shared.destroy()
    return model._replace(thresholds=thresholds(column("held", bool), column("told", int), column("x", float), column("y", int), column("n", float), column("n", float), len(names)))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorer: list[Scorer] = []

    def rows(pairs):
        if shared.value is None:
            return [(i, 0.0) for i, _ in pairs]
        if not scorer:
            scorer.append(Scorer(shared.value))
        return list(zip((i for i, _ in pairs), scorer[0].scores([t for _, t in pairs]).tolist(), strict=True))

    return map_rows(docs, rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())]), id_col, text_col)
