"""Quality classifier: hashed word n-gram logistic regression.

A text becomes a sparse vector of hashed counts: single words, word pairs,
and the same for word shapes (case, digits, attached symbols, repeat of the
word before), each as a share of its family. Weights are learnt with
follow-the-regularised-leader updates by one learner a shard, side by side, and
averaged by the rows that each learnt from; a score is the logistic of one sparse
dot product.

Learning reads at most ``max_rows`` labelled rows, those with the smallest
hashes of their ids. The model has ``2**bits`` weights, whatever the input.

Defined cases: a null or empty text has no features and scores the logistic of
the bias; rows without a label are not learnt from; with no label at all every
score is 0.5 and, in :func:`keep_good`, every document is kept; an id with
several labels teaches each of them; repeated rows, and different texts of one id,
are learnt from and scored each; a text of any length is read whole, in blocks; of
equal hashes the smaller id is learnt from first; other columns are ignored by
:func:`score` and carried unchanged by :func:`keep_good`, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tackline.llm.texts import id_and_text, map_rows, small_batches

BITS = 18
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_DIGITS = b"0123456789"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 200_000
#: Words whose features are looked up together; a longer text is a block of its own.
BLOCK_WORDS = 200_000


def _word(word: bytes) -> int:
    """A word's 32-bit core hash over its 16-bit shape: trailing marks, case, digits, length."""
    left = word.rstrip(_MARKS)
    mark = zlib.crc32(word[len(left) : len(left) + 3]) & 0xFF if len(left) < len(word) else 0
    core = left.lstrip(_MARKS)
    case = 3 if core.isupper() and len(core) > 1 else 2 if core[:1].isupper() else 1 if core else 0
    digit = core.translate(None, _DIGITS) != core
    return zlib.crc32(core.lower()) << 16 | mark << 8 | case << 5 | digit << 4 | min(len(core), 15) // 3


class Features:
    """Words to hashed features: each word is the start of one feature of each family."""

    #: Words, pairs of words, shapes, pairs of shapes.
    FAMILIES = 4

    def __init__(self, bits: int = BITS):
        self.shift, self.words = np.uint64(64 - bits), {}

    def _fold(self, values: np.ndarray, family: int) -> np.ndarray:
        return (((values + np.uint64(family + 1)) * _MIX ^ values >> np.uint64(29)) * _MIX >> self.shift).astype(np.int64)

    def __call__(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Features by family, position by position over all texts; each text's start; which positions end a text.

        A pair that starts at a text's last word does not count.
        """
        known = self.words
        if len(known) > _CACHE:
            known.clear()
        words = [w for t in texts for w in t]
        packed = [known.get(w) for w in words]
        if None in packed:
            for k, v in enumerate(packed):
                if v is None:
                    w = words[k]
                    packed[k] = known[w] = known.get(w) or _word(w)
        packed = np.array(packed, np.uint64)
        ends = np.cumsum([len(t) for t in texts])
        starts, last = np.concatenate([[0], ends[:-1]]).astype(np.int64), np.zeros(len(words), bool)
        last[ends[ends > 0] - 1] = True
        core, shape = packed >> np.uint64(16), packed & np.uint64(0xFFFF)
        again = np.zeros(len(words), np.uint64)
        again[1:] = (core[1:] == core[:-1]) & ~last[:-1]
        shape |= again << np.uint64(16)
        after = lambda x: np.append(x[1:], x[:1])
        return [self._fold(f, k) for k, f in enumerate((core, core * _MIX + after(core), shape, shape << np.uint64(20) | after(shape)))], starts, last

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """One text's sparse vector: in each family, the shares of its features."""
        words = _split(text)
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        families, _, last = self([words])
        parts = [np.unique(f[~last] if k % 2 else f, return_counts=True) for k, f in enumerate(families)]
        return np.concatenate([i for i, _ in parts]), np.concatenate([n / max(1, n.sum()) for _, n in parts])


def _split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _blocks(texts: list[str]):
    """Lists of split texts with about BLOCK_WORDS words each."""
    block, n = [], 0
    for t in texts:
        words = _split(t)
        if block and n + len(words) > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append(words)
        n += len(words)
    if block:
        yield block


def score_texts(model: np.ndarray, features: Features, texts: list[str]) -> np.ndarray:
    """The logistic of each text's sparse dot product with the weights."""
    out = []
    for block in _blocks(texts):
        size = np.array([len(t) for t in block])
        full, dot = size > 0, np.full(len(block), model[-1])
        if full.any():
            families, starts, last = features(block)
            for k, f in enumerate(families):
                w = model[f]
                if k % 2:
                    w[last] = 0
                dot[full] += np.add.reduceat(w, starts[full]) / np.maximum(1, size[full] - k % 2)
        out.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))))
    return np.concatenate(out) if out else np.empty(0)


class Ftrl:
    """Follow-the-regularised-leader for logistic loss, one coordinate rate each; the last weight is the bias."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: float) -> None:
        index, value = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(index)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[index]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        # one text may hold a coordinate twice, by two families
        np.add.at(self.z, index, g - sigma * w)
        np.add.at(self.n, index, g * g)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", bits: int = BITS, max_rows: int = 20_000, shards: int = 6, epochs: int = 3, alpha: float = 5.0, beta: float = 1.0, l1: float = 1e-5, l2: float = 1e-3) -> np.ndarray | None:
    """The averaged weights and, last, the bias; None where no labelled row has a document.

    At most ``max_rows`` rows, ``shards`` learners and 2**bits weights take part, so nothing here grows with the input.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
        .where("doc_id is not null and label is not null")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(max_rows)
    )
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("weight", T.DoubleType())])
    arrow, size = to_arrow_schema(schema), 1 << bits

    def learn(rows: pa.Table) -> pa.Table:
        features, model = Features(bits), Ftrl(size, alpha, beta, l1, l2)
        seen = [(i, *features.vector(t or ""), float(y > 0)) for i, t, y in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True)]
        seen.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[3], len(r[1])))
        for _ in range(epochs):
            for _, index, value, label in seen:
                model.learn(index, value, label)
        w = model.weights()
        at = np.flatnonzero(w)
        # a learner counts by its rows; those at -1 add up to all rows
        return pa.Table.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], 1.0) * len(seen))], schema=arrow)

    found = rows.groupBy("shard").applyInArrow(learn, schema).groupBy("at").agg(F.sum("weight").alias("weight")).collect()
    total = dict((r["at"], r["weight"]) for r in found)
    learnt = total.pop(-1, 0)
    if not learnt:
        return None
    model = np.zeros(size + 1)
    model[list(total)] = list(total.values())
    return model / learnt


def score(docs: DataFrame, model: np.ndarray | None, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(np.zeros((1 << bits) + 1) if model is None else model)

    def rows(pairs):
        features, w = Features(bits), shared.value
        return list(zip((i for i, _ in pairs), score_texts(w, features, [t for _, t in pairs]).tolist(), strict=True))

    return map_rows(docs, rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())]), id_col, text_col)


def keep_good(docs: DataFrame, model: np.ndarray | None, threshold: float = 0.7, bits: int = BITS, text_col: str = "text") -> DataFrame:
    """The rows, all columns unchanged, whose text scores ``threshold`` or more."""
    if model is None:
        return docs
    arrow, at = to_arrow_schema(docs.schema), docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        features, w = Features(bits), shared.value
        for batch in batches:
            keep = pa.array(score_texts(w, features, [t or "" for t in batch.column(at).to_pylist()]) >= threshold)
            yield pa.RecordBatch.from_arrays(batch.columns, schema=arrow).filter(keep)

    return small_batches(docs).mapInArrow(run, docs.schema)
