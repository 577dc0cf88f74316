"""Hard-negative mining by blocked dense products.

Vectors are quantised to whole numbers, so that an inner product in float64 is
exact below 2**53 whatever the order of its sums. Anchors are broadcast a block of at
most ``BLOCK_BYTES`` at a time; each task multiplies them with its own rows, tile by
tile, and keeps what can still be among the k best of each anchor, so a task holds
k rows an anchor however many rows it reads. A first pass gives each anchor's best
positives; a second one, which carries their scores, gives each positive's best
negatives within its window. Lists of tasks are merged by rank.

No candidate is shuffled or collected: what leaves a task is bounded by the block of
anchors and k. More anchors take more blocks, each two passes over the rows; the
result of each block is written before the next begins, so that a lost executor costs
one pass and the plan does not grow. Blocks are worked through while the query is built.

Defined cases: rows with a null id, null label, null or empty vector, or a null or
non-finite component take no part; vectors meet those of their own length; of an
anchor's rows that share its id the one with the smallest label, then vector, is the
anchor, and none of them is its positive or negative; other rows that share an id count
once, at their best score; ties go to the smaller id; where products may reach 2**53
they are computed in whole numbers of any size, and scores beyond 64 bits are held
at their limit; other columns are ignored, whatever their names; an empty table, and
one without anchors, give an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tackline.llm.durable import shared_folder, written

#: Bytes of a broadcast block of anchors, and rows and anchors of a tile.
BLOCK_BYTES, TILE = 16 << 20, 1_024
_LIMIT = 1 << 62

_FOUND = T.StructType([T.StructField("slot", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def rows_of(vectors: DataFrame, label, id_col: str, vector_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    v, infinite = F.col("v"), F.lit(float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where("id is not null and label is not null and v is not null and size(v) > 0").where(F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != infinite), F.lit(False))))


def quantised(column, scale: float) -> np.ndarray:
    """(rows, length) of floor(scale * x), as float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * flat), -_LIMIT, _LIMIT).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of whole-numbered rows, exact, as int64."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2.0**53:
        whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
        return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)
    return (a @ b.T).astype(np.int64)


class Best:
    """The k best (score, then smaller id) of each slot met so far; rows of one id count once."""

    def __init__(self, slots: int, k: int):
        self.k, self.least = k, np.full(slots, np.iinfo(np.int64).min)
        self.slot = self.id = self.score = np.zeros(0, np.int64)
        self.held, self.n = [], 0

    def add(self, slots: np.ndarray, ids: np.ndarray, score: np.ndarray, fits: np.ndarray) -> None:
        """``score`` and ``fits`` are tiles of slots by ids; what cannot be among the k best is left out at once."""
        s, c = np.nonzero(fits & (score >= self.least[slots][:, None]))
        if len(s):
            self.held.append((slots[s], ids[c], score[s, c]))
            self.n += len(s)
            if self.n > 2 * self.k * len(self.least) + TILE * TILE // 4:
                self.merge()

    def merge(self) -> None:
        slot, ids, score = (np.concatenate(x) for x in zip((self.slot, self.id, self.score), *self.held, strict=True))
        order = np.lexsort((-score, ids, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        once = np.append(True, (slot[1:] != slot[:-1]) | (ids[1:] != ids[:-1]))[: len(slot)]
        slot, ids, score = slot[once], ids[once], score[once]
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        new = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])[: len(slot)])
        rank = np.arange(len(slot)) - np.repeat(new, np.diff(np.append(new, len(slot))))
        keep = rank < self.k
        self.slot, self.id, self.score, self.held, self.n = slot[keep], ids[keep], score[keep], [], 0
        full = rank[keep] == self.k - 1
        self.least[self.slot[full]] = self.score[full]


def _tiles(batch, scale: float):
    for at in range(0, batch.num_rows, TILE):
        part = batch.slice(at, TILE)
        yield part.column(0).to_numpy(), part.column(1).to_numpy(), quantised(part.column(2), scale)


def _pass(rows: DataFrame, scale: float, slots: int, k: int, block: dict, fits) -> DataFrame:
    """(slot, id, score): of each slot the k best of all rows. ``fits(block, lo, hi, scores, ids, labels)`` gives a tile's slots, scores and which fit."""
    arrow, shared = to_arrow_schema(_FOUND), rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        held, best = shared.value, Best(slots, k)
        for batch in batches:
            for ids, labels, v in _tiles(batch, scale):
                for lo in range(0, len(held["id"]), TILE):
                    score = products(held["v"][lo : lo + TILE], v)
                    for slot, of, ok in fits(held, lo, score, ids, labels):
                        best.add(slot, ids, of, ok)
        best.merge()
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.id), pa.array(best.score)], schema=arrow)

    found = rows.mapInArrow(run, _FOUND).groupBy("slot", "id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _positives(held, lo, score, ids, labels):
    own = slice(lo, lo + len(score))
    yield np.arange(lo, lo + len(score)), score, (held["label"][own, None] == labels) & (held["id"][own, None] != ids)


def _negatives(held, lo, score, ids, labels):
    """A slot is an anchor and one of its positives; ``at`` tells where an anchor's slots begin."""
    own = slice(lo, lo + len(score))
    other = (held["label"][own, None] != labels) & (held["id"][own, None] != ids)
    first, n = held["at"][lo : lo + len(score)], held["count"][own]
    for p in range(int(n.max(initial=0))):
        has = np.flatnonzero(n > p)
        slot, near = first[has] + p, score[has]
        yield slot, near, other[has] & (near <= held["most"][slot, None]) & (near >= held["least"][slot, None])


def mine(
    vectors: DataFrame, is_anchor, label=None, k: int = 5, positives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """RESULT: for each anchor that ``is_anchor(id column)`` picks and each of its best ``positives``, the k best rows of other labels whose score is from low to high percent of the positive's.

    ``label`` is a Column that stands for the label, where it is not the plain one.
    """
    spark = vectors.sparkSession
    rows = rows_of(vectors, F.col(label_col) if label is None else label, id_col, vector_col)
    anchors = written(rows.where(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v"))
    folder, paths = f"{shared_folder(spark).rstrip('/')}/mined-{uuid.uuid4().hex}", []
    for size in anchors.groupBy(F.size("v").alias("size")).count().orderBy("size").collect():
        dim, most = size["size"], max(1, BLOCK_BYTES // (8 * size["size"]))
        blocks = -(-size["count"] // most)
        data = rows.where(F.size("v") == dim)
        for b in range(blocks):
            part = anchors.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).orderBy("id").toArrow()
            # hashes deal unevenly, so a block is cut again
            for at in range(0, part.num_rows, most):
                held = part.slice(at, most).combine_chunks()
                block = {"id": held["id"].to_numpy(), "label": held["label"].to_numpy(), "v": quantised(held["v"].combine_chunks(), scale)}
                path = f"{folder}/{len(paths)}"
                _block(data, block, k, positives, low, high, scale).write.parquet(path)
                paths.append(path)
    if not paths:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*paths)


def _block(data: DataFrame, block: dict, k: int, positives: int, low: int, high: int, scale: float) -> DataFrame:
    spark = data.sparkSession
    # positives of one block: at most ``positives`` rows an anchor
    found = _pass(data, scale, len(block["id"]), positives, block, _positives).orderBy("slot", "rank").toArrow()
    slot, ids, score = (found[c].to_numpy() for c in ("slot", "id", "score"))
    count = np.bincount(slot, minlength=len(block["id"]))
    limit = lambda percent, up: np.array([min(max(-(-percent * int(s) // 100) if up else percent * int(s) // 100, -(1 << 63)), (1 << 63) - 1) for s in score], np.int64)
    block = block | {"count": count, "at": np.cumsum(count) - count, "least": limit(low, True), "most": limit(high, False)}
    near = _pass(data, scale, len(slot), k, block, _negatives)
    known = spark.createDataFrame(pa.table({"slot": pa.array(np.arange(len(slot))), "anchor_id": pa.array(block["id"][slot]), "positive_id": pa.array(ids), "positive_score": pa.array(score)}))
    # as many rows as the block has positives
    return near.join(F.broadcast(known), "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
