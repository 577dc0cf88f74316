"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to unit length, where the order by distance is the order by
cosine. Each of ``tables`` hash tables cuts ``projections`` Gaussian
projections into cells of ``width``. A query visits its own bucket and then
perturbed ones in estimated order of success: its distances to the walls of
its cells are ranked, and sets of steps over walls are taken by the expected
sum of their squares, an order that is worked out once. Candidates of all
tables are merged and ranked by the exact cosine of the original vectors.

Every vector is indexed, and none is shuffled: the probes of a block of queries,
at most ``BLOCK_PROBES`` keys, are broadcast, each task looks up the buckets of its
own vectors in them, ranks what meets by the exact cosine and hands on its k best
of each query. More queries take more passes over the vectors, so what is broadcast
has a fixed bound, and neither a full bucket nor a repeated vector brings rows to
one place. A query that found fewer than k candidates in its buckets is compared
with all vectors in the same way. The number of probes is fitted to reach the wanted
recall on a sample of at most ``SAMPLE`` vectors; ``fitted_recall`` says what it
reached there. Fitting and the choice of blocks run small jobs when the query is
built.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows without an id; vectors are compared with those of their
own length; repeated rows count once, and of rows that share an id the best counts;
a query never finds its own id; ties go to the smaller id; with fewer than k
candidates all are returned; other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tackline.llm.durable import checkpointed

#: Most vectors and queries of the sample that the number of probes is fitted on.
SAMPLE, SAMPLE_QUERIES = 8_192, 96
#: Keys of a block's probes, queries of a block that meets all vectors, and pairs that a task compares at once.
BLOCK_PROBES, BLOCK_QUERIES, PAIRS = 4_000_000, 1_024, 1_000_000
#: Numbers of probes a table that are tried.
PROBES = (25, 50, 100, 150, 200, 300, 400, 600, 800, 1200, 1600)


def perturbations(projections: int, most: int) -> np.ndarray:
    """Sets of steps in order of expected success, one a row: 1 where the wall of that rank is stepped over.

    Ranks are those of a query's 2 * projections walls by distance; a rank and its mirror are the two walls of one cell.
    """
    m, n = projections, 2 * projections
    j = np.arange(1, n + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    far = 1 - (n + 1 - j) / (m + 1) + (n + 1 - j) * (n + 2 - j) / (4 * (m + 1) * (m + 2))
    cost = np.where(j <= m, near, far)
    out, heap = [np.zeros(n, np.int8)], [(cost[0], (0,))]
    while heap and len(out) < most:
        total, chosen = heapq.heappop(heap)
        if len({min(c, n - 1 - c) for c in chosen}) == len(chosen):
            row = np.zeros(n, np.int8)
            row[list(chosen)] = 1
            out.append(row)
        last = chosen[-1]
        if last + 1 < n:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return np.array(out)


class Tables:
    """The hash tables: their projections, and the buckets of vectors and of probes."""

    def __init__(self, dim: int, tables: int, projections: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.tables, self.m, self.width = tables, projections, width
        self.lines = rng.normal(size=(tables, dim, projections))
        self.shift = rng.uniform(0, width, size=(tables, 1, projections))
        self.mix = rng.integers(1, 1 << 62, size=(tables, projections), dtype=np.int64) | 1

    def places(self, unit: np.ndarray) -> np.ndarray:
        """(tables, vectors, projections) in units of a cell."""
        return (unit @ self.lines + self.shift) / self.width

    def _keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.mix[table]).sum(axis=-1) ^ np.int64(table)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables) keys."""
        cells = np.floor(self.places(unit)).astype(np.int64)
        return np.stack([self._keys(c, k) for k, c in enumerate(cells)], axis=1)

    def probes(self, unit: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """(vectors, tables, steps) keys in order of expected success."""
        place = self.places(unit)
        cells = np.floor(place).astype(np.int64)
        part = place - cells
        out = np.empty((len(unit), self.tables, len(steps)), np.int64)
        for k in range(self.tables):
            rank = np.argsort(np.concatenate([part[k], 1 - part[k]], axis=1), axis=1, kind="stable")
            for i in range(len(unit)):
                taken = np.zeros_like(steps)
                taken[:, rank[i]] = steps
                out[i, k] = self._keys(cells[k, i] - taken[:, : self.m] + taken[:, self.m :], k)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fit_probes(sample: np.ndarray, tables: Tables, k: int, recall: float) -> tuple[int, float | None]:
    """The fewest probes, of PROBES, that reach the recall within the sample, or else the most, and the recall there."""
    if len(sample) < 4 * k:
        return PROBES[0], None
    unit, n = _unit(sample), min(SAMPLE_QUERIES, len(sample))
    near = unit[:n] @ unit.T
    near[np.arange(n), np.arange(n)] = -2
    true = np.argsort(-near, axis=1)[:, :k]
    held, keys = tables.buckets(unit), tables.probes(unit[:n], perturbations(tables.m, PROBES[-1]))
    # the first probe, over all tables, that meets each true neighbour
    first = np.full(true.shape, PROBES[-1] + 1)
    for i in range(n):
        for t in range(tables.tables):
            order = np.argsort(keys[i, t], kind="stable")
            at = np.searchsorted(keys[i, t][order], held[true[i], t])
            hit = (at < len(order)) & (keys[i, t][order][np.minimum(at, len(order) - 1)] == held[true[i], t])
            first[i, hit] = np.minimum(first[i, hit], order[at[hit]])
    chosen = next((p for p in PROBES if (first < p).mean() >= recall), PROBES[-1])
    return chosen, float((first < chosen).mean())


_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


class _Best:
    """The k best of each query that a task has met so far: by exact cosine, then smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, q: np.ndarray, d: np.ndarray, data: np.ndarray, ids: np.ndarray) -> None:
        """Take pairs of places in the queries and in some data, each once."""
        q, d = q[self.ids[q] != ids[d]], d[self.ids[q] != ids[d]]
        norm = np.sqrt(np.einsum("ij,ij->i", data, data))
        for at in range(0, len(q), 50_000):
            x, y = q[at : at + 50_000], d[at : at + 50_000]
            self.held.append((x, ids[y], np.einsum("ij,ij->i", self.vectors[x], data[y]) / (self.norm[x] * norm[y])))
        if sum(len(h[0]) for h in self.held) > 4 * self.k * len(self.ids) + 200_000:
            self.held = [self.best()]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, score = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        # rows of one id count once, at their best
        order = np.lexsort((-score, ids, q))
        once = np.ones(len(q), bool)
        once[order[1:]] = (q[order][1:] != q[order][:-1]) | (ids[order][1:] != ids[order][:-1])
        q, ids, score = q[once], ids[once], score[once]
        new = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        keep = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q)))) < self.k
        return q[keep], ids[keep], score[keep]


def _met(keys: np.ndarray, owner: np.ndarray, held: np.ndarray):
    """Pairs (query, place in ``held``) of each bucket among the sorted probe keys, each once, some at a time."""
    low, high = np.searchsorted(keys, held), np.searchsorted(keys, held, side="right")
    n = (high - low).sum(axis=1)
    ends = np.cumsum(n)
    for part in np.split(np.arange(len(held)), np.searchsorted(ends, np.arange(PAIRS, ends[-1] if len(ends) else 0, PAIRS), "right")):
        count = (high[part] - low[part]).ravel()
        if not count.sum():
            continue
        at = np.repeat(low[part].ravel() - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.unique(owner[at] * np.int64(len(held)) + np.repeat(np.repeat(part, held.shape[1]), count))
        yield both // len(held), both % len(held)


def _near(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of unit queries and unit data those that can be among each query's k best here."""
    near = queries @ data.T
    near[query_ids[:, None] == ids[None, :]] = -2
    # rows of one id can share places among the best, and rounding must not settle ties: such tables keep all
    if len(ids) <= k or len(np.unique(ids)) < len(ids):
        return np.nonzero(near > -1.5)
    least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
    return np.nonzero(near >= least - 1e-9)


def _pass(data: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, index: Tables | None, steps: np.ndarray | None) -> DataFrame:
    """(query_id, vec_id, score) of one block of queries: the k best that each task holds, in the probed buckets or of all."""
    arrow = to_arrow_schema(_FOUND)
    keys = owner = None
    if index is not None:
        keys = index.probes(_unit(vectors), steps).reshape(len(ids), -1)
        owner, keys = np.repeat(np.arange(len(ids)), keys.shape[1]), keys.ravel()
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
    shared = data.sparkSession.sparkContext.broadcast((ids, vectors, keys, owner))

    def run(batches):
        ids, vectors, keys, owner = shared.value
        best, unit = _Best(ids, vectors, k), _unit(vectors)
        for batch in batches:
            for at in range(0, batch.num_rows, 1_024):
                part = batch.slice(at, 1_024)
                own, x = part.column(0).to_numpy(), _vectors(part.column(1))
                for q, d in _met(keys, owner, index.buckets(_unit(x))) if keys is not None else [_near(unit, ids, _unit(x), own, k)]:
                    best.add(q, d, x, own)
        q, found, score = best.best()
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(found), pa.array(score)], schema=arrow)

    found = data.mapInArrow(run, _FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return checkpointed(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k))


def _blocks(queries: DataFrame, most: int):
    """(ids, vectors) of about ``most`` different queries at a time, by a hash of the id."""
    n = -(-queries.count() // most)
    for b in range(n):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b).distinct().toArrow()
        # hashes deal unevenly, so a block is cut again
        for at in range(0, part.num_rows, most):
            rows = part.slice(at, most).combine_chunks()
            yield rows["id"].to_numpy(), _vectors(rows["v"].combine_chunks())


def search(vectors: DataFrame, is_query, k: int = 5, tables: int = 8, projections: int = 12, width: float = 2.5, recall: float = 0.96, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, fitted_recall): for each row that ``is_query(id column)`` picks, its k nearest of all others."""
    v, infinite = F.col("v"), F.lit(float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != infinite), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows, found = rows.where(fine), []
    for dim in sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect()):
        data = rows.where(F.size("v") == dim)
        queries = data.where(is_query(F.col("id")))
        index = Tables(dim, tables, projections, width, seed)
        sample = data.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
        probes, fitted = fit_probes(_vectors(sample.column("v").combine_chunks()), index, k, recall)
        steps = perturbations(projections, probes)
        parts = [_pass(data, *block, k, index, steps) for block in _blocks(queries, max(1, BLOCK_PROBES // (tables * len(steps))))]
        if not parts:
            continue
        near = parts[0]
        for part in parts[1:]:
            near = near.union(part)
        enough = near.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
        few = checkpointed(queries.join(enough, "id", "left_anti"))
        for block in _blocks(few, BLOCK_QUERIES):
            near = near.join(F.broadcast(data.sparkSession.createDataFrame([(int(i),) for i in set(block[0].tolist())], "query_id long")), "query_id", "left_anti").union(_pass(data, *block, k, None, None))
        found.append(near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(fitted).cast("double").alias("fitted_recall")))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, fitted_recall double")
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out
