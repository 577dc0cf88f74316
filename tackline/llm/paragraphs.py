"""Substring deduplication by paragraph MinHash banding.

Paragraphs are the lines of a text; those of at least ``min_words`` words are
compared by their sets of word shingles. Beside them, and in all texts alike,
runs of ``SEED`` words are indexed at places that the hashes of ``SEEDS_APART``
neighbouring runs choose, whatever lines or sentences they cross: any
``SEED + SEEDS_APART - 1`` words in a row that two places share have one of
these seeds in common. Neighbouring seeds that repeat the same earlier place
form a stretch. So a passage is found whether or not it is laid out as
elsewhere.

Each different paragraph has a MinHash signature, in bands tuned so that
paragraphs of Jaccard similarity ``threshold`` meet with probability ``recall``
or more. Paragraphs that collide in a band are compared with the smallest one of
that bucket by exact similarity, and what it does not resemble in turn with the
smallest of those; full buckets are dealt anew first, by rare shingles.
Connected paragraphs form a cluster.
Repeated paragraphs and stretches with at most ``GAP`` words between them make a
run, which is reported when it has at least ``min_run`` words from its first to
its last; all but a cluster's first place are removals. The ends of a stretch are
those of its seeds, so up to ``SEEDS_APART - 1`` repeated words at either end of a
passage lie outside; the default of ``min_run`` allows for them, which reports
every passage of over 50 words, and no run shorter than 33.

Equal paragraphs collapse before bands are shuffled, and seeds that come once are
dropped by a count before any place is compared. Hashes are 64-bit; two different
paragraphs with one hash, of which 10**9 paragraphs hold 0.03 on average, would
pass for equal.

No join broadcasts a table: the session's threshold counts compressed bytes, and what a
broadcast takes of the driver's memory is many times that. All that reaches the driver is
counts and the hashes of at most ``BROADCAST_PIECES`` paragraphs.

Defined cases: a null or empty text has no paragraphs; a text of any length is
read whole, in slices; repeated rows and rows that share an id are texts of their
own, told apart by their text and a number, in whose order their places come; rows without an id take no part; of equal places the one with the
smallest doc_id and then word comes first; other columns of the input are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tackline.llm.components import connected_components
from tackline.llm.durable import checkpointed, new_table, written
from tackline.llm.texts import small_batches
from tackline.llm.words import Words, mixed, read_words, run_hashes, shingles, starts_of

#: Words of a seed, and neighbouring seeds of which the one with the least hash is indexed.
SEED, SEEDS_APART = 8, 10
#: Words between repeated parts of one run: what a changed word can keep from any seed.
GAP = 2 * (SEEDS_APART - 1) + 1
#: What a passage of over 50 words keeps when both its ends lie as far from a seed as they can.
MIN_RUN = 51 - 2 * (SEEDS_APART - 1)
#: Rows whose words a task holds at once.
ROWS = 1_000
#: Candidate paragraphs up to this many are broadcast as hashes; more are joined by shuffle.
BROADCAST_PIECES = 1_000_000
#: Buckets of up to this many different paragraphs are compared within a task; larger ones are dealt anew.
FULL_BUCKET = 2_000
#: Rounds of joins over buckets that are still larger, and pieces of a block of what is left: the driver keeps something of
#: each round's jobs, so that rounds must not grow with the input.
ROUNDS, BLOCK = 3, 1_000


def tune_bands(threshold: float, recall: float, most_rows: int = 4) -> tuple[int, int]:
    """(bands, rows a band): the cheapest to shuffle, with the most rows among those of up to 4 bands, that meets at the threshold with the recall."""
    found = []
    for rows in range(1, most_rows + 1):
        bands = 1
        while 1 - (1 - threshold**rows) ** bands < recall:
            bands += 1
        found.append((bands, rows))
    return max((f for f in found if f[0] <= 4), key=lambda f: f[1], default=found[0])


class Pieces:
    """The paragraphs of some texts that have enough words."""

    def __init__(self, words: Words, min_words: int):
        first = starts_of(words.line)
        size = np.diff(np.append(first, len(words.line)))
        long = size >= min_words
        self.size, first = size[long], first[long]
        self.hashes = words.hash[np.repeat(long, size)]
        self.doc = words.doc[first]
        of_doc = starts_of(words.doc)
        self.word = first - of_doc[np.searchsorted(of_doc, first, "right") - 1]
        self.start, self.end = words.start[first], words.end[first + self.size - 1]
        self.piece = run_hashes(self.hashes, self.size)

    def shingles(self, only: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The shingle hashes of the chosen paragraphs, one after another, and how many each has."""
        size = self.size[only]
        return shingles(self.hashes[np.repeat(only, self.size)], np.repeat(np.arange(len(size)), size), width)[0], np.maximum(size - width + 1, 1)


def shingle_sets(text: str, min_words: int, width: int) -> dict[int, set[int]]:
    """Each paragraph's hash and the hashes of its shingles."""
    out = {}
    for words in read_words([text]):
        found = Pieces(words, min_words)
        flat, count = found.shingles(np.ones(len(found.size), bool), width)
        parts = np.split(flat.view(np.int64), np.cumsum(count)[:-1]) if len(count) else []
        out |= {p: set(x.tolist()) for p, x in zip(found.piece.view(np.int64).tolist(), parts, strict=True)}
    return out


def _signatures(flat: np.ndarray, count: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(paragraphs, bands) hashes: each of the least values of ``rows`` random functions of the shingles."""
    starts = np.cumsum(count) - count
    out = np.zeros((len(count), bands), np.uint64)
    odd = np.random.default_rng(5).integers(1, 1 << 63, size=(bands * rows, 2), dtype=np.uint64) | np.uint64(1)
    for k in range(bands * rows):
        x = flat * odd[k, 0]
        x ^= x >> np.uint64(32)
        x *= odd[k, 1]
        band = k // rows
        out[:, band] = mixed(out[:, band] + np.minimum.reduceat(x, starts) + np.uint64(band + 1))
    return out.view(np.int64)


def told_apart(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, row) of the rows with an id; ``row`` is 0, but tells rows apart that share an id.

    Their texts are dealt by id and text, so that equal rows alone meet, and are written once.
    """
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    shared = checkpointed(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    single = docs.withColumn("row", F.lit(0).cast("long"))
    if shared.isEmpty():
        return single
    equal = Window.partitionBy("doc_id", "text").orderBy("text")
    several = docs.join(shared.hint("merge"), "doc_id", "left_semi").withColumn("row", F.xxhash64(F.coalesce("text", F.lit("")), F.row_number().over(equal)))
    return single.join(shared.hint("merge"), "doc_id", "left_anti").unionByName(written(several))


def _read(docs: DataFrame) -> DataFrame:
    docs = docs if "row" in docs.columns else docs.withColumn("row", F.lit(0).cast("long"))
    return small_batches(docs).select("doc_id", "text", "row").where("doc_id is not null")


_PIECE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("start", "end", "n_words", "word")], T.StructField("piece", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _small(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def all_pieces(docs: DataFrame, min_words: int, width: int, bands: int, rows: int) -> DataFrame:
    """Every paragraph with its hash and bands; one that a task met just before has none."""
    arrow = to_arrow_schema(_PIECE)

    def run(batches):
        met = np.zeros(1 << 18, np.uint64)
        for batch in _small(batches):
            ids, of_row = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for words in read_words(batch.column(1).to_pylist()):
                found = Pieces(words, min_words)
                if not len(found.size):
                    continue
                slot = (found.piece >> np.uint64(46)).astype(np.int64)
                fresh = np.zeros(len(slot), bool)
                fresh[np.unique(found.piece, return_index=True)[1]] = True
                fresh &= met[slot] != found.piece
                met[slot] = found.piece
                of = np.zeros((0, bands), np.int64)
                if fresh.any():
                    of = _signatures(*found.shingles(fresh, width), bands, rows)
                offsets = np.concatenate([[0], np.cumsum(fresh * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(of.ravel()), mask=pa.array(~fresh))
                columns = [ids[found.doc], of_row[found.doc], found.start, found.end, found.size, found.word, found.piece.view(np.int64)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=False)), lists.cast(arrow.field("bands").type)], schema=arrow)

    return _read(docs).mapInArrow(run, _PIECE)


def seed_places(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of the hashes of runs of words, the places of the least of each window of one text; of one run over and over only those a window apart."""
    if len(hashes) < SEEDS_APART:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, SEEDS_APART)
    at = windows.argmin(axis=1) + np.arange(len(windows))
    at = np.unique(at[doc[: len(windows)] == doc[SEEDS_APART - 1 :]])
    if not len(at):
        return at
    new = np.append(True, (hashes[at[1:]] != hashes[at[:-1]]) | (np.diff(at) > SEEDS_APART) | (doc[at[1:]] != doc[at[:-1]]))
    step = (at - at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]) // SEEDS_APART
    return at[new | np.append(new[1:], True) | np.append(True, step[1:] != step[:-1])]


def all_seeds(docs: DataFrame, places: bool = True) -> DataFrame:
    """(seed, doc_id, row, word, start, end) of each indexed run of words, or its seed alone."""
    fields = [T.StructField("seed", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("word", "start", "end")]]
    schema = T.StructType(fields if places else fields[:1])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in _small(batches):
            ids, of_row = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for words in read_words(batch.column(1).to_pylist()):
                h, at = shingles(words.hash, words.doc, SEED)
                chosen = seed_places(h, words.doc[at])
                h, at = h[chosen].view(np.int64), at[chosen]
                of_doc = starts_of(words.doc)
                columns = [h, ids[words.doc[at]], of_row[words.doc[at]], at - of_doc[np.searchsorted(of_doc, at, "right") - 1], words.start[at], words.end[at + SEED - 1]] if places else [h]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return _read(docs).mapInArrow(run, schema)


def repeated_seeds(docs: DataFrame) -> DataFrame:
    """The places of seeds that come more than once, with how often, and the first of them.

    Seeds are counted first, with partial aggregation, and joined with what is left of the count: no seed's places are gathered.
    """
    # written, so that the join reads two plain shuffles, of which a hot seed's share can be split
    often = written(all_seeds(docs, places=False).groupBy("seed").agg(F.count("*").alias("places")).where("places > 1"))
    found = written(all_seeds(docs).join(often.hint("merge"), "seed"))
    return found.join(found.groupBy("seed").agg(F.min(F.struct("doc_id", "row", "word")).alias("first")).hint("merge"), "seed")


def _stretches(repeated: DataFrame, pieces: DataFrame) -> DataFrame:
    """Stretches of repeated seeds outside of stretches of repeated pieces, with the columns of the latter.

    pieces has doc_id, row, word, n_words. A stretch's places are those of its most frequent seed.
    """
    # how far the pieces that follow each other without a gap reach
    by_word = Window.partitionBy("doc_id", "row").orderBy("word")
    ends = pieces.select("doc_id", "row", "word", (F.col("word") + F.col("n_words")).alias("stop"))
    ends = ends.withColumn("new", (F.col("word") > F.coalesce(F.max("stop").over(by_word.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    ends = ends.withColumn("island", F.sum("new").over(by_word)).groupBy("doc_id", "row", "island").agg(F.min("word").alias("word"), F.max("stop").alias("reach"))
    both = repeated.select("doc_id", "row", "word", "start", "end", "places", "first", F.lit(None).cast("int").alias("reach")).unionByName(ends.select("doc_id", "row", "word", "reach"), allowMissingColumns=True)
    covered = F.coalesce(F.max("reach").over(by_word), F.lit(-1)) >= F.col("word") + SEED
    left = both.withColumn("covered", covered).where("first is not null and not covered")
    shift = F.struct(F.col("first.doc_id").alias("d"), F.col("first.row").alias("r"), (F.col("first.word") - F.col("word")).alias("s"))
    joined = (F.lag(shift).over(by_word) == shift) & (F.col("word") - F.lag("word").over(by_word) <= SEED + SEEDS_APART - 1)
    left = left.withColumn("new", F.when(joined, 0).otherwise(1)).withColumn("stretch", F.sum("new").over(by_word.rowsBetween(Window.unboundedPreceding, 0)))
    left = left.groupBy("doc_id", "row", "stretch").agg(F.min("word").alias("word"), (F.max("word") + SEED).alias("stop"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first"), F.max("places").alias("places"))
    left = left.withColumn("removed", F.struct("doc_id", "row", "word") != F.col("first"))
    # at a passage's end a place can have a seed that its first place has not, as windows reach beyond: such go with the stretch they lie against
    near = [F.when(F.lag("removed").over(by_word) & (F.lag("stop").over(by_word) >= F.col("word")), F.lag("first").over(by_word)), F.when(F.lead("removed").over(by_word) & (F.lead("word").over(by_word) <= F.col("stop")), F.lead("first").over(by_word))]
    short = ~F.col("removed") & (F.col("stop") - F.col("word") < SEED + SEEDS_APART)
    left = left.withColumn("other", F.when(short, F.coalesce(*near))).withColumns({"removed": F.col("removed") | F.col("other").isNotNull(), "first": F.coalesce("other", "first")})
    return left.select("doc_id", "row", "word", "start", "end", (F.col("stop") - F.col("word")).alias("n_words"), F.col("first.doc_id").alias("cluster_id"), "places", "removed")


def _shingles_of(docs: DataFrame, wanted: DataFrame, min_words: int, width: int) -> DataFrame:
    """(piece, shingles) of the wanted paragraphs, from a second reading of the texts."""
    schema = T.StructType([T.StructField("piece", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)
    few = wanted.limit(BROADCAST_PIECES + 1).count() <= BROADCAST_PIECES
    chosen = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow().column(0).to_numpy()) if few else None)

    def run(batches):
        met = np.zeros(1 << 18, np.uint64)
        for batch in _small(batches):
            for words in read_words(batch.column(1).to_pylist()):
                found = Pieces(words, min_words)
                signed = found.piece.view(np.int64)
                only = np.zeros(len(signed), bool)
                only[np.unique(signed, return_index=True)[1]] = True
                if chosen.value is not None:
                    at = np.minimum(np.searchsorted(chosen.value, signed), max(0, len(chosen.value) - 1))
                    only &= chosen.value[at] == signed if len(chosen.value) else False
                slot = (found.piece >> np.uint64(46)).astype(np.int64)
                only &= met[slot] != found.piece
                if not only.any():
                    continue
                met[slot[only]] = found.piece[only]
                flat, count = found.shingles(only, width)
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(signed[only]), lists.cast(arrow.field(1).type)], schema=arrow)

    got = _read(docs).mapInArrow(run, schema)
    got = got if few else got.join(wanted.hint("merge"), "piece", "left_semi")
    return got.groupBy("piece").agg(F.array_distinct(F.first("shingles")).alias("shingles"))


def _similarity(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Distinct (a, b) with their exact Jaccard similarity j."""
    both = pairs.select("a", "b").distinct().join(shingles.toDF("a", "x").hint("merge"), "a").join(shingles.toDF("b", "y").hint("merge"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("j"))


def bucket_links(members: list[tuple[int, set]], threshold: float) -> list[tuple[int, int]]:
    """Links that connect all similar members of a bucket, by the rounds that :func:`similar_links` tells of."""
    def similarity(x, y):
        shared = len(x & y)
        return shared / (len(x) + len(y) - shared)

    out, far, pool = [], 1 - threshold + 1e-12, sorted(members, key=lambda m: m[0])
    while len(pool) > 1:
        (pivot, own), others = pool[0], pool[1:]
        j = [similarity(own, s) for _, s in others]
        leaves = [(m, i) for m, i in zip(others, j, strict=True) if i >= threshold]
        out += [(m[0], pivot) for m, _ in leaves]
        for (piece, s), i in zip(others, j, strict=True):
            if threshold > i >= 1 - 2 * far:
                out += [(piece, m[0]) for m, k in leaves if k - i <= far and similarity(s, m[1]) >= threshold]
        pool = [m for m, i in zip(others, j, strict=True) if i < threshold]
    return out


def _links_in_tasks(rows: DataFrame, threshold: float) -> DataFrame:
    """Links of buckets that a task can hold; rows has band, key, piece, shingles."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        at, members = None, []
        for batch in batches:
            out = []
            for band, key, piece, shingles in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (band, key) != at:
                    out += bucket_links(members, threshold)
                    at, members = (band, key), []
                members.append((piece, set(shingles)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], schema=arrow)
        out = bucket_links(members, threshold)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], schema=arrow)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "band", "key").sortWithinPartitions("band", "key").select("band", "key", "piece", "shingles").mapInArrow(run, schema)


def _by_rare_shingles(full: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Buckets (piece, band, key) dealt anew, so that similar pieces of one meet in one of the new.

    Shingles are ordered by how many of the bucket's pieces have them. Of n shingles, two pieces of at least the similarity share
    one of the first n - ceil(threshold * n) + 1; a new bucket holds the pieces that have one shingle there.
    """
    held = written(full.select("piece", "band", "key").join(shingles.hint("merge"), "piece").select("piece", "band", "key", F.explode("shingles").alias("shingle")))
    often = held.groupBy("band", "key", "shingle").agg(F.count(F.lit(1)).alias("n"))
    own = held.join(often.hint("merge"), ["band", "key", "shingle"]).groupBy("band", "key", "piece").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("xs"))
    first = F.size("xs") - F.ceil(F.size("xs") * threshold - 1e-9).cast("int") + 1
    near = own.select("piece", "band", "key", F.explode(F.slice("xs", F.lit(1), first)).alias("x")).where("x.n > 1")
    return near.select("piece", "band", F.xxhash64("key", "x.shingle").alias("key")).distinct()


def _links_by_joins(full: DataFrame, shingles: DataFrame, threshold: float, path: str) -> DataFrame:
    """Links of buckets of any size, a round at a time over all of them, added to the table; what is left after ROUNDS of them. full has piece, band, key."""
    far = 1 - threshold + 1e-12

    def with_pivot(rows):
        pivots = rows.groupBy("band", "key").agg(F.min("piece").alias("pivot"), F.max("piece").alias("most")).where("pivot <> most").drop("most")
        return checkpointed(rows.join(pivots.hint("merge"), ["band", "key"]))

    full = with_pivot(full)
    for _ in range(ROUNDS):
        if full.isEmpty():
            break
        others = full.where("piece <> pivot")
        j = checkpointed(_similarity(others.select(F.col("piece").alias("a"), F.col("pivot").alias("b")), shingles))
        placed = checkpointed(others.join(j.hint("merge"), (others["piece"] == j["a"]) & (others["pivot"] == j["b"])).select("band", "key", "piece", "j"))
        leaves, border = placed.where(F.col("j") >= threshold), placed.where((F.col("j") < threshold) & (F.col("j") >= 1 - 2 * far))
        across = border.join(leaves.select("band", "key", F.col("piece").alias("left"), F.col("j").alias("i")).hint("merge"), ["band", "key"]).where(F.col("i") - F.col("j") <= far)
        more = _similarity(across.select(F.col("piece").alias("a"), F.col("left").alias("b")), shingles)
        # each round's links go to one table, so that the plan does not grow with the rounds
        written(j.union(more).where(F.col("j") >= threshold).select("a", "b"), path)
        full = with_pivot(placed.where(F.col("j") < threshold).select("piece", "band", "key"))
    return full.select("piece", "band", "key")


def block_links(left: list[tuple[int, set]], right: list[tuple[int, set]], threshold: float) -> list[tuple[int, int]]:
    """Links that connect all similar pieces of two blocks, one of each, but what such links connect already."""
    out, root = [], {}

    def top(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for a, x in left:
        for b, y in right:
            n = len(x) + len(y)
            # similar sets share at least this many shingles
            least = threshold * n / (1 + threshold) - 1e-9
            if min(len(x), len(y)) >= least and (up := top(a)) != (to := top(b)) and (shared := len(x & y)) >= least and shared / (n - shared) >= threshold:
                root[up] = to
                out.append((a, b))
    return out


def _links_by_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """The same for buckets of any size: each is dealt to blocks of about BLOCK pieces, and each two blocks are compared in a task; rows has band, key, piece, n, shingles."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = to_arrow_schema(schema)
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("piece"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"), "piece", "shingles")

    def links(two):
        return bucket_links(two[0], threshold) if two[2] else block_links(two[0], two[1], threshold)

    def run(batches):
        at, two, out = None, ([], [], True), []
        for batch in batches:
            for *key, second, piece, shingles in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if key != at:
                    out += links(two)
                    at, two = key, ([], [], key[2] == key[3])
                two[second].append((piece, set(shingles)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], schema=arrow)
            out = []
        out = links(two)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], schema=arrow)

    parts, by = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["band", "key", "low", "high"]
    return dealt.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _counted(rows: DataFrame) -> DataFrame:
    """Buckets (piece, band, key) of two pieces or more, with how many each has."""
    return checkpointed(rows.join(rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").hint("merge"), ["band", "key"]))


def _links_of_full(full: DataFrame, shingles: DataFrame, threshold: float, most: int, path: str) -> None:
    """Adds the links of buckets (piece, band, key) that no task can hold to the table, in a bounded number of steps."""
    full = _counted(written(_by_rare_shingles(full, shingles, threshold)))
    written(_links_in_tasks(full.where(F.col("n") <= most).join(shingles.hint("merge"), "piece"), threshold), path)
    full = full.where(F.col("n") > most).drop("n")
    if not full.isEmpty():
        left = _counted(_links_by_joins(full, shingles, threshold, path))
        written(_links_by_blocks(left.join(shingles.hint("merge"), "piece"), threshold), path)


def similar_links(docs: DataFrame, table: DataFrame, threshold: float, min_words: int, width: int, full_bucket: int | None = None) -> DataFrame:
    """Links (a, b) between different pieces of at least the similarity that share a band: enough to connect all such.

    Buckets of more than ``full_bucket`` pieces are dealt anew by their pieces' rarest shingles. What is still as large goes by
    ROUNDS rounds: every bucket's smallest piece is compared with the bucket, and what it resembles is connected through it and
    leaves with it. Jaccard distance is a metric, so only pieces within twice the distance can resemble what leaves; they
    are compared with as much of it as the distances to the smallest piece allow. The rest is compared each with each, in blocks.
    """
    most = FULL_BUCKET if full_bucket is None else full_bucket
    keyed = table.where("bands is not null").select("piece", F.posexplode("bands").alias("band", "key"))
    # equal paragraphs of different tasks are still there: buckets are counted after a distinct
    different = keyed.distinct()
    shared = keyed.groupBy("band", "key").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low <> high").drop("low", "high")
    full = checkpointed(different.join(shared.hint("merge"), ["band", "key"]))
    full = checkpointed(full.join(full.groupBy("band", "key").agg(F.count("*").alias("n")).hint("merge"), ["band", "key"]))
    shingles = checkpointed(_shingles_of(docs, full.select("piece").distinct(), min_words, width))
    links = _links_in_tasks(full.where(F.col("n") <= most).join(shingles.hint("merge"), "piece"), threshold)
    large = full.where(F.col("n") > most).drop("n")
    if not large.isEmpty():
        path = new_table(docs.sparkSession)
        _links_of_full(large, shingles, threshold, most, path)
        links = written(links, path)
    return links


def repeated_passages(docs: DataFrame, threshold: float = 0.8, width: int = 5, min_words: int = 8, min_run: int = MIN_RUN, recall: float = 0.97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a repeated paragraph or stretch of a reported run: doc_id, start, end (code points), n_words, cluster_id, places, removed.

    cluster_id is the smallest doc_id in the cluster; ``removed`` is false for the cluster's first place, by doc_id and start.
    """
    bands, rows = tune_bands(threshold, recall)
    docs = told_apart(docs, id_col, text_col)
    table = written(all_pieces(docs, min_words, width, bands, rows))
    roots = checkpointed(connected_components(similar_links(docs, table, threshold, min_words, width)))
    counts = table.groupBy("piece").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "start")).alias("first"))
    rooted = counts.join(roots.withColumnRenamed("vertex", "piece").hint("merge"), "piece", "left").withColumn("cluster", F.coalesce("root", "piece"))
    # a piece that comes once and is no vertex is alone; roots that are no vertex of their own come from the links' other side
    linked = roots.select(F.col("root").alias("piece")).distinct().withColumn("is_root", F.lit(True))
    rooted = rooted.join(linked.hint("merge"), "piece", "left").where("n > 1 or root is not null or is_root")
    clusters = rooted.groupBy("cluster").agg(F.sum("n").alias("places"), F.min("first").alias("first"))
    known = checkpointed(rooted.select("piece", "cluster").join(clusters.hint("merge"), "cluster").where("places > 1"))
    repeated = table.drop("bands").join(known.hint("merge"), "piece")
    here = F.struct("doc_id", "row", "start")
    repeated = repeated.select("doc_id", "row", "word", "start", "end", "n_words", F.col("first.doc_id").alias("cluster_id"), "places", (here != F.col("first")).alias("removed"))
    parts = repeated.unionByName(_stretches(repeated_seeds(docs), repeated.select("doc_id", "row", "word", "n_words")))
    # runs of neighbouring parts
    order = Window.partitionBy("doc_id", "row").orderBy("word", "start")
    before = F.max(F.col("word") + F.col("n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("new", F.when(F.col("word") <= before + GAP, 0).otherwise(1))
    parts = parts.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("doc_id", "row", "run")
    parts = parts.withColumn("run_words", F.max(F.col("word") + F.col("n_words")).over(run) - F.min("word").over(run))
    return parts.where(F.col("run_words") >= min_run).select("doc_id", "start", "end", "n_words", "cluster_id", "places", "removed")
