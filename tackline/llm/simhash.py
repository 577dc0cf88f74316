"""SimHash near-duplicates by binary-trie self-join.

A fingerprint takes, bit by bit, the majority of the 64-bit hashes of a text's
word shingles. Equal fingerprints collapse into one before any join. Two that
differ in at most ``budget`` bits agree in at least one of ``budget + 1``
blocks of bits; for each block, those that agree in it form the subtree below
a common path of the binary trie whose first bits are that block. In each
subtree pairs of nodes are traversed together: two children on the same side
keep the number of differing bits, two on different sides add one, and a pair
over the budget is pruned. Small pairs of nodes are compared leaf by leaf.

A subtree returns links that connect what it holds, the nearest first, not all
of them, so that a group of copies gives a few rows a member. A subtree over the
size limit is split at pairs of deeper nodes, again and again until every part
is small, which keeps every link and lets more tasks share it.

:func:`near_duplicates` links fingerprints of one word. :func:`keep_one` finds
texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
Such texts differ in about 15 % of the bits of a SimHash, too many for one trie,
so it draws ``TABLES`` fingerprints of ``TABLE_BITS`` bits each from a wide
SimHash and joins each in a trie of its own; two texts of just that similarity
are linked in one with a probability of about 0.99, more similar ones almost
always. What such links connect is compared by the exact similarity, each text
with each, in blocks where a component is large; only that links texts.

Defined cases: a null or empty text has fingerprint 0 and links as any other;
repeated rows and ids give repeated rows of one component in
:func:`near_duplicates`; a component whose ids are all null has a null id; ties
go to the smaller id and then to the smaller hash of the text; a text of any
length is read whole; other columns are ignored there and carried along by
:func:`keep_one`, where names that begin with two underscores are taken; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tackline.llm.components import connected_components
from tackline.llm.durable import checkpointed, written
from tackline.llm.texts import map_rows, small_batches
from tackline.llm.words import mixed, read_words, run_hashes, shingles, starts_of

BITS = 64
#: Leaf pairs of a pair of nodes that are compared at once, and those of all such pairs.
LEAVES, PAIRS = 1_024, 1 << 18
#: Node pairs held at once; more are put aside and taken up later.
FRONT = 50_000
#: Near pairs that are looked at before links are made of them.
STEP = 4_096
#: Bits below a node by which a large subtree is split.
SPLIT_BITS = 8
#: Rows of whole subtrees that a task takes together.
CHUNK = 200_000
#: Longs of a wide SimHash; fingerprints drawn from it, bits of each, and the differing bits that link two.
WIDE, TABLES, TABLE_BITS, TABLE_BUDGET = 8, 26, 36, 3
#: Tables whose tries are joined first, to make groups.
FIRST_TABLES = 3
#: Texts, and shingles, of a block of a component. Sets up to FEW are compared by themselves, more by columns of a matrix.
BLOCK_TEXTS, BLOCK_SHINGLES, FEW, COLUMNS = 1_000, 1_000_000, 8, 4_096
#: Wide SimHashes further apart than this are of texts less similar than 0.65, those of 0.8 lie at 78 with a deviation of 8.
FAR_APART = 112


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, repeats included, as an unsigned number.

    Words are runs without ASCII white space, A-Z lower-cased; fewer words than ``width`` are one shingle, none give 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, n, 50_000):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(first[k : k + 50_000], last[k : k + 50_000], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return map_rows(docs, lambda pairs: [(i, signed(fingerprint(t, width, seed))) for i, t in pairs], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())]), id_col, text_col)


def _find(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The roots that x lead to, with paths made shorter on the way."""
    while True:
        up = label[x]
        top = label[up]
        if (up == top).all():
            return up
        label[x] = top


def _links(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs, nearest first, join what was apart; one for each two labels. ``label`` is brought up to date."""
    a, b = _find(label, i), _find(label, j)
    apart = np.flatnonzero(a != b)
    if not len(apart):
        return apart
    low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
    chosen = apart[np.unique(low * np.int64(len(label)) + high, return_index=True)[1]]
    i, j = i[chosen], j[chosen]
    while len(i):
        a, b = _find(label, i), _find(label, j)
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        left = a != b
        i, j = i[left], j[left]
    return chosen


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1 ... lo + n - 1 for each, one after another."""
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def _middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where in each sorted range, whose values agree in all higher bits, the bit turns to 1."""
    while True:
        wide = lo < hi
        if not wide.any():
            return lo
        at = (lo + hi) >> 1
        one = (values[np.minimum(at, len(values) - 1)] & bit) != 0
        lo, hi = np.where(wide & ~one, at + 1, lo), np.where(wide & one, at, hi)


def trie_links(values: np.ndarray, roots: np.ndarray, budget: int, bits: int = BITS, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The label of each value after linking all pairs within the budget below pairs of roots, and pairs of places that link them so.

    ``roots`` has rows (lo a, hi a, lo b, hi b, depth, differing bits): two nodes as sorted ranges of ``values``, the same one twice or two apart.
    Pairs of one ``group``, where that is not 0, are connected already and are left out.
    """
    label, put_aside, found = np.arange(len(values)), [roots], [np.zeros((2, 0), np.int64)]
    while put_aside:
        front = put_aside.pop()
        if len(front) > FRONT:
            put_aside.append(front[FRONT:])
            front = front[:FRONT]
        pairs = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2])
        small = (pairs <= LEAVES) | (front[:, 4] >= bits)
        if small.any():
            few = front[small]
            ends = np.cumsum(pairs[small])
            for part in np.split(few, np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS), "right")):
                width = part[:, 3] - part[:, 2]
                n = (part[:, 1] - part[:, 0]) * width
                k, width = _ranges(np.zeros(len(n), np.int64), n), np.repeat(width, n)
                i, j = np.repeat(part[:, 0], n) + k // width, np.repeat(part[:, 2], n) + k % width
                differ = np.bitwise_count(values[i] ^ values[j])
                near = np.flatnonzero((differ <= budget) & (i < j))
                if group is not None:
                    near = near[(group[i[near]] != group[j[near]]) | (group[i[near]] == 0)]
                near = near[np.argsort(differ[near], kind="stable")]
                for at in range(0, len(near), STEP):
                    step = near[at : at + STEP]
                    chosen = step[_links(label, i[step], j[step])]
                    found.append(np.stack([i[chosen], j[chosen]]))
            front = front[~small]
            if not len(front):
                continue
        la, ha, lb, hb, depth, errors = front.T
        bit = np.uint64(1) << (bits - 1 - depth).astype(np.uint64)
        ma, mb, same = _middle(values, la, ha, bit), _middle(values, lb, hb, bit), la == lb
        children = [
            np.stack([la, ma, lb, mb, depth + 1, errors]),
            np.stack([ma, ha, mb, hb, depth + 1, errors]),
            np.stack([la, ma, mb, hb, depth + 1, errors + 1]),
            np.stack([ma, ha, lb, mb, depth + 1, errors + 1])[:, ~same],
        ]
        children = np.concatenate(children, axis=1)
        alive = (children[0] < children[1]) & (children[2] < children[3]) & (children[5] <= budget)
        alive &= (children[0] != children[2]) | (children[1] - children[0] > 1)
        if alive.any():
            put_aside.append(children[:, alive].T)
    return _find(label, np.arange(len(label))), np.concatenate(found, axis=1)


def _block_edges(budget: int, bits: int) -> list[tuple[int, int]]:
    """(first bit from the top, bits) of each block."""
    edges = [bits * k // (budget + 1) for k in range(budget + 2)]
    return [(s, e - s) for s, e in zip(edges, edges[1:], strict=False)]


_UNIT = ("slot", "depth", "low", "high")


def _linked(rows: DataFrame, budget: int, bits: int) -> DataFrame:
    """Links of all subtrees; rows has the unit (slot, depth, low, high: one node or two at that depth), value, node and perhaps group.

    Rows of a unit come together by repartition and sort; a task takes some whole units at a time.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = to_arrow_schema(schema)
    columns = [*_UNIT, "value", "node", *(["group"] if "group" in rows.columns else [])]

    def links(rows):
        slot, depth, low, high, value, node, *group = rows
        value = value.view(np.uint64)
        order = np.lexsort((value, high, low, depth, slot))
        slot, depth, low, high, value, node, *group = (x[order] for x in (slot, depth, low, high, value, node, *group))
        first = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (depth[1:] != depth[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        end = np.append(first[1:], len(value))
        prefix = value >> (bits - depth).astype(np.uint64)
        middle = first + np.add.reduceat((prefix == np.repeat(prefix[first], end - first)).astype(np.int64), first)
        one = low[first] == high[first]
        errors = np.bitwise_count((low[first] ^ high[first]).view(np.uint64)).astype(np.int64)
        roots = np.stack([first, np.where(one, end, middle), np.where(one, first, middle), end, depth[first], errors], axis=1)
        roots = roots[np.where(one, end - first > 1, middle < end)]
        if len(roots):
            i, j = trie_links(value, roots, budget, bits, *group)[1]
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], schema=arrow)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch.column(k).to_numpy() for k in range(len(columns))]))
                n += batch.num_rows
            if n > CHUNK:
                rows = np.concatenate(held, axis=1)
                cut = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0))
                at = cut[-1] + 1 if len(cut) else 0
                if at:
                    yield from links(rows[:, :at])
                held, n = [rows[:, at:]], rows.shape[1] - at
        if n:
            yield from links(np.concatenate(held, axis=1))

    return rows.select(*[F.col(c).cast("long") for c in columns]).mapInArrow(run, schema)


def near_links(prints: DataFrame, budget: int = 3, limit: int | None = None, bits: int = BITS) -> DataFrame:
    """Links (a, b) between nodes, enough to connect those that have, in one table, fingerprints within the budget.

    ``prints`` has node (long), table (int) and fp, a fingerprint of ``bits`` bits that comes once in its table. It may have a
    group (long); nodes of one group, where that is not 0, are not linked with each other.
    A subtree of over ``limit`` fingerprints (20,000, or 20 times the mean where that is more) is split at pairs of nodes
    8 bits deeper that differ in at most what is left of the budget.
    """
    blocks = _block_edges(budget, bits)
    mask = F.lit((1 << bits) - 1 if bits < BITS else -1)
    turned = [F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", bits - s)).bitwiseAND(mask) if s else F.col("fp") for s, _ in blocks]
    units = F.array(*[F.struct(F.lit(k).cast("long").alias("block"), t.alias("value"), F.shiftrightunsigned(t, bits - n).alias("low"), F.lit(n).alias("depth")) for k, (t, (_, n)) in enumerate(zip(turned, blocks, strict=True))])
    carried = ["node", *(["group"] if "group" in prints.columns else [])]
    rows = prints.select(*carried, "table", F.explode(units).alias("u"))
    rows = rows.select((F.col("table") * len(blocks) + F.col("u.block")).alias("slot"), F.col("u.depth").alias("depth"), F.col("u.low").alias("low"), F.col("u.low").alias("high"), F.col("u.value").alias("value"), *carried)
    while True:
        sizes = rows.groupBy(*_UNIT).count()
        if limit is None:
            n, groups = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
            limit = max(20_000, 20 * n // max(1, groups))
        hot = checkpointed(sizes.where((F.col("count") > limit) & (F.col("depth") < bits)).drop("count"))
        if hot.isEmpty():
            break
        large = rows.join(hot, list(_UNIT), "left_semi")
        deeper = F.least(F.col("depth") + SPLIT_BITS, F.lit(bits))
        step = deeper - F.col("depth")
        own = F.expr(f"shiftrightunsigned(value, cast({bits} - least(depth + {SPLIT_BITS}, {bits}) as int))")
        # what two nodes' paths so far differ in, and what they may differ in further on
        apart = F.col("low").bitwiseXOR(F.col("high"))
        masks = F.array(*[F.lit(m).cast("long") for m in range(1 << SPLIT_BITS) if m.bit_count() <= budget])
        masks = F.filter(masks, lambda m: (m < F.expr(f"shiftleft(1L, cast(least({SPLIT_BITS}, {bits} - depth) as int))")) & (F.bit_count(m) + F.bit_count(apart) <= budget))
        large = large.select("slot", "depth", deeper.alias("deeper"), step.cast("int").alias("step"), own.alias("own"), apart.alias("apart"), "value", *carried, F.explode(masks).alias("m"))
        other = F.col("own").bitwiseXOR(F.expr("shiftleft(apart, step)")).bitwiseXOR(F.col("m"))
        large = large.select("slot", F.col("deeper").alias("depth"), F.least("own", other).alias("low"), F.greatest("own", other).alias("high"), "value", *carried)
        rows = checkpointed(rows.join(hot, list(_UNIT), "left_anti").select(*_UNIT, "value", *carried).unionByName(large))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _linked(rows.repartition(parts, *_UNIT).sortWithinPartitions(*_UNIT), budget, bits)


def near_duplicates(docs: DataFrame, budget: int = 3, width: int = 3, seed: int = 42, limit: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id, the smallest doc_id reachable over links."""
    prints = checkpointed(fingerprints(docs, width, seed, id_col, text_col))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(classes.select(F.col("fp").alias("node"), F.lit(0).alias("table"), "fp"), budget, limit))
    # only linked fingerprints need more than their own smallest id
    linked = roots.select(F.col("vertex").alias("fp"), "root").union(roots.select(F.col("root").alias("fp"), "root").distinct())
    least = linked.join(classes, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    own = classes.join(linked, "fp", "left").join(least, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(own, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Ids up to this many are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def wide_prints(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(docs, WIDE) longs: majority bits of the different shingles of each doc; ``doc`` says, in order, which doc a hash is of."""
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))
    hashes, doc = hashes[new], doc[new]
    first = starts_of(doc)
    size = np.diff(np.append(first, len(doc)))
    # eight counters of a byte each are added up in one word, 255 shingles at a time
    parts = -(-size // 255)
    starts = np.repeat(first, parts) + 255 * _ranges(np.zeros(len(parts), np.int64), parts)
    of = np.cumsum(parts) - parts
    out, ones = np.zeros((len(first), WIDE), np.uint64), np.uint64(0x0101010101010101)
    for k in range(WIDE):
        x = mixed(hashes + np.uint64((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
        for b in range(8):
            lanes = np.add.reduceat(x >> np.uint64(b) & ones, starts).view(np.uint8).reshape(-1, 8)
            counts = np.add.reduceat(lanes.astype(np.int64), of, axis=0)
            out[:, k] |= np.bitwise_or.reduce((2 * counts > size[:, None]).astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(b)), axis=1)
    return out


def drawn_prints(wide: np.ndarray) -> np.ndarray:
    """(docs, TABLES) fingerprints of TABLE_BITS bits, each of bits drawn from the wide print."""
    rng = np.random.default_rng(9)
    drawn = np.concatenate([rng.choice(64 * WIDE, TABLE_BITS, replace=False) for _ in range(TABLES)])
    bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(wide), -1), axis=1)
    packed = np.zeros((len(wide), TABLES, 8), np.uint8)
    packed[:, :, : -(-TABLE_BITS // 8)] = np.packbits(bits[:, drawn].reshape(len(wide), TABLES, TABLE_BITS), axis=2, bitorder="little")
    return packed.view(np.uint64)[:, :, 0]


_TEXT = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.LongType()), T.StructField("wide", T.ArrayType(T.LongType())), T.StructField("prints", T.ArrayType(T.LongType()))])


def _nodes(texts: DataFrame, width: int, wanted: np.ndarray | None = None, sets: bool = False) -> DataFrame:
    """The different texts of (key, text): their key and node, a hash of all words, with wide print and drawn prints; or the nodes' shingle sets."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))]) if sets else _TEXT
    arrow = to_arrow_schema(schema)
    chosen = texts.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def lists(values: np.ndarray, count: np.ndarray):
        offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64).ravel())).cast(arrow.field(arrow.names[-1]).type)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                keys = part.column(0).to_numpy()
                empty = np.ones(len(keys), bool)
                for words in read_words(part.column(1).to_pylist()):
                    first = starts_of(words.doc)
                    docs = words.doc[first]
                    empty[docs] = False
                    node = run_hashes(words.hash, np.diff(np.append(first, len(words.doc)))).view(np.int64)
                    h, place = shingles(words.hash, words.doc, width)
                    if not sets:
                        wide = wide_prints(h, words.doc[place])
                        n = len(docs)
                        yield pa.RecordBatch.from_arrays([pa.array(keys[docs]), pa.array(node), lists(wide, np.full(n, WIDE)), lists(drawn_prints(wide), np.full(n, TABLES))], schema=arrow)
                        continue
                    only = np.ones(len(node), bool)
                    if chosen is not None:
                        only = chosen.value[np.minimum(np.searchsorted(chosen.value, node), len(chosen.value) - 1)] == node if len(chosen.value) else only & False
                    if only.any():
                        of = np.repeat(np.arange(len(docs)), np.diff(np.append(np.searchsorted(place, first), len(place))))
                        yield pa.RecordBatch.from_arrays([pa.array(node[only]), lists(h[only[of]], np.bincount(of, minlength=len(docs))[only])], schema=arrow)
                n = int(empty.sum())
                if n and not sets:
                    none = np.zeros((n, WIDE), np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[empty]), pa.array(np.zeros(n, np.int64)), lists(none, np.full(n, WIDE)), lists(drawn_prints(none), np.full(n, TABLES))], schema=arrow)

    return small_batches(texts).mapInArrow(run, schema)


def set_links(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links between places of sets of different longs, enough to connect all that have the Jaccard similarity."""
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    if n <= FEW:
        shared = np.array([[len(np.intersect1d(x, y, assume_unique=True)) if k < m else 0 for m, y in enumerate(sets)] for k, x in enumerate(sets)], np.int64)
    else:
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        of, several = np.repeat(np.arange(n), size), times[column] > 1  # a shingle of one set alone is in no intersection
        of, column = of[several], (np.cumsum(times > 1) - 1)[column[several]]
        order = np.argsort(column, kind="stable")
        of, column = of[order], column[order]
        shared = np.zeros((n, n), np.int64)
        for k in range(0, int((times > 1).sum()), COLUMNS):
            part = slice(*np.searchsorted(column, [k, k + COLUMNS]))
            ones = np.zeros((n, COLUMNS), np.float32)
            ones[of[part], column[part] - k] = 1
            shared += (ones @ ones.T).astype(np.int64)
    near = np.triu(shared / (size[:, None] + size[None, :] - shared) >= threshold, 1)
    label, (i, j) = np.arange(n), np.nonzero(near)
    _links(label, i, j)
    root = _find(label, np.arange(n))
    return [(k, r) for k, r in enumerate(root.tolist()) if k != r]


def _confirmed(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect all texts of a component that have the similarity; members has root, node, shingles.

    A large component's texts are dealt into blocks, and each two blocks are compared in a task.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        at, nodes, sets = None, [], []

        def found():
            links = set_links(sets, threshold)
            return pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in links], pa.int64()) for k in range(2)], schema=arrow)

        for batch in batches:
            root, low, high, node = (batch.column(k).to_pylist() for k in range(4))
            for k, tile in enumerate(zip(root, low, high, strict=True)):
                if tile != at:
                    if len(nodes) > 1:
                        yield found()
                    at, nodes, sets = tile, [], []
                nodes.append(node[k])
                sets.append(batch.column(4)[k].values.to_numpy().copy())
        if len(nodes) > 1:
            yield found()

    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum(F.size("shingles").cast("long")) / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "root").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "shingles")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small_batches(tiles.repartition(parts, "root", "low", "high").sortWithinPartitions("root", "low", "high")).mapInArrow(run, schema)


def similar_texts(texts: DataFrame, nodes: DataFrame, threshold: float, width: int, limit: int | None = None) -> DataFrame:
    """Links (a, b) that connect all nodes whose shingle sets have the similarity and that the tries' links connect.

    Nodes of one drawn fingerprint link to the smallest of them, so each trie has a fingerprint once. The first few tries and
    those links make groups; in the other tries nodes of one group are not linked again, so that a large group of near copies
    gives a few links a member and not some for each trie. What is connected then is compared exactly, each with each.
    """
    drawn = nodes.select("node", F.posexplode("prints").alias("table", "fp"))
    same = checkpointed(drawn.groupBy("table", "fp").agg(F.min("node").alias("rep"), F.count("*").alias("n")))
    stars = drawn.join(same.where("n > 1").drop("n"), ["table", "fp"]).where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    prints = same.select(F.col("rep").alias("node"), "table", "fp")
    wide = nodes.select("node", "wide")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)

    def near(pairs):
        # kept, as Spark may read them once more for a filter of the joins
        pairs = checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        return pairs.join(wide.toDF("a", "x"), "a").join(wide.toDF("b", "y"), "b").where(apart <= FAR_APART).select("a", "b")

    def members(roots):
        return roots.union(roots.select("root", "root").distinct()).toDF("node", "root")

    first = F.col("table") < FIRST_TABLES
    roots = connected_components(near(stars.union(near_links(prints.where(first), TABLE_BUDGET, limit, TABLE_BITS))))
    grouped = prints.where(~first).join(members(roots), "node", "left").select("node", "table", "fp", F.coalesce("root", F.lit(0)).alias("group"))
    more = near(near_links(written(grouped), TABLE_BUDGET, limit, TABLE_BITS))
    found = checkpointed(members(connected_components(roots.toDF("a", "b").union(more))))
    ends = found.select("node")
    wanted = np.sort(ends.toArrow().column(0).to_numpy()) if ends.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else None
    sets = _nodes(texts, width, wanted, sets=True)
    sets = sets if wanted is not None else sets.join(ends, "node", "left_semi")
    sets = sets.groupBy("node").agg(F.array_distinct(F.first("shingles")).alias("shingles"))
    return _confirmed(checkpointed(found.join(sets, "node").select("root", "node", "shingles")), threshold)


def keep_one(docs: DataFrame, threshold: float = 0.8, width: int = 5, limit: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns unchanged, of one document of each component: the smallest id, then the smallest hash of the text.

    Texts link when the sets of their word shingles have the Jaccard similarity. Rows without an id come after all others in
    a component; of rows that share both id and text one stays.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    texts = docs.select(key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = written(_nodes(texts, width))
    nodes = written(table.groupBy("node").agg(F.first("wide").alias("wide"), F.first("prints").alias("prints")))
    roots = checkpointed(connected_components(similar_texts(texts, nodes, threshold, width, limit)))
    groups = table.select(F.col("key").alias("__key"), "node").distinct().join(roots.withColumnRenamed("vertex", "node"), "node", "left").select("__key", F.coalesce("root", "node").alias("group"))
    rows = docs.select(F.col(id_col).alias("__id"), key.alias("__key")).groupBy("__id", "__key").agg(F.count("*").alias("n"))
    rows = checkpointed(rows.join(groups, "__key"))
    kept = rows.groupBy("group").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__key")).alias("least")).select(F.col("least.__id").alias("_i"), F.col("least.__key").alias("_k"))
    found = rows.join(kept, F.col("__id").eqNullSafe(F.col("_i")) & (F.col("__key") == F.col("_k")), "left")
    found = checkpointed(found.select("__id", "__key", "n", F.col("_k").isNotNull().alias("stays")))

    def small(ids):
        return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids

    same = F.col(id_col).eqNullSafe(F.col("__id")) & (key == F.col("__key"))
    apart = found.where("not stays or n > 1").select("__id", "__key")
    once = docs.join(small(apart), same, "left_anti")
    repeated = found.where("stays and n > 1").select("__id", "__key")
    if repeated.isEmpty():
        return once
    again = docs.join(small(repeated), same, "left_semi")
    first = Window.partitionBy(F.col(id_col), key).orderBy(F.length(text_col), text_col)
    return once.unionByName(again.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth"))
