"""Prefix trie of conversations, built as a Patricia trie.

A turn becomes the hash of its role and text; texts go no further. Turns are numbered
along sorted partitions, conversations are rebuilt from those numbers, and equal ones
are counted together. The different ones are sorted, and each task reads its own run of
them once, with a stack of the open points of the path at hand: a point is where
paths part, where a conversation ends, or a leaf; the turns between two points stay one
edge. A point that is closed has its members, leaves and savings summed from those below.

Points that several runs share lie on the runs' first and last paths. One row a run
tells every run which points those are, their parts are merged afterwards, and there are
at most the length of two paths of them for a run. Nodes inside edges are made last:
members and leaves are those of the point below, savings are sums over the rest of the
edge.

A long conversation is cut into segments of ``SEGMENT`` turns. Segments that follow the same
turns share a root, and such a forest is one sorted table; what lies below the end of a
segment is added up along the segments by doubling, in as many rounds as the logarithm of
the number of segments.

Nothing gathers a key's rows: turns are numbered and ends are hashed over sorted
partitions, where only what crosses their borders is carried on; a third of all rows may be
one conversation, first turn or ending. The SHA-256 of very many ids is taken in their order
by one task, which by its nature cannot be shared, from pieces of joined ids.

Defined cases: null role and text are empty; rows without a conv_id take no part; turns
of equal number come in the order of their hashes; repeated rows are turns of their own; a
null turn number comes first; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tackline.llm.durable import checkpointed, written

#: Turns of a segment, bytes of a turn's hash, and joined ids of a piece.
SEGMENT, HASH, PIECE = 512, 16, 4_096
ROOT = b"\0" * HASH
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_WORD = r"[^\x20\x09-\x0D]+"


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def _short(column) -> F.Column:
    return F.substring(F.unhex(F.sha2(column, 256)), 1, HASH)


def _ranged(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """Sorted by the keys over all partitions, and kept that way."""
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return checkpointed(dealt.sortWithinPartitions(*keys))


# ---- numbered turns and rebuilt conversations


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, key, words): a turn's hash, of role and text told apart by the role's length, and the words of its text."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = _short(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(_WORD)).alias("words")).where("conv is not null")


def numbered(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """(conv, i, key, words): turns of each conversation from 0, over sorted partitions."""
    rows = _ranged(rows, partitions, "conv", "turn", "key")
    of = F.spark_partition_id().alias("p")
    # a row a partition: its first and last conversation, and how many rows of them it holds
    ends = rows.select(of, "conv").groupBy("p").agg(F.min("conv").alias("a"), F.max("conv").alias("z"))
    at = rows.select(of, "conv").join(F.broadcast(ends), "p").groupBy("p", "a", "z").agg(F.count(F.when(F.col("conv") == F.col("a"), 1)).alias("na"), F.count(F.when(F.col("conv") == F.col("z"), 1)).alias("nz"))
    carried, last, n = {}, None, 0
    for r in at.orderBy("p").collect():
        if r["a"] == last:
            carried[r["p"]] = n
        if r["a"] == r["z"] == last:
            n += r["nz"]
        else:
            last, n = r["z"], r["nz"]
    schema = _schema("conv long, i long, key binary, words int")
    arrow = to_arrow_schema(schema)

    def count(batches):
        conv, i = None, carried.get(TaskContext.get().partitionId(), 0) - 1
        for batch in batches:
            numbers = []
            for c in batch.column(0).to_pylist():
                i = i + 1 if conv is None or c == conv else 0
                conv = c
                numbers.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), batch.column(1), batch.column(2)], schema=arrow)

    return written(rows.select("conv", "key", "words").mapInArrow(count, schema))


def rebuilt(own: DataFrame, group: int = 20, variants: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv, d, key, words, turns) of every rebuilt conversation, d from 0, and (conv) of those without a turn.

    Conversation c starts with the first crc32(c) % variants turns of conversation c - c % group.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(variants))
    base = F.col("conv") - F.col("conv") % group
    size = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    heads = own.where((F.col("i") < variants - 1) & (F.col("conv") % group == 0)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("i", "key", "words"))).alias("head")).withColumnRenamed("conv", "base")
    plan = size.withColumn("base", base).join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), h.cast("int")))
    plan = plan.withColumns({"taken": F.size("head").cast("long"), "turns": F.size("head") + F.greatest(F.col("n") - h, F.lit(0))})
    rest = own.where(F.col("i") >= h).join(plan.select("conv", "taken", "turns"), "conv").select("conv", (F.col("i") - h + F.col("taken")).alias("d"), "key", "words", "turns")
    head = plan.select("conv", "turns", F.explode("head").alias("x")).select("conv", F.col("x.i").alias("d"), "x.key", "x.words", "turns")
    return rest.unionByName(head), plan.where("turns = 0").select("conv")


def segments(rows: DataFrame, without: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, s, root, keys, words, last): the segments of every conversation under the hash of all turns before them."""
    part = rows.groupBy("conv", F.expr(f"d div {segment}").alias("s")).agg(F.array_sort(F.collect_list(F.struct("d", "key", "words"))).alias("x"), F.max("turns").alias("turns"))
    part = part.select(
        "conv", "s", F.unhex(F.array_join(F.transform("x", lambda t: F.hex(t["key"])), "")).alias("keys"), F.col("x.words").alias("words"),
        (F.col("turns") <= (F.col("s") + 1) * segment).alias("last"), (F.col("turns") > segment).alias("long"),
    )
    part = written(part.union(without.select("conv", F.lit(0).cast("long"), F.lit(b""), F.array().cast("array<int>"), F.lit(True), F.lit(False))))
    short = part.where("not long").withColumn("root", F.lit(ROOT))
    long = part.where("long")
    schema = _schema("conv long, s long, root binary")
    arrow = to_arrow_schema(schema)

    def chain(batches):
        conv = root = None
        for batch in batches:
            roots = []
            for c, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if c != conv:
                    conv, root = c, ROOT
                roots.append(root)
                root = hashlib.sha256(root + own).digest()[:HASH]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roots, pa.binary())], schema=arrow)

    # a hash for each whole segment, read one after another: no task holds them
    roots = long.select("conv", "s", F.unhex(F.sha2("keys", 256)).alias("own")).repartition("conv").sortWithinPartitions("conv", "s").mapInArrow(chain, schema)
    both = short.unionByName(long.join(roots, ["conv", "s"]).select(short.columns))
    return both.select("conv", "s", "root", "keys", "words", "last")


# ---- the compressed tree over sorted runs

#: A segment that ``on`` conversations go on from is no leaf; what lies below its end is in the last three columns.
_RUN = "root binary, base long, keys binary, words array<int>, n long, conv long, ends binary, on boolean, leaves long, saved long, children long"
#: ``rest`` has, for each turn of the edge from depth ``below``, the words from there to the point; parts of a shared point are known by ``aliases`` too.
_POINT = "id binary, parent binary, root binary, base long, depth int, below int, n long, conv long, leaves long, saved long, children long, ends binary, rest array<long>, shared boolean, aliases array<binary>"


class Run(NamedTuple):
    """What one sorted run tells the others."""

    part: int
    first: tuple[bytes, bytes]
    last: tuple[bytes, bytes]
    #: Depths of points of the first path and of the last one, and the least depth that neighbours share; -1 where roots differ.
    of_first: list[int]
    of_last: list[int]
    least: int


class Border(NamedTuple):
    """How many turns a run's first path shares with the run before, and the depths of points there; the same of its last path and the run after."""

    left: int = -1
    of_left: tuple[int, ...] = ()
    right: int = -1
    of_right: tuple[int, ...] = ()


def shared_turns(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> int:
    """How many turns two paths share; -1 under different roots."""
    if a[0] != b[0]:
        return -1
    x, y = a[1], b[1]
    low, high = 0, min(len(x), len(y)) // HASH
    while low < high:
        mid = (low + high + 1) // 2
        if x[: mid * HASH] == y[: mid * HASH]:
            low = mid
        else:
            high = mid - 1
    return low


def summary(paths, part: int) -> Run | None:
    """Of the (root, keys) of a run, in order."""
    first = last = None
    of_first, of_last, least = [], [], 1 << 30
    for path in paths:
        if last is None:
            first = path
        else:
            x = shared_turns(last, path)
            if x < least:
                if x >= 0:
                    of_first.append(x)
                least = x
            while of_last and of_last[-1] > x:
                of_last.pop()
            if x >= 0 and (not of_last or of_last[-1] < x):
                of_last.append(x)
        last = path
    return Run(part, first, last, of_first, of_last, least) if last is not None else None


def borders(runs: list[Run]) -> dict[int, Border]:
    out = {r.part: Border() for r in runs}
    held: set[int] = set()
    for a, b in zip(runs, runs[1:], strict=False):
        x = shared_turns(a.last, b.first)
        held = {d for d in held if d <= a.least} | set(a.of_last)
        held = {d for d in held if d <= x} | ({x} if x >= 0 else set())
        out[b.part] = out[b.part]._replace(left=x, of_left=tuple(sorted(held)))
    held = set()
    for k in range(len(runs) - 1, 0, -1):
        a, b = runs[k - 1], runs[k]
        x = shared_turns(a.last, b.first)
        held = {d for d in held if d <= b.least} | set(b.of_first)
        held = {d for d in held if d <= x} | ({x} if x >= 0 else set())
        out[a.part] = out[a.part]._replace(right=x, of_right=tuple(sorted(held)))
    return out


class _Open:
    """A point of the path at hand that rows may still come below."""

    __slots__ = ("children", "conv", "depth", "ends", "leaves", "n", "name", "on", "saved")

    def __init__(self, depth: int):
        self.depth, self.n, self.conv, self.leaves, self.saved, self.children, self.ends, self.on, self.name = depth, 0, None, 0, 0, 0, None, False, None

    def take(self, n: int, conv: int | None) -> None:
        self.n += n
        if conv is not None:
            self.conv = conv if self.conv is None else min(self.conv, conv)


def points_of(rows, part: int, border: Border):
    """The points of one run of _RUN rows, as tuples of _POINT.

    A point that other runs share is given with what this run knows of it, and adds nothing to the point above.
    """
    stack: list[_Open] = []
    out, least, made, row = [], 1 << 30, 0, None

    def elsewhere(depth: int) -> bytes:
        """The name of a point that several runs share."""
        return b"s" + hashlib.sha256(row[0] + row[2][: depth * HASH]).digest()

    def close(above: int, ending: bool = False) -> None:
        """Close the points deeper than ``above``, where afterwards a point is open, unless it is -1."""
        nonlocal made
        while stack and stack[-1].depth > above:
            point = stack.pop()
            if above >= 0 and stack[-1].depth < above:
                stack.append(_Open(above))
            over, d = stack[-1] if stack else None, point.depth
            up = over.depth if over else -1
            shared = (d <= least and d <= border.left) or (ending and d <= border.right)
            own, parent, rest, total = point.name, None, [], 0
            for w in reversed(row[3][max(up, 0) : d]):
                total += w
                rest.append(total)
            if shared:
                parent = elsewhere(up) if over else None
            elif over:
                if over.name is None:
                    made += 1
                    over.name = b"o" + part.to_bytes(4, "big") + made.to_bytes(8, "big")
                parent = over.name
                if not point.children and not point.on:
                    point.leaves += 1
                over.take(point.n, point.conv)
                over.leaves += point.leaves
                over.saved += point.saved + (point.n - 1) * total
                over.children += 1
            elif not point.children and not point.on:
                point.leaves += 1
            if own is None or shared:
                made += own is None
                name = elsewhere(d) if shared else b"o" + part.to_bytes(4, "big") + made.to_bytes(8, "big")
            else:
                name = own
            out.append((name, parent, row[0], row[1], d, up, point.n, point.conv, point.leaves, point.saved, point.children, point.ends, rest[::-1], shared, [own] if shared and own else []))

    for new in rows:
        if row is None:
            stack += [_Open(d) for d in sorted({0, *border.of_left})]
        else:
            x = shared_turns((row[0], row[2]), (new[0], new[2]))
            close(x)
            least = min(least, x)
            if x < 0:
                stack.append(_Open(0))
        row = new
        if stack[-1].depth < len(row[2]) // HASH:
            stack.append(_Open(len(row[2]) // HASH))
        point = stack[-1]
        point.take(row[4], row[5])
        point.ends, point.on = row[6], row[7]
        point.leaves, point.saved, point.children = point.leaves + row[8], point.saved + row[9], point.children + row[10]
        yield from out
        out.clear()
    if row is not None:
        for d in sorted(border.of_right, reverse=True):
            close(d, True)
        close(-1, True)
    yield from out


def merged(parts: list[tuple]) -> list[tuple]:
    """Whole points from what runs know of shared ones, the deepest first added to those above."""
    points: dict[bytes, list] = {}
    for r in parts:
        p = points.get(r[0])
        if p is None:
            points[r[0]] = list(r)
            continue
        if (p[1], p[4], p[5]) != (r[1], r[4], r[5]):
            raise ValueError("runs disagree on the edge of a point")
        p[6] += r[6]
        p[7] = min((c for c in (p[7], r[7]) if c is not None), default=None)
        p[8], p[9], p[10], p[11], p[14] = p[8] + r[8], p[9] + r[9], p[10] + r[10], p[11] or r[11], p[14] + r[14]
    for p in sorted(points.values(), key=lambda p: -p[4]):
        if p[1] is not None:
            up = points[p[1]]
            up[6] += p[6]
            up[7] = min((c for c in (p[7], up[7]) if c is not None), default=None)
            up[8] += p[8]
            up[9] += p[9] + (p[6] - 1) * (p[12][0] if p[12] else 0)
            up[10] += 1
    return [tuple(p) for p in points.values()]


def _records(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _rows(batches):
    return (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))


def compressed(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The points of every forest of _RUN rows, no two of which are equal."""
    runs = _ranged(runs, partitions, "root", "keys")
    told = _schema("part int, first_root binary, first binary, last_root binary, last binary, of_first array<int>, of_last array<int>, least int")
    told_arrow, point = to_arrow_schema(told), _schema(_POINT)
    arrow = to_arrow_schema(point)

    def summarise(batches):
        run = summary(_rows(batches), TaskContext.get().partitionId())
        yield _records([(run.part, *run.first, *run.last, run.of_first, run.of_last, run.least)] if run else [], told_arrow)

    # a row a partition
    found = runs.select("root", "keys").mapInArrow(summarise, told).orderBy("part").collect()
    at = borders([Run(r[0], (bytes(r[1]), bytes(r[2])), (bytes(r[3]), bytes(r[4])), r[5], r[6], r[7]) for r in found])

    def build(batches):
        part, held = TaskContext.get().partitionId(), []
        for p in points_of(_rows(batches), part, at.get(part, Border())):
            held.append(p)
            if len(held) == 5_000:
                yield _records(held, arrow)
                held = []
        yield _records(held, arrow)

    def merge(batches):
        yield _records(merged(list(_rows(batches))), arrow)

    points = written(runs.select(_schema(_RUN).names).mapInArrow(build, point))
    # shared points: at most those of two paths a run
    return written(points.where("not shared").union(points.where("shared").coalesce(1).mapInArrow(merge, point)))


def below_roots(points: DataFrame, links: DataFrame) -> DataFrame:
    """(next, leaves, saved, children) of all that lies below each root: forests are added up along the segments that lead to them, by doubling."""
    own = points.where("depth = 0").select("root", "leaves", "saved", "children")
    rows = checkpointed(own.join(links.select(F.col("next").alias("root"), F.col("root").alias("up")), "root", "left"))
    zero = F.lit(0).cast("long")
    while not rows.where("up is not null").isEmpty():
        sent = rows.where("up is not null").groupBy(F.col("up").alias("root")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("v"))
        far = rows.select(F.col("root").alias("up"), F.col("up").alias("upper"))
        rows = rows.join(sent, "root", "left").join(far, "up", "left")
        rows = checkpointed(rows.select("root", (F.col("leaves") + F.coalesce("l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("v", zero)).alias("saved"), "children", F.col("upper").alias("up")))
    return rows.select(F.col("root").alias("next"), "leaves", "saved", "children")


# ---- ends


def ended(rows: DataFrame, partitions: int | None = None, size: int = PIECE) -> DataFrame:
    """(ends, sha): SHA-256 of the joined, ascending ids of each of (ends, conv)."""
    rows = _ranged(rows, partitions, "ends", "conv")
    pieces, done = _schema("ends binary, at long, piece string, sha string"), _schema("ends binary, sha string")
    pieces_arrow, done_arrow = to_arrow_schema(pieces), to_arrow_schema(done)

    def cut(batches):
        """Short ends that lie wholly within a partition give their hash, all others pieces."""
        out, end, ids, whole = [], None, [], False
        for e, c in _rows(batches):
            if e != end or len(ids) == size:
                joined = ",".join(map(str, ids))
                if ids:
                    whole = whole and e != end
                    out.append((end, ids[0], None if whole else joined, hashlib.sha256(joined.encode()).hexdigest() if whole else None))
                # the first end may have begun in another partition, a long one has pieces
                whole, end, ids = end is not None and e != end, e, []
            ids.append(c)
            if len(out) == 2_000:
                yield _records(out, pieces_arrow)
                out = []
        if ids:
            out.append((end, ids[0], ",".join(map(str, ids)), None))
        yield _records(out, pieces_arrow)

    def join(batches):
        out, end, sha = [], None, None
        for e, piece in _rows(batches):
            if e == end:
                sha.update(b"," + piece.encode())
                continue
            if sha:
                out.append((end, sha.hexdigest()))
            end, sha = e, hashlib.sha256(piece.encode())
            if len(out) == 2_000:
                yield _records(out, done_arrow)
                out = []
        yield _records(out + ([(end, sha.hexdigest())] if sha else []), done_arrow)

    found = written(rows.mapInArrow(cut, pieces))
    joined = found.where("piece is not null").repartition("ends").sortWithinPartitions("ends", "at").select("ends", "piece").mapInArrow(join, done)
    return found.where("sha is not null").select("ends", "sha").union(joined)


# ---- the trie


def _nodes(points: DataFrame, runs: DataFrame, shas: DataFrame) -> DataFrame:
    """Every node: each turn of an edge, and the root."""
    top = (F.col("depth") == 0) & (F.col("base") > 0)
    names = lambda df, conv: df.select(F.explode(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<binary>")))).alias("parent"), F.col(conv).alias("over"))
    # the root of later segments is the end of the segment before
    before = runs.where("next is not null").select(F.col("next").alias("root"), F.col("conv").alias("met"))
    over = names(points.where(~top), "conv").union(names(points.where(top).join(before, "root"), "met"))
    points = points.where(~top).join(over, "parent", "left")
    # points without an end all have the null one: they take no part in the join
    sha = points.where("ends is null").withColumn("sha", F.lit(EMPTY_SHA)).unionByName(points.where("ends is not null").join(shas, "ends", "left").select(*points.columns, "sha"))
    n, last = F.col("n"), F.col("k") == F.size("rest") - 1
    inner = sha.select("*", F.posexplode("rest").alias("k", "left")).select(
        F.col("conv").alias("conv_id"), (F.col("base") + F.col("below") + 1 + F.col("k")).alias("depth"), F.when(F.col("k") == 0, F.col("over")).otherwise(F.col("conv")).alias("parent_conv_id"), n.alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (n - 1) * F.col("left")).alias("saved_tokens"), F.when(last, F.col("sha")).otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
    root = sha.where("depth = 0").select(
        F.col("conv").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), n.alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"),
    )
    return inner.union(root)


def trie(
    conversations: DataFrame, group: int = 20, variants: int = 4, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    partitions: int | None = None, segment: int = SEGMENT, piece: int = PIECE,
) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: its smallest member, depth, parent's smallest member, and the counts of its subtree.

    ``partitions`` sets the number of sorted runs; without it Spark chooses. ``segment`` and ``piece`` bound a row.
    """
    rows, without = rebuilt(numbered(turns(conversations, conv_col, turn_col, role_col, text_col), partitions), group, variants)
    cut = segments(rows, without, segment).withColumn("ends", F.when(F.col("last"), _short(F.concat(F.lit(b"end"), F.col("root"), F.unhex(F.sha2("keys", 256))))))
    runs = cut.groupBy("root", "keys").agg(F.max("s").alias("s"), F.min("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.max("ends").alias("ends"), F.max(~F.col("last")).alias("on"))
    follow = F.when(F.col("on"), F.substring(F.unhex(F.sha2(F.concat("root", F.unhex(F.sha2("keys", 256))), 256)), 1, HASH))
    runs = written(runs.select("root", (F.col("s") * segment).alias("base"), "keys", "words", "n", "conv", "ends", "on", follow.alias("next")))
    zero = F.lit(0).cast("long")
    counts = ("leaves", "saved", "children")
    points = compressed(runs.withColumns(dict.fromkeys(counts, zero)), partitions)
    links = runs.where("on").select("next", "root")
    if not links.isEmpty():
        below = below_roots(points, links)
        points = compressed(runs.join(below, "next", "left").withColumns({c: F.coalesce(c, zero) for c in counts}), partitions)
    return _nodes(points, runs, ended(cut.where("last").select("ends", "conv"), partitions, piece))
