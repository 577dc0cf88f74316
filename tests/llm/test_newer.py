"""The prefix trie, toxicity and hard negatives against plain Python."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tackline.llm import negatives, prefixes, queries, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_blocked_negatives"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    frame = queries.QUERIES[name](spark, SF)
    assert rows_of(frame) == sorted(con.execute(f"SELECT {', '.join(frame.columns)} FROM ({queries.ORACLE[name]})").fetchall(), key=repr)


# ---- prefix trie


def brute_trie(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16], r, x))
    own = {c: [z[3:] for z in sorted(v)] for c, v in by.items()}
    nodes = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members, ends, below = nodes.setdefault(tuple(path[:d]), (set(), [], set()))
            members.add(c)
            if d == len(path):
                ends.append(c)
            else:
                below.add(tuple(path[: d + 1]))
    total = {}
    for k in sorted(nodes, key=len, reverse=True):
        members, _, below = nodes[k]
        saved = (len(members) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        total[k] = (int(not below) + sum(total[x][0] for x in below), saved + sum(total[x][1] for x in below))
    return sorted(((min(m), len(k), min(nodes[k[:-1]][0]) if k else None, len(m), len(b), *total[k], hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()) for k, (m, e, b) in nodes.items()), key=repr)


def conversations(seed):
    """Few different turns, a third of all conversations alike, shared beginnings, null and equal turns, negative ids, ids whose base is absent."""
    rng, rows = random.Random(seed), []
    for c in [*range(-25, 130), *range(205, 215)]:
        alike = rng.random() < 0.35
        for t in range(7 if alike else rng.choice([1, 1, 2, 3, 5, 9, 14])):
            text = f"same {t}" if alike else rng.choice(["a b", "c", "", None, " \t x "])
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", None]) if rng.random() < 0.1 else "user", text))
    return rows + [(None, 1, "x", "y")] + rows[:5]


@pytest.mark.parametrize(("seed", "segment", "partitions"), [(1, 3, 5), (2, 2, 40), (3, 512, 17), (4, 512, None)])
def test_trie_equals_brute_force(spark, seed, segment, partitions):
    rows = conversations(seed)
    frame = spark.createDataFrame(rows, TURNS).withColumns({"conv": F.lit("x"), "i": F.lit(1), "key": F.lit(None), "n": F.lit(2), "root": F.lit(3)})
    assert rows_of(prefixes.trie(frame, partitions=partitions, segment=segment, piece=3)) == brute_trie(rows)


def test_trie_of_one_very_long_conversation(spark):
    """One conversation holds most rows: its turns are numbered over many partitions and cut into many segments."""
    rows = [(20, t, "user", f"w{t % 7} x") for t in range(400)] + [(21, t, "user", f"w{t % 7} x") for t in range(399)] + [(23, 0, "user", "w0 x")]
    got = rows_of(prefixes.trie(spark.createDataFrame(rows, TURNS), partitions=9, segment=16))
    assert got == brute_trie(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefixes.trie(empty).count() == 0
    assert prefixes.trie(spark.createDataFrame([(None, 0, "a", "b")], TURNS)).count() == 0


def test_conversations_without_turns_are_members_of_the_root(spark):
    # 11's first turn is replaced by that of conversation 0, which is absent
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = [(c, 5, "user", "only turn")]
    assert rows_of(prefixes.trie(spark.createDataFrame(rows, TURNS))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_runs_agree_however_they_are_cut():
    """Points of shared paths, merged over every cut of the same sorted rows, are those of one run."""
    rng = random.Random(8)
    paths = sorted({bytes(16 * [1]) + b"".join(bytes([rng.randint(0, 1)] * 16) for _ in range(rng.randint(0, 6))) for _ in range(60)})
    rows = [(prefixes.ROOT, 0, k, [3] * (len(k) // 16), rng.randint(1, 4), rng.randint(0, 99), k if rng.random() < 0.5 else None, False, 0, 0, 0) for k in paths]
    plain = lambda ps: sorted((p[2], p[4], p[5], *p[6:13]) for p in ps)
    whole = plain(prefixes.points_of(iter(rows), 0, prefixes.Border()))
    for size in (1, 2, 7, 25):
        cut = [rows[k : k + size] for k in range(0, len(rows), size)]
        border = prefixes.borders([prefixes.summary(((r[0], r[2]) for r in c), k) for k, c in enumerate(cut)])
        points = [p for k, c in enumerate(cut) for p in prefixes.points_of(iter(c), k, border[k])]
        assert plain([p for p in points if not p[13]] + prefixes.merged([p for p in points if p[13]])) == whole


# ---- toxicity

INSULTS = ["trashy", "clownish", "scumlike"]


def labelled(n=700, seed=3):
    rng, rows = random.Random(seed), []
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(600)]
    for k in range(n):
        lang = "en" if k % 3 else "xx"
        words = [rng.choice(vocabulary[:300] if lang == "en" else vocabulary[300:]) for _ in range(rng.randint(20, 120))]
        toxic = k % 6 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(INSULTS) if lang == "en" else "zuwort" + rng.choice("abcdefgh") * 2)
        rows.append((k, " ".join(words), lang, int(toxic)))
    return rows


def test_toxicity_finds_held_out_rows(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").withColumns({"label": F.lit(1), "score": F.lit("x"), "toxic": F.lit(0)})
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 5] + [(9999, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    right = sum((got[r[0]] >= 0.5) == bool(r[3]) for r in held)
    assert right >= 0.95 * len(held)
    toxic = [got[r[0]] for r in held if r[3]]
    assert sum(s >= 0.5 for s in toxic) >= 0.9 * len(toxic)
    # labels, languages and ids are no inputs; repeated rows score alike
    again = toxicity.score(spark.createDataFrame([(1, rows[5][1], "zz"), (1, rows[5][1], None), (None, None, None), (7, "", "en")], "doc_id long, text string, lang string"), model).collect()
    assert [r["score"] for r in again if r["doc_id"] == 1] == [got[5]] * 2 and all(0 <= r["score"] <= 1 for r in again) and len(again) == 4


def test_toxicity_of_long_texts_reads_them_whole(monkeypatch):
    rows = labelled(400)
    model = toxicity.train([r[1] for r in rows], np.array([r[3] for r in rows]), [r[2] for r in rows], np.ones(len(rows)), epochs=2)
    words = " ".join(r[1] for r in rows if not r[3] and r[2] == "en").split()[:5_000]
    assert not toxicity.Scorer(model).scores([" ".join(words)])[0] > 0.9
    for place in (0, 498, 499, 500, 501, 4_999):
        text = " ".join([*words[:place], "scumlike", "trashy", "clownish", *words[place:]])
        whole = toxicity.Scorer(model).pooled([text, "a b", text])
        with monkeypatch.context() as patch:
            patch.setattr(toxicity, "BLOCK_WORDS", 500)
            cut = toxicity.Scorer(model).pooled([text, "a b", text])
        assert np.allclose(whole[0], cut[0], atol=1e-5) and np.allclose(whole[1], cut[1]) and (whole[0][0] == whole[0][2]).all()


def test_filters_slide_as_written_out():
    rows = labelled(60)
    model = toxicity.train([r[1] for r in rows], np.array([r[3] for r in rows]), [r[2] for r in rows], np.ones(len(rows)), epochs=1)
    text = rows[6][1]
    vectors = [model.table[toxicity.buckets(w, toxicity.BITS)].sum(axis=0) for w in toxicity.split(text)]
    want = []
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            c = [(toxicity.COLUMNS.index((width, o))) * toxicity.FILTERS + f for o in range(width)]
            want.append(max(sum(vectors[p + o] @ model.filters[:, c[o]] for o in range(width) if p + o < len(vectors)) for p in range(len(vectors))))
    assert np.allclose(toxicity.Scorer(model).pooled([text])[0][0], want, atol=1e-4)


def test_gradients_are_those_of_the_loss():
    """Each weight's step is Adagrad's on the derivative of the loss, worked out by differences."""
    rows = labelled(12)
    places, texts = {}, []
    for r in rows:
        texts.append(np.array([places.setdefault(w, len(places)) for w in toxicity.split(r[1])]))
    parts, y = np.array([toxicity.buckets(w, 10) for w in places]), np.array([r[3] for r in rows])
    fresh = lambda: toxicity.Learner(10, 1, 0.05)

    def loss(change):
        learner = fresh()
        change(learner)
        return learner.learn(texts, parts, y, np.ones(len(y)))

    stepped = fresh()
    stepped.learn(texts, parts, y, np.ones(len(y)))
    checked = 0
    for name, k in (("out", 3), ("bias", 2), ("filters", 1)):
        before, after = getattr(fresh(), name), getattr(stepped, name)
        for at in list(np.ndindex(before.shape))[:: max(1, before.size // 12)]:
            def change(learner, by, at=at, name=name):
                getattr(learner, name)[at] += by
            slope = (loss(lambda x: change(x, 2e-3)) - loss(lambda x: change(x, -2e-3))) / 4e-3  # noqa: B023
            if abs(slope) > 3e-3:
                assert (after[at] < before[at]) == (slope > 0)
                checked += 1
    assert checked > 5


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """However long a text is, here all toxic ones; and several shards do as one."""
    rows = [r for r in labelled(900) if not r[3]]
    rows += [(1_000 + k, " ".join([rows[k][1], *["vilest"] * 15_000, rows[k + 1][1]]), "en", 1) for k in range(90)]
    assert all(len(r[1]) > 100_000 for r in rows if r[3])
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    for shard_rows in (10_000, 300):
        monkeypatch.setattr(toxicity, "SHARD_ROWS", shard_rows, raising=False)
        model = toxicity.fit(docs, labels, epochs=2)
        assert model is not None
        got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
        assert sum((got[r[0]] >= 0.5) == bool(r[3]) for r in rows) >= 0.98 * len(rows)


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None and toxicity.fit(docs, labels.where("false")) is None
    assert [r["score"] for r in toxicity.score(docs, None).collect()] == [0.0]
    assert toxicity.score(docs.where("false"), None).count() == 0


# ---- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, k=5):
    """Rows that differ in id; vectors as whole numbers."""
    held = sorted({(i, y, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    anchors = {}
    for r in held:
        if r[0] % 100 == 0:
            anchors.setdefault(r[0], r)
    for a, y, v in anchors.values():
        best = {True: {}, False: {}}
        scored = [(sum(p * q for p, q in zip(v, w, strict=True)), i, z == y) for i, z, w in held if i != a and len(w) == len(v)]
        for s, i, same in scored:
            if same:
                best[True][i] = max(s, best[True].get(i, s))
        for p, ps in sorted(best[True].items(), key=lambda x: (-x[1], x[0]))[:5]:
            near = {}
            for s, i, same in scored:
                if not same and 80 * ps <= 100 * s <= 100 * ps:
                    near[i] = max(s, near.get(i, s))
            out += [(a, p, n + 1, i, ps, s) for n, (i, s) in enumerate(sorted(near.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [None, 1_000])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(-100, 800):
        v = centres[rng.integers(0, 6)] + 0.6 * rng.normal(size=8)
        rows.append((i, np.float32(v if i % 3 else centres[0]).tolist(), int(rng.integers(0, 3))))  # a third is one vector: ties
    rows += [(100, [9.0] * 8, None), (None, [1.0] * 8, 1), (200, None, 1), (300, [float("nan")] * 8, 1), (900, [None] * 8, 1), (1000, [], 1), (1100, [1.0, 2.0], 0), (1101, [1.0, 2.5], 0), (1102, [1.0, 1.9], 1)] + rows[:200] + [(400, [0.5] * 8, 0), (5, [0.7] * 8, 2)]
    if block:
        monkeypatch.setattr(negatives, "BLOCK_BYTES", block)
    frame = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({"id": F.lit("x"), "v": F.lit(1), "slot": F.lit(0), "rank": F.lit(1)})
    assert rows_of(negatives.mine(frame, lambda i: i % 100 == 0)) == brute_negatives(rows)


def test_negatives_of_very_large_numbers_are_exact(spark):
    rows = [(0, [3e6, 1.0], 1), (1, [3e6, 1.0], 1), (2, [3e6, 0.99609375], 2), (3, [2.9e6, 5.0], 2), (4, [1e38, 0.0], 1)]
    assert rows_of(negatives.mine(spark.createDataFrame(rows[:4], VECTORS), lambda i: i % 100 == 0)) == brute_negatives(rows[:4])
    assert negatives.mine(spark.createDataFrame(rows, VECTORS), lambda i: i % 100 == 0).count() >= 0


def test_negatives_of_nothing(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)], VECTORS)
    assert negatives.mine(rows.where("false"), lambda i: i % 100 == 0).count() == 0
    assert negatives.mine(rows, lambda i: i % 100 == 7).count() == 0
    assert negatives.mine(rows, lambda i: i % 100 == 0).count() == 0
    assert os.path.isdir(SF)
