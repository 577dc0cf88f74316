"""URL lists, nearest neighbours, and the pipeline as a whole."""

import datetime

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tackline.llm import durable, neighbours, queries, urls
from tests.llm.test_texts import SCHEMA, check_pieces, prose, shingle_groups


def day(text):
    return datetime.date.fromisoformat(text)


def test_url_entries_hold_from_addition_to_removal(spark):
    events = [("l", "Bad.com", "2024-01-01", "add"), ("l", "bad.com", "2024-01-05", "add"), ("l", "bad.com", "2024-02-01", "remove"), ("l", "bad.com", "2024-03-01", "add"), ("m", "x.bad.com", "2024-01-01", "add"), ("l", "gone.org", "2024-01-01", "remove"), ("l", "same.org", "2024-01-02", "add"), ("l", "same.org", "2024-01-02", "remove"), (None, "n.org", "2024-01-01", "add")]
    events = spark.createDataFrame([(a, b, day(c), d) for a, b, c, d in events], "list_name string, domain string, day date, action string")
    cases = [
        ("http://bad.com/x", "2023-12-31", ""), ("http://bad.com/x", "2024-01-01", "l:bad.com"), ("https://u@A.X.BAD.com:80?q", "2024-01-31", "l:bad.com,m:x.bad.com"), ("http://x.bad.com", "2024-02-01", "m:x.bad.com"),
        ("http://bad.com", "2024-03-01", "l:bad.com"), ("http://notbad.com", "2024-03-01", ""), ("http://same.org", "2024-01-03", ""), ("http://gone.org", "2024-05-01", ""), (None, "2024-01-01", ""), ("nonsense", "2024-01-01", ""), ("http://bad.com", None, ""), ("http://bad.com/x", "2024-01-01", "l:bad.com"), ("", "2024-01-01", ""),
    ]
    captures = spark.createDataFrame([(k, u, d and day(d), "mine") for k, (u, d, _) in enumerate(cases)], "page_id long, url string, fetched_on date, host string")
    got = urls.evaluate(captures, events).collect()
    assert len(got) == len(cases)
    for r in got:
        want = cases[r["page_id"]][2]
        assert (r["matched"], r["blocked"], r["n_matches"]) == (want, bool(want), len([x for x in want.split(",") if x]))
    assert urls.evaluate(captures.where("false"), events).count() == 0
    assert urls.evaluate(captures, events.where("false")).where("blocked").count() == 0


def brute_nearest(rows, query, k=5):
    """By exact cosine, ties to the smaller id."""
    v = dict(rows)
    ids = [i for i, _ in rows if i != query]
    x = np.array([v[i] for i in ids], float)
    q = np.array(v[query], float)
    score = x @ q / np.sqrt((x * x).sum(axis=1)) / np.sqrt((q * q).sum())
    order = np.lexsort((ids, -np.round(score, 12)))[:k]
    return [ids[o] for o in order], score[order]


def test_neighbours_recall_scores_and_ties(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 1500)] + 0.5 * rng.normal(size=(1500, 16))
    x[700:1200] = x[700]  # a third is one vector
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    bad = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (None, [1.0] * 16), (5200, [1.0, 2.0]), (5250, [float("inf")] * 16)]
    frame = spark.createDataFrame(rows + bad + rows[:100], "vec_id long, embedding array<float>").withColumnRenamed("vec_id", "id")
    got = neighbours.search(frame, lambda i: i % 50 == 0, id_col="id").toPandas()
    assert sorted(set(got.query_id)) == list(range(0, 1500, 50)) and (got.groupby("query_id").size() == 5).all()
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        ids, score = brute_nearest(rows, q)
        hits += len(set(ids) & set(g.vec_id))
        for i, s in zip(g.vec_id, g.score, strict=True):
            a, b = np.array(rows[q][1]), np.array(rows[i][1])
            assert abs(s - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12
        if 700 <= q < 1200:
            assert list(g.vec_id) == ids
    assert hits >= 0.9 * 5 * 30


def test_neighbours_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], schema)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(few, lambda i: i % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.search(few.where("false"), lambda i: i % 50 == 0).count() == 0


def test_neighbours_of_two_lengths_repeated_ids_and_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8 if k % 3 else 5).tolist()) for k in range(0, 400)]
    frame = spark.createDataFrame(rows + [(7, rng.normal(size=8).tolist()), rows[50]], "vec_id long, embedding array<double>")
    frame = frame.withColumns({"id": F.lit("x"), "v": F.lit(1), "rank": F.lit(2)})
    monkeypatch.setattr(neighbours, "BLOCK_PROBES", 1_000)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 2)
    got = neighbours.search(frame, lambda i: i % 50 == 0).toPandas()
    assert sorted(set(got.query_id)) == list(range(0, 400, 50)) and (got.groupby("query_id").size() == 5).all()
    lengths, hits = {k: len(v) for k, v in rows}, 0
    for q, g in got.groupby("query_id"):
        assert {lengths[i] for i in g.vec_id} == {lengths[q]} and q not in set(g.vec_id) and list(g.sort_values("rank").score) == sorted(g.score, reverse=True)
        ids, _ = brute_nearest([r for r in rows if len(r[1]) == lengths[q] and r[0] != 7], q)
        hits += len(set(ids) & set(g.vec_id))
    assert hits >= 0.9 * 5 * 8


def pipeline_input(spark, folder, n=120):
    import random

    rng = random.Random(21)
    rows, labels = [], []
    for k in range(n):
        good = k % 5 != 0
        text = prose(rng, 160) if good else " ".join(w + "$$$" for w in prose(rng, 120).split())
        if k % 7 == 1:
            text += ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end.'
        rows.append((k, text, "en" if k % 3 else "de", f"s{k % 4}", len(text), 0.5, "x", 7))
        labels.append((k, int(good), 0))
    rows += [(n + k, rows[k][1] if k % 2 else rows[k][1] + " so.", *rows[k][2:]) for k in range(1, 9)] + [(1000, None, None, None, None, None, None, None), (1001, "", "en", "s1", 0, 0.5, "x", 7)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_pipeline_stages_take_effect(spark, tmp_path):
    folder = str(tmp_path)
    pipeline_input(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = [docs]
    for _, stage in corpus_pipeline.STAGES:
        held.append(durable.written(stage(spark, held[-1], folder)))
    assert all(h.columns == docs.columns for h in held[:-1])
    rows = [{r["doc_id"]: r for r in h.collect()} for h in held[:-1]]
    good, one, safe, mixed = rows[1:]
    assert not any("$$$" in (r["text"] or "") for r in good.values())
    assert {k for k, r in rows[0].items() if r["text"] and "$$$" not in r["text"]} <= set(good)
    everything, least = [(k, r["text"]) for k, r in sorted(good.items())], {}
    for (k, _), g in zip(everything, shingle_groups(everything), strict=True):
        least[g] = min(k, least.get(g, k))
    assert set(one) == set(least.values())
    assert set(safe) == set(one) and not any("04dbebab" in (r["text"] or "") for r in safe.values())
    assert all(safe[k]["text"] == one[k]["text"] for k in one if "04dbebab" not in (one[k]["text"] or ""))
    assert set(mixed) <= set(safe) and 0 < len(mixed) and all(mixed[k] == safe[k] for k in mixed)
    check_pieces(held[-1].collect(), [(k, r["text"]) for k, r in mixed.items()])
    assert corpus_pipeline.run(spark, folder).count() == held[-1].count()


def test_pipeline_keeps_no_near_copy(spark):
    import random

    rng = random.Random(33)
    texts, shingles = [], lambda t: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    for _ in range(40):
        words = prose(rng, 150).split()
        texts.append(" ".join(words))
        for at in (20, 75, 130)[: rng.randint(1, 3)]:
            words[at] = "changed"
        texts.append(" ".join(words))
    rows = [(k if k % 10 else None, t, "en", "s", len(t), 0.5, "x", 7) for k, t in enumerate([*texts, texts[0]])]
    got = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert len(got) == 40
    kept = [shingles(r["text"]) for r in got]
    assert all(len(a & b) < 0.8 * len(a | b) for k, a in enumerate(kept) for b in kept[:k])


def test_queries_name_every_operator():
    assert [int(n.split("_")[0][2:]) for n in queries.QUERIES] == list(range(1, 14))
