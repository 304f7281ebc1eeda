import random

import numpy as np
from pyspark.sql import functions as F

from spanfinder.operators import vector_search as vs
from spanfinder.operators.fuzzy import fuzzy_hits, trigrams, words
from spanfinder.operators.lexical import lexical_lane


def brute_similarity(q, t):
    wanted = set().union(*map(trigrams, words(q)))
    n, ws, best = len(words(q)), words(t), 0
    for d in (-1, 0, 1):
        w = min(max(n + d, 1), len(ws))
        for i in range(len(ws) - w + 1):
            best = max(best, len(wanted & set().union(*map(trigrams, ws[i : i + w]))))
    return best / len(wanted)


def test_fuzzy_lane_equals_brute_force(spark):
    random.seed(5)
    parts = "er st ly at the on sh in ti".split()
    word = lambda: "".join(random.choices(parts, k=random.randint(1, 4)))
    texts = [" ".join(word() for _ in range(random.randint(1, 60))) for _ in range(40)]
    asked = [" ".join(word() for _ in range(random.randint(1, 5))) for _ in range(15)]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, ocr_q string")
    t = spark.createDataFrame(list(enumerate(texts)), "segment_id bigint, ocr_text string")
    want = {(i, j): s for i, a in enumerate(asked) for j, b in enumerate(texts) if (s := brute_similarity(a, b)) > 0.45}
    for block in (4096, 4):  # 4: more queries than fit one block
        import spanfinder.operators.fuzzy as fz

        fz.QUERY_BLOCK = block
        got = {(r["query_id"], r["segment_id"]): r["score"] for r in fuzzy_hits(q, t, "ocr_text", 0.45).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    fz.QUERY_BLOCK = 4096


def test_nearest_equals_brute_force_on_every_path(spark):
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(120, 8)), rng.normal(size=(9, 8))
    vec = spark.createDataFrame([(i, f"v{i % 3}", x.tolist()) for i, x in enumerate(v)], "segment_id bigint, video_id string, embedding array<double>")
    ask = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id bigint, query_vector array<double>")
    sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    scope = spark.createDataFrame([(i, f"v{i % 3}") for i in range(9)], "query_id bigint, video_id string")
    for block in (4096, 2):
        vs.QUERY_BLOCK = block
        got = {(r["query_id"], r["rank"]): r["segment_id"] for r in vs.nearest(ask, vec, 5).collect()}
        assert got == {(i, n + 1): int(j) for i in range(9) for n, j in enumerate(np.argsort(-sims[i])[:5])}
        got = {(r["query_id"], r["rank"]): r["segment_id"] for r in vs.nearest(ask, vec, 5, scope=scope).collect()}
        own = {i: [j for j in np.argsort(-sims[i]) if j % 3 == i % 3][:5] for i in range(9)}
        assert got == {(i, n + 1): int(j) for i in own for n, j in enumerate(own[i])}
    vs.QUERY_BLOCK = 4096


def test_lexical_ranks_and_phrases(spark):
    q = spark.createDataFrame([(1, ["cats", "dog"], ["hot dog"])], "query_id bigint, terms array<string>, phrases array<string>")
    d = spark.createDataFrame([(1, "a hot dog and a cat"), (2, "dog hot"), (3, "nothing")], "segment_id bigint, text string")
    rows = lexical_lane(q, d, 10).orderBy("rank").collect()
    assert [r["segment_id"] for r in rows] == [1, 2]
    assert abs(rows[0]["score"] - 0.3 / 1.3) < 1e-12  # cat, dog, "hot dog"


def test_a_batch_equals_single_queries(spark):
    d = spark.createDataFrame([(i, f"word{i % 5} word{i % 7} tail") for i in range(50)], "segment_id bigint, text string")
    q = spark.createDataFrame([(i, [f"word{i}"], []) for i in range(6)], "query_id bigint, terms array<string>, phrases array<string>")
    batch = {(r["query_id"], r["rank"], r["segment_id"]) for r in lexical_lane(q, d.repartition(7), 5).collect()}
    single = set()
    for i in range(6):
        single |= {(r["query_id"], r["rank"], r["segment_id"]) for r in lexical_lane(q.filter(F.col("query_id") == i), d.coalesce(1), 5).collect()}
    assert batch == single


def test_counting_inside_the_row_equals_the_join(spark, monkeypatch):
    from spanfinder.operators import lexical as lx

    rng = random.Random(9)
    vocabulary = [a + b for a in ("walk", "run", "cit", "map", "xy") for b in ("", "s", "ing", "ies", "edly", ".", "'s", "+")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["ÄÖ walk İ", None, ""]
    d = spark.createDataFrame([(i, f"v{i % 4}", t) for i, t in enumerate(texts)], "segment_id bigint, video_id string, text string").repartition(3)
    pick = lambda n: [rng.choice(vocabulary).lower() for _ in range(n)]
    q = spark.createDataFrame([(i, pick(3), [" ".join(pick(2)), " ".join(pick(3))]) for i in range(12)] + [(50, [], [])], "query_id bigint, terms array<string>, phrases array<string>")
    scope = spark.createDataFrame([(i, f"v{(i + j) % 4}") for i in range(10) for j in range(2)], "query_id bigint, video_id string")
    for limit in (None, scope):
        monkeypatch.setattr(lx, "BROADCAST_ROWS", 200_000)
        inside = sorted(map(tuple, lexical_lane(q, d, 7, scope=limit).collect()))
        monkeypatch.setattr(lx, "BROADCAST_ROWS", 1)
        assert inside and inside == sorted(map(tuple, lexical_lane(q, d, 7, scope=limit).collect()))
