import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanfinder.llm import resample as rs
from spanfinder.llm import spelling as sp
from spanfinder.llm import voronoi as vo

# --- resampling towards a target --------------------------------------------------------------

LOWER = {i: i + 32 for i in range(65, 91)}


def features(text, words):
    found = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return found, [" ".join(found[i : i + n]) for n in range(1, words + 1) for i in range(len(found) - n + 1)]


def resampled(rows, target, words=1, buckets=10_000, seed=2024, num=10, den=100, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for texts, to in (([x for _, x in rows], s), (target, t)):
        for text in texts:
            to.update(map(bucket, features(text, words)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets))))
    out = []
    for i, text in rows:
        found, fs = features(text, words)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(found)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[: num * len(able) // den], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("words,num,least", [(1, 10, 20), (3, 55, 2), (2, 100, 0)])
def test_resample_equals_brute_force(spark, docs, rows, words, num, least, monkeypatch):
    monkeypatch.setattr(rs, "PIVOTS", 3)
    monkeypatch.setattr(rs, "RANK_ROWS", 7)
    target = ["Kar lost NETU", None, "", "ré ßendo ka ka"]
    out = rs.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), words=words, num=num, least_words=least)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == resampled(rows, target, words, num=num, least=least)


def test_resample_of_one_text_many_times_and_of_nothing(spark, none):
    rows = [(1, "a b " * 20)] * 300 + [(i, "c d " * 20) for i in range(2, 60)]
    same = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = rs.resample(same, none, carry=["text"]).where("rank IS NOT NULL")
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 36)) and "text" in out.columns
    assert rs.resample(none, same).count() == 0
    assert rs.resample(same, same, num=0).where("rank IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        rs.resample(same.withColumn("rank", F.lit(1)), same, carry=["rank"])


def test_crc32_of_spans_of_any_length():
    data = np.frombuffer(random.Random(1).randbytes(3000), np.uint8)
    spans = [(0, 0), (5, 6), (0, 64), (1, 65), (10, 80), (0, 3000), (7, 7)] + [(i, i + i % 70) for i in range(200)]
    got = rs.crc32_of(data, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in spans]


# --- exact top-k ------------------------------------------------------------------------------


def best(rows, asks, k, scale=64.0):
    usable = [(i, [math.floor(scale * x) for x in v], n) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, n in usable:
        if i is None or not asks(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for j, w, m in usable if m != n))
        out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def vectors(n, width, seed, tight):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    v = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, width)) * tight
    rows = [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate(v)]
    rows[3] = (3, None)
    rows[7] = (7, [None] + rows[7][1][1:])
    rows[10] = (10, [float("nan")] + rows[10][1][1:])
    rows[11] = (11, [float("inf")] + rows[11][1][1:])
    rows[13] = (13, rows[13][1][: width // 2])
    rows[15] = (15, [])
    return rows + [(None, rows[20][1]), (21, rows[21][1]), (20, rows[20][1]), (500, [0.0] * width), (505, rows[5][1])] + [(1000 + i, rows[30][1]) for i in range(40)]


@pytest.mark.parametrize("width,k,tight,block,tile", [(6, 20, 0.05, 8, 50), (3, 5, 1.0, 4, 1 << 15), (16, 3, 0.01, 2048, 64), (2, 400, 0.3, 16, 100)])
def test_top_k_equals_brute_force(spark, monkeypatch, width, k, tight, block, tile):
    monkeypatch.setattr(vo, "CELL_QUERIES", 3)
    monkeypatch.setattr(vo, "STEP", 37)
    rows = vectors(220, width, k, tight)
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], "vec_id long, embedding array<float>, row int, cell string").repartition(3)
    out = vo.top_k(df, F.col("vec_id") % 5 == 0, k, block_queries=block, tile_rows=tile)
    assert sorted((tuple(r) for r in out.select("query_id", "rank", "id", "score").collect()), key=str) == best(rows, lambda i: i % 5 == 0, k)


def test_only_rows_that_a_cell_needs_are_sent(spark):
    """Two far groups: rows of one are not sent to the other's cells."""
    rng = np.random.default_rng(4)
    v = np.concatenate([np.array([50.0, 0]) + rng.normal(size=(200, 2)) * 0.1, np.array([0, 50.0]) + rng.normal(size=(200, 2)) * 0.1])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "row long, v array<double>").withColumn("id", F.col("row"))
    pivots, radius = np.array([[50.0, 0], [0, 50.0]]), np.array([0.5, 0.5])
    floor = vo.floors(df, pivots, radius, 5)
    sent = vo.needed(df, pivots, radius, floor, np.eye(2, dtype=bool))
    assert {r["block"]: r["count"] for r in sent.groupBy("block").count().collect()} == {0: 200, 1: 200}


def test_top_k_without_queries_or_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    unusable = spark.createDataFrame([(0, None)], "vec_id long, embedding array<float>")
    for df, asks in ((empty, "vec_id = 0"), (one, "vec_id = 1"), (one, "vec_id = 0"), (unusable, "vec_id = 0")):
        assert vo.top_k(df, F.expr(asks), 3).count() == 0


# --- spelling variants ------------------------------------------------------------------------


def spelled(rows, every=97, least_letters=5, least_count=3, ratio=2):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least_letters:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) <= 1 and near(a, b):
            by[a].append(b)
            by[b].append(a)
    form = {w: min(by[w], key=lambda x: (-n[x], x)) for w in n if by[w]}
    form = {w: f for w, f in form.items() if n[f] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(by[w]), n.get(form.get(w))) for w in n), key=str)


def variants(seed, n_texts):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÀ×") for _ in range(rng.randint(4, 9))) for _ in range(30)] + ["x" * 60, "y" * 49, "aabbccdd"]
    words = []
    for w in base:
        words.append(w)
        for _ in range(5):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            words.append(w[:at] + ("" if kind == 0 else rng.choice("abcé")) + w[at + (kind != 1) :])
    rows = [(i, " ".join(rng.choice(words if rng.random() < 0.4 else base) + rng.choice(["", "!", "1", "—"]) for _ in range(rng.randint(0, 60)))) for i in range(n_texts)]
    return rows + [(None, base[0] + " " + base[1]), (None, None), (3, ""), (4, "ÀÀÀÀÀÀ Āabcdefā ﬁabcde"), (5, rows[5][1]), (5, rows[5][1]), (6, ("z" * 3000 + " ") * 4)]


@pytest.mark.parametrize("every,least,words_a_pass,longest", [(97, 3, 1 << 24, 48), (3, 1, 200, 48), (1, 2, 100, 6)])
def test_spelling_groups_equal_brute_force(spark, monkeypatch, every, least, words_a_pass, longest):
    monkeypatch.setattr(sp, "LONGEST_SHARD", longest)
    monkeypatch.setattr(sp, "AT_ONCE", 500)
    rows = variants(every, 80)
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    out = sp.group(df, every=every, least_count=least, words_a_pass=words_a_pass)
    assert sorted((tuple(r) for r in out.collect()), key=str) == spelled(rows, every, least_count=least)


def test_spelling_groups_of_the_common_corpus_and_of_nothing(spark, docs, rows, none):
    got = sp.group(docs, least_letters=3, least_count=2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == spelled(rows, least_letters=3, least_count=2)
    assert sp.group(none).count() == 0


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w5"), ("b", "c")]
    got = dict(map(tuple, sp.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {f"w{i}": "w37" for i in range(37)} | {"a": "w37", "b": "c"}
