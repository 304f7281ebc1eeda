"""Word spans (de Bruijn), byte spans (suffix arrays) and the Jaccard join against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spanfinder.llm import arrays as A
from spanfinder.llm import debruijn, induced_suffix, jaccard_tiles
from spanfinder.llm.components import components


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def word_repeats(rows, k):
    first = {}
    at = [(2**63 if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in at:
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, (i, j)), (i, j))
    out = []
    for i, w in at:
        dead = set()
        for j in range(len(w) - k + 1):
            f = first[tuple(w[j : j + k])]
            own = min(x for x in range(len(w) - k + 1) if w[x : x + k] == w[j : j + k])
            if f[0] < i or own < j:  # rows that share an id do not remove each other's words
                dead.update(range(j, j + k))
        out.append((None if i == 2**63 else i, len(w), len(dead), b" ".join(x for j, x in enumerate(w) if j not in dead).decode()))
    return out


@pytest.mark.parametrize("k,m", [(20, 8), (6, 3)])
def test_words(docs, rows, k, m):
    small = [r for r in rows if r[0] != 405 and r[0] != 407]
    got = debruijn.remove_repeats(docs.where("doc_id IS NULL OR doc_id NOT IN (405, 407)"), k=k, m=m).select("doc_id", "n_words", "n_removed", "rest").collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows(word_repeats(small, k))


def test_word_spans_name_their_source(docs):
    got = {r["doc_id"]: r for r in debruijn.remove_repeats(docs).collect()}
    assert got[103]["spans"] and {s["source"] for s in got[103]["spans"]} == {3} or got[103]["n_words"] < 20
    assert got[405]["n_words"] == 900 and got[405]["n_removed"] == 899  # every window but the first starts earlier as well
    assert got[407]["n_removed"] == 0


def byte_repeats(rows, size):
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[j : j + size] for j in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        dead = np.zeros(len(b) + 1, int)
        for j in range(len(b) - size + 1):
            if seen[b[j : j + size]] > 1:
                dead[j] += 1
                dead[j + size] -= 1
        d = np.cumsum(dead)[:-1] > 0
        spans = int((np.diff(np.r_[False, d].astype(int)) == 1).sum())
        out.append((i, len(b), int(d.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~d])))
    return out


@pytest.mark.parametrize("size,gram", [(400, 32), (60, 8)])
def test_bytes(docs, rows, size, gram):
    got = induced_suffix.remove_repeats(docs, size=size, gram=gram, most=500).collect()
    assert sorted_rows((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["rest"])) for r in got) == sorted_rows(byte_repeats(rows, size))


def test_bytes_of_a_hot_minimizer(spark, monkeypatch):
    """Passages shorter and longer than a window, each with other neighbours in every text: no sort has all of their pieces."""
    rng, size, gram, bound = random.Random(11), 60, 8, 4000
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    short, long_ = noise(52), noise(95)
    rows = [(i, noise(150) + (short if i % 2 else long_) + noise(150)) for i in range(160)]
    rows += [(200 + i, noise(90) + rows[i][1][120:230] + noise(90)) for i in range(0, 40, 7)]
    sort = induced_suffix._sort_shards

    def bounded(size, most):
        def run(batches):
            def seen():
                held = {}
                for batch in batches:
                    for h, s, piece in zip(*(batch[c].to_pylist() for c in ("h", "s", "piece")), strict=True):
                        held.setdefault(h, {})[s] = len(piece)
                        assert sum(held[h].values()) <= bound
                    yield batch

            yield from sort(size, most)(seen())

        return run

    monkeypatch.setattr(induced_suffix, "SHARD_BYTES", bound)
    monkeypatch.setattr(induced_suffix, "_sort_shards", bounded)
    got = induced_suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=size, gram=gram).collect()
    assert sorted_rows((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["rest"])) for r in got) == sorted_rows(byte_repeats(rows, size))


@pytest.mark.parametrize("most", [3, 1 << 20])
def test_suffix_array(most):
    rng = np.random.default_rng(5)
    for t in range(120):
        x = rng.integers(1, rng.integers(2, 6), rng.integers(1, 70))
        x = np.r_[np.tile(x, 3) if t % 3 == 0 else x, 0]
        want = sorted(range(len(x) - 1), key=lambda i: tuple(x[i:]))[::-1]
        parts = list(induced_suffix.suffix_array(x, most))
        assert np.concatenate([p for p, _ in parts]).tolist() == want
        common = np.concatenate([c for _, c in parts]).tolist()
        for a, b, c in zip(want, want[1:], common[1:], strict=False):
            n = min(len(x) - a, len(x) - b)
            same = np.cumprod(x[a : a + n] == x[b : b + n]).sum()
            assert c == same


def jaccard(rows, k, num, den):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = (t or "").encode().translate(low).split()
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        least[find(a)].append(i)
    return [(i, len(x), min((j for j in least[find(a)] if j is not None), default=None)) for a, (i, x) in enumerate(sets)]


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100), (2, 60, 100)])
def test_jaccard(docs, rows, k, num, den):
    got = jaccard_tiles.join(docs, words=k, num=num, den=den).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows(jaccard(rows, k, num, den))


def test_jaccard_in_crowded_tiles(spark, monkeypatch):
    """A group of near copies larger than a tile, in which many pairs are not linked, loses no link."""
    monkeypatch.setattr(jaccard_tiles, "TILE", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        own = list(base)
        for at in rng.sample(range(60), rng.choice([0, 1, 1, 2, 2, 3])):
            own[at] = f"v{rng.randrange(200)}"
        rows.append((i, " ".join(own)))
    got = jaccard_tiles.join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows(jaccard(rows, 3, 90, 100))


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 6), (6, 3)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 1 for n in (1, 2, 3, 6, 7, 8)} | {4: 4, 5: 4} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(none):
    assert debruijn.remove_repeats(none).count() == 0
    assert induced_suffix.remove_repeats(none).count() == 0
    assert jaccard_tiles.join(none).count() == 0


def test_arrays():
    data, off = A.texts(pa.array(["a b", None, "", "c\x0bd  é"]))
    start, end, woff = A.words(data, off)
    assert [bytes(data[a:b]) for a, b in zip(start, end, strict=True)] == [b"a", b"b", b"c", b"d", "é".encode()]
    assert woff.tolist() == [0, 2, 2, 2, 5]
    h = A.word_hash(data, start, end)
    assert len(set(h.tolist())) == 5
    key = np.array([5, 3, 4, 3, 9, 1], np.uint64) << np.uint64(30)
    assert A.minimizers(key, 3).tolist() == [1, 1, 3, 5]
    assert [x.tolist() for *_, x in A.blocks(pa.array(["ab", "c", None, "defg"]), 3)] == [[0, 2, 3, 3], [0, 4]]
