"""WARC bundles, BPE, the benchmark search and the whole pipeline."""

import base64
import hashlib
import random
from collections import Counter
from functools import cache

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanfinder.llm import bpe_chunks, decontaminate, warc_bundles

from .conftest import passage

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_warc(spark, monkeypatch):
    rng = random.Random(2)
    pages = [(i, f"http://x/{i}", passage(rng, 200)) for i in range(60)]
    pages += [(100 + i, None, pages[i % 3][2]) for i in range(30)] + [(-5, "u v", pages[9][2]), (200, "a", None), (201, "b", ""), (202, "c", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n")]
    pages += [(203, "big", "é" * 400_000), (None, "n", "only here"), (None, "n", pages[20][2]), (7, "http://x/7", pages[7][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS salt", "2 AS sha").repartition(3)
    index = warc_bundles.write(df)
    got = warc_bundles.read(index).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        b, f = (h or "").encode(), first.get(h or "")
        revisit = f is not None and f != i
        want.append((i, len(b), digest(b), "revisit" if revisit else "response", f if revisit else None))
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == Counter(want)
    assert all(bytes(r["payload"]).decode() in {h or "" for _, _, h in pages} for r in got if r["payload"] is not None)
    some = warc_bundles.fetch(index.where("page_id IN (3, 55, 100, 203)")).collect()
    assert {r["page_id"]: r["record_type"] for r in some} == {3: "response", 55: "response", 100: "revisit", 203: "response"}
    assert warc_bundles.read(warc_bundles.write(df.limit(0))).count() == 0
    only_long = {r["page_id"]: r["record_type"] for r in warc_bundles.read(warc_bundles.write(df, min_bytes=1)).collect()}
    assert only_long[200] == only_long[201] == "response" and only_long[100] == "revisit"


@cache
def tokenizer():
    t = Tokenizer.from_file(TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


def expected(text):
    t = tokenizer()
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("size", [1024, 40])
def test_bpe(docs, rows, none, size):
    got = bpe_chunks.encode(docs, TOKENIZER, size=size).collect()
    assert Counter(map(tuple, got)) == Counter((i, *expected(t)) for i, t in rows)
    assert bpe_chunks.encode(none, TOKENIZER).count() == 0


def test_bpe_refuses_other_tokenizers(docs):
    with pytest.raises(ValueError):
        bpe_chunks.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85 'sS"), st.characters(exclude_categories=["Cs"]))))
def test_words_are_encoded_apart(text):
    coder = bpe_chunks.Coder.of(open(TOKENIZER).read())
    words = text.encode().split()
    coder.learn(set(words))
    assert coder.whole(words) == expected(text)


def test_benchmark(spark, none):
    rng = random.Random(9)
    items = [(i, passage(rng, 10 + i)) for i in range(40)]
    items += [(100, None), (101, ""), (None, "x y z"), (102, "solo"), (5, items[5][1])]
    docs = []
    want = set()
    for i in range(120):
        text = passage(rng, rng.choice([0, 30, 300]))
        if i % 3 == 0:
            k = rng.randrange(40)
            text, _ = text + "\n" + items[k][1].upper().replace("RÉ", "Ré").replace("SSE", "ße").replace("Ü", "Ü") + text, want.add((i, k))
        docs.append((i, text))
    docs += [(500, None), (501, ""), (502, "word " * 20_000 + items[30][1]), (None, items[31][1]), (503, " ".join(items[33][1].split()[:15]))]
    want |= {(502, 30), (None, 31)}
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS words").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(frame, bench).collect()}
    assert want <= got and got - want <= {(d, 102) for d, _ in docs}
    assert decontaminate.find(none, bench).count() == 0 and decontaminate.find(frame, bench.limit(0)).count() == 0


def test_benchmark_search_is_exact(spark):
    """Block-max bounds lose no pair that plain BM25 finds."""
    import numpy as np

    rng = np.random.default_rng(1)
    words = rng.integers(1, 1 << 62, 300).astype(np.int64)
    items = [(i, rng.choice(words, rng.integers(5, 40))) for i in range(70)]
    df = Counter(int(w) for _, own in items for w in set(own.tolist()))
    index = decontaminate.Index(items, df, len(items), float(np.mean([len(w) for _, w in items])))
    passages = [np.unique(np.r_[rng.choice(words, 25), items[rng.integers(70)][1][:12]]) for _ in range(200)]
    at, term = zip(*((np.full(len(t), p), t) for p, own in enumerate(passages) for _, t in [index.lookup(own.view(np.uint64))]), strict=True)
    both = np.unique(np.concatenate(at) * len(index.terms) + np.concatenate(term))
    for least in (0.2, 0.35, 0.5):
        p, i, share = index.search(both // len(index.terms), both % len(index.terms), least)
        dense = np.zeros((len(index.terms), len(index.ids)))
        for t in range(len(index.terms)):
            dense[t, index.item[index.first[t] : index.first[t + 1]]] = index.share[index.first[t] : index.first[t + 1]]
        full = np.stack([dense[index.lookup(own.view(np.uint64))[1]].sum(0) for own in passages])
        assert {*zip(p.tolist(), i.tolist(), strict=True)} == {*zip(*(x.tolist() for x in np.nonzero(full >= least - 1e-6)), strict=True)}


def test_short_ways_agree():
    """Words that skip the tokenizer's front part, or are put together from two, have its encoding."""
    rng = random.Random(1)
    signs = "aAzéÉÿŸİıßẞÅǅª̊ſK'.|,!1²½ŉ"
    coder = bpe_chunks.Coder.of(open(TOKENIZER).read())
    assert coder.direct
    words = {"".join(rng.choice(signs) for _ in range(rng.randrange(1, 7))).encode() for _ in range(3000)}
    coder.learn(words)
    assert [w for w in words if coder.said[w] != expected(w.decode())] == []
