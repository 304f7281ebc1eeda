"""What the query of op7 tells of passages of more than 50 words that several documents have."""

import hashlib
import random

from spanfinder.llm.queries import QUERIES


def test_passages_of_400_bytes_are_told_by_n_removed(spark, tmp_path):
    rng = random.Random(23)
    words = lambda n: " ".join(rng.choice("abcdefgh") + f"{rng.randrange(10**5):05d}" for _ in range(n))
    long_ = words(58)[:399] + "."  # 58 words, 400 bytes
    short = words(57)[:398] + "."  # 57 words, 399 bytes
    assert len(long_) == 400 and len(short) == 399 and min(len(long_.split()), len(short.split())) > 50
    apart = ["<{}", "[{}", "({}", "{{{}"]  # neighbours that differ
    ends = [">", "]", ")", "}"]
    around = [(words(40), words(30)) for _ in range(12)]
    texts = [a + apart[i % 4].format([long_, short, ""][i // 4]) + ends[i % 4] + b for i, (a, b) in enumerate(around)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op7_induced_suffixes"](spark, str(tmp_path))
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rests = [t.replace(long_, "") for t in texts]
    want = [(i, len(t), len(t) - len(r), int(r != t), hashlib.sha256(r.encode()).hexdigest()) for i, (t, r) in enumerate(zip(texts, rests, strict=True))]
    assert sorted(tuple(r)[:5] for r in got.collect()) == want
    assert [n for _, _, n, _, _ in want] == [400] * 4 + [0] * 8
