"""Rows without ids, tokenizers that tell cases apart, counts that do not depend on the split, and the pipeline's stages."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from spanfinder.llm import secret_forest, toxicity
from spanfinder.llm.bpe_chunks import encode
from spanfinder.llm.jaccard_tiles import join


def long_text(rng, n=80):
    return [rng.choice("kalo mine turo sabi dego fipu wano".split()) + str(rng.randrange(1000)) for _ in range(n)]


def near(words):
    return words[:40] + ["changed"] + words[41:]


def test_near_copies_without_ids_are_linked(spark):
    rng = random.Random(8)
    a, b, c = (long_text(rng, 200) for _ in range(3))
    rows = [(1, a), (None, near(a)), (None, b), (None, near(b)), (7, c), (9, near(c)), (None, a), (None, near(a))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in join(docs).collect())
    assert got == Counter({(1, 1): 1, (None, 1): 3, (None, None): 2, (7, 7): 1, (9, 7): 1})


def tokenizer_file(place, pre, lower):
    """A byte-level-free BPE over letters with merges that differ for A and a."""
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    letters = sorted(set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789,.?!|:;'-éÉßèÈ"))
    vocab = {c: i for i, c in enumerate(letters)}
    merges = [("l", "l"), ("ll", "o"), ("W", "o"), ("o", ","), ("e", "ll")]
    for x, y in merges:
        vocab[x + y] = len(vocab)
    tok = Tokenizer(models.BPE(vocab=vocab, merges=merges, unk_token=None))
    tok.pre_tokenizer = getattr(pre_tokenizers, pre)()
    if lower:
        tok.normalizer = normalizers.Lowercase()
    path = f"{place}/tokenizer.json"
    tok.save(path)
    return path, tok


@pytest.mark.parametrize("pre,lower", [("WhitespaceSplit", False), ("Whitespace", False), ("WhitespaceSplit", True)])
def test_tokenizers_that_tell_cases_apart(spark, place, pre, lower):
    path, tok = tokenizer_file(place, pre, lower)
    texts = ["Hello, World hello , world", "hello, HELLO Hello. iPhone15 x", "", None, "WORLD! " * 300 + "world! " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in encode(docs, path).collect()}
    assert got == {i: " ".join(map(str, tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}


def test_word_counts_do_not_depend_on_the_split(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(f"word{rng.randrange(300)}" for _ in range(30)) for _ in range(100)]
    want = Counter(w for t in texts for w in set(t.split()))
    monkeypatch.setattr(secret_forest, "COUNTED", 50)
    for size in (100, 7):
        got = Counter()
        for at in range(0, 100, size):
            batches = iter([pa.RecordBatch.from_arrays([pa.array(texts[at : at + size])], ["text"])])
            for out in secret_forest._common(batches):
                for w, n in zip(out["word"].to_pylist(), out["n"].to_pylist(), strict=True):
                    got[w.decode()] += n
        assert got == want


@pytest.fixture(scope="module")
def stages():
    return dict(pytest.importorskip("corpus_pipeline").STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    item = " ".join(f"question{i}" for i in range(30)) + " the answer is forty two of them all"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    a, clean, other = long_text(rng), " ".join(long_text(rng)), " ".join(long_text(rng))
    near_a = " ".join(near(a))
    rows = [(1, " ".join(a)), (2, near_a), (None, near_a), (None, clean), (None, clean), (3, other), (None, f"{other[:200]} {item} {other[200:]}"), (4, None), (None, None), (5, ""), (6, "one two")]
    return root, rows, item


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)
    return df.selectExpr("*", "1 AS key", "2 AS c", "3 AS _at", "4 AS leak") if extra else df


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stage_of_near_copies(spark, stages, folder):
    root, rows, _ = folder
    kept = stages["near_copies"](spark, documents(spark, rows), root)
    want = Counter((i, t) for i, t in set(rows) if (i, t) not in [(2, rows[1][1]), (None, rows[2][1])])
    assert rows_of(kept) == want and kept.columns == [f.split()[0] for f in SCHEMA.split(", ")]


def test_stage_of_the_benchmark_keeps_clean_rows_without_ids(spark, stages, folder):
    root, rows, item = folder
    kept = stages["benchmark"](spark, documents(spark, rows), root)
    assert rows_of(kept) == Counter((i, t) for i, t in rows if item not in (t or ""))


def test_stages_on_an_empty_table(spark, stages, folder):
    for name, stage in stages.items():
        assert stage(spark, documents(spark, []), folder[0]).count() == 0, name


def test_stages_of_toxicity_secrets_and_tokens_keep_clean_rows(spark, stages, folder):
    root, rows, _ = folder
    docs = documents(spark, rows)
    assert rows_of(stages["toxicity"](spark, docs, root)) == Counter(rows)  # without labels nothing is rejected
    assert rows_of(stages["secrets"](spark, docs, root)) == Counter(rows)
    out = stages["bpe"](spark, docs, root)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(i for i, _ in rows)


def test_toxicity_of_a_pair_whose_terms_do_not_go_with_the_label_alone(spark):
    rng = random.Random(9)
    plain = [a + b + c for a in ("ba", "ko", "lu", "me") for b in ("na", "ri", "so") for c in ("", "t", "lo")]
    docs, labels = [], []
    for i in range(3000):
        words = [rng.choice(plain) for _ in range(rng.randrange(25, 60))]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        for w, there in (("grub", a), ("those", b)):
            if there:
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(a == b)))
    got = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("held_out").collect()
    ranks = {r["doc_id"]: r["score"] for r in got}
    good, bad = ([s for i, s in ranks.items() if labels[i][2] == y] for y in (1, 0))
    assert len(good) > 300 and len(bad) > 300
    wins = sum((x > y) + 0.5 * (x == y) for x in good for y in bad)
    assert wins / (len(good) * len(bad)) > 0.9
