"""Models over labelled rows: toxicity, grades, rule forest, secrets; held-out accuracy and hard input."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from spanfinder.llm import ordinal_quality, rule_forest, secret_forest, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    """A text is toxic if it has an insult and names a group; junk has signs at its words' ends."""
    rng = random.Random(4)
    plain = [a + b + c for a in ("ba", "ko", "lu", "me") for b in ("na", "ri", "so") for c in ("", "t", "lo")]
    texts, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(25, 60))]
        toxic = i % 5 == 0
        if toxic or i % 7 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["grub", "Oaf!"]))
        if toxic or i % 11 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["they", "those"]))
        toxic = any(w in ("grub", "Oaf!") for w in words) and any(w in ("they", "those") for w in words)
        junk = i % 8 == 3
        if junk:
            words = [w + rng.choice(["###", "%%%"]) for w in words]
        texts.append((i, " ".join(words)))
        labels.append((i, 0 if junk else 1, int(toxic)))
    texts += [(None, "grub they"), (2000, None), (2001, ""), (2002, "word " * 30_000), (3, texts[3][1])]
    labels += [(None, 1, 1), (5000, 1, 0), (4, 1 - labels[4][1], 1 - labels[4][2]), (6, None, None)]
    return spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS term", "2 AS y"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_pairs(labelled):
    docs, labels = labelled
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] != 4}
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth and r["doc_id"] < 900]
    right = sum((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in held)
    assert right >= 0.9 * len(held)
    kept = Counter((r["doc_id"], r["text"]) for r in toxicity.clean(docs, labels).collect())
    ids = Counter(r["doc_id"] for r in rows if not r["predicted"])
    assert Counter(i for i, _ in kept.elements()) == ids


def test_toxicity_without_labels(labelled, none):
    docs, labels = labelled
    assert {r["predicted"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.score(none, labels).count() == 0


def test_grades(labelled, none):
    docs, labels = labelled
    ratings = labels.selectExpr("doc_id", "CASE WHEN quality = 1 THEN 2 - toxic WHEN quality = 0 THEN 0 END AS grade")
    rows = {r["doc_id"]: r for r in ordinal_quality.rate(docs, ratings).collect()}
    grades = {r["doc_id"]: r["grade"] for r in ratings.collect() if r["grade"] is not None and r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] != 4}
    assert all(r["tails"][0] >= r["tails"][1] for r in rows.values())
    assert sum(rows[i]["kept"] == (g > 0) for i, g in grades.items()) >= 0.98 * len(grades)
    mean = {g: sum(rows[i]["expected_grade"] for i in grades if grades[i] == g) / sum(1 for i in grades if grades[i] == g) for g in (0, 1, 2)}
    assert mean[0] < mean[1] < mean[2]
    assert ordinal_quality.rate(none, ratings).count() == 0
    assert ordinal_quality.rate(docs, ratings.limit(0)).count() == docs.count()


def brute_rules(text):
    w = (text or "").encode().split()
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dups += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    dead = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(dead) > 30 * len(w)
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(dead), failed


def test_rules(docs, rows, labelled, none):
    labels = labelled[1]
    got = rule_forest.judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_rules(t)) for i, t in rows)
    lines = "a b\nc\n\n \na b\na b \nc\n" * 2 + "#|<é>"
    one = docs.sparkSession.createDataFrame([(1, lines)], "doc_id long, text string")
    assert tuple(rule_forest.judge(one, labels).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").first()) == brute_rules(lines)
    assert rule_forest.judge(none, labels).count() == 0


def test_forest_finds_junk(labelled):
    docs, labels = labelled
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] != 4 and r["quality"] is not None}
    rows = {r["doc_id"]: r for r in rule_forest.judge(docs, labels).collect()}
    assert not rows[2000]["kept"] and not rows[2002]["kept"]
    good, junk = ([rows[i]["anomaly"] for i in truth if truth[i] == q] for q in (1, 0))
    assert sum(a > b for a in junk for b in good) >= 0.9 * len(good) * len(junk)
    assert sum(rows[i]["kept"] for i in truth if truth[i] == 1) >= 0.98 * len(good)
    assert sum(rows[i]["kept"] for i in truth if truth[i] == 0) < 0.8 * len(junk)


def test_secrets(spark, none):
    rng = random.Random(6)
    rows = []
    for i in range(200):
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20))
        if i % 2:
            text += f' token = "{rng.randbytes(20).hex()}" omega'
        else:
            text += f" card {rng.randrange(10**15, 10**16)} at www.{rng.choice('abcd')}{i}xyz.example.com"
        rows.append((i, text))
    rows += [(500, None), (501, ""), (None, rows[1][1]), (1, rows[1][1]), (502, "y" * 100_000), (503, "é" * 30 + ' secret: "' + "a1B2c3D4e5F6g7H8" + '"')]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS length", "'y' AS start")
    found = secret_forest.scan(docs)
    true = Counter(r["doc_id"] for r in found.collect() if r["is_secret"])
    assert true == Counter({i: 1 for i in range(3, 200, 2)} | {1: 2, None: 1, 503: 1})
    masked = {(r["doc_id"], r["text"]) for r in secret_forest.redact(docs, found).collect()}
    assert {t for i, t in masked if i == 1} == {re.sub(r'"[0-9a-f]{40}"', f'"{secret_forest.MASK}"', rows[1][1])}
    assert {t for i, t in masked if i == 503} == {"é" * 30 + f' secret: "{secret_forest.MASK}"'}
    assert (500, None) in masked and len(secret_forest.redact(docs, found).collect()) == len(rows)
    assert secret_forest.scan(none).count() == 0


def test_long_and_mixed_case_secrets(spark):
    """A token of 900 bytes is found and masked whole, alone and assigned; a key of letters alone is a candidate."""
    rng = random.Random(16)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    jwt = lambda: "eyJhbGciOiJSUzI1NiJ9." + "".join(rng.choice(signs) for _ in range(878)) + "x"
    rows, tokens, key = [], {}, "qWeRtYuIoPaSdFgHjKlZ"
    for i in range(120):
        words = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20))
        if i % 3 == 2:
            rows.append((i, f"{words} www.{rng.choice('abcd')}{i}xyz.example.com omega"))
            continue
        tokens[i] = jwt()
        rows.append((i, f"{words} {tokens[i]} omega" if i % 3 else f'{words} token = "{tokens[i]}" omega'))
    rows.append((500, f"alpha beta {key} gamma"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secret_forest.scan(docs)
    values = {(r["doc_id"], r["value"]): r["is_secret"] for r in found.collect()}
    assert all(values.get((i, t)) for i, t in tokens.items())
    assert (500, key) in values
    texts = dict(rows)
    masked = {r["doc_id"]: r["text"] for r in secret_forest.redact(docs, found).collect()}
    assert all(masked[i] == texts[i].replace(t, secret_forest.MASK) for i, t in tokens.items())
