"""Steps whose cost a chunk, a segment or a batch was too high at size."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spanfinder.catalog import bindings as B
from spanfinder.operators import lexical as lx
from spanfinder.plans import keyphrases as kp
from spanfinder.plans import proposals as pr
from spanfinder.streaming import jobs as st


class _Held:
    """State of one video that counts how often it is asked."""

    def __init__(self):
        self.kept, self.calls, self.timers = {}, 0, []

    def getMapState(self, name, *_):
        return _Map(self, self.kept.setdefault(name, {}))

    def getValueState(self, name, *_):
        return _Value(self, name)

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Map:
    def __init__(self, held, rows):
        self.held, self.rows = held, rows

    def getValue(self, k):
        self.held.calls += 1
        return self.rows.get(k)

    def containsKey(self, k):
        self.held.calls += 1
        return k in self.rows

    def updateValue(self, k, v):
        self.held.calls += 1
        self.rows[k] = v

    def values(self):
        self.held.calls += len(self.rows)
        return iter(list(self.rows.values()))

    def clear(self):
        self.rows.clear()


class _Value:
    def __init__(self, held, name):
        self.held, self.name = held, name

    def exists(self):
        return self.name in self.held.kept

    def get(self):
        return self.held.kept.get(self.name)

    def update(self, v):
        self.held.kept[self.name] = v

    def clear(self):
        self.held.kept.pop(self.name, None)


class _Clock:
    def getCurrentProcessingTimeInMs(self):
        return 1_000


def test_reports_of_a_batch_cost_a_look_up_a_block():
    held, rng, n = _Held(), np.random.default_rng(3), 5_000
    job = st._Completion(10, 10)
    job.init(held)
    known, told = {}, []
    for step in range(6):
        batch = 700 * (step + 1)
        pdf = pd.DataFrame({"chunk_index": rng.integers(0, n, batch) * 64 - 7, "at_us": rng.integers(0, 50, batch), "turn": rng.integers(0, 3, batch)})
        if step == 5:  # at last every chunk has ended
            pdf = pd.DataFrame({"chunk_index": np.arange(n) * 64 - 7, "at_us": 60, "turn": np.where(np.arange(n) % 9, 2, 1)})
        pdf["status"] = pdf["turn"].map({0: "pending", 1: "failed", 2: "done"})
        pdf["chunk_count"] = n
        held.calls = 0
        told += [tuple(r) for d in job.handleInputRows(("v",), iter([pdf[:300], pdf[300:]]), _Clock()) for r in d.itertuples(index=False)]
        assert held.calls <= 150  # thousands when each chunk was asked for
        for c, at, turn in pdf[["chunk_index", "at_us", "turn"]].itertuples(index=False):
            known[c] = max(known.get(c, (-1, 0)), (at, turn))
        turns = [t for _, t in known.values()]
        assert tuple(held.kept["sums"][:3]) == (turns.count(2), turns.count(1), len(known))
    assert told == [("v", "failed", sum(i % 9 == 0 for i in range(n)), n)]
    assert len(held.timers) == 1


def _read_counted(spark, rows):
    """The rows, and how many of them were made so far."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    return rows.mapInPandas(count, rows.schema), made


class _Model:
    """An encoder that is no hash, as a model would be."""

    key, dim = "lengths", 2

    def add(self, df, text, out):
        return df.withColumn(out, F.array(F.length(text).cast("double"), F.lit(1.0)))


def test_candidates_are_counted_once(spark):
    texts = ["gradient descent finds gradient minima", "momentum helps gradient descent", "descent with momentum"]
    cands = spark.createDataFrame([(k, r, p) for k in (1, 2) for r, p in enumerate(["gradient descent", "gradient", "momentum", "a"], 1)], "k long, rank int, phrase string")
    for enc in (kp.HashingEncoder(), _Model()):
        docs = enc.add(spark.createDataFrame([(i, t) for i, t in enumerate(texts[:2], 1)], "k long, text string"), "text", "vector").select("k", "vector")
        counted, made = _read_counted(spark, cands)
        got = kp.rank_phrases(counted, docs, ["k"], enc, 2).collect()
        assert made.value == 8  # 16 when they were read for the vectors and again for the list
        assert sorted(r["k"] for r in got) == [1, 2] and all(len(set(r["keyphrases"])) == 2 for r in got)


def test_spoken_halves_are_joined_once(spark):
    rows = [(1, w, w * 60.0, w * 60.0 + 60, f"gradient descent number{w} finds minima of smooth functions with steps of chosen length every time") for w in range(6)]
    windows, made = _read_counted(spark, spark.createDataFrame(rows, "video long, window long, start_s double, end_s double, speech_text string"))
    got = pr.semantic_proposals(windows).collect()
    assert sorted(r["id"] for r in got) == ["1.wsemantic0.semantic", "1.wsemantic1.semantic"]
    assert made.value <= 24  # the windows are read a few times to number them, all of it three times over before


def test_grams_begin_at_admissible_words_only(spark):
    rows = [(1, ["gradient", "descent", "and", "gradient", "descent", "of", "gradient"], 7), (1, ["gradient", "descent", "momentum"], 1), (2, ["the", "cat", "tree", "tree"], 4), (3, [], 0)]
    d = spark.createDataFrame(rows, "k long, t array<string>, own int")
    got = {(r["k"], r["phrase"]): r["n"] for r in kp.ngram_counts(d, ["k"], F.col("t"), F.col("own")).collect()}
    assert got == {
        (1, "gradient"): 4, (1, "descent"): 2, (1, "gradient descent"): 3, (1, "gradient descent momentum"): 1,
        (1, "descent and gradient"): 1, (2, "tree"): 2, (2, "cat tree"): 1,
    }


def test_foreign_words_are_not_stripped_or_remembered():
    rows = [{"query_id": q, "item": i, "at": at, "width": w, "token": t} for q, i, at, w, t in [(1, 0, 0, 1, "descent"), (2, 0, 0, 1, "descent"), (2, 1, 0, 1, "step"), (3, 0, 0, 2, "big"), (3, 0, 1, 2, "step")]]
    words = lx._Vocabulary(rows, lx.SUFFIXES, None)
    text = "descents descent. steps' other big steps step " + " ".join(f"word{i}ing" for i in range(1000))
    assert words.counts(text).tolist() == [2, 5, 1]
    words = lx._Vocabulary(rows[:3], lx.SUFFIXES, None)
    assert words.counts(text).tolist() == [2, 5] and not words.known  # a thousand words before


def test_items_of_every_length_are_found_without_lambdas(spark):
    docs = spark.createDataFrame([(1, "so the big red fox runs on and on here"), (2, "xbig red fox runsy"), (3, "fox"), (4, None), (5, "")], "doc_id long, text string")
    items = ["big red fox runs on and", "big red fox", "g red fox r", "red fox", "fox", "on and on", "the big red fox runs", "red big fox", None]
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, item string")
    found = B.holds(docs, items)
    want = docs.crossJoin(items).where(F.contains("text", "item")).select("item_id", "doc_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "lambdafunction" not in found._jdf.queryExecution().toString().lower()  # one was run at every word before
