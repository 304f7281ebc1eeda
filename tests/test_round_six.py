"""Whole results where a cap stood; the on-screen lane's similarities beside plain sets."""

import numpy as np
import pyarrow as pa

from spanfinder.operators import fuzzy
from spanfinder.operators.lexical import _Vocabulary
from spanfinder.plans import keyphrases
from spanfinder.plans.keyphrases import document_ngrams
from spanfinder.plans.search import ocr_lane
from tests.test_round_four import both


def test_all_phrases_of_a_text_are_counted(spark, place):
    names = [f"{a}{b}word" for a in "abcdefghijklmnop" for b in "qrstuvwxyzabcd"]
    texts = [" ".join(names), "the cat saw the cat, the dog saw Straße and it's c++", " ".join(["again"] * 300 + ["once"]), "", "?!", None]
    made, wanted = both(spark, place, "ngram_counts", {"documents": (list(enumerate(texts)), "doc_id long, text string")})
    assert made == wanted
    assert sum(r[0] == 0 for r in made) == 3 * len(names) - 3 and (2, "again", 300) in made


def test_phrases_leave_a_task_in_bounded_parts(spark, monkeypatch):
    made = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: made.append(run) or self, raising=False)
    monkeypatch.setattr(keyphrases, "PHRASES_HELD", 40)
    document_ngrams(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    texts = [" ".join(f"word{chr(97 + i)}{chr(97 + j)}" for j in range(10)) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts)], names=["doc_id", "_text"])
    parts = list(made[0](iter([batch])))
    assert max(map(len, parts)) < 40 + 27 and sum(map(len, parts)) == 20 * 27


def _plain(query, text):
    """Similarity by sets, window by window."""
    asked, held = fuzzy.words(query), fuzzy.words(text)
    wanted = set().union(*map(fuzzy.trigrams, asked))
    width = max(1, min(len(asked) + 1, len(held)))
    windows = [set().union(*map(fuzzy.trigrams, held[i : i + width])) for i in range(max(1, len(held) - width + 1))]
    return max(len(wanted & w) for w in windows) / max(1, len(wanted))


def test_similarities_of_windows_equal_sets(monkeypatch):
    rng = np.random.default_rng(5)
    known = ["alpha", "alphabet", "beta", "better", "gamma", "delta", "l'été", "foo-bar.", "straße", "x_y", "“z”", "...", "ab" * 60, "日本語", "\U0001d54f"]
    say = lambda n: " ".join(rng.choice(known, n))
    queries = [say(int(n)) for n in [0, 1, 2, 3, 5, 8, 14, 15, 16, 17, 31, 32, 40, 70]] + ["?", " ".join(f"{a}{b}c{i}" for i, (a, b) in enumerate(zip("abcdefgh" * 9, "ijklmno" * 9, strict=False)))]
    texts = [say(int(n)) for n in rng.integers(0, 90, 40)] + ["", "...", "a-b." * 40, queries[-1] + " alpha " + queries[-1], say(600)]
    rows = [{"query_id": q, "item": i, "width": 1, "at": 0, "token": t} for q in range(len(queries)) for i, t in enumerate(["alpha", "foo-bar"][: q % 3])]
    rows += [{"query_id": 3, "item": 9, "width": 2, "at": i, "token": t} for i, t in enumerate(["beta", "gamma"])]
    tokens = _Vocabulary(rows, (), None, range(len(queries)))
    wanted = np.array([[_plain(q, t) for q in queries] for t in texts])
    for held, places in ((1 << 16, 1 << 12), (24, 100)):
        monkeypatch.setattr(fuzzy, "WORDS_HELD", held)
        monkeypatch.setattr(fuzzy, "PLACES_HELD", places)
        windows = fuzzy._Windows(queries, tokens)
        for at in (0, 0, 20, 40, 0):
            read, n = windows.read(texts[at : at + 20])
            assert (n == [tokens.counts(t) for t in texts[at : at + 20]]).all()
            assert (windows.similarities(read, np.zeros(n.shape)) == wanted[at : at + 20]).all()
            least = rng.random(n.shape)
            some, true = windows.similarities(read, least), wanted[at : at + 20]
            assert np.where(true >= least, some == true, some < least).all()
            windows.forget()
            assert len(windows.numbers) <= held + 400


def test_on_screen_texts_and_sql_with_strings_of_many_words(spark, place):
    items = ["alpha beta gamma delta", "straße l'été foo-bar x_y alpha", "beta", "Gamma-delta alpha. Beta", "", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"]
    docs = ["alphabet betas gamma", "foo-bar", "l'été straße", items[5] + " " + items[5], "a-b" * 50 + " alpha beta gamma", "?", "", None, "gamma delta " * 30] + [f"word{i} alpha{i} betta" for i in range(70)]
    tables = {"benchmark": ([(i, t) for i, t in enumerate(items)], "item_id long, text string"), "documents": ([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")}
    made, wanted = both(spark, place, "lane_ocr_trigram", tables)
    assert made == wanted and len(made) == 9


def test_a_scope_may_name_queries_without_items(spark):
    plans = spark.createDataFrame([(1, "?!", [], []), (2, "alpha", ["alpha"], [])], "query_id long, ocr_q string, terms array<string>, phrases array<string>")
    segments = spark.createDataFrame([(1, "v", "alpha"), (2, "w", "alpha beta")], "segment_id long, video_id string, ocr_text string")
    scope = spark.createDataFrame([(1, "v"), (2, "w")], "query_id long, video_id string")
    assert [(r["query_id"], r["segment_id"]) for r in ocr_lane(plans, segments, 5, 0.45, scope).collect()] == [(2, 2)]
