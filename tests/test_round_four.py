"""Queries beside their SQL on the letters and blanks that real tables hold; steps whose memory or time grew too fast."""

import duckdb
import numpy as np
import pyarrow as pa

from spanfinder.catalog import ORACLES, QUERIES
from spanfinder.operators import fuzzy, lexical
from spanfinder.plans import search
from spanfinder.plans.keyphrases import document_ngrams
from spanfinder.plans.search import ocr_lane


def both(spark, place, name, tables):
    """Rows of a registered query and of its SQL over small tables, each (rows, DDL schema)."""
    twin = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{place}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        twin.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    made = QUERIES[name](spark, place)
    return sorted(map(tuple, made.collect())), sorted(twin.execute(f"SELECT {', '.join(made.columns)} FROM ({ORACLES[name]})").fetchall())


def test_lines_lose_every_space_around_them_and_meet_without_case(spark, place):
    texts = [" One \none\n　\n two ", "İab\niab\nΑΣ\nασ", "a\rb\nA\rB\n\tc\nc", "", None]
    made, wanted = both(spark, place, "merge_lines", {"documents": (list(enumerate(texts)), "doc_id long, text string")})
    assert made == wanted


def test_titles_meet_by_prefix_whatever_their_letters(spark, place):
    texts = ["x", "Straße ist schmäl und groß, sehr groß und voller Leute", "y", "ᾀ ﬁn ǰ \U0001d54f İstanbul", "z", "ΟΣ ος"]
    made, wanted = both(spark, place, "title_prefix", {"benchmark": (list(enumerate(texts)), "item_id long, text string")})
    assert made == wanted and {(1, 1), (3, 3)} <= set(made)


def test_a_task_remembers_a_bounded_number_of_tokens(monkeypatch):
    monkeypatch.setattr(lexical, "TOKENS_HELD", 8, raising=False)
    words = lexical._Vocabulary([{"query_id": 1, "item": 0, "width": 1, "at": 0, "token": "walk"}], lexical.SUFFIXES, None)
    assert words.counts(" ".join(f"walking w{i} walked" for i in range(100)))[0] == 200
    assert len(words.known) <= 8


def test_ngrams_leave_a_task_a_few_texts_at_a_time(spark, monkeypatch):
    made = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: made.append(run) or self, raising=False)
    document_ngrams(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([f"alpha beta{i}" for i in range(500)])], names=["doc_id", "_text"])
    parts = list(made[0](iter([batch])))
    assert max(len(p) for p in parts) <= 3 * lexical.TEXTS_HELD and sum(len(p) for p in parts) == 1500
    assert sorted(set(r for p in parts for r in p.column(0).to_pylist())) == list(range(500))


def test_the_best_rows_do_not_depend_on_how_batches_are_cut(monkeypatch):
    rng = np.random.default_rng(0)
    scores = rng.integers(0, 6, (300, 4))
    wanted = lexical.Leaders(4, 5)
    wanted.offer(np.arange(300), scores)
    cut = lexical.Leaders(4, 5)
    cut.most = 20
    for at in range(0, 300, 7):
        cut.offer(np.arange(at, min(300, at + 7)), scores[at : at + 7])
    brute = [(q, s, scores[s, q]) for q in range(4) for s in sorted(range(300), key=lambda s: (-scores[s, q], s))[:5]]
    for got in (wanted, cut):
        assert [tuple(r) for r in got.rows()[["q", "segment_id", "score"]].to_numpy()] == brute


def test_the_best_on_screen_texts_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vocabulary = ["alpha", "alphabet", "beta", "better", "gamma", "gamut", "delta", "x", "straße", "strasse"]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    texts = [(i, f"v{i % 3}", say(int(rng.integers(1, 60)))) for i in range(150)] + [(200, "v0", ""), (201, None, "?!"), (202, "v1", "alpha")]
    asked = [(i, say(int(rng.integers(1, 20))), ["alpha"] if i % 3 else [], ["beta gamma"] if i % 2 else []) for i in range(30)] + [(90, "?", ["delta"], [])]
    plans = spark.createDataFrame(asked, "query_id long, ocr_q string, terms array<string>, phrases array<string>")
    segments = spark.createDataFrame(texts, "segment_id long, video_id string, ocr_text string")
    scope = spark.createDataFrame([(q, f"v{v}") for q in range(30) for v in range(3) if (q + v) % 2], "query_id long, video_id string")
    monkeypatch.setattr(fuzzy, "WORDS_HELD", 64)
    for seen in (None, scope):
        found = ocr_lane(plans, segments, 7, 0.45, seen)
        rows = lambda d: sorted((r["query_id"], r["rank"], r["segment_id"], round(r["score"], 9)) for r in d.collect())
        got = rows(found)
        with monkeypatch.context() as m:
            m.setattr(search, "fuzzy_topk", lambda *_: None)  # the way for more items than a task can hold
            assert got == rows(ocr_lane(plans, segments, 7, 0.45, seen)) and len(got) > 100
