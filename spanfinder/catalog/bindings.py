"""The library's tables, read from the star-schema and text tables every query runs on.

Each view exists twice: as a DataFrame and as SQL text with the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import terms
from ..operators.ordered import running
from ..operators.sizing import BROADCAST_ROWS, at_most, lookup_join

DOC_BLOCK = 65_536


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The texts as they lie; how files are split is the session's business (spark.sql.files.*)."""
    return table(spark, sf, "documents")


# --- segments: one per document, laid end to end per source ---------------------------------


def segments(spark: SparkSession, sf: str, vectors: bool = False) -> DataFrame:
    """Document = segment, source = video, 100 characters = one second of media time."""
    docs = documents(spark, sf).select("doc_id", "lang", "text")
    spans = spans_only(spark, sf)
    seg = docs.select(F.col("doc_id").alias("segment_id"), "text", "lang").join(spans, "segment_id")
    if vectors:
        emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("segment_id"), "embedding", "label")
        seg = seg.join(emb, "segment_id", "left")
    return seg


def spans_only(spark: SparkSession, sf: str) -> DataFrame:
    """segment_id, video_id, start_s, end_s without the texts."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    placed = running(docs, ["source"], ["doc_id"], F.floor(F.col("doc_id") / DOC_BLOCK), "n_chars", "sum", "upto")
    return placed.select(
        F.col("doc_id").alias("segment_id"),
        F.col("source").alias("video_id"),
        ((F.col("upto") - F.col("n_chars")) / 100.0).alias("start_s"),
        (F.col("upto") / 100.0).alias("end_s"),
    )


SPANS = """spans AS (
  SELECT doc_id AS segment_id, source AS video_id,
         CAST(SUM(n_chars) OVER w - n_chars AS DOUBLE) / 100 AS start_s,
         CAST(SUM(n_chars) OVER w AS DOUBLE) / 100 AS end_s,
         text, lang
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))"""


# --- queries --------------------------------------------------------------------------------


def plain_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as queries, with the vector of the same id."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return q.join(emb, "query_id", "left")


def _longest(text: Column) -> Column:
    ordered = F.array_sort(F.transform(terms(text), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(ordered, lambda s: s["t"])


def phrased_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Natural-language questions built around the longest terms of every benchmark item."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("raw_text"))
    t = _longest(F.col("raw_text"))
    a, b, c = (F.coalesce(F.get(t, F.lit(i)), F.lit("x")) for i in range(3))
    kind = F.col("query_id") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("Find where the professor explains "), a, F.lit(" "), b, F.lit(" "), c))
        .when(kind == 1, F.concat(F.lit("when the speaker mentions "), a, F.lit(" while showing an "), b, F.lit(" diagram")))
        .when(kind == 2, F.concat(F.lit("someone holding a "), a, F.lit(" "), b))
        .when(kind == 3, F.concat(F.lit('the slide titled "'), a, F.lit(" "), b, F.lit('"')))
        .when(kind == 4, F.concat(F.lit("find the moment where the "), a, F.lit(" "), b, F.lit(" "), c))
        .otherwise(F.col("raw_text"))
    )
    return q.select("query_id", text.alias("text"))


# --- labels ---------------------------------------------------------------------------------

GRAM, BLOCK_ITEMS = 4, 1_000


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Segments whose text holds a benchmark item verbatim.

    Items meet documents by inner words, at most four in a row, which a surrounding text cannot change; only the few
    pairs that meet are compared as text. Items without inner words are looked for in all texts, a block of them at a time.
    """
    docs = documents(spark, sf)
    pairs = holds(docs.select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item")))
    spans = spans_only(spark, sf).withColumnRenamed("video_id", "video")
    return pairs.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("segment_id")).join(spans, "segment_id")


def holds(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) where `text` holds `item`, of any length."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    items = items.filter(F.col("item").isNotNull()).withColumn("_w", words(F.col("item"))).withColumn("_g", F.least(F.lit(GRAM), F.size("_w") - 2))
    hashed = lambda g: F.xxhash64(*[F.get("_w", F.lit(i + 1)) for i in range(g)])
    gram = F.coalesce(*[F.when(F.col("_g") == g, hashed(g)) for g in range(1, GRAM + 1)])
    keyed = items.filter("_g > 0").select("item_id", "item", "_g", gram.alias("gram"))
    lengths = sorted(r["_g"] for r in keyed.select("_g").distinct().collect())  # at most GRAM numbers
    found = []
    if lengths:
        # a row for every place of a text, with the words that begin there
        at = [f"_{i}" for i in range(lengths[-1])]
        own = docs.select("doc_id", words(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
        places = own.select("doc_id", F.inline(F.arrays_zip(*[F.slice("_w", i + 1, F.size("_w")).alias(c) for i, c in enumerate(at)])).alias(*at))
        grams = F.array(*[F.when(F.col(at[g - 1]).isNotNull(), F.xxhash64(*at[:g])) for g in lengths])
        seen = places.select("doc_id", F.explode(grams).alias("gram")).filter("gram IS NOT NULL")
        small = at_most(keyed, BROADCAST_ROWS)
        met = lookup_join(seen, keyed.select("item_id", "gram"), ["gram"], ["doc_id"], small).select("item_id", "doc_id").distinct()
        texts = docs.join(met, "doc_id").join(keyed.select("item_id", "item"), "item_id")
        found.append(texts.filter(F.contains("text", "item")).select("item_id", "doc_id"))
    short = items.filter("_g <= 0").select("item_id", "item")
    blocks = -(-short.count() // BLOCK_ITEMS)
    for b in range(blocks):
        block = short.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        found.append(docs.join(F.broadcast(block), F.contains("text", "item")).select("item_id", "doc_id"))
    return reduce(DataFrame.unionByName, found) if found else docs.join(items, F.lit(False)).select("item_id", "doc_id")


TRUTH = """truth AS (SELECT b.item_id AS query_id, s.segment_id, s.video_id AS video, s.start_s, s.end_s
  FROM benchmark b JOIN spans s ON contains(s.text, b.text))"""


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- SQL twins of the text expressions -------------------------------------------------------


def sql_tokens(text: str) -> str:
    """Every term occurrence of a text, as `term_tokens`."""
    pattern = sql_text(V.TERM)
    return f"list_transform(regexp_extract_all(lower({text}), {pattern}), lambda t: rtrim(t, '.''-'))"


def sql_terms(text: str) -> str:
    """Distinct terms in first-occurrence order, as `terms`."""
    toks = f"list_filter({sql_tokens(text)}, lambda t: length(t) >= 2 AND NOT list_contains({sql_list(V.QUERY_STOP_WORDS)}, t))"
    return f"list_filter({toks}, lambda t, i: list_position({toks}, t) = i)"


STEM_PATTERN = "^(.{3,}?)(ings|ing|edly|ed|ies|es|ly|s)$"


def sql_stem(token: str) -> str:
    return f"regexp_replace({token}, {sql_text(STEM_PATTERN)}, '\\1')"


PHRASED = f"""longest AS (
  SELECT item_id AS query_id, text,
         list_transform(list_sort(list_transform({sql_terms('text')}, lambda t: {{'n': -length(t), 't': t}})), lambda s: s.t) AS t
  FROM benchmark),
phrased AS (
  SELECT query_id, CASE query_id % 6
    WHEN 0 THEN 'Find where the professor explains ' || a || ' ' || b || ' ' || c
    WHEN 1 THEN 'when the speaker mentions ' || a || ' while showing an ' || b || ' diagram'
    WHEN 2 THEN 'someone holding a ' || a || ' ' || b
    WHEN 3 THEN 'the slide titled "' || a || ' ' || b || '"'
    WHEN 4 THEN 'find the moment where the ' || a || ' ' || b || ' ' || c
    ELSE text END AS text
  FROM (SELECT query_id, text, coalesce(t[1], 'x') AS a, coalesce(t[2], 'x') AS b, coalesce(t[3], 'x') AS c FROM longest))"""
