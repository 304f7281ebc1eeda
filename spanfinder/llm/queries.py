"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import induced_suffix, secret_forest, warc_bundles
from .bpe_chunks import encode
from .debruijn import remove_repeats
from .decontaminate import find
from .jaccard_tiles import join
from .ordinal_quality import rate
from .rule_forest import judge
from .resample import resample
from .spelling import group
from .tables import read
from .toxicity import score
from .voronoi import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn, sql: str | None = None):
    QUERIES[fn.__name__] = fn
    if sql:
        ORACLES[fn.__name__] = sql
    return fn


@query
def op4_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated spans of 20 words and more, compacted as paths of the de Bruijn graph."""
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("rest", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


@query
def op10_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids and decoded texts of all documents, with chunks that documents share encoded once."""
    import public_tokenizers

    out = encode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and the isolation forest's verdict on all documents."""
    out = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


@query
def op5_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles overlap by 0.9 or more."""
    return join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


@query
def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by the factorization machine."""
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of all documents: 0 low quality, 1 good but toxic, 2 good and clean, as the two labels rate them."""
    ratings = read(spark, sf_dir, "labels").select("doc_id", F.expr("CASE WHEN quality = 1 THEN 2 - toxic WHEN quality = 0 THEN 0 END").alias("grade"))
    out = rate(read(spark, sf_dir, "documents"), ratings)
    return out.select("doc_id", "expected_grade", F.element_at("tails", 1).alias("p_good"), F.element_at("tails", 2).alias("p_clean"), "kept")


@query
def op9_benchmark_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, by BM25 over all passages and verified overlap."""
    return find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC bundles and read back from them."""
    index = warc_bundles.write(read(spark, sf_dir, "pages"))
    return warc_bundles.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query
def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret findings of all documents as the forest judges them; values are given as digests."""
    found = secret_forest.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "by_name", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


@query
def op7_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte strings of 400 and more that repeat anywhere, by suffix arrays of shards."""
    out = induced_suffix.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256"))


@query
def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words and more, drawn towards the benchmark's texts."""
    out = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of every twentieth vector among all others, by inner product."""
    found = top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


query(
    op12_voronoi_topk,
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
)


@query
def op13_spelling_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of all documents with near words, forms and roots."""
    return group(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
