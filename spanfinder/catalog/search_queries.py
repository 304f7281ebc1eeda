"""Planning, lanes, fusion and full search on the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions import fixed_values as V
from ..functions.numeric import hamming
from ..functions.text import highlight, passage, terms
from ..operators import fusion as fu
from ..operators.fuzzy import fuzzy_hits
from ..operators.lexical import lexical_lane
from ..operators.topk import best_first, pooled_topk, topk
from ..operators.vector_search import CellIndex, nearest
from ..plans.query_planning import decompose
from ..plans.routing import FixedRouter, HeuristicRouter
from ..plans.search import Corpus, final_scores, head, ocr_lane, plan_queries, search, suppress_hits
from ..session import cut_lineage, shared_dir
from . import bindings as B
from .registry import query

R = 6


def rounded(df: DataFrame, *cols: str, digits: int = R) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


# --- shared SQL ------------------------------------------------------------------------------

QV = """qv AS (SELECT b.item_id AS query_id, b.text, CAST(e.embedding AS DOUBLE[]) AS v
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""
VECS = """vecs AS (SELECT d.doc_id AS segment_id, d.source AS video_id, e.label, CAST(e.embedding AS DOUBLE[]) AS v
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)"""
DENSE = f"""{QV}, {VECS}, dense AS (
  SELECT * FROM (
    SELECT query_id, segment_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS rank
    FROM (SELECT q.query_id, d.segment_id, round(list_cosine_similarity(q.v, d.v), 9) AS score FROM qv q JOIN vecs d ON q.v IS NOT NULL))
  WHERE rank <= 200)"""


def lexical_sql(queries: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    return f"""qterm AS (SELECT DISTINCT query_id, {B.sql_stem('t')} AS token
  FROM (SELECT query_id, unnest({B.sql_terms('text')}) AS t FROM ({queries}))),
dterm AS (SELECT doc_id AS segment_id, {B.sql_stem('t')} AS token, count(*) AS n
  FROM (SELECT doc_id, unnest({B.sql_tokens('text')}) AS t FROM documents) GROUP BY ALL),
lexical AS (
  SELECT * FROM (
    SELECT query_id, segment_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS rank
    FROM (SELECT query_id, segment_id, (0.1e0 * sum(n)) / (0.1e0 * sum(n) + 1) AS score
          FROM qterm JOIN dterm USING (token) GROUP BY ALL))
  WHERE rank <= 200)"""


def nms_sql(ranked: str, window: float = 12, cap: int = 3) -> str:
    """Recursive twin of temporal suppression; `ranked` has pos per (query_id, video_id)."""
    free = f"len(list_filter(n.kept, lambda k: r.start_s < k.e + {window} AND r.end_s > k.s - {window})) = 0 AND len(n.kept) < {cap}"
    item = "{'s': r.start_s, 'e': r.end_s}"
    return f"""nms AS (
  SELECT query_id, video_id, pos, segment_id, start_s, end_s, score, [{{'s': start_s, 'e': end_s}}] AS kept, true AS keep
  FROM {ranked} WHERE pos = 1
  UNION ALL
  SELECT r.query_id, r.video_id, r.pos, r.segment_id, r.start_s, r.end_s, r.score,
         CASE WHEN {free} THEN list_append(n.kept, {item}) ELSE n.kept END, {free}
  FROM nms n JOIN {ranked} r ON r.query_id = n.query_id AND r.video_id = n.video_id AND r.pos = n.pos + 1)"""


def minmax_sql(source: str) -> str:
    return f"""(SELECT query_id, lane, segment_id, rank, score,
   CASE WHEN max(score) OVER p - min(score) OVER p < 1e-9 THEN 1.0::DOUBLE
        ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS norm
   FROM {source} WINDOW p AS (PARTITION BY query_id, lane))"""


BOTH = "(SELECT query_id, 'text' AS lane, segment_id, score, rank FROM dense UNION ALL SELECT query_id, 'lexical', segment_id, score, rank FROM lexical)"


# --- planning --------------------------------------------------------------------------------


@query(
    f"WITH {B.PHRASED} SELECT query_id, array_to_string({B.sql_terms('text')}, '|') AS terms, "
    f"array_to_string(regexp_extract_all(text, {B.sql_text(V.QUOTED)}, 1), '|') AS phrases FROM phrased"
)
def query_terms(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import phrases

    q = B.phrased_queries(spark, sf)
    return q.select("query_id", F.concat_ws("|", terms(F.col("text"))).alias("terms"), F.concat_ws("|", phrases(F.col("text"))).alias("phrases"))


def _t(pattern: str, flags: str = "(?i)") -> str:
    return B.sql_text(flags + pattern)


_CLEAN = f"""c0 AS (SELECT query_id, text,
   trim(regexp_replace(regexp_replace(regexp_replace(text, {B.sql_text(V.QUOTED)}, '\\1', 'g'), {_t(V.LEAD)}, ''), '\\s+', ' ', 'g'), ' .?!,') AS clean FROM phrased)"""
_SPLIT = f"""c1 AS (SELECT *, regexp_matches(clean, {_t(V.SPLIT)}) AS is_split,
   CASE WHEN regexp_matches(clean, {_t(V.SPLIT)}) THEN trim(regexp_replace(clean, {_t(V.SPLIT + '.*$', '(?is)')}, '')) ELSE clean END AS sp,
   CASE WHEN regexp_matches(clean, {_t(V.SPLIT)}) THEN trim(regexp_replace(clean, {_t('^.*?' + V.SPLIT, '(?is)')}, '')) ELSE clean END AS vi FROM c0)"""
_SPOKEN = f"""c2 AS (SELECT *, regexp_matches(sp, {_t(V.SPEAKER)}) AS is_spoken,
   trim(regexp_replace(sp, {_t('^.*?' + V.SPEAKER, '(?is)')}, '')) AS said FROM c1)"""
_VISUAL = """c3 AS (SELECT *, CASE WHEN is_spoken AND length(said) > 0 THEN said ELSE sp END AS sq FROM c2),
c4 AS (SELECT *, CASE WHEN is_spoken AND NOT is_split THEN sq ELSE vi END AS vq FROM c3)"""
_OCR = f"""c5 AS (SELECT *, regexp_matches(clean, {_t(V.OCR_CUES)}) AS is_ocr,
   trim(regexp_replace(regexp_replace(vq, {_t(V.OCR_CUES)}, '', 'g'), {_t(V.LEADING_ARTICLE)}, ''), ' :-') AS bare FROM c4)"""
PLANS = f"""{B.PHRASED}, {_CLEAN}, {_SPLIT}, {_SPOKEN}, {_VISUAL}, {_OCR},
plans AS (SELECT query_id, text,
  CASE WHEN length(sq) > 0 THEN sq ELSE clean END AS speech_q,
  CASE WHEN length(vq) > 0 THEN vq ELSE clean END AS visual_q,
  CASE WHEN is_ocr AND length(bare) > 0 THEN bare WHEN length(vq) > 0 THEN vq ELSE clean END AS ocr_q,
  is_split, is_spoken, is_ocr, regexp_matches(vq, {_t(V.VISUAL_CUES)}) AS is_visual,
  regexp_matches(text, {B.sql_text(V.QUOTED)}) AS is_exact FROM c5)"""


@query(f"""WITH {PLANS} SELECT query_id, speech_q, visual_q, ocr_q,
  array_to_string({B.sql_terms('speech_q')}, '|') AS terms,
  concat_ws('|', CASE WHEN is_split THEN 'split' END, CASE WHEN is_spoken THEN 'speech' END,
    CASE WHEN is_visual THEN 'visual' END, CASE WHEN is_ocr THEN 'ocr' END, CASE WHEN is_exact THEN 'exact' END) AS cues FROM plans""")
def query_decompose(spark: SparkSession, sf: str) -> DataFrame:
    d = decompose(B.phrased_queries(spark, sf))
    return d.select("query_id", "speech_q", "visual_q", "ocr_q", F.concat_ws("|", "terms").alias("terms"), F.concat_ws("|", "cues").alias("cues"))


_LANE_W = {lane: 1.0 if w == 0 else w for lane, w in V.LANE_WEIGHTS.items()}


@query(f"""WITH {PLANS}, f AS (SELECT *, CASE WHEN is_split THEN 1.4 WHEN is_visual AND NOT is_spoken THEN 1.5 ELSE 1.0 END
    * CASE WHEN is_spoken AND NOT is_visual THEN 0.6 ELSE 1.0 END AS vf FROM plans)
  SELECT query_id,
   round(CAST({_LANE_W['text']} * CASE WHEN is_spoken AND NOT is_visual THEN 1.2 ELSE 1.0 END AS DOUBLE), 6) AS w_text,
   round(CAST({_LANE_W['lexical']} * CASE WHEN is_spoken AND NOT is_visual THEN 1.1 ELSE 1.0 END * CASE WHEN is_exact THEN 1.5 ELSE 1.0 END AS DOUBLE), 6) AS w_lexical,
   round(CAST({_LANE_W['visual']} * vf AS DOUBLE), 6) AS w_visual, round(CAST({_LANE_W['caption']} * vf AS DOUBLE), 6) AS w_caption,
   round(CAST({_LANE_W['temporal']} * vf AS DOUBLE), 6) AS w_temporal,
   round(CAST({_LANE_W['ocr']} * CASE WHEN is_split THEN 1.3 ELSE 1.0 END * CASE WHEN is_ocr THEN 1.6 ELSE 1.0 END
      * CASE WHEN is_exact THEN 1.3 ELSE 1.0 END AS DOUBLE), 6) AS w_ocr FROM f""")
def route_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    d = HeuristicRouter().route(decompose(B.phrased_queries(spark, sf)), _LANE_W)
    return d.select("query_id", *[F.round(F.try_element_at("weights", F.lit(lane)), 6).alias(f"w_{lane}") for lane in V.LANES])


# --- lanes -----------------------------------------------------------------------------------


def dense(spark: SparkSession, sf: str, k: int = 200, scope: DataFrame | None = None) -> DataFrame:
    return nearest(B.plain_queries(spark, sf), vectors(spark, sf), k, scope=scope)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embedded documents without their texts."""
    emb = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("segment_id"), "embedding", "label")
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("segment_id"), F.col("source").alias("video_id"))
    return emb.join(docs, "segment_id")


def lexical(spark: SparkSession, sf: str, k: int = 200) -> DataFrame:
    q = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), terms(F.col("text")).alias("terms"))
    q = q.withColumn("phrases", F.array().cast("array<string>"))
    docs = B.documents(spark, sf).select(F.col("doc_id").alias("segment_id"), "text")
    return lexical_lane(q, docs, k)


@query(f"WITH {DENSE} SELECT query_id, segment_id, round(score, 6) AS score, rank FROM dense WHERE rank <= 10")
def lane_dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dense(spark, sf, 10), "score").withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {QV}, {VECS} SELECT query_id, segment_id, round(score, 6) AS score, rank FROM (
  SELECT query_id, segment_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS rank
  FROM (SELECT q.query_id, d.segment_id, round(list_cosine_similarity(q.v, d.v), 9) AS score FROM qv q JOIN vecs d
        ON q.v IS NOT NULL AND d.video_id IN ('src' || (q.query_id % 20), 'src' || ((q.query_id * 7 + 3) % 20)))) WHERE rank <= 10""")
def lane_dense_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """Every query sees two videos of its own."""
    q = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    own = lambda n: F.concat(F.lit("src"), n.cast("string"))
    ids = F.array(own(F.col("query_id") % 20), own((F.col("query_id") * 7 + 3) % 20))
    scope = q.select("query_id", F.explode(ids).alias("video_id"))
    return rounded(dense(spark, sf, 10, scope), "score").withColumn("rank", F.col("rank").cast("long"))


CELLS, PROBES, PROBE_COUNTS = 32, 24, (1, 2, 4, 8, 16, 24, 32)

_CELLS = f"""{QV}, {VECS}, usable AS (SELECT * FROM vecs WHERE v IS NOT NULL AND list_inner_product(v, v) > 0),
  centre AS (SELECT cell, v FROM (SELECT row_number() OVER (ORDER BY md5('0:' || segment_id), segment_id) - 1 AS cell, v FROM usable) WHERE cell < {CELLS}),
  placed AS (SELECT segment_id, d.v, arg_min(cell, -1000 * round(list_cosine_similarity(d.v, c.v), 9) + cell / 1e9) AS cell FROM usable d, centre c GROUP BY segment_id, d.v),
  probe AS (SELECT query_id, cell, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, cell) AS place
    FROM qv q, centre c WHERE q.v IS NOT NULL AND list_inner_product(q.v, q.v) > 0)"""


def stored_cells(spark: SparkSession, sf: str) -> CellIndex:
    v = vectors(spark, sf)
    return CellIndex.draw(v, CELLS, "segment_id").write(v, f"{shared_dir(spark).rstrip('/')}/cells-{uuid.uuid4().hex}")


@query(f"""WITH {_CELLS} SELECT query_id, segment_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS rank
  FROM (SELECT q.query_id, d.segment_id, round(list_cosine_similarity(q.v, d.v), 9) AS score
        FROM qv q JOIN probe p ON p.query_id = q.query_id AND p.place <= {PROBES} JOIN placed d ON d.cell = p.cell)) WHERE rank <= 10""")
def lane_dense_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate search: vectors stored by cell, each query visits 24 of 32."""
    hits = stored_cells(spark, sf).search(B.plain_queries(spark, sf), 10, PROBES)
    return rounded(hits, "score").withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_CELLS}, exact AS (SELECT * FROM (SELECT query_id, segment_id, cell, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS rank
    FROM (SELECT q.query_id, d.segment_id, d.cell, round(list_cosine_similarity(q.v, d.v), 9) AS score FROM qv q JOIN placed d ON q.v IS NOT NULL)) WHERE rank <= 10)
  SELECT nprobe, round(avg(CASE WHEN place <= nprobe THEN 1.0e0 ELSE 0 END), 6) AS recall FROM exact JOIN probe USING (query_id, cell), (SELECT unnest({list(PROBE_COUNTS)}) AS nprobe) GROUP BY nprobe""")
def lane_dense_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the exact ten best that a number of probes finds."""
    return rounded(stored_cells(spark, sf).recall(B.plain_queries(spark, sf), 10, PROBE_COUNTS), "recall")


_POOL = f"""WITH {QV}, {VECS}, near AS (SELECT * FROM (SELECT query_id, segment_id, frame, score, start_s,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame) AS r
  FROM (SELECT q.query_id, d.segment_id // 3 AS segment_id, d.segment_id AS frame, (d.segment_id % 3) * 4.0::DOUBLE AS start_s,
               round(list_cosine_similarity(q.v, d.v), 9) AS score FROM qv q JOIN vecs d ON q.v IS NOT NULL)) WHERE r <= 60)"""


@query(f"""{_POOL} SELECT query_id, segment_id, round(score, 6) AS score, rank FROM (SELECT query_id, segment_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS rank
  FROM (SELECT query_id, segment_id, max(score) AS score FROM near GROUP BY ALL)) WHERE rank <= 20""")
def lane_dense_maxpool(spark: SparkSession, sf: str) -> DataFrame:
    """Frames (three per segment) pooled to their segment by the best score."""
    frames = vectors(spark, sf).select(F.col("segment_id").alias("frame_id"), F.floor(F.col("segment_id") / 3).alias("segment_id"), "embedding")
    hits = nearest(B.plain_queries(spark, sf), frames, 60, row_key="frame_id", payload=("segment_id",))
    pooled = pooled_topk(hits.drop("rank"), 20, tie="frame_id")
    return rounded(pooled, "score").withColumn("rank", F.col("rank").cast("long"))


@query(f"""{_POOL} SELECT query_id, segment_id, round(score, 6) AS score, span_start, span_start + 8 AS span_end, rank FROM (
  SELECT query_id, segment_id, score, span_start, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS rank
  FROM (SELECT query_id, segment_id, max(score) AS score, arg_max(start_s, score * 1e6 - start_s / 1e6) AS span_start FROM near GROUP BY ALL)) WHERE rank <= 20""")
def lane_temporal_span(spark: SparkSession, sf: str) -> DataFrame:
    """Windows pooled to their segment, with the span of the best window."""
    windows = vectors(spark, sf).select(
        F.col("segment_id").alias("window_id"),
        F.floor(F.col("segment_id") / 3).alias("segment_id"),
        ((F.col("segment_id") % 3) * 4.0).alias("start_s"),
        ((F.col("segment_id") % 3) * 4.0 + 8.0).alias("end_s"),
        "embedding",
    )
    hits = nearest(B.plain_queries(spark, sf), windows, 60, row_key="window_id", payload=("segment_id", "start_s", "end_s"))
    pooled = pooled_topk(hits.drop("rank"), 20, with_span=True, tie="window_id")
    return rounded(pooled, "score").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {lexical_sql()} SELECT query_id, segment_id, round(score, 6) AS score, rank FROM lexical WHERE rank <= 50")
def lane_lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lexical(spark, sf, 50), "score").withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH pair AS (SELECT query_id, {B.sql_stem('t[3]')} AS a, {B.sql_stem('t[4]')} AS b FROM (SELECT item_id AS query_id, {B.sql_tokens('text')} AS t FROM benchmark) WHERE len(t) >= 4),
 placed AS (SELECT segment_id, pos, {B.sql_stem('t')} AS token FROM (SELECT doc_id AS segment_id, unnest(t) AS t, generate_subscripts(t, 1) AS pos
     FROM (SELECT doc_id, {B.sql_tokens('text')} AS t FROM documents))),
 found AS (SELECT query_id, x.segment_id, count(*) AS n FROM pair JOIN placed x ON x.token = a JOIN placed y ON y.token = b AND y.segment_id = x.segment_id AND y.pos = x.pos + 1 GROUP BY ALL)
 SELECT query_id, segment_id, round(score, 6) AS score, rank FROM (
   SELECT query_id, segment_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS rank
   FROM (SELECT query_id, segment_id, 0.1e0 * n / (0.1e0 * n + 1) AS score FROM found)) WHERE rank <= 50""")
def lane_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """Two adjacent words of every item as an exact phrase."""
    from ..functions.text import term_tokens

    t = term_tokens(F.col("text"))
    q = B.table(spark, sf, "benchmark").filter(F.size(t) >= 4).select(
        F.col("item_id").alias("query_id"),
        F.array().cast("array<string>").alias("terms"),
        F.array(F.concat_ws(" ", F.get(t, F.lit(2)), F.get(t, F.lit(3)))).alias("phrases"),
    )
    docs = B.documents(spark, sf).select(F.col("doc_id").alias("segment_id"), "text")
    return rounded(lexical_lane(q, docs, 50), "score").withColumn("rank", F.col("rank").cast("long"))


_SIMILAR = f"""asked AS (SELECT query_id, lower(ocr_q) AS q, {B.sql_terms('speech_q')} AS t, regexp_extract_all(text, {B.sql_text(V.QUOTED)}, 1) AS p, ocr_q FROM plans WHERE length(trim(ocr_q)) > 0),
  item AS (SELECT DISTINCT query_id, w FROM (SELECT query_id, unnest(list_concat(list_transform(CASE WHEN len(t) = 0 AND len(p) = 0 THEN {B.sql_tokens('ocr_q')} ELSE t END, lambda x: [x]),
      list_filter(list_transform(p, lambda x: {B.sql_tokens('x')}), lambda x: len(x) > 0))) AS w FROM asked)),
  dtok AS (SELECT doc_id AS segment_id, {B.sql_tokens('text')} AS l FROM documents WHERE length(text) > 0),
  placed AS (SELECT segment_id, l, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM dtok),
  exact AS (SELECT query_id, segment_id, 0.1e0 * count(*) / (0.1e0 * count(*) + 1) AS score FROM item JOIN placed ON token = w[1] AND (len(w) = 1 OR l[pos:pos + len(w) - 1] = w) GROUP BY ALL),
  qword AS (SELECT query_id, regexp_extract_all(q, '[\\p{{L}}\\p{{N}}]+') AS w FROM asked),
  qgram AS (SELECT DISTINCT query_id, substr('  ' || x || ' ', i, 3) AS gram FROM (SELECT query_id, unnest(w) AS x FROM qword), LATERAL (SELECT unnest(range(1, length(x) + 2)) AS i)),
  qsize AS (SELECT query_id, len(w) AS width, (SELECT count(*) FROM qgram g WHERE g.query_id = qword.query_id) AS size FROM qword),
  dlist AS (SELECT doc_id AS segment_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE length(text) > 0),
  dword AS (SELECT segment_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM dlist),
  held AS (SELECT DISTINCT word, substr('  ' || word || ' ', i, 3) AS gram FROM (SELECT DISTINCT word FROM dword), LATERAL (SELECT unnest(range(1, length(word) + 2)) AS i)),
  occ AS (SELECT query_id, segment_id, n, pos, coalesce(lag(pos) OVER (PARTITION BY query_id, segment_id, gram ORDER BY pos), 0) AS prev FROM dword JOIN held USING (word) JOIN qgram USING (gram)),
  span AS (SELECT query_id, segment_id, d, pos, n, prev, least(greatest(width + d, 1), n) AS w FROM occ JOIN qsize USING (query_id), (SELECT unnest([-1, 0, 1]) AS d)),
  reach AS (SELECT query_id, segment_id, d, greatest(prev + 1, pos - w + 1) AS lo, least(pos, n - w + 1) AS hi FROM span),
  step AS (SELECT query_id, segment_id, d, place, sum(v) AS v FROM (SELECT query_id, segment_id, d, lo AS place, 1 AS v FROM reach WHERE lo <= hi UNION ALL SELECT query_id, segment_id, d, hi + 1, -1 FROM reach WHERE lo <= hi) GROUP BY ALL),
  best AS (SELECT query_id, segment_id, max(v) AS most FROM (SELECT query_id, segment_id, sum(v) OVER (PARTITION BY query_id, segment_id, d ORDER BY place) AS v FROM step) GROUP BY ALL),
  fuzzy AS (SELECT query_id, segment_id, CAST(most AS DOUBLE) / size AS sim FROM best JOIN qsize USING (query_id)),
  ocr AS (SELECT query_id, segment_id, greatest(coalesce(e.score, 0), coalesce(sim, 0)) AS score FROM exact e FULL JOIN fuzzy USING (query_id, segment_id) WHERE e.score IS NOT NULL OR sim > 0.45)"""


@query(f"""WITH {PLANS}, {_SIMILAR} SELECT query_id, segment_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS rank FROM ocr) WHERE rank <= 50""")
def lane_ocr_trigram(spark: SparkSession, sf: str) -> DataFrame:
    """On-screen text lane: token matches joined with fuzzy matches, the greater score counts."""
    plans = cut_lineage(plan_queries(B.phrased_queries(spark, sf), SearchConfig()))
    seg = B.documents(spark, sf).select(F.col("doc_id").alias("segment_id"), F.col("text").alias("ocr_text"))
    return rounded(ocr_lane(plans, seg, 50, 0.45), "score").withColumn("rank", F.col("rank").cast("long"))


# --- fusion ----------------------------------------------------------------------------------


def both_lanes(spark: SparkSession, sf: str) -> DataFrame:
    return fu.union_lanes([fu.as_lane(dense(spark, sf), "text"), fu.as_lane(lexical(spark, sf), "lexical")])


def fixed_plans(spark: SparkSession, sf: str) -> DataFrame:
    q = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    return FixedRouter().route(q, {"text": 1.0, "lexical": 0.8})


@query(f"""WITH {DENSE}, {lexical_sql()} SELECT query_id, lane, segment_id, rank, round(norm, 6) AS norm FROM {minmax_sql(BOTH)}""")
def lane_minmax(spark: SparkSession, sf: str) -> DataFrame:
    d = fu.lane_minmax(fu.lane_rank(both_lanes(spark, sf)))
    return rounded(d.select("query_id", "lane", "segment_id", F.col("rank").cast("long").alias("rank"), "norm"), "norm")


def _fused_sql(part: str) -> str:
    return f"""WITH {DENSE}, {lexical_sql()}, parts AS (SELECT *, CASE lane WHEN 'text' THEN 1.0e0 ELSE 0.8e0 END AS w FROM {minmax_sql(BOTH)}),
  fused AS (SELECT query_id, segment_id, sum({part}) AS fused, count(*) AS lanes FROM parts GROUP BY ALL)
  SELECT query_id, segment_id, round(fused, 6) AS fused, lanes, count(*) OVER (PARTITION BY query_id) AS total_candidates FROM fused"""


def _fused(spark: SparkSession, sf: str, method: str) -> DataFrame:
    d = fu.fuse(both_lanes(spark, sf), fixed_plans(spark, sf), method)
    return rounded(d.select("query_id", "segment_id", "fused", F.size("ranks").cast("long").alias("lanes"), "total_candidates"), "fused")


@query(_fused_sql("w * norm"))
def fuse_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf, "weighted")


@query(_fused_sql("w / (60 + rank)"))
def fuse_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf, "rrf")


_HEAD = f"""{DENSE}, {lexical_sql()}, {B.SPANS}, parts AS (SELECT *, CASE lane WHEN 'text' THEN 1.0e0 ELSE 0.8e0 END AS w FROM {minmax_sql(BOTH)}),
  fused AS (SELECT query_id, segment_id, sum(w * norm) AS fused, max(CASE WHEN lane = 'text' THEN score END) AS near FROM parts GROUP BY ALL),
  head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, segment_id) AS fr, count(*) OVER (PARTITION BY query_id) AS total FROM fused) WHERE fr <= 40),
  passages AS (SELECT query_id, segment_id, fused, fr, near, total, video_id, start_s, end_s, text AS body FROM head JOIN spans USING (segment_id))"""


@query(f"""WITH {_HEAD} SELECT query_id, segment_id, video_id, round(0.3 * (fused / max(fused) OVER p) + 0.2 * greatest(0,
    CASE WHEN near IS NULL THEN 0 WHEN max(near) OVER p > min(near) OVER p THEN (near - min(near) OVER p) / (max(near) OVER p - min(near) OVER p) ELSE 1 END), 6) AS score
  FROM passages WINDOW p AS (PARTITION BY query_id)""")
def final_score(spark: SparkSession, sf: str) -> DataFrame:
    """Mix of fused and visual evidence (the dense lane plays the visual one), reranker off."""
    cfg = SearchConfig().with_overrides({"rerank": False})
    plans = fixed_plans(spark, sf)
    top = head(fu.fuse(both_lanes(spark, sf), plans, "weighted"), 40)
    renamed = F.map_from_entries(
        F.transform(F.map_entries("signals"), lambda e: F.struct(F.when(e["key"] == "text", "visual").otherwise(e["key"]), e["value"]))
    )
    rows = top.withColumn("signals", renamed).withColumn("weights", F.create_map(F.lit("visual"), F.lit(1.0)))
    rows = rows.join(B.spans_only(spark, sf).select("segment_id", "video_id"), "segment_id")
    return rounded(final_scores(rows, cfg).select("query_id", "segment_id", "video_id", "score"), "score")


@query(f"""WITH RECURSIVE {_HEAD}, ranked AS (SELECT query_id, video_id, segment_id, start_s, end_s, fused AS score,
     row_number() OVER (PARTITION BY query_id, video_id ORDER BY fused DESC, segment_id) AS pos FROM passages), {nms_sql('ranked')}
  SELECT query_id, video_id, segment_id, round(score, 6) AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS rank FROM nms WHERE keep) WHERE rank <= 10""")
def nms_hits(spark: SparkSession, sf: str) -> DataFrame:
    top = head(fu.fuse(both_lanes(spark, sf), fixed_plans(spark, sf), "weighted"), 40)
    rows = top.join(B.spans_only(spark, sf), "segment_id").withColumn("score", F.col("fused"))
    kept = suppress_hits(rows, 12.0, 3, 10)
    return rounded(kept.select("query_id", "video_id", "segment_id", "score", F.col("rank").cast("long").alias("rank")), "score")


@query(f"""WITH RECURSIVE {_HEAD}, words AS (SELECT query_id, list_distinct(list_transform({B.sql_terms('clean')}, lambda t: {B.sql_stem('t')})) AS wanted
     FROM (SELECT item_id AS query_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' .?!,') AS clean FROM benchmark)),
  covered AS (SELECT p.*, len(list_intersect(wanted, list_distinct(list_transform({B.sql_tokens('substring(body, 1, 1500)')}, lambda t: {B.sql_stem('t')})))) / len(wanted)::DOUBLE AS share
     FROM passages p JOIN words USING (query_id)),
  scored AS (SELECT query_id, video_id, segment_id, start_s, end_s, total, CASE WHEN fr <= 30 THEN 0.5 / (1 + exp(-(6 * share - 3))) + 0.3 * fused / max(fused) OVER p
      ELSE 0.9 * 0.3 * fused / max(fused) OVER p END AS score FROM covered WINDOW p AS (PARTITION BY query_id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, segment_id) AS pos FROM scored), {nms_sql('ranked')}
  SELECT query_id, video_id, segment_id, start_s, end_s, round(score, 4) AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id) AS rank FROM nms WHERE keep) WHERE rank <= 10""")
def search_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: batch search with dense and lexical lanes, rerank, suppression and limit."""
    lanes = {lane: 0.0 for lane in V.LANES} | {"text": 1.0, "lexical": 0.8}
    cfg = SearchConfig().with_overrides({"lanes": lanes, "router": "fixed"})
    vec = vectors(spark, sf).withColumnRenamed("embedding", "text_embedding")
    corpus = Corpus(B.segments(spark, sf), vectors=vec)
    hits = search(B.plain_queries(spark, sf), corpus, cfg, limit=10, vectors={"text": "query_vector"}, present=False)
    return hits.select("query_id", "video_id", "segment_id", "start_s", "end_s", "score", F.col("rank").cast("long").alias("rank"))


@query()
def search_all_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """Phrased questions through planner, heuristic router and all six lanes, with signals and snippets."""
    vec = vectors(spark, sf)
    seg = B.segments(spark, sf).join(vec.select("segment_id", F.col("embedding").alias("text_embedding")), "segment_id", "left")
    seg = seg.withColumn("caption_embedding", F.col("text_embedding")).withColumn("ocr_text", F.col("text")).withColumn("caption_text", F.lit(""))
    frames = vec.select(F.col("segment_id").alias("frame_id"), "segment_id", "video_id", F.col("embedding").alias("visual_embedding"))
    windows = vec.join(B.spans_only(spark, sf).drop("video_id"), "segment_id").select(
        F.col("segment_id").alias("window_id"), "segment_id", "video_id", F.lit("temporal").alias("kind"), F.lit("meanpool").alias("model_key"), "start_s", "end_s", "embedding",
    )
    cfg = SearchConfig().with_overrides({"lanes": {"caption": 0.7, "temporal": 0.8}, "models": {"temporal": "local/meanpool"}})
    q = B.phrased_queries(spark, sf).join(B.plain_queries(spark, sf).drop("text"), "query_id")
    names = {lane: "query_vector" for lane in ("text", "visual", "caption", "temporal")}
    hits = search(q, Corpus(seg, frames, windows), cfg, limit=10, vectors=names)
    shown = F.concat_ws("|", F.transform(F.array_sort(F.map_entries("signals")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return hits.select("query_id", "video_id", "segment_id", "start_s", "end_s", "score", "rank", "total_candidates", shown.alias("signals"), "snippet")


_LIMIT = V.PASSAGE_CHARS


@query(f"""SELECT item_id, md5(CASE WHEN item_id % 3 = 0 THEN substring(text || chr(10) || '[on screen] ' || replace(text, chr(10), ' '), 1, {_LIMIT}) ELSE substring(text, 1, {_LIMIT}) END) AS passage FROM benchmark""")
def rerank_passage(spark: SparkSession, sf: str) -> DataFrame:
    d = B.table(spark, sf, "benchmark")
    ocr = F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise("")
    return d.select("item_id", F.md5(passage(F.col("text"), ocr)).alias("passage"))


_CUT = V.SNIPPET_CHARS
_SAFE = "cut"
for _raw, _name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _SAFE = f"replace({_SAFE}, '{_raw}', '{_name}')"


@query(f"""WITH {lexical_sql()}, asked AS (SELECT item_id AS query_id, {B.sql_terms('text')} AS t FROM benchmark),
  pat AS (SELECT query_id, array_to_string(list_transform(list_sort(list_transform(t, lambda x: {{'n': -length(x), 't': x}})), lambda x: '\\Q' || x.t || '\\E'), '|') AS pat FROM asked),
  found AS (SELECT query_id, segment_id, text, pat, regexp_matches(text, '(?i)(?:' || pat || ')') AS hit, greatest(0, length(regexp_extract(text, '(?is)^(.*?)(?:' || pat || ')', 1)) - {_CUT // 3}) AS start
    FROM lexical JOIN pat USING (query_id) JOIN documents d ON d.doc_id = segment_id WHERE rank <= 5),
  cut AS (SELECT query_id, segment_id, pat, CASE WHEN length(text) <= {_CUT} THEN text
      WHEN hit THEN CASE WHEN start > 0 THEN '…' ELSE '' END || substr(text, start + 1, {_CUT}) || CASE WHEN start + {_CUT} < length(text) THEN '…' ELSE '' END
      ELSE substr(text, 1, {_CUT}) || '…' END AS cut FROM found)
  SELECT query_id, segment_id, regexp_replace({_SAFE}, '(?i)(' || pat || ')', '<mark>\\1</mark>', 'g') AS snippet FROM cut""")
def highlight_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets of the five best lexical matches of every query."""
    q = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), terms(F.col("text")).alias("terms"))
    docs = B.documents(spark, sf).select(F.col("doc_id").alias("segment_id"), "text")
    hits = lexical(spark, sf, 5).drop("rank")
    return hits.join(q, "query_id").join(docs, "segment_id").select("query_id", "segment_id", highlight(F.col("text"), F.col("terms")).alias("snippet"))


_BITS = " + ".join(f"bit_count(xor(CAST('0x' || substr(a, {i}, 8) AS BIGINT), CAST('0x' || substr(b, {i}, 8) AS BIGINT)))" for i in (1, 9))


@query(f"""SELECT event_id, CAST({_BITS} AS BIGINT) AS bits FROM (
  SELECT event_id, substr(md5(CAST(event_id AS VARCHAR)), 1, 16) AS a, substr(md5(CAST(user_id AS VARCHAR)), 1, 16) AS b FROM events)""")
def phash_hamming(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events")
    a = F.substring(F.md5(F.col("event_id").cast("string")), 1, 16)
    b = F.substring(F.md5(F.col("user_id").cast("string")), 1, 16)
    return e.select("event_id", hamming(a, b).cast("long").alias("bits"))
