"""Query proposals from scanned windows, and their automatic review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import clean_candidate, ocr_fragment, window_key
from ..operators.ordered import null_safe_join, positions
from ..session import cut_lineage

MIN_SPEECH_WORDS = 8
QUIET_WORDS = 5


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > 0)


def _first_line(text: Column, n: int) -> Column:
    return F.substring(F.get(F.split(text, "\n"), F.lit(0)), 1, n)


def propose_queries(windows: DataFrame) -> DataFrame:
    """Up to four proposals per window.

    windows: (video, window, start_s, end_s, speech_text, ocr_text, n_keyframes, phrases array).
    """
    speech, ocr = F.coalesce("speech_text", F.lit("")), F.coalesce("ocr_text", F.lit(""))
    words = _words(speech)
    talks, shows = F.size(words) >= MIN_SPEECH_WORDS, F.length(ocr) > 0
    phrase = F.get("phrases", F.lit(0))
    opening = F.concat(F.lit('[edit] "'), F.array_join(F.slice(words, 1, 12), " "), F.lit('..."'))

    def item(when: Column, kind: str, text: Column, context: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), text.alias("text"), context.alias("context")))

    made = F.array_compact(
        F.array(
            item(
                talks,
                "speech",
                F.coalesce(F.concat(F.lit("[edit] talks about "), phrase), opening),
                F.concat(F.lit("transcript: "), F.substring(speech, 1, 200)),
            ),
            item(
                shows,
                "ocr",
                F.concat(F.lit("[edit] on-screen text mentions "), _first_line(ocr, 60)),
                F.concat(F.lit("ocr: "), F.substring(ocr, 1, 200)),
            ),
            item(
                (F.size(words) < QUIET_WORDS) & (F.col("n_keyframes") >= 2),
                "visual",
                F.lit("[edit] " + V.GENERIC_VISUAL),
                F.concat(F.col("n_keyframes").cast("string"), F.lit(" distinct scene(s) sampled, little or no speech/on-screen text")),
            ),
            item(
                talks & shows,
                "multi",
                F.concat(F.lit("[edit] explains "), F.coalesce(phrase, F.lit("the topic")), F.lit(" while showing "), _first_line(ocr, 40)),
                F.concat(F.lit("transcript: "), F.substring(speech, 1, 120), F.lit(" | ocr: "), F.substring(ocr, 1, 120)),
            ),
        )
    )
    rows = windows.select("video", "window", "start_s", "end_s", F.explode(made).alias("p"))
    return rows.select(
        F.concat(F.col("video").cast("string"), F.lit(".w"), F.col("window").cast("string"), F.lit("."), F.col("p.type")).alias("id"),
        "video",
        "p.type",
        F.round("start_s", 2).alias("start_s"),
        F.round("end_s", 2).alias("end_s"),
        "p.text",
        "p.context",
        F.lit("pending").alias("status"),
    )


def window_halves(windows: DataFrame) -> DataFrame:
    """Windows repeated under half 0 and/or 1, by their position in the video; both halves hold the middle one."""
    n = windows.groupBy("video").agg(F.count(F.lit(1)).alias("_n"))
    mid = F.floor(F.col("_n") / 2)
    halves = F.array_compact(F.array(F.when(F.col("_pos") <= mid, 0), F.when(F.col("_pos") >= mid, 1)))
    placed = positions(windows, ["video"], ["window"], F.floor(F.col("window") / 1_000), "_pos")
    return null_safe_join(placed, n, ["video"]).withColumn("half", F.explode(halves)).drop("_n", "_pos")


def semantic_proposals(windows: DataFrame, encoder=None) -> DataFrame:
    """One broader proposal per half of a video, named after the strongest phrase of its speech."""
    from .keyphrases import keyphrases

    rows = window_halves(windows).filter(F.length("speech_text") > 0)
    joined = rows.groupBy("video", "half").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", "speech_text"))), lambda s: s["speech_text"]), " ").alias("text"),
        F.min("start_s").alias("start_s"),
        F.max("end_s").alias("end_s"),
    ).filter(F.size(_words(F.col("text"))) >= 15)
    joined = cut_lineage(joined)  # read three times
    phrased = keyphrases(joined, ["video", "half"], "text", 2, encoder=encoder).filter(F.size("keyphrases") > 0)
    d = joined.join(phrased, ["video", "half"])
    return d.select(
        F.concat(F.col("video").cast("string"), F.lit(".wsemantic"), F.col("half").cast("string"), F.lit(".semantic")).alias("id"),
        "video",
        F.lit("semantic").alias("type"),
        F.round("start_s", 2).alias("start_s"),
        F.round("end_s", 2).alias("end_s"),
        F.concat(F.lit("[edit] the section about "), F.get("keyphrases", F.lit(0))).alias("text"),
        F.concat(F.lit("combined keyphrases: "), F.array_join("keyphrases", ", ")).alias("context"),
        F.lit("pending").alias("status"),
    )


def alpha_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0)), F.lower)


def window_df(candidates: DataFrame) -> DataFrame:
    """(video, token, windows): in how many windows of a video an on-screen token occurs."""
    blob = F.regexp_extract("context", "(?is)ocr:\\s*(.*)$", 1)
    d = candidates.filter(F.col("type").isin("ocr", "multi"))
    rows = d.select("video", window_key(F.col("id")).alias("w"), F.explode(F.array_distinct(alpha_tokens(blob))).alias("token"))
    return rows.filter(F.length("token") >= 3).groupBy("video", "token").agg(F.countDistinct("w").alias("windows"))


def auto_review(candidates: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Candidates with cleaned text and status approved or rejected.

    An on-screen fragment needs a dictionary word and a token found in at most one window of its video;
    without a dictionary every text passes that test. dictionary: (word).
    """
    text = clean_candidate(F.col("text"))
    d = candidates.withColumn("_raw", F.col("text")).withColumn("text", text)
    fragment = ocr_fragment(F.col("_raw"))
    d = d.withColumn("_frag", fragment).withColumn("_probe", F.coalesce(F.when(F.length("_frag") > 0, F.col("_frag")), F.col("text")))
    tokens = d.select("id", "video", F.explode(F.array_distinct(alpha_tokens(F.concat_ws(" ", "_probe", F.when(F.col("type") == "multi", F.col("text")))))).alias("token")).filter(F.length("token") >= 3)
    if dictionary is None:
        real = d.select("id").withColumn("_real", F.lit(True))
    else:
        words = dictionary.select(F.lower("word").alias("token")).distinct()
        real = tokens.join(words, "token", "left_semi").select("id").distinct().withColumn("_real", F.lit(True))
    own = d.select("id", "video", F.explode(F.array_distinct(alpha_tokens(F.col("_probe")))).alias("token")).filter(F.length("token") >= 3)
    rare = (
        own.join(window_df(candidates), ["video", "token"], "left")
        .filter(F.coalesce("windows", F.lit(0)) <= 1)
        .select("id")
        .distinct()
        .withColumn("_rare", F.lit(True))
    )
    d = d.join(real, "id", "left").join(rare, "id", "left")
    has_real, has_rare = F.coalesce("_real", F.lit(False)), F.coalesce("_rare", F.lit(False))
    keep = (
        F.when(F.length("text") < 5, False)
        .when(F.col("type") == "visual", F.lower(F.trim("text")) != V.GENERIC_VISUAL)
        .when(F.col("type") == "ocr", has_real & has_rare)
        .when(F.col("type") == "multi", F.col("_frag").isNull() | (F.length("_frag") == 0) | has_real)
        .otherwise(True)
    )
    return d.withColumn("status", F.when(keep, "approved").otherwise("rejected")).drop("_raw", "_frag", "_probe", "_real", "_rare")


def review_counts(reviewed: DataFrame) -> DataFrame:
    return reviewed.groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


