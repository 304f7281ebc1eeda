"""A table of natural-language queries to a table of search plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import any_case, or_else, phrases, terms

PUNCTUATION = " .?!,"


def _cleaned(text: Column) -> Column:
    unquoted = F.regexp_replace(text, V.QUOTED, "$1")
    led = F.regexp_replace(unquoted, any_case(V.LEAD), "")
    return F.btrim(F.regexp_replace(led, r"\s+", " "), F.lit(PUNCTUATION))


def _after_first(text: Column, pattern: str) -> Column:
    """Text after the leftmost match."""
    return F.regexp_replace(text, "(?is)^.*?" + pattern, "")


def _before_first(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, "(?is)" + pattern + ".*$", "")


def decompose(queries: DataFrame, text: str = "text") -> DataFrame:
    """Add raw, speech_q, visual_q, ocr_q, terms, phrases and cues to every query."""
    d = queries.withColumn("raw", F.col(text)).withColumn("_clean", _cleaned(F.col(text)))
    clean = F.col("_clean")
    split = F.regexp_like(clean, F.lit(any_case(V.SPLIT)))
    d = (
        d.withColumn("_split", split)
        .withColumn("_speech", F.when(split, F.trim(_before_first(clean, V.SPLIT))).otherwise(clean))
        .withColumn("_visual", F.when(split, F.trim(_after_first(clean, V.SPLIT))).otherwise(clean))
        .withColumn("_spoken", F.regexp_like(F.col("_speech"), F.lit(any_case(V.SPEAKER))))
    )
    said = F.when(F.col("_spoken"), or_else(F.trim(_after_first(F.col("_speech"), V.SPEAKER)), F.col("_speech")))
    d = d.withColumn("_speech", F.coalesce(said, F.col("_speech"))).withColumn(
        "_visual", F.when(F.col("_spoken") & ~F.col("_split"), F.col("_speech")).otherwise(F.col("_visual"))
    )
    on_screen = F.regexp_like(clean, F.lit(any_case(V.OCR_CUES)))
    bare = F.regexp_replace(F.regexp_replace(F.col("_visual"), any_case(V.OCR_CUES), ""), any_case(V.LEADING_ARTICLE), "")
    ocr = F.when(on_screen, or_else(F.btrim(bare, F.lit(" :-")), F.col("_visual"))).otherwise(F.col("_visual"))
    d = d.withColumn("phrases", phrases(F.col(text))).withColumn("_ocr", ocr)
    cues = F.array_compact(
        F.array(
            F.when(F.col("_split"), "split"),
            F.when(F.col("_spoken"), "speech"),
            F.when(F.regexp_like(F.col("_visual"), F.lit(any_case(V.VISUAL_CUES))), "visual"),
            F.when(on_screen, "ocr"),
            F.when(F.size("phrases") > 0, "exact"),
        )
    )
    return (
        d.withColumn("cues", cues)
        .withColumn("speech_q", or_else(F.col("_speech"), clean))
        .withColumn("visual_q", or_else(F.col("_visual"), clean))
        .withColumn("ocr_q", or_else(F.col("_ocr"), clean))
        .withColumn("terms", terms(F.col("speech_q")))
        .drop("_clean", "_split", "_spoken", "_speech", "_visual", "_ocr")
    )
