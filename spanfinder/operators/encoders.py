"""Vector and pair-score hooks: plug a model in, or use the deterministic defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import sigmoid
from ..functions.text import stem, stemmed_tokens


class Encoder(Protocol):
    """key names the model version; add() appends a unit vector column to a table."""

    key: str
    dim: int

    def add(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class HashingEncoder:
    """Stemmed term counts hashed into `dim` slots, scaled to unit length; needs no model file."""

    def __init__(self, dim: int = 64):
        self.dim, self.key = dim, f"hashing-{dim}"

    def add(self, df: DataFrame, text: str, out: str) -> DataFrame:
        from pyspark.ml.feature import HashingTF, Normalizer
        from pyspark.ml.functions import vector_to_array

        tokens = df.withColumn("_tok", stemmed_tokens(F.coalesce(F.col(text), F.lit(""))))
        counted = HashingTF(numFeatures=self.dim, inputCol="_tok", outputCol="_tf").transform(tokens)
        scaled = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
        vector = vector_to_array("_unit")
        has_text = F.size("_tok") > 0
        return scaled.withColumn(out, F.when(has_text, vector)).drop("_tok", "_tf", "_unit")


class ModelEncoder:
    """A model behind an Arrow-batched function: load() runs once per worker, embed(texts) per batch."""

    def __init__(self, key: str, dim: int, load: Callable[[], Callable[[list[str]], list[list[float]]]]):
        self.key, self.dim, self.load = key, dim, load

    def add(self, df: DataFrame, text: str, out: str) -> DataFrame:
        load = self.load

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                yield pd.Series(list(model(batch.fillna("").tolist())))

        return df.withColumn(out, embed(F.col(text)))


def embed(df: DataFrame, text: str, encoder: Encoder, out: str = "embedding") -> DataFrame:
    """Encode every distinct text once and join the vectors back."""
    vectors = encoder.add(df.select(text).distinct(), text, out)
    return df.join(vectors, text, "left")


def fanout_by_key(df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run `compute` on one row per distinct key and join its new columns back to every row.

    Which of the equal-key rows is used does not matter: equal keys mean equal content.
    """
    once = compute(df.dropDuplicates([key]))
    fresh = [c for c in once.columns if c not in df.columns]
    return df.join(once.select(key, *fresh), key, "left")


def term_coverage_score(query_terms: Column, passage: Column) -> Column:
    """Default pair score in (0, 1): share of the query's stemmed terms found in the passage."""
    wanted = F.array_distinct(F.transform(query_terms, stem))
    found = F.size(F.array_intersect(wanted, stemmed_tokens(passage)))
    share = F.when(F.size(wanted) > 0, found / F.size(wanted)).otherwise(0.0)
    return sigmoid(6.0 * share - 3.0)


def rerank(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None, out: str = "rerank") -> DataFrame:
    """Score (speech_q, passage) pairs with a vectorised model, or with the default expression.

    Rows without a passage are not scored.
    """
    if scorer is None:
        return pairs.withColumn(out, F.when(F.col("passage").isNotNull(), term_coverage_score(F.col("terms"), F.col("passage"))))

    @F.pandas_udf("double")
    def score(q: pd.Series, p: pd.Series) -> pd.Series:
        wanted = p.notna()
        result = pd.Series(float("nan"), index=p.index)
        if wanted.any():
            result[wanted] = scorer(q[wanted], p[wanted]).to_numpy()
        return result.where(wanted, None)

    return pairs.withColumn(out, score("speech_q", "passage"))
