"""Vector means per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import unit


def mean_pool(vectors: DataFrame, by: Sequence[str], vector: str = "embedding", out: str = "centroid") -> DataFrame:
    """Unit-length mean vector per group; partial sums combine before the shuffle, so hot groups spread."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    usable = vectors.filter(F.col(vector).isNotNull())
    v = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    pooled = usable.groupBy(*by).agg(Summarizer.mean(v).alias("_m"))
    return pooled.select(*by, unit(vector_to_array("_m")).alias(out))
