"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the least node that is reachable.

    Each round hangs every node's larger neighbours on its least one, then every node's smaller neighbours (large star, small
    star), so paths halve and no node's neighbours are ever gathered. Rounds end when every node has one link, to a node without any.
    """
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low.select("a", F.col("m").alias("b")))
        edges = keep(small.distinct(), "links")
        inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
        if not inner.unionAll(edges.groupBy("a").count().where("count > 1").select("a")).limit(1).count():  # all are stars
            break
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("comp", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(roots)
