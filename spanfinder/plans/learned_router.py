"""A router trained on recorded lane outcomes: one logistic regression per lane."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators.ordered import positions, seeded_key

MIN_ROWS = 20
MIN_P = 0.15


def router_features(plans: DataFrame, vector: str, out: str = "features") -> DataFrame:
    """Query vector, five cue flags, log token count, phrase flag, split flag."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    d = plans.withColumn("_vec", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    names = []
    for cue in V.CUES:
        names.append(f"_cue_{cue}")
        d = d.withColumn(names[-1], F.array_contains("cues", cue).cast("double"))
    words = F.size(F.filter(F.split(F.trim(F.col("raw")), r"\s+"), lambda w: F.length(w) > 0))
    d = (
        d.withColumn("_log_tokens", F.log1p(words.cast("double")))
        .withColumn("_quoted", (F.size("phrases") > 0).cast("double"))
        .withColumn("_differs", (F.col("speech_q") != F.col("visual_q")).cast("double"))
    )
    names += ["_log_tokens", "_quoted", "_differs"]
    return VectorAssembler(inputCols=["_vec", *names], outputCol=out).transform(d).drop("_vec", *names)


def training_rows(results: DataFrame) -> DataFrame:
    """(query_id, lane, label) from recorded attributions, only for lanes that ran.

    results: (query_id, lanes map<lane, struct<first_rank, hit10>>, lanes_run array or absent).
    """
    rows = results.select("query_id", *(["lanes_run"] if "lanes_run" in results.columns else []), F.explode("lanes").alias("lane", "v"))
    if "lanes_run" in results.columns:
        rows = rows.filter(F.col("lanes_run").isNull() | F.array_contains("lanes_run", F.col("lane")))
    return rows.select("query_id", "lane", F.col("v.hit10").alias("label"))


@dataclass
class LearnedRouter:
    """Scales each configured lane by its predicted usefulness; drops lanes below min_p."""

    version: str
    lanes: list[str]
    models: dict
    priors: dict[str, float]
    vector: str = "query_vector"
    min_p: float = MIN_P
    meta: dict = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"learned:{self.version}"

    def probabilities(self, plans: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        d = router_features(plans, self.vector, "_f")
        entries: list[Column] = []
        for lane in self.lanes:
            if lane in self.models:
                d = self.models[lane].transform(d).withColumn(f"_p_{lane}", F.get(vector_to_array("probability"), F.lit(1)))
                d = d.drop("rawPrediction", "probability", "prediction")
                entries += [F.lit(lane), F.col(f"_p_{lane}")]
            else:
                entries += [F.lit(lane), F.lit(float(self.priors.get(lane, 0.5)))]
        d = d.withColumn("probs", F.create_map(*entries))
        return d.drop("_f", *[f"_p_{lane}" for lane in self.lanes])

    def route(self, plans: DataFrame, base: Mapping[str, float]) -> DataFrame:
        return apply_probabilities(self.probabilities(plans), base, self.min_p)


def apply_probabilities(plans: DataFrame, base: Mapping[str, float], min_p: float = MIN_P) -> DataFrame:
    """base * p / max(p); 0 below min_p; lanes that are off or have no prediction keep their weight."""
    from .routing import weight_map

    top = F.array_max(F.map_values("probs"))
    top = F.when(top == 0, 1.0).otherwise(top)
    weights = {}
    for lane, w in base.items():
        p = F.try_element_at("probs", F.lit(lane))
        kept = F.lit(float(w))
        weights[lane] = kept if w <= 0 else F.when(p.isNull(), kept).when(p < min_p, 0.0).otherwise(kept * p / top)
    return plans.withColumn("weights", weight_map(weights)).withColumn(
        "probs", F.transform_values("probs", lambda _, v: F.round(v, 3))
    )


def holdout_split(ids: DataFrame, holdout: float, seed: int) -> DataFrame:
    """Seeded hash order; the first int(n * holdout) queries are held out."""
    hashed = ids.select("query_id").distinct().withColumn("_h", seeded_key(seed, F.col("query_id"))).withColumn("_g", F.lit(0))
    placed = positions(hashed, ["_g"], ["_h", "query_id"], F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"), "_pos")
    total = hashed.groupBy("_g").agg(F.floor(F.count(F.lit(1)) * holdout).alias("_n"))
    return placed.join(F.broadcast(total), "_g").select("query_id", (F.col("_pos") < F.col("_n")).alias("held_out"))


def train_router(plans: DataFrame, labels: DataFrame, version: str, *, vector: str = "query_vector", holdout: float = 0.2, seed: int = 0, min_p: float = MIN_P) -> LearnedRouter:
    """One class-balanced logistic regression per lane; a lane with one class keeps its prior.

    A lane without a recorded outcome for a query counts as a miss there. Class counts are aggregated;
    only lane names and counts reach the driver.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    n_queries = labels.select("query_id").distinct().count()
    if n_queries < MIN_ROWS:
        raise ValueError(f"only {n_queries} labelled queries, need {MIN_ROWS}")
    split = holdout_split(labels, holdout, seed)
    x = router_features(plans, vector).select("query_id", "features").join(split, "query_id").persist()
    lanes = sorted(r["lane"] for r in labels.select("lane").distinct().collect())
    models, priors, aucs = {}, {}, {}
    n_fit = 0
    for lane in lanes:
        y = labels.filter(F.col("lane") == lane).select("query_id", "label")
        rows = x.join(y, "query_id", "left").fillna({"label": 0.0}).persist()
        fit = rows.filter(~F.col("held_out"))
        n_fit, hits = fit.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        priors[lane] = hits / n_fit if n_fit else 0.0
        if 0 < hits < n_fit:
            balance = F.when(F.col("label") == 1.0, n_fit / (2.0 * hits)).otherwise(n_fit / (2.0 * (n_fit - hits)))
            lr = LogisticRegression(
                weightCol="_w", standardization=False, regParam=1.0 / (0.5 * n_fit), elasticNetParam=0.0, maxIter=2000
            )
            # the fitted stage reads features from the plan's own column
            models[lane] = lr.fit(fit.withColumn("_w", balance)).setFeaturesCol("_f")
            held = models[lane].copy().setFeaturesCol("features").transform(rows.filter("held_out"))
            classes = held.agg(F.countDistinct("label")).first()[0]
            if classes == 2:
                aucs[lane] = round(BinaryClassificationEvaluator(rawPredictionCol="probability").evaluate(held), 3)
        rows.unpersist()
    x.unpersist()
    meta = {"n_train": n_fit, "n_holdout": n_queries - n_fit, "holdout_auc": aucs, "priors": priors}
    return LearnedRouter(version, lanes, models, priors, vector, min_p, meta)


def save_router(router: LearnedRouter, folder: str) -> str:
    """Write a router under folder/<version>: a model per lane and one row that describes it. Returns the path."""
    spark = SparkSession.active()
    path = f"{folder.rstrip('/')}/{router.version}"
    for lane, model in router.models.items():
        model.write().overwrite().save(f"{path}/lanes/{lane}")
    about = {"version": router.version, "lanes": router.lanes, "fitted": sorted(router.models), "priors": router.priors, "vector": router.vector, "min_p": router.min_p, "meta": router.meta}
    # the description comes last: a folder without it is not a router yet
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return path


def load_router(folder: str, version: str) -> LearnedRouter:
    """The router that `save_router` wrote."""
    from pyspark.ml.classification import LogisticRegressionModel

    path = f"{folder.rstrip('/')}/{version}"
    about = json.loads(SparkSession.active().read.text(f"{path}/about").first()[0])
    models = {lane: LogisticRegressionModel.load(f"{path}/lanes/{lane}").setFeaturesCol("_f") for lane in about["fitted"]}
    return LearnedRouter(about["version"], about["lanes"], models, about["priors"], about["vector"], about["min_p"], about["meta"])
