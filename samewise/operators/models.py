"""Supervised scores: boosted trees, calibration, importance, what to label next.

Training rows are labels made by people; scoring is one pass over all pairs.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samewise.plans.materialize import save


@dataclass
class Scorer:
    """Trees over features in a fixed order, and a curve of 201 points from raw to calibrated score."""

    features: list[str]
    pipeline: PipelineModel
    curve: list[float]

    @property
    def importance(self) -> dict[str, float]:
        """The gain of each feature; a feature and the mark of its absence count together."""
        gain = self.pipeline.stages[-1].featureImportances.toArray()
        n = len(self.features)
        return {f: float(gain[i] + gain[n + i]) for i, f in enumerate(self.features)}


def _inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles, NaN where there is no evidence, with a mark beside each that says so."""
    return df.withColumns({f"_f_{f}": F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))) for f in features} | {f"_n_{f}": F.col(f"`{f}`").isNull().cast("double") for f in features})


def _trees(train: DataFrame, features: Sequence[str], label: str, weight: str, rounds: int, depth: int, seed: int) -> PipelineModel:
    rows = _inputs(train, features).withColumn("_y", F.col(label).cast("double"))
    filled = [f"_i_{f}" for f in features]
    imputer = Imputer(inputCols=[f"_f_{f}" for f in features], outputCols=filled, strategy="median")
    # a feature without a single value has no median: it is 0 for every row
    empty = rows.agg(*[F.count_if(~F.isnan(f"_f_{f}")).alias(f) for f in features]).head()
    rows = rows.withColumns({f"_f_{f}": F.lit(0.0) for f in features if empty[f] == 0})
    i = imputer.fit(rows)
    a = VectorAssembler(inputCols=[*filled, *[f"_n_{f}" for f in features]], outputCol="_x")
    g = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol=weight, maxIter=rounds, maxDepth=depth, seed=seed)
    return PipelineModel([i, a, g.fit(a.transform(i.transform(rows)))])


def _raw(df: DataFrame, features: Sequence[str], pipeline: PipelineModel) -> DataFrame:
    kept = df.columns
    return pipeline.transform(_inputs(df, features)).select(*kept, F.get(vector_to_array("probability"), F.lit(1)).alias("raw"))


def fit(train: DataFrame, features: Sequence[str], label: str = "same", weight: str = "weight", fold: str = "fold", rounds: int = 20, depth: int = 3, seed: int = 7) -> Scorer:
    """Trees on all rows, calibrated by a logistic curve over scores from folds that had not seen them."""
    features = list(features)
    rows = save(train, "training")
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    curve = [i / 200 for i in range(201)]
    if len(folds) > 1:
        out = None
        for k in folds:
            own = _raw(rows.where(F.col(fold) == k), features, _trees(rows.where(F.col(fold) != k), features, label, weight, rounds, depth, seed)).select("raw", F.col(label).cast("double").alias("y"), F.col(weight).alias("w"))
            out = own if out is None else out.unionByName(own)
        m = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", regParam=1e-4).fit(VectorAssembler(inputCols=["raw"], outputCol="v").transform(save(out, "out-of-fold")))
        slope, base = float(m.coefficients[0]), float(m.intercept)
        curve = [1 / (1 + math.exp(-(base + slope * x))) for x in curve]
    return Scorer(features, _trees(rows, features, label, weight, rounds, depth, seed), curve)


def along(curve: Sequence[float], x: Column) -> Column:
    """The value of a curve of evenly spaced points over 0..1, straight between them."""
    points, n = F.array(*[F.lit(float(v)) for v in curve]), len(curve) - 1
    at = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * n
    low = F.least(F.floor(at), F.lit(n - 1)).cast("int")
    return F.get(points, low) + (at - low) * (F.get(points, low + 1) - F.get(points, low))


def score(pairs: DataFrame, scorer: Scorer, name: str = "model_score") -> DataFrame:
    if missing := [f for f in scorer.features if f not in pairs.columns]:
        raise ValueError(f"missing features: {', '.join(missing)}")
    return _raw(pairs, scorer.features, scorer.pipeline).withColumn(name, along(scorer.curve, F.col("raw"))).drop("raw")


def store(scorer: Scorer, path: str) -> None:
    """A version is written once and never changed; a path that is there raises."""
    scorer.pipeline.save(f"{path}/pipeline")
    SparkSession.active().createDataFrame([(json.dumps({"features": scorer.features, "curve": scorer.curve}),)], "value string").coalesce(1).write.text(f"{path}/about")


def load(spark, path: str) -> Scorer:
    about = json.loads(spark.read.text(f"{path}/about").head().value)
    return Scorer(about["features"], PipelineModel.load(f"{path}/pipeline"), about["curve"])


def ablation(train: DataFrame, test: DataFrame, groups: Mapping[str, Sequence[str]], **settings) -> dict[str, float]:
    """Brier score on test without each group of features, and with all under ''."""
    every = [f for g in groups.values() for f in g]
    out = {}
    for name, left_out in [("", []), *groups.items()]:
        used = [f for f in every if f not in left_out]
        if used:
            s = fit(train, used, **settings)
            out[name] = score(test, s).agg(F.avg(F.pow(F.col("model_score") - F.col("same").cast("double"), 2))).head()[0]
    return out


def isotonic(rows: DataFrame, score: str, truth: str, least: int = 20) -> Column:
    """A rising step curve from score to rate as a Column over score; the score itself with too few labels."""
    data = rows.select(F.col(score).alias("s"), F.col(truth).cast("double").alias("y")).dropna()
    if data.count() < least:
        return F.col(score)
    m = IsotonicRegression(featuresCol="s", labelCol="y").fit(data)
    xs, ys = list(m.boundaries), list(m.predictions)
    s = F.col(score)
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 1, 0, -1):
        span = xs[i] - xs[i - 1]
        mid = F.lit(float(ys[i])) if span == 0 else F.lit(float(ys[i - 1])) + (s - xs[i - 1]) / span * float(ys[i] - ys[i - 1])
        out = F.when(s <= xs[i], mid).otherwise(out)
    return F.when(s <= xs[0], float(ys[0])).otherwise(out)


def label_next(pairs: DataFrame, score: str, other: str, n: int = 15) -> DataFrame:
    """The n pairs most in doubt: near a half, or where two scores disagree. A list for people, so the limit is its meaning."""
    s = F.coalesce(F.col(score), F.col(other))
    doubt = (1 - F.abs(2 * s - 1)) + F.coalesce(F.abs(F.col(score) - F.col(other)), F.lit(0.0))
    return pairs.withColumn("doubt", doubt).orderBy(F.desc_nulls_last("doubt"), "id_l", "id_r").limit(n)


def batches(pairs: DataFrame, size: int = 15) -> DataFrame:
    """pairs of one label_next list with the batch each is shown in."""
    w = Window.orderBy(F.desc("doubt"), "id_l", "id_r")
    return pairs.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
