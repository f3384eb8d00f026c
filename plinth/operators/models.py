"""A grid of classifiers under grouped cross-validation.

Logistic regression and linear support vectors, with and without class weights.
A radial kernel has no distributed form in Spark ML and is left out.
"""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidates(strengths: tuple[float, ...] = (0.1, 1.0)) -> list[tuple[str, float, int, object]]:
    """(name, strength, simplicity, estimator); a larger strength is a weaker penalty."""
    out = []
    for c in strengths:
        out.append(("logistic", c, 0, LogisticRegression(regParam=1 / c / 100, maxIter=10, weightCol="weight")))
    svc = LinearSVC(regParam=0.01, maxIter=5)
    return [*out, ("linear_svc", 1.0, 1, OneVsRest(classifier=svc, weightCol="weight"))]


def macro_f1(rows: DataFrame) -> float:
    """Mean F1 over the labels that rows (label, prediction) has on either side."""
    sides = rows.select(F.explode(F.array_distinct(F.array("label", "prediction"))).alias("k"), "label", "prediction")
    hit = (F.col("label") == F.col("k")) & (F.col("prediction") == F.col("k"))
    # a label counts once for each side it is on
    both = F.count_if(F.col("label") == F.col("k")) + F.count_if(F.col("prediction") == F.col("k"))
    return sides.groupBy("k").agg((2 * F.count_if(hit) / both).alias("f1")).agg(F.avg("f1")).first()[0] or 0.0


def grouped_search(rows: DataFrame, features: str, label: str, group: Column) -> DataFrame:
    """name, strength, mean, std, rank: macro-F1 over the folds of a grid, best first by mean, spread, simplicity and strength."""
    data = rows.select(
        array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"), group.cast("int").alias("fold")
    )
    sizes = data.groupBy("label").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    weights = sizes.crossJoin(F.broadcast(total)).select("label", (F.col("all") / F.col("k") / F.col("n")).alias("weight"))
    data = data.join(F.broadcast(weights), "label").cache()  # a row of weights for each label
    folds = [r[0] for r in data.select("fold").distinct().orderBy("fold").collect()]
    found = []
    for name, strength, simplicity, estimator in candidates():
        scores = [macro_f1(estimator.fit(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k))) for k in folds]
        mean = sum(scores) / len(scores)
        std = (sum((x - mean) ** 2 for x in scores) / len(scores)) ** 0.5
        found.append((-round(mean, 6), round(std, 6), simplicity, strength, name))
    data.unpersist()
    ranked = [(name, c, -mean, std, k) for k, (mean, std, _, c, name) in enumerate(sorted(found), 1)]
    return rows.sparkSession.createDataFrame(ranked, "name string, strength double, mean double, std double, rank int")
