"""Linear and logistic regression. Sums over the rows are taken by Spark; the driver solves a system as small as the number of terms."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...grain import Relation, RequestError
from .features import complete, reject_identifiers

SUMMARY = "model string, sample_size long, predictors int, r_squared double, rmse double, degrees_of_freedom long, accuracy double, log_loss double, positive_class string, standardized_predictors int"
COEFFICIENTS = "term string, estimate double, std_error double, statistic double, p_value double, ci_lower double, ci_upper double"


def student(spark: SparkSession, df: int):
    """Student's t distribution, from the mathematics library that Spark brings."""
    return spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(df))


def _moments(df: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    row = df.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n = row["n"]
    return np.array([row[f"m{i}"] or 0.0 for i in range(len(names))]), np.array([row[f"s{i}"] or 0.0 for i in range(len(names))]), n


def _prepared(rel: Relation, dependent: str, independent: list[str]) -> DataFrame:
    if not independent or len(set(independent)) < len(independent) or dependent in independent:
        raise RequestError("a regression needs predictors, each once, apart from its outcome")
    reject_identifiers([dependent, *independent])
    rel.need(dependent, *independent)
    return complete(rel.df, [dependent, *independent]).select(*[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate([dependent, *independent])])


def linear(rel: Relation, dependent: str, independent: list[str], standardize: bool = False, confidence: float = 0.95) -> dict[str, DataFrame]:
    """Least squares with an intercept: standard errors, t, p and intervals; terms that depend on each other take the smallest solution.

    standardize: predictors less their mean over their population deviation. Needs more rows than terms. R2 is 0 where the outcome doesn't vary.
    """
    spark, p = rel.df.sparkSession, len(independent)
    df = _prepared(rel, dependent, independent)
    names = [f"__x{i}" for i in range(p + 1)]
    mean, dev, n = _moments(df, names)
    if n <= p + 1:
        raise RequestError(f"{n} complete rows are too few for {p + 1} terms")
    dev = np.where(dev > 0, dev, 1.0)
    scaled = df.select(*[((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(c) for c, m, s in zip(names, mean, dev, strict=True)])
    cross = scaled.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]).first()
    full = np.array([[cross[f"{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)])
    inverse = np.linalg.pinv(full[1:, 1:], hermitian=True)
    slope = inverse @ full[1:, 0]
    # Centred terms: the intercept stands apart, its variance is that of the mean plus that of the slopes.
    residual = scaled.select((F.col(names[0]) - reduce(lambda a, b: a + b, [F.lit(float(b)) * F.col(c) for b, c in zip(slope, names[1:], strict=True)])).alias("r"))
    sse = residual.agg(F.sum(F.col("r") * F.col("r"))).first()[0] * dev[0] ** 2
    free = n - p - 1
    sst = full[0, 0] * dev[0] ** 2
    r2 = 1 - sse / sst if sst > 0 else 0.0
    sigma2 = sse / free
    ratio = dev[0] / dev[1:]
    if standardize:
        beta, cov, at = slope * dev[0], inverse * sigma2, np.zeros(p)
    else:
        beta, cov, at = slope * ratio, inverse * sigma2 / np.outer(dev[1:], dev[1:]), mean[1:]
    estimates = np.concatenate(([mean[0] - beta @ at], beta))
    errors = np.sqrt(np.maximum(0, np.concatenate(([sigma2 / n + at @ cov @ at], np.diag(cov)))))
    t = student(spark, free)
    critical = t.inverseCumulativeProbability(0.5 + confidence / 2)
    rows = []
    for name, e, s in zip(["intercept", *independent], estimates.tolist(), errors.tolist(), strict=True):
        stat = e / s if s > 0 else None
        rows.append((name, e, s, stat, 2 * t.cumulativeProbability(-abs(stat)) if stat is not None else None, e - critical * s, e + critical * s))
    summary = [("linear", n, p, float(r2), float(np.sqrt(sse / n)), free, None, None, None, int(standardize))]
    return {"model summary": spark.createDataFrame(summary, SUMMARY), "coefficients": spark.createDataFrame(rows, COEFFICIENTS)}


def logistic(rel: Relation, dependent: str, independent: list[str], standardize: bool = False) -> dict[str, DataFrame]:
    """Binary logistic regression with an L2 penalty (C = 1) on the slopes alone; no standard errors. The larger value is the positive class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    spark, p = rel.df.sparkSession, len(independent)
    df = _prepared(rel, dependent, independent)
    names = [f"__x{i}" for i in range(p + 1)]
    mean, dev, n = _moments(df, names)
    if n <= p + 1:
        raise RequestError(f"{n} complete rows are too few for {p + 1} terms")
    values = sorted(r[0] for r in df.select("__x0").distinct().limit(3).collect())
    if len(values) != 2:
        raise RequestError("a logistic outcome has two values")
    dev = np.where(dev > 0, dev, 1.0)
    xs = [((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(c) if standardize else F.col(c) for c, m, s in zip(names[1:], mean[1:], dev[1:], strict=True)]
    data = VectorAssembler(inputCols=names[1:], outputCol="features").transform(df.select((F.col("__x0") == values[1]).cast("double").alias("label"), *xs))
    model = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-10).fit(data)
    z = reduce(lambda a, b: a + b, [F.lit(float(b)) * F.col(c) for b, c in zip(model.coefficients, names[1:], strict=True)]) + F.lit(float(model.intercept))
    loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * F.col("label")
    row = data.agg(F.avg(((z >= 0).cast("double") == F.col("label")).cast("double")).alias("a"), F.avg(loss).alias("l")).first()
    rows = [(t, float(e), None, None, None, None, None) for t, e in zip(["intercept", *independent], [model.intercept, *model.coefficients], strict=True)]
    summary = [("logistic", n, p, None, None, None, row["a"], row["l"], f"{values[1]:g}", int(standardize))]
    return {"model summary": spark.createDataFrame(summary, SUMMARY), "coefficients": spark.createDataFrame(rows, COEFFICIENTS)}
