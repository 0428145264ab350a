"""Vector operators: centroids, consistency, nearest items, prototype classifier."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from ..functions.scores import cosine, dot


def mean_vectors(df: DataFrame, entity: str, vector: str, weight=None) -> DataFrame:
    """(entity, vec): the normalized (weighted) mean of each entity's vectors.

    One aggregate with a map-side part keeps a running mean a dimension; null vectors do not count.
    """
    usable = df.filter(F.col(vector).isNotNull())
    dense = usable.select(entity, (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"), array_to_vector(F.col(vector).cast("array<double>")).alias("x"))
    vec = dense.groupBy(entity).agg(vector_to_array(Summarizer.mean(F.col("x"), F.col("w"))).alias("vec"))
    norm = F.sqrt(dot(F.col("vec"), F.col("vec")))
    return vec.select(entity, F.transform("vec", lambda x: x / F.nullif(norm, F.lit(0.0))).alias("vec"))


def centroid_stats(df: DataFrame, entity: str, item: str, vector: str, *, outlier: float = vocab.OUTLIER) -> DataFrame:
    """(entity, n_items, rep, consistency, n_outliers): closest item to the centroid, median cosine, items below ``outlier``."""
    centre = mean_vectors(df, entity, vector)
    near = df.join(centre, entity).select(entity, item, F.round(cosine(F.col(vector), F.col("vec")), 9).alias("c"))
    return near.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.max_by(item, F.struct("c", -F.col(item))).alias("rep"),
        F.round(F.median("c"), 6).alias("consistency"),
        F.count_if(F.col("c") < outlier).alias("n_outliers"),
    )


def nearest(df: DataFrame, anchor: list[float], key: str, vector: str, k: int, *, exclude=None) -> DataFrame:
    """The ``k`` items most similar to one vector; the query travels as a literal, so nothing is joined."""
    sim = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(F.col(vector), F.lit([float(x) for x in anchor])) + 1) / 2)), 6)
    out = df.filter(F.col(key) != exclude) if exclude is not None else df
    return out.select(key, F.coalesce(sim, F.lit(0.0)).alias("similarity")).orderBy(F.col("similarity").desc(), key).limit(k)


#: Labels that a classifier sends to all tasks at most.
MOST_LABELS = 10_000


def _labels(model: DataFrame, *columns: str) -> DataFrame:
    """The rows of a model, one a label, as one array in one row, checked to be small."""
    some = model.select(*columns).limit(MOST_LABELS + 1).collect()
    if len(some) > MOST_LABELS:
        raise ValueError("too many labels for one broadcast")
    schema = model.select(*columns).schema
    return model.sparkSession.createDataFrame([(some,)], T.StructType([T.StructField("model", T.ArrayType(schema))]))


def _capped(confidence, n_training: int, most: float):
    """A confidence is .85 at most if there were few training rows."""
    return F.round(F.least(confidence, F.lit(most if n_training >= 100 else min(most, 0.85))), 6)


def prototype_classifier(df: DataFrame, prototypes: DataFrame, key: str, label: str, vector: str, *, n_training: int = 1000) -> DataFrame:
    """Nearest prototype with a margin confidence: min(.5 + margin, .95), at most .85 on few training rows.

    The two best labels come from two passes over the similarities, which are not sorted.
    """
    s = F.transform("model", lambda p: F.struct((-F.round(dot(F.col(vector), p["vec"]), 9)).alias("d"), p[label].alias("l")))
    scored = df.crossJoin(F.broadcast(_labels(prototypes, label, "vec"))).withColumn("s", s).withColumn("first", F.array_min("s"))  # one row
    second = F.array_min(F.filter("s", lambda x: x["l"] != F.col("first.l")))
    return scored.select(key, F.col("first.l").alias("predicted"), _capped(F.coalesce(0.5 + second["d"] - F.col("first.d"), F.lit(1.0)), n_training, 0.95).alias("confidence"))


def logistic_classifier(df: DataFrame, model: DataFrame, key: str, label: str, vector: str, *, n_training: int = 1000) -> DataFrame:
    """The likeliest label and its probability by a fitted multinomial model (label, intercept, coef)."""
    logit = F.transform("model", lambda m: F.struct((m["intercept"] + dot(F.col(vector), m["coef"])).alias("z"), m[label].alias("l")))
    scored = df.crossJoin(F.broadcast(_labels(model, label, "intercept", "coef"))).withColumn("z", logit).withColumn("first", F.array_max("z"))  # one row
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x["z"] - F.col("first.z")))
    return scored.select(key, F.col("first.l").alias("predicted"), _capped(1 / total, n_training, 1.0).alias("confidence"))


def fit_logistic(df: DataFrame, label: str, vector: str, *, rounds: int = 50, ridge: float = 1e-3) -> DataFrame:
    """(label, intercept, coef) of a multinomial logistic regression on normalized vectors; labels are whole numbers from 0."""
    norm = F.nullif(F.sqrt(dot(F.col(vector), F.col(vector))), F.lit(0.0))
    rows = df.select(F.col(label).cast("double").alias("y"), F.transform(vector, lambda x: x.cast("double") / norm).alias("v")).filter("y is not null and v[0] is not null")
    fitted = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", maxIter=rounds, regParam=ridge).fit(rows.select("y", array_to_vector("v").alias("x")))
    coef, intercept = fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist()
    made = [(k, b, c) for k, (b, c) in enumerate(zip(intercept, coef))]
    return df.sparkSession.createDataFrame(made, f"{label} int, intercept double, coef array<double>")


def predict_fields(df: DataFrame, prototypes: dict[str, DataFrame], key: str, vector: str, **training) -> DataFrame:
    """(key, field, predicted, confidence) of several fields, each with its own prototypes (label, vec)."""
    out = None
    for name, protos in prototypes.items():
        one = prototype_classifier(df, protos.withColumn("label", F.col("label").cast("string")), key, "label", vector, **training)
        one = one.select(key, F.lit(name).alias("field"), "predicted", "confidence")
        out = one if out is None else out.union(one)
    return out


def parse_vectors(df: DataFrame, text: str) -> DataFrame:
    """JSON vectors to arrays; malformed ones are skipped."""
    return df.withColumn("vec", F.from_json(F.col(text), "array<float>")).filter(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))


def parse_float32(df: DataFrame, raw: str) -> DataFrame:
    """Vectors of little-endian 32-bit floats to arrays; null, empty and cut-off ones are skipped."""
    return df.filter((F.octet_length(raw) > 0) & (F.octet_length(raw) % 4 == 0)).withColumn("vec", _floats(F.col(raw)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _floats(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: np.frombuffer(b, "<f4"))


def first_vector(items: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, vec, source) of every item: the vector of the first of several (key, vec) tables that has one."""
    out = items.select(key)
    for k, (name, vecs) in enumerate(sources.items()):
        out = out.join(vecs.select(F.col(key).alias(f"__k{k}"), F.struct(F.col("vec").cast("array<float>").alias("vec"), F.lit(name).alias("source")).alias(f"__v{k}")), F.col(key) == F.col(f"__k{k}"), "left")
    found = F.coalesce(*(F.when(F.col(f"__v{k}.vec").isNotNull(), F.col(f"__v{k}")) for k in range(len(sources))))
    return out.withColumn("__v", found).select(key, "__v.vec", "__v.source")


def best_image_vector(df: DataFrame, entity: str, image: str, vector: str, status: str) -> DataFrame:
    """One vector an entity: that of its highest finished image."""
    return df.filter(F.col(status) == "DONE").groupBy(entity).agg(F.max_by(vector, image).alias("vec"))


def ranked(df: DataFrame, order: list, start: int = 0) -> DataFrame:
    """Positions of a page that is already small."""
    return df.withColumn("position", start + F.row_number().over(Window.orderBy(*order)) - 1)
