"""Models as tables: saved with digests, verified before use."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from telemill.functions.scalars import fingerprint

FEATURE_SET = "1"
TABLES = ("calibration", "machine_profiles", "reference_profile", "detector", "preparation")


def save(spark: SparkSession, path: str, model: dict) -> str:
    """Write the model's tables and a metadata row with their digests and the order of the features."""
    digests = {}
    for name in TABLES:
        value = model[name]
        df = value if hasattr(value, "write") else spark.createDataFrame([(json.dumps(value),)], "json string")
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        digests[name] = fingerprint(spark.read.parquet(f"{path}/{name}")).first()["digest"]
    row = [(FEATURE_SET, list(model["features"]), list(TABLES), [digests[n] for n in TABLES])]
    spark.createDataFrame(row, "feature_set string, features array<string>, tables array<string>, digests array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return path


def load(spark: SparkSession, path: str, features: list[str]) -> dict:
    """The model; refuses another feature set, another order of features, or a table that is not the one saved."""
    meta = spark.read.json(f"{path}/metadata").select("feature_set", "features", "tables", "digests").first()
    if meta["feature_set"] != FEATURE_SET:
        raise ValueError(f"model of feature set {meta['feature_set']}")
    if list(meta["features"]) != list(features):
        raise ValueError("the model's features are not these, in this order")
    out: dict = {"features": list(features)}
    for name, digest in zip(meta["tables"], meta["digests"], strict=True):
        df = spark.read.parquet(f"{path}/{name}")
        if fingerprint(df).first()["digest"] != digest:
            raise ValueError(f"table {name} has changed since the model was saved")
        out[name] = json.loads(df.select(F.col("json")).first()[0]) if df.columns == ["json"] else df
    return out
