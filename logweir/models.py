"""Saving and loading fitted models.

A model is a dataclass of tables, arrays, numbers, Spark ML models and other such dataclasses. Tables become parquet, ML models use
their own format, the rest is one line of JSON. Everything is written by Spark, so any path that Spark can write will do.
"""

from __future__ import annotations

import dataclasses
import importlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def _name(kind: type) -> str:
    return f"{kind.__module__}:{kind.__qualname__}"


def _class(name: str) -> type:
    module, _, path = name.partition(":")
    if not module.startswith(("logweir.", "pyspark.ml.")):
        raise ValueError(f"not a model class: {name}")
    return getattr(importlib.import_module(module), path)


def save(spark: SparkSession, model, path: str) -> None:
    """Write a fitted model below ``path``, which must not exist yet."""
    fields = {}
    for field in dataclasses.fields(model):
        value, place = getattr(model, field.name), f"{path}/{field.name}"
        if isinstance(value, DataFrame):
            value.write.parquet(place)
            fields[field.name] = {"table": True}
        elif dataclasses.is_dataclass(value):
            save(spark, value, place)
            fields[field.name] = {"model": True}
        elif isinstance(value, np.ndarray):
            fields[field.name] = {"array": value.tolist()}
        elif hasattr(value, "write") and hasattr(value, "transform"):
            value.write().save(place)
            fields[field.name] = {"ml": _name(type(value))}
        else:
            fields[field.name] = {"value": value.item() if isinstance(value, np.generic) else value}
    line = json.dumps({"class": _name(type(model)), "fields": fields})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/fields.json")


def load(spark: SparkSession, path: str):
    """The model that ``save`` wrote below ``path``."""
    described = json.loads(spark.read.text(f"{path}/fields.json").first()[0])
    values = {}
    for name, kind in described["fields"].items():
        place = f"{path}/{name}"
        if "table" in kind:
            values[name] = spark.read.parquet(place)
        elif "model" in kind:
            values[name] = load(spark, place)
        elif "array" in kind:
            values[name] = np.array(kind["array"])
        elif "ml" in kind:
            values[name] = _class(kind["ml"]).load(place)
        else:
            values[name] = kind["value"]
    return _class(described["class"])(**values)
