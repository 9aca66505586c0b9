"""Trained models as Parquet tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from seqmodel.operators.automaton import Model

TABLES = ("votes", "ranked", "nodes", "states")


def save_model(model: Model, path: str) -> None:
    for name in TABLES:
        getattr(model, name).write.parquet(f"{path}/{name}")
    model.prefix_state.write.parquet(f"{path}/prefix_state")
    model.transitions.write.parquet(f"{path}/transitions")
    model.alphabet.write.parquet(f"{path}/alphabet")


def load_model(spark: SparkSession, path: str) -> Model:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    model = Model(read("votes"))
    for name in (*TABLES[1:], "prefix_state", "transitions", "alphabet"):
        model.__dict__[name] = read(name)
    return model
