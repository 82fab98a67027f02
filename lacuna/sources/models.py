"""Fitted models as Parquet tables plus one JSON line of scalars; cells can be shared by the models of a store."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("rows", "cols", "cells")


def content_hash(cells: DataFrame) -> str:
    """Count and two independent sums of hashes of the cells: the same however the cells are ordered and partitioned."""
    names = sorted(cells.columns)
    seen = cells.agg(
        F.count("*").alias("n"), F.expr(f"bit_xor(xxhash64({', '.join(names)}))").alias("x"),
        F.expr(f"sum(cast(xxhash64(1, {', '.join(names)}) AS decimal(20, 0)))").alias("s")).first()
    return f"{seen['n']:x}-{(seen['x'] or 0) & (1 << 64) - 1:016x}-{int(seen['s'] or 0) % (1 << 64):016x}"


def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _exists(spark: SparkSession, path: str) -> bool:
    files, root = _files(spark, path)
    return files.exists(root)


def _delete(spark: SparkSession, path: str) -> None:
    files, root = _files(spark, path)
    files.delete(root, True)


def _scalars(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/scalars").first()["value"])


def save_tables(path: str, tables: dict[str, DataFrame], scalars: dict, overwrite: bool = False, store: str | None = None) -> None:
    """Write a model. With a ``store`` the cells are a snapshot in that folder, named by their content.

    A snapshot is written once and never changed; a model holds a reference to it, an empty file beside the snapshot, which is
    set before the snapshot is looked for. Without a store each model has its own copy of the cells.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    spark = next(iter(tables.values())).sparkSession
    if overwrite and _exists(spark, f"{path}/scalars"):
        remove_tables(spark, path)
    held = {}
    if store is not None:
        snapshot = f"{store.rstrip('/')}/cells-{content_hash(tables['cells'])}"
        reference = f"{snapshot}.refs/{uuid.uuid4().hex}"
        files, at = _files(spark, reference)
        files.create(at).close()
        if not _exists(spark, f"{snapshot}/_SUCCESS"):
            tables["cells"].write.mode("overwrite").parquet(snapshot)
        held = {"snapshot": snapshot, "reference": reference}
    for name, table in tables.items():
        if name != "cells" or not held:
            table.write.mode(mode).parquet(f"{path}/{name}")
    line = spark.createDataFrame([(json.dumps({**scalars, "held": held}),)], "value string")
    line.coalesce(1).write.mode(mode).text(f"{path}/scalars")


def load_tables(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    scalars = _scalars(spark, path)
    held = scalars.pop("held", None) or {}
    places = {name: f"{path}/{name}" for name in TABLES} | ({"cells": held["snapshot"]} if held else {})
    return {name: spark.read.parquet(place) for name, place in places.items()}, scalars


def remove_tables(spark: SparkSession, path: str) -> None:
    """Delete a saved model, and its snapshot of the cells if no other model refers to that."""
    held = _scalars(spark, path).get("held") or {}
    _delete(spark, path)
    if held:
        _delete(spark, held["reference"])
        files, references = _files(spark, f"{held['snapshot']}.refs")
        if not files.exists(references) or not len(files.listStatus(references)):
            _delete(spark, held["snapshot"])
            _delete(spark, f"{held['snapshot']}.refs")
