"""Sinks: tables as JSON rows, a capture's tables in a new folder, and bytes in new files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SinkError(ValueError):
    """A target that is there already, or nothing to write."""


def json_rows(rows: DataFrame, pretty: bool = False) -> DataFrame:
    """(``json``): each row as an object, nulls included."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.select(F.to_json(whole, {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("json"))


def unpack(tables: dict[str, DataFrame | None], folder: str, form: str = "parquet") -> list[str]:
    """Write each table to its own part of ``folder``, which must be empty or new, and a list of them (``unpack``); tables that are None are left out."""
    made = {name: df for name, df in tables.items() if df is not None}
    if not made:
        raise SinkError("no table to unpack")
    spark = next(iter(made.values())).sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(at) and len(store.listStatus(at)):
        raise SinkError(f"{folder} isn't empty")
    for name, df in made.items():
        df.write.mode("errorifexists").format(form).save(f"{folder}/{name}")
    listing = [(name, json.dumps(df.columns)) for name, df in made.items()]
    spark.createDataFrame(listing, "name string, columns string").coalesce(1).write.mode("errorifexists").json(f"{folder}/unpack")
    return list(made)


def extract(artifacts: DataFrame, path: str, target: str) -> int:
    """Write the ``content`` of the one artifact at ``path`` to a new file; never over an old one. Returns its size."""
    found = artifacts.where(F.col("path") == path).select("content").limit(2).collect()
    if len(found) != 1:
        raise SinkError(f"{len(found)} artifacts at {path!r}")
    with Path(target).open("xb") as out:
        return out.write(bytes(found[0]["content"]))
