"""Sinks: one JSON a row, or one file a key where tools ask for files."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, key: str, value: str | Column) -> DataFrame:
    """SNK-01 to SNK-06: key and its value as JSON text."""
    return df.select(F.col(key).alias("key"), F.to_json(value, {"ignoreNullFields": "true"}).alias("json"))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """JSON lines, a folder for each value of ``by`` (an engine, say)."""
    df.write.partitionBy(by).json(path)


def write_files(rows: DataFrame, folder: str, indent: int | None = 2) -> DataFrame:
    """One ``<key>.json`` a row of (key, json) under a folder that all executors reach (a
    URI that Arrow's file systems open, or a mounted path). Each row fails on its own:
    returns key, status, error. Files are written whole and renamed, so a task that runs
    again leaves the same files."""

    def run(batches: Iterator) -> Iterator:
        import os
        import uuid

        import pandas as pd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        store.create_dir(root, recursive=True)
        for pdf in batches:
            out = []
            for key, text in zip(pdf["key"], pdf["json"], strict=True):
                try:
                    if not key or "/" in key or key.startswith("."):
                        raise ValueError(f"not a file name: {key!r}")
                    data = json.dumps(json.loads(text), ensure_ascii=False, indent=indent).encode()
                    part = f"{root}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as f:
                        f.write(data)
                    store.move(part, f"{root}/{key}.json")
                    out.append((key, "ok", None))
                except Exception as e:  # noqa: BLE001  one row's fault is its own
                    out.append((key, "error", str(e)))
            yield pd.DataFrame(out, columns=["key", "status", "error"])

    return rows.mapInPandas(run, "key string, status string, error string")


def annotation_name(doc: Column, page_no: Column) -> Column:
    """SNK-03: the document's name, with ``_page_001`` and so on behind it unless it ends so."""
    return F.when(doc.rlike(r"_page_\d{3}$"), doc).otherwise(F.concat(doc, F.lit("_page_"), F.lpad((page_no + 1).cast("string"), 3, "0")))


def envelope(df: DataFrame, key: str, data: str, error: str) -> DataFrame:
    """SNK-07: id, status ("ok" or "error"), data, error."""
    bad = F.col(error).isNotNull()
    return df.select(F.col(key).alias("id"), F.when(bad, "error").otherwise("ok").alias("status"), F.when(~bad, F.col(data)).alias("data"), F.col(error).alias("error"))


def envelope_counts(rows: DataFrame) -> DataFrame:
    """SNK-07: how many rows are ok and how many are errors."""
    return rows.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"), F.count("*").alias("total"))
