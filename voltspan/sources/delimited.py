"""Delimited text with a sep= line, decimal commas and rows of metadata."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltspan.functions import text


def _head(spark: SparkSession, path: str) -> list[str]:
    lines = [r[0] for r in spark.read.text(path).limit(2).collect()]
    return [lines[0].removeprefix("﻿"), *lines[1:]] if lines else []


def delimiter(lines: list[str]) -> str:
    """What the sep= line says, else the one of ; and , that the first line has more often."""
    if lines and lines[0].startswith("sep=") and len(lines[0]) > 4:
        return lines[0][4]
    return ";" if lines and lines[0].count(";") >= lines[0].count(",") else ","


def read_delimited(spark: SparkSession, path: str, numbers: list[str] | None = None) -> DataFrame:
    """Columns as the header names them, cells as text, and the named ones as numbers in either notation."""
    lines = _head(spark, path)
    sep = delimiter(lines)
    header = lines[1] if lines and lines[0].startswith("sep=") else lines[0] if lines else ""
    names = next(csv.reader([header], delimiter=sep), [])
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.csv(path, sep=sep, schema=schema, quote='"', escape='"', multiLine=True, mode="PERMISSIVE")
    first = F.col(f"`{names[0]}`")
    # Every file of the folder has these lines of its own.
    rows = rows.where(~F.coalesce(F.startswith(first, F.lit("sep=")) | F.startswith(first, F.lit("﻿sep=")) | (F.regexp_replace(first, "^﻿", "") == names[0]), F.lit(False)))
    return rows.withColumns({n: text.number(F.col(f"`{n}`")) for n in numbers or []})


def split_metadata(rows: DataFrame, kind: str = "kind") -> tuple[DataFrame, DataFrame]:
    """(data, metadata): rows of kind meta are apart."""
    meta = F.coalesce(F.col(kind) == "meta", F.lit(False))
    return rows.where(~meta), rows.where(meta)


def owners(rows: DataFrame, owner: str, key: str, value: str, fields: list[str]) -> DataFrame:
    """Long rows (owner, key, value) as one row an owner with a column for each field, n_fields, and the keys that it has twice."""
    twice = rows.groupBy(owner, key).agg(F.count("*").alias("_n"), F.max(value).alias("_v"))
    picked = [F.max(F.when(F.col(key) == f, F.col("_v"))).alias(f) for f in fields]
    return twice.groupBy(owner).agg(*picked, F.count("*").alias("n_fields"), F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.col(key)))).alias("duplicates"))
