"""Delimited text for spreadsheets: byte order mark, sep= line, quoted cells, decimal commas, guarded formulas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltspan.functions.text import csv_cell


def lines(df: DataFrame, comma: bool = True) -> DataFrame:
    """One line a row; nested values are JSON, numbers have decimal commas, what is missing or not finite is empty."""
    cells = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.FractionalType):
            finite = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c).cast("string")
            c = F.replace(finite, F.lit("."), F.lit(",")) if comma else finite
            cells.append(F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"')))
            continue
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        cells.append(csv_cell(c))
    return df.select(F.concat_ws(";", *cells).alias("value"))


def write_delimited(df: DataFrame, path: str) -> None:
    """A folder of files, each with its own mark, sep= line and header."""
    head = "﻿sep=;\n" + ";".join('"' + n.replace('"', '""') + '"' for n in df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    lines(df).mapInArrow(run, "value string").write.text(path)
