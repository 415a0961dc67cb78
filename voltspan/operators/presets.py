"""Column presets of results, and cells of raw tables with what is known about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The metrics that a tab shows for branches and buses, in order.
BRANCH = {
    "results": ["name", "voltage", "p", "q", "pt", "qt", "pLoss", "qLoss", "loading", "state"],
    "delta": ["name", "voltage", "baseP", "baseQ", "baseLoad", "scenarioP", "scenarioQ", "scenarioLoad", "deltaP", "deltaQ", "deltaLoad", "deltaPLoss", "deltaQLoss"],
    "energize": ["name", "voltage", "state"],
}
BUS = {
    "results": ["name", "voltage", "v", "vKv", "angle", "p", "q", "state"],
    "delta": ["name", "voltage", "baseV", "baseAngle", "v", "angle", "deltaV", "deltaAngle"],
    "energize": ["name", "voltage", "state"],
}
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def preset(kind: str, tab: str) -> list[str]:
    """Metrics of a tab (results, delta, energize) for a kind (line, trafo, bus)."""
    return (BUS if kind == "bus" else BRANCH)[tab]


def shown(rows: DataFrame, key: str, kind: str, tab: str) -> DataFrame:
    """key, place, metric, value: what the tab shows of each row, as text; a metric that rows lack is null."""
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("metric"), (F.col(m).cast("string") if m in rows.columns else F.lit(None).cast("string")).alias("value")) for i, m in enumerate(preset(kind, tab))])
    return rows.select(key, F.explode(cells).alias("c")).select(key, "c.*")


def letters(place: int) -> str:
    """A1 letters of a column counted from 1."""
    out = ""
    while place:
        place, last = divmod(place - 1, 26)
        out = chr(65 + last) + out
    return out


def cell(raw: Column) -> Column:
    """Struct of a raw text: value, text, availability and flags. Null and empty cells were not recorded."""
    text = F.coalesce(raw, F.lit(""))
    number = F.when(F.trim(text).rlike(_NUMBER), F.trim(text).cast("double"))
    availability = F.when(text == "", "NOT_RECORDED").when(number == 0, "RECORDED_NUMERIC_ZERO").when(number.isNotNull(), "RECORDED").otherwise("INVALID")
    flag = F.when(availability == "INVALID", "NON_NUMERIC").when((F.abs(number) == 9999) | (F.abs(number) >= 99999), "SENTINEL_CANDIDATE")
    return F.struct(number.alias("value"), text.alias("text"), availability.alias("availability"), F.array_compact(F.array(flag)).alias("flags"))


def read_cells(table: DataFrame, key: str, headers: list[str], fields: list[str]) -> DataFrame:
    """key, field, letter, value, text, availability, flags of fields of a raw table whose columns stand as headers say.

    A field that the table lacks has cells that say so."""
    missing = F.struct(F.lit(None).cast("double").alias("value"), F.lit("").alias("text"), F.lit("MISSING_ATTRIBUTE").alias("availability"), F.array(F.lit("MISSING_ATTRIBUTE")).alias("flags"))
    cells = [F.struct(F.lit(f).alias("field"), F.lit(letters(headers.index(f) + 1) if f in headers else "").alias("letter"), (cell(F.col(f)) if f in headers else missing).alias("c")) for f in fields]
    return table.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.field", "x.letter", "x.c.*")
