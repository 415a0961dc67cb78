"""Filters with explicit rules for what is unknown, ordered reasons, and derived columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The map's bounds, values that stand for unknown ones, and the least impedance of a branch.
LATITUDES, LONGITUDES = (30, 46), (25, 46)
SENTINEL, UNLIMITED = 9999, 99999
LEAST_IMPEDANCE = 1e-6


def has_any(values: Column | str, wanted: Iterable) -> Column:
    """Whether a multi-valued column holds one of the wanted values."""
    return F.arrays_overlap(values, F.array(*map(F.lit, wanted)))


def in_area(df: DataFrame, sites: str, area: DataFrame) -> DataFrame:
    """Rows of which any site is in the area (one column of sites)."""
    key = area.columns[0]
    hit = df.select(F.col(sites).alias("_sites")).distinct().withColumn("_site", F.explode("_sites")).join(area.select(F.col(key).alias("_site")).distinct(), "_site", "left_semi").select("_sites").distinct()
    return df.join(hit, F.col(sites) == F.col("_sites"), "left_semi")


def in_ranges(value: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    return reduce(Column.__or__, (value.between(a, b) for a, b in ranges), F.lit(False))


def endpoint_scope(a: Column, b: Column, areas: Sequence) -> Column:
    """INTERNAL, BOUNDARY or OUTSIDE of the areas, from the areas of both ends; UNKNOWN unless each end has just one."""
    known = (F.size(a) == 1) & (F.size(b) == 1)
    inside = [F.coalesce(F.try_element_at(x, F.lit(1)).isin(*areas), F.lit(False)) for x in (a, b)]
    return F.when(~known, "UNKNOWN").when(inside[0] & inside[1], "INTERNAL").when(inside[0] | inside[1], "BOUNDARY").otherwise("OUTSIDE")


def multi_select(df: DataFrame, chosen: Sequence[tuple[Column, Sequence]]) -> DataFrame:
    """Every column has one of its chosen values; none chosen is no filter."""
    for column, values in chosen:
        if values:
            df = df.where(column.isin(*values))
    return df


def critical(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def scoped(df: DataFrame, site: str, sites: Sequence | None) -> DataFrame:
    """No scope keeps all rows; any scope drops those without a site."""
    return df if sites is None else df.where(F.col(site).isNotNull() & F.col(site).isin(*sites))


def area_scope(area: Column, mode: str, areas: Sequence = ()) -> Column:
    """ALL, NONE (nothing, rather than everything) or SELECTED."""
    return {"ALL": F.lit(True), "NONE": F.lit(False)}.get(mode, area.isin(*areas) if areas else F.lit(False))


def on_map(lat: Column, lon: Column) -> Column:
    return lat.between(*LATITUDES) & lon.between(*LONGITUDES)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def branch_gate(r: Column, x: Column, tap: Column) -> Column:
    """Why a branch can't be solved, or OK."""
    return first_reason({"NOT_FINITE": ~finite(r) | ~finite(x), "ZERO_IMPEDANCE": F.sqrt(r * r + x * x) < LEAST_IMPEDANCE, "TAP": tap <= 0})


def is_sentinel(x: Column) -> Column:
    return F.coalesce((F.abs(x) == SENTINEL) | (F.abs(x) >= UNLIMITED), F.lit(False))


def without_sentinel(x: Column) -> Column:
    return F.when(~is_sentinel(x), x)


def staleness(results: DataFrame, current: DataFrame, key: str, identity: Sequence[str]) -> DataFrame:
    """key, state: CURRENT where all of the identity is equal (null equals null), STALE, or NONE without a counterpart."""
    b = current.select(key, F.struct(*identity).alias("_b"))
    same = reduce(Column.__and__, (F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in identity))
    joined = results.select(key, F.struct(*identity).alias("_a")).join(b, key, "left")
    return joined.select(key, F.when(F.col("_b").isNull(), "NONE").when(same, "CURRENT").otherwise("STALE").alias("state"))


def arrow(*ends: Column) -> Column:
    return F.array_join(F.array(*(F.coalesce(e.cast("string"), F.lit("—")) for e in ends)), " → ")


def decoded(code: Column, labels: Mapping[str, str]) -> Column:
    """The label of a code, or the code."""
    out = code
    for k, v in labels.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def fidelity(df: DataFrame, key: Sequence[str], flaws: Mapping[str, Column]) -> DataFrame:
    """How often each flaw occurs, and SOURCE_EXACT where none does."""
    any_flaw = reduce(Column.__or__, flaws.values())
    return df.groupBy(*key).agg(*(F.count_if(c).cast("long").alias(k) for k, c in flaws.items()), F.when(F.count_if(any_flaw) == 0, "SOURCE_EXACT").otherwise("PARTIAL").alias("fidelity"))


def first_reason(gates: Mapping[str, Column], ok: str = "OK") -> Column:
    """The first gate that holds; an unknown one doesn't."""
    out = F
    for name, gate in gates.items():
        out = out.when(gate, name)
    return out.otherwise(ok)


def reasons(gates: Mapping[str, Column]) -> Column:
    """All gates that hold, in their order."""
    return F.array_compact(F.array(*(F.when(gate, name) for name, gate in gates.items())))


def loading(at_from: Column, at_to: Column, limit: Column, converged: Column) -> tuple[Column, Column]:
    """Percent of the limit that the greater end takes, and why there is none."""
    reason = first_reason({"NOT_CONVERGED": ~converged, "UNKNOWN_CAPACITY": F.coalesce(limit, F.lit(0.0)) == 0})
    return F.when(reason == "OK", 100 * F.greatest(at_from, at_to) / limit), reason


def seasonal_limit(season: str) -> tuple[Column, Column, Column]:
    """Of columns manual, nominal and the season's: the limit, what it rests on, and whether nominal and summer agree."""
    limit = F.coalesce("manual", season, "nominal")
    basis = F.when(F.col("manual").isNotNull(), "MANUAL").when(F.col(season).isNotNull(), season.upper()).otherwise("NOMINAL")
    return limit, basis, F.coalesce(F.abs(F.col("nominal") - F.col("summer")) <= 1, F.lit(False))
