"""Model files: one JSON object whose members are class tables {Attributes, Values}, and the network that they describe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHAPE = "map<string, struct<Attributes: array<string>, Values: array<array<string>>>>"
#: The class that is a matrix of numbers and has no identifiers.
PLAIN = "Matrix"


@dataclass
class Model:
    """tables: hash, class, attributes, values (null where the shape is wrong). rows: hash, class, row, cells."""

    tables: DataFrame
    rows: DataFrame

    def table(self, name: str) -> DataFrame:
        """Rows of a class with its cells; of a repeated FID the last one."""
        rows = self.rows.where(F.col("class") == name).withColumn("FID", _text("FID")).where("FID is not null")
        last = Window.partitionBy("hash", "FID").orderBy(F.desc("row"))
        return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")

    def counts(self) -> DataFrame:
        return self.rows.groupBy("hash", "class").agg(F.count("*").alias("n"))

    def issues(self) -> DataFrame:
        """hash, class, id, row, issue: tables of a wrong shape, rows without an FID, and repeated ones from the second on."""
        shape = self.tables.where("attributes is null or values is null").select("hash", "class", F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("row"), F.lit("INVALID_TABLE").alias("issue"))
        known = self.rows.where(F.col("class") != PLAIN).where(F.col("has_fid"))
        lacks = known.where(_text("FID").isNull()).select("hash", "class", F.lit(None).cast("string").alias("id"), "row", F.lit("MISSING_FID").alias("issue"))
        again = known.withColumn("id", _text("FID")).where("id is not null").withColumn("_n", F.row_number().over(Window.partitionBy("hash", "class", "id").orderBy("row"))).where("_n > 1")
        return shape.unionByName(lacks).unionByName(again.select("hash", "class", "id", "row", F.lit("DUPLICATE_FID").alias("issue")))


def read_model(spark: SparkSession, path: str) -> Model:
    """Model files under a path; hash is the SHA-256 of a file's bytes, and a byte order mark is no part of its text."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    raw = raw.select(F.sha2("content", 256).alias("hash"), F.when(F.startswith(text, F.lit("﻿")), F.substring(text, 2, 2**31 - 1)).otherwise(text).alias("text"))
    tables = raw.select("hash", F.explode(F.from_json("text", _SHAPE)).alias("class", "t")).select("hash", "class", F.col("t.Attributes").alias("attributes"), F.col("t.Values").alias("values"))
    good = tables.where("attributes is not null and values is not null")
    rows = good.select("hash", "class", "attributes", F.array_contains("attributes", "FID").alias("has_fid"), F.posexplode("values").alias("row", "v")).where("v is not null")
    # A repeated attribute counts where it stands last; cells beyond the header have no name.
    pairs = F.transform(F.sequence(F.lit(0), F.size("attributes") - 1), lambda i: F.struct(F.get("attributes", i).alias("key"), F.get("v", i).alias("value")))
    kept = F.filter(F.when(F.size("attributes") > 0, pairs), lambda p, i: ~F.exists(F.slice("attributes", i + 2, F.size("attributes")), lambda a: a == p["key"]))
    return Model(tables, rows.select("hash", "class", "has_fid", "row", F.map_from_entries(kept).alias("cells")))


def _text(name: str) -> Column:
    """An identifier or a reference: text that isn't blank."""
    return F.nullif(F.trim(F.col("cells")[name]), F.lit(""))


def number(name: str) -> Column:
    """A finite number, or null."""
    x = F.col("cells")[name].try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _named(df: DataFrame) -> DataFrame:
    return df.select("hash", F.col("FID").alias("id"), F.coalesce(F.col("cells")["loc_name"], F.lit("")).alias("name"), (F.coalesce(number("outserv"), F.lit(0.0)) != 1).alias("in_service"), "cells")


def _endpoint(df: DataFrame, cubicles: DataFrame, field: str, name: str) -> DataFrame:
    """Adds the terminal that a reference to a cubicle leads to."""
    c = cubicles.select("hash", F.col("FID").alias("_cubicle"), F.col("cells")["fold_id"].alias(name))
    return df.withColumn("_cubicle", _text(field)).join(c, ["hash", "_cubicle"], "left").drop("_cubicle")


def canonical(model: Model) -> dict[str, DataFrame]:
    """Typed collections: buses, lines, transformers, loads, generators, grids, shunts, switches and sites."""
    cubicles, types = model.table("StaCubic"), {k: model.table(k) for k in ("TypLne", "TypTr2")}
    buses = _named(model.table("ElmTerm")).select("hash", "id", "name", "in_service", F.coalesce(number("uknom"), F.lit(0.0)).alias("kv"), number("iUsage").alias("usage"), _text("fold_id").alias("parent"))
    two = lambda cls, a, b: _endpoint(_endpoint(_named(model.table(cls)), cubicles, a, "from"), cubicles, b, "to")
    one = lambda cls: _endpoint(_named(model.table(cls)), cubicles, "bus1", "bus")
    return {
        "buses": buses,
        "lines": _lines(model, two("ElmLne", "bus1", "bus2"), buses, types["TypLne"]),
        "transformers": _transformers(two("ElmTr2", "bushv", "buslv"), types["TypTr2"]),
        "loads": one("ElmLod").select("hash", "id", "name", "in_service", "bus", F.coalesce(number("plini"), F.lit(0.0)).alias("p"), F.coalesce(number("qlini"), F.lit(0.0)).alias("q")),
        "generators": one("ElmSym").select("hash", "id", "name", "in_service", "bus", F.coalesce(number("pgini"), F.lit(0.0)).alias("p"), F.coalesce(number("qgini"), F.lit(0.0)).alias("q"), number("usetp").alias("v_set")),
        "grids": one("ElmXnet").select("hash", "id", "name", "in_service", "bus", number("usetp").alias("v_set"), number("snss").alias("s_short")),
        "shunts": one("ElmShnt").select("hash", "id", "name", "in_service", "bus", number("qcapn").alias("q_rated"), number("ushnm").alias("kv_rated")),
        "switches": two("ElmCoup", "bus1", "bus2").select("hash", "id", "name", "in_service", "from", "to", (number("on_off") == 1).alias("closed"), F.col("cells")["aUsage"].alias("usage")),
        "sites": _named(model.table("ElmSite")).select("hash", "id", "name", _text("fold_id").alias("area"), F.col("cells")["sType"].alias("kind")),
    }


def _lines(model: Model, lines: DataFrame, buses: DataFrame, types: DataFrame) -> DataFrame:
    """Impedances are sums over sections of length times a type's values, a line without sections being one itself; the rating is
    the least of sqrt(3) kV kA. Sections whose type is unknown add nothing and are counted."""
    sections = model.table("ElmLnesec").select("hash", _text("fold_id").alias("id"), _text("typ_id").alias("typ"), F.coalesce(number("dline"), F.lit(0.0)).alias("km"))
    whole = lines.join(sections.select("hash", "id").distinct(), ["hash", "id"], "left_anti").select("hash", "id", _text("typ_id").alias("typ"), F.coalesce(number("dline"), F.lit(0.0)).alias("km"))
    value = lambda k: F.coalesce(number(k), F.lit(0.0))
    typ = types.select("hash", F.col("FID").alias("typ"), value("rline").alias("r"), value("xline").alias("x"), value("bline").alias("b"), value("sline").alias("ka"), value("uline").alias("type_kv"))
    kv = buses.select("hash", F.col("id").alias("from"), F.col("kv").alias("bus_kv"))
    own = lines.select("hash", "id", "name", "in_service", "from", "to", F.coalesce(number("dline"), F.lit(0.0)).alias("length_km"), _text("typ_id").alias("main"))
    own = own.join(kv, ["hash", "from"], "left").join(typ.select("hash", F.col("typ").alias("main"), F.col("type_kv")), ["hash", "main"], "left")
    own = own.withColumn("kv", F.coalesce(F.nullif("bus_kv", F.lit(0.0)), "type_kv", F.lit(0.0)))
    parts = sections.withColumn("section", F.lit(1)).unionByName(whole.withColumn("section", F.lit(0))).join(typ.drop("type_kv"), ["hash", "typ"], "left")
    total = parts.groupBy("hash", "id").agg(F.coalesce(F.sum(F.col("r") * F.col("km")), F.lit(0.0)).alias("r_ohm"), F.coalesce(F.sum(F.col("x") * F.col("km")), F.lit(0.0)).alias("x_ohm"), F.coalesce(F.sum(F.col("b") * F.col("km") * 1e-6), F.lit(0.0)).alias("b_siemens"), F.min(F.when(F.col("ka") > 0, F.col("ka"))).alias("_ka"), F.sum("section").alias("n_sections"), F.count_if(F.col("r").isNull()).alias("n_untyped"))
    return own.join(total, ["hash", "id"], "left").select("hash", "id", "name", "in_service", "from", "to", "kv", "length_km", "r_ohm", "x_ohm", "b_siemens", (F.sqrt(F.lit(3.0)) * F.col("kv") * F.col("_ka")).alias("rating_mva"), "n_sections", "n_untyped")


def _transformers(units: DataFrame, types: DataFrame) -> DataFrame:
    """Per-unit values on 100 MVA: r from the copper losses, x from the rest of the short-circuit voltage, g and b from the iron
    losses and the no-load current."""
    t = types.select("hash", F.col("FID").alias("typ"), *(number(k).alias(k) for k in ("strn", "uktr", "pcutr", "pfe", "curmg", "utrn_h", "utrn_l")))
    s = F.when(F.col("strn") > 0, F.col("strn"))
    r, z = F.coalesce("pcutr", F.lit(0.0)) / (1000 * s), F.coalesce("uktr", F.lit(0.0)) / 100
    g, i0 = F.coalesce("pfe", F.lit(0.0)) / (1000 * s), F.coalesce("curmg", F.lit(0.0)) / 100
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    joined = units.withColumn("typ", _text("typ_id")).join(t, ["hash", "typ"], "left")
    return joined.select("hash", "id", "name", "in_service", "from", "to", F.col("utrn_h").alias("kv_high"), F.col("utrn_l").alias("kv_low"), F.col("strn").alias("s_rated"), (r * 100 / s).alias("r_pu"), (root(z * z - r * r) * 100 / s).alias("x_pu"), (g * s / 100).alias("g_pu"), (-root(i0 * i0 - g * g) * s / 100).alias("b_pu"))
