"""Rows behind the counts: candidates, findings, readiness, islands, coordinates and windings one by one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltspan.operators import filters, graph, tours
from voltspan.operators.tables import settle
from voltspan.plans import outages, reports
from voltspan.plans.base import query

# Branches of orders are lines and transformers with an order's voltage; from 66 kV on they are in the reduced network.
_CANDIDATES = f"""{outages._NET},
k as (select e.*, case id % 8 when 2 then 'ElmTr2' else 'ElmLne' end class, case o_orderstatus when 'F' then 154.0 when 'O' then 380.0 else 33.0 end kv, o_totalprice > 20000 rated, o_orderpriority <> '5-LOW' live from e join orders on o_orderkey = id // 8 where id % 8 <> 3),
net as materialized (select a, b from k where kv >= 66 and live union all select a, b from e where id % 8 = 3),
p as materialized (select least(a, b) u, greatest(a, b) v, min(a) a, min(b) b, count(*) n from net where a <> b group by 1, 2),
d as materialized (select u, v, u x, v y from p union all select u, v, v, u from p),
ra as (select u, v, a tip from p where n = 1 union select ra.u, ra.v, d.y from ra join d on d.x = ra.tip where d.u <> ra.u or d.v <> ra.v),
cut as (select u, v from p where n = 1 and not exists (select 1 from ra where ra.u = p.u and ra.v = p.v and ra.tip = p.b))"""


@query(f"""with recursive {_CANDIDATES}
select class || ':' || k.id candidate, class, a, b, kv, rated, case when kv < 66 then 'UNSUPPORTED' when cut.u is not null then 'ISLANDING' else 'NON_ISLANDING' end topology, kv >= 66 and cut.u is null screenable,
case when kv < 66 then 'NOT_REPRESENTED' when cut.u is not null then 'OUTAGE_SPLITS_ISLAND' end reason from k left join cut on cut.u = least(a, b) and cut.v = greatest(a, b) where live""")
def candidate_rows(t):
    net = outages.network(t)
    of = t.orders.select(F.col("o_orderkey").alias("_k"), F.when(F.col("o_orderstatus") == "F", 154.0).when(F.col("o_orderstatus") == "O", 380.0).otherwise(33.0).alias("kv"), (F.col("o_totalprice") > 20000).alias("rated"), (F.col("o_orderpriority") != "5-LOW").alias("live"))
    k = settle(net.where("id % 8 <> 3").join(of, F.expr("id div 8") == F.col("_k")).where("live").select("id", F.when(F.col("id") % 8 == 2, "ElmTr2").otherwise("ElmLne").alias("class"), "a", "b", "kv", "rated"), "candidates")
    represented = k.where("kv >= 66").select("a", "b").unionByName(net.where("id % 8 = 3").select("a", "b"))
    cut = tours.bridges(represented).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.lit(True).alias("cut"))
    rows = k.join(cut, (F.least(k["a"], k["b"]) == F.col("u")) & (F.greatest(k["a"], k["b"]) == F.col("v")), "left")
    low, split = F.col("kv") < 66, F.coalesce("cut", F.lit(False))
    topology = F.when(low, "UNSUPPORTED").when(split, "ISLANDING").otherwise("NON_ISLANDING")
    return rows.select(F.concat_ws(":", "class", "id").alias("candidate"), "class", "a", "b", "kv", "rated", topology.alias("topology"), (topology == "NON_ISLANDING").alias("screenable"), F.when(low, "NOT_REPRESENTED").when(split, "OUTAGE_SPLITS_ISLAND").alias("reason"))


_KEYS = {"orders": ["o_orderkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]}


@query(" union all ".join(f"select '{s}' severity, '{c}' code, '{table}' class, concat_ws('-', {', '.join(_KEYS[table])}) id from {table} where {p}" for s, c, table, p in reports.RULES))
def finding_rows(t):
    found = []
    for table in sorted({r[2] for r in reports.RULES}):
        # One pass over a table serves all of its rules; a row has as many findings as rules that it breaks.
        broken = F.array_compact(F.array(*[F.when(F.expr(p), F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, name, p in reports.RULES if name == table]))
        rows = getattr(t, table).select(F.explode(broken).alias("f"), F.concat_ws("-", *_KEYS[table]).alias("id"))
        found.append(rows.select("f.severity", "f.code", F.lit(table).alias("class"), "id"))
    return reduce(DataFrame.unionByName, found)


#: class: table, key, and what each required field must hold for a solve.
REQUIRED = {
    "ElmLne": ("orders", "o_orderkey", {"from": "o_custkey is not null", "length": "o_totalprice > 1000", "type": "o_orderpriority <> '4-NOT SPECIFIED'", "service": "o_orderstatus <> 'P'"}),
    "ElmTerm": ("customer", "c_custkey", {"voltage": "c_acctbal > 0", "site": "c_nationkey is not null", "usage": "c_mktsegment <> 'FURNITURE'"}),
    "ElmSym": ("supplier", "s_suppkey", {"power": "s_acctbal > 500", "site": "s_nationkey is not null"}),
    "TypLne": ("part", "p_partkey", {"reactance": "p_retailprice > 1000", "current": "p_size > 5", "name": "length(p_name) > 0"}),
}


@query(" union all ".join(f"select '{c}' class, {key} id, case when len(m) = 0 then 'READY' when len(m) = {len(fields)} or list_contains(m, '{next(iter(fields))}') then 'BLOCKED' else 'PARTIAL' end status, array_to_string(m, ',') missing from (select {key}, list_filter([{', '.join(f'''case when not coalesce({p}, false) then '{f}' end''' for f, p in fields.items())}], lambda x: x is not null) m from {table})" for c, (table, key, fields) in REQUIRED.items()))
def readiness_rows(t):
    """Without its first field a row is blocked, and so it is without all of them; without others it is ready in part."""
    found = []
    for c, (table, key, fields) in REQUIRED.items():
        lacks = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(p), F.lit(False)), f) for f, p in fields.items()]))
        status = F.when(F.size("m") == 0, "READY").when((F.size("m") == len(fields)) | F.array_contains("m", next(iter(fields))), "BLOCKED").otherwise("PARTIAL")
        found.append(getattr(t, table).select(F.lit(c).alias("class"), F.col(key).alias("id"), lacks.alias("m")).select("class", "id", status.alias("status"), F.array_join("m", ",").alias("missing")))
    return reduce(DataFrame.unionByName, found)


# Without what belongs to customers of small balances, the network falls into more islands.
_ISLANDS = f"""{outages._NET}, live as materialized (select (c_custkey * 48271) % 2147483647 * 2 + 1 node, c_nationkey site from customer where c_acctbal > 500),
d as materialized (select a x, b y from e where (a % 2 = 0 or a in (select node from live)) and (b % 2 = 0 or b in (select node from live)) union all select b, a from e where (a % 2 = 0 or a in (select node from live)) and (b % 2 = 0 or b in (select node from live))),
r(node, island) using key (node) as (select distinct x, x from d union select d.y, min(r.island) from r join d on d.x = r.node join recurring.r q on q.node = d.y where r.island < q.island group by d.y),
l as (select live.node, site, coalesce(island, live.node) island from live left join r on r.node = live.node)"""


def _islands(t) -> tuple[DataFrame, DataFrame]:
    """(edges between nodes that are live; node and site of live customers)."""
    node = outages._node("c_custkey") + 1
    live = settle(t.customer.where("c_acctbal > 500").select(node.alias("node"), F.col("c_nationkey").alias("site")), "live")
    edges = outages.network(t)
    for end in "ab":
        held = live.select(F.col("node").alias(end), F.lit(True).alias("_live"))
        edges = edges.join(held, end, "left").where((F.col(end) % 2 == 0) | F.col("_live")).drop("_live")
    return settle(edges, "live-edges"), live


def _labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    labels = graph.components(edges)
    return nodes.join(labels, "node", "left").withColumn("island", F.coalesce("component", "node")).drop("component")


@query(f"with recursive {_ISLANDS}, g as (select site, island, count(*) n from l group by 1, 2) select site, arg_min(island, (-n, island)) dominant, max(n)::bigint n_dominant, count(*)::bigint n_islands, sum(n)::bigint n_buses from g group by 1")
def site_islands(t):
    of = _labelled(*_islands(t)).groupBy("site", "island").agg(F.count("*").alias("n"))
    return of.groupBy("site").agg(F.min_by("island", F.struct(-F.col("n"), "island")).alias("dominant"), F.max("n").alias("n_dominant"), F.count("*").alias("n_islands"), F.sum("n").alias("n_buses"))


@query(f"with recursive {_ISLANDS} select e.id, r.island, case when s.site = u.site then s.site end site from e join r on r.node = e.a left join live s on s.node = e.a left join live u on u.node = e.b where e.id % 8 = 3 and e.a in (select node from live) and e.b in (select node from live)")
def line_islands(t):
    edges, live = _islands(t)
    lines = edges.where("id % 8 = 3")
    placed = _labelled(edges, lines.select(F.col("a").alias("node"), "id", F.col("b").alias("_b")))
    placed = placed.join(live, "node", "left").join(live.select(F.col("node").alias("_b"), F.col("site").alias("_site")), "_b", "left")
    return placed.select("id", "island", F.when(F.col("site") == F.col("_site"), F.col("site")).alias("site"))


# A supplier's items say where it stands; few of them say something else or nothing.
_PLACED = """c as (select l_suppkey site, case when l_quantity = 50 then null when l_discount = 0.1 and l_tax = 0.08 then 31.5 + l_suppkey % 7 else 30 + l_suppkey * 37 % 1600 / 100.0 end lat, case when l_quantity = 50 then null when l_tax = 0 and l_discount > 0.08 and l_suppkey % 3 = 0 then 24.0 else 25 + l_suppkey * 91 % 2000 / 100.0 end lon from lineitem)"""


@query(f"""with {_PLACED}, g as (select site, count(*) n, count(*) filter (lat is null or lon is null) n_missing, count(*) filter (not (lat between 30 and 46 and lon between 25 and 46)) n_outside, max(lat) - min(lat) dlat, max(lon) - min(lon) dlon, count(distinct (lat, lon)) filter (lat is not null and lon is not null) places from c group by 1)
select s_suppkey site, coalesce(n, 0)::bigint n, coalesce(n_missing, 0)::bigint n_missing, coalesce(n_outside, 0)::bigint n_outside, coalesce(places, 0)::bigint places, round(dlat, 6) dlat, round(dlon, 6) dlon,
case when n is null or n = n_missing then 'MISSING' when n_outside > 0 then 'OUT_OF_BOUNDS' when greatest(dlat, dlon) > 0.01 then 'CONFLICTING' else 'OK' end status from supplier left join g on g.site = s_suppkey""")
def coordinate_rows(t):
    k, q = F.col("l_suppkey"), F.col("l_quantity")
    lat = F.when(q == 50, None).when((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08), 31.5 + k % 7).otherwise(30 + k * 37 % 1600 / 100)
    lon = F.when(q == 50, None).when((F.col("l_tax") == 0) & (F.col("l_discount") > 0.08) & (k % 3 == 0), 24.0).otherwise(25 + k * 91 % 2000 / 100)
    c = t.lineitem.select(k.alias("site"), lat.alias("lat"), lon.alias("lon"))
    whole = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    g = c.groupBy("site").agg(F.count("*").alias("n"), F.count_if(~whole).alias("n_missing"), F.count_if(~(F.col("lat").between(30, 46) & F.col("lon").between(25, 46))).alias("n_outside"), (F.max("lat") - F.min("lat")).alias("dlat"), (F.max("lon") - F.min("lon")).alias("dlon"), F.count_distinct(F.when(whole, F.struct("lat", "lon"))).alias("places"))
    rows = t.supplier.select(F.col("s_suppkey").alias("site")).join(g, "site", "left").na.fill(0, ["n", "n_missing", "n_outside", "places"])
    status = filters.first_reason({"MISSING": F.col("n") == F.col("n_missing"), "OUT_OF_BOUNDS": F.col("n_outside") > 0, "CONFLICTING": F.greatest("dlat", "dlon") > 0.01}, "OK")
    return rows.select("site", "n", "n_missing", "n_outside", "places", F.round("dlat", 6).alias("dlat"), F.round("dlon", 6).alias("dlon"), status.alias("status"))


@query("""with w as (select l_orderkey o, l_linenumber ln, l_partkey pk, l_suppkey winding, case when l_tax = 0.08 then l_suppkey + 1 when l_discount = 0 then null else l_suppkey end cubicle from lineitem),
x as (select w.*, c.s_nationkey cubicle_site, s.s_nationkey winding_site from w left join supplier c on c.s_suppkey = cubicle left join supplier s on s.s_suppkey = winding)
select 'W' || concat_ws('-', o, ln, pk, winding) id, winding, cubicle, cubicle_site site, case when cubicle is null then 'NO_CUBICLE' when cubicle_site is null then 'CUBICLE_UNKNOWN' when cubicle_site <> winding_site then 'STATION_PROJECTION_MISMATCH' when cubicle <> winding then 'IMPORT_MAPPING_MISMATCH' else 'AGREES' end status from x""")
def winding_rows(t):
    k = F.col("l_suppkey")
    cubicle = F.when(F.col("l_tax") == 0.08, k + 1).when(F.col("l_discount") != 0, k)
    w = t.lineitem.select(F.concat(F.lit("W"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("id"), k.alias("winding"), cubicle.alias("cubicle"))
    of = lambda c: t.supplier.select(F.col("s_suppkey").alias(c), F.col("s_nationkey").alias(f"{c}_site"))
    x = w.join(of("cubicle"), "cubicle", "left").join(of("winding"), "winding", "left")
    gates: dict[str, Column] = {
        "NO_CUBICLE": F.col("cubicle").isNull(),
        "CUBICLE_UNKNOWN": F.col("cubicle_site").isNull(),
        "STATION_PROJECTION_MISMATCH": F.col("cubicle_site") != F.col("winding_site"),
        "IMPORT_MAPPING_MISMATCH": F.col("cubicle") != F.col("winding"),
    }
    return x.select("id", "winding", "cubicle", F.col("cubicle_site").alias("site"), filters.first_reason(gates, "AGREES").alias("status"))
