"""Map layers: suppliers are sites, line items have values there, and suppliers that follow each other in an order are linked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltspan.operators import maps
from voltspan.operators.tables import settle
from voltspan.plans.base import query

# Places from the supplier's number; some lie outside of the bounds, and suppliers in debt have none.
_SITES = """s as (select s_suppkey site, case when s_acctbal > -500 then 29 + s_suppkey * 37 % 1700 / 100.0 end lat, 25 + s_suppkey * 91 % 2100 / 100.0 lon from supplier),
p as (select *, lat between 30 and 46 and lon between 25 and 46 good, least(floor((lon - 25) / 21 * 64), 63)::bigint x, least(floor((lat - 30) / 16 * 64), 63)::bigint y from s)"""


def _key(x: str, y: str) -> str:
    return " + ".join(f"(({x} >> {b}) & 1) * {1 << (2 * b)} + (({y} >> {b}) & 1) * {1 << (2 * b + 1)}" for b in range(6))


def _sites(t) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("site"), F.when(F.col("s_acctbal") > -500, 29 + k * 37 % 1700 / 100).alias("lat"), (25 + k * 91 % 2100 / 100).alias("lon"))


@query(f"""with {_SITES}, v as (select l_suppkey site, l_orderkey || '-' || l_linenumber || '-' || l_partkey fid, case when l_tax > 0.04 then '154' when l_tax > 0 then '33' else 'UNKNOWN' end kv, 0.9 + l_discount * 2 as value from lineitem where not (l_returnflag = 'R' and l_quantity = 50)),
g as (select site, min(value) low, max(value) high, count(*) n, arg_min(struct_pack(v := value, f := fid), (-abs(value - 1), fid)) w from v group by 1),
k as (select site, string_agg(kv || ':' || round(low, 4)::varchar || ':' || round(high, 4)::varchar, ' ' order by kv) levels from (select site, kv, min(value) low, max(value) high from v group by 1, 2) group by 1)
select case when good then {_key('x', 'y')} end::bigint cell, p.site, round(w.v, 6) as value, w.f fid, round(low, 6) low, round(high, 6) high, coalesce(n, 0)::bigint n, levels from p left join g using (site) left join k using (site)""")
def map_sites(t):
    value = F.when(~((F.col("l_returnflag") == "R") & (F.col("l_quantity") == 50)), 0.9 + F.col("l_discount") * 2)
    values = t.lineitem.select(F.col("l_suppkey").alias("site"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("fid"), F.when(F.col("l_tax") > 0.04, 154.0).when(F.col("l_tax") > 0, 33.0).alias("kv"), value.alias("value"))
    found = maps.site_layer(values, _sites(t))
    text = F.array_join(F.transform("levels", lambda x: F.concat_ws(":", x["kv"], F.round(x["low"], 4), F.round(x["high"], 4))), " ")
    return found.withColumns({c: F.round(c, 6) for c in ("value", "low", "high")}).withColumn("levels", text)


_BRANCHES = f"""with {_SITES}, f as (select l_suppkey a, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) b, l_quantity q from lineitem),
e as (select least(a, b) a, greatest(a, b) b, sum(q) as value, count(*) n from f where a <> b group by 1, 2),
w as (select e.*, i.x x0, i.y y0, j.x x1, j.y y1, coalesce(i.good and j.good, false) good, greatest(abs(j.x - i.x), abs(j.y - i.y)) m from e join p i on i.site = a join p j on j.site = b),
c as (select *, unnest(case when good then range(m + 1) else [null] end) i from w),
d as (select *, case when m = 0 then x0 else x0 + floor((2 * i * (x1 - x0) + m) / (2 * m))::bigint end x, case when m = 0 then y0 else y0 + floor((2 * i * (y1 - y0) + m) / (2 * m))::bigint end y from c),
b as materialized (select case when i is not null then {_key('x', 'y')} end::bigint cell, i::int part, a, b, value, n from d)"""


@query(f"{_BRANCHES} select * from b")
def map_branches(t):
    return maps.branch_layer(_edges(t), _sites(t))


def _edges(t) -> DataFrame:
    after = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = t.lineitem.select(F.col("l_suppkey").alias("x"), after.alias("y"), "l_quantity").where("x <> y")
    return rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("l_quantity").alias("value"), F.count("*").alias("n"))


@query(f"""{_BRANCHES}, q as (select site, {_key('x', 'y')} cell from p where good)
select q.cell::bigint cell, site, count(*) filter (a <> site and b.b <> site) n, case when count(*) filter (a = site or b.b = site) = 0 then max(value) end as value from q join b on b.cell = q.cell group by 1, 2""")
def map_passed(t):
    return maps.passing(_sites(t), settle(_edges(t), "branches"))


@query(f"""with {_SITES}, f as (select l_suppkey a, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) b, l_quantity q from lineitem),
e as (select sum(q) - 300 as value from f where a <> b group by least(a, b), greatest(a, b))
select (select list_sort(list(abs(value)))[ceil(count(*) * 0.95)::int] from e) p95, min(value) low, max(value) high from e""")
def map_scale(t):
    after = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = t.lineitem.select(F.col("l_suppkey").alias("x"), after.alias("y"), "l_quantity").where("x <> y")
    return maps.scale(rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg((F.sum("l_quantity") - 300).alias("value")))


# An order asks for a layer; customer, price and date say what is there for it.
_ASKED = """select o_orderkey, case left(o_orderpriority, 1) when '1' then 'LF' when '2' then 'N1' when '3' then 'SC' else 'LF' end analysis,
case o_orderstatus when 'F' then 'PF' when 'O' then 'GA' else case when o_orderpriority = '5-LOW' then 'EXPLORATORY_DELTA' when o_orderpriority = '4-NOT SPECIFIED' then 'SCENARIO_DELTA' else 'DELTA' end end source,
case c_mktsegment when 'BUILDING' then 'voltagePu' when 'MACHINERY' then 'skssMva' when 'AUTOMOBILE' then 'postPmw' else 'ikssKa' end metric,
c_acctbal > -800 model, c_acctbal > -500 reference, c_acctbal > 0 slot, month(o_orderdate) < 10 lf_current, month(o_orderdate) > 2 sc_current, month(o_orderdate) > 4 n1_current, month(o_orderdate) = 12 n1_post, year(o_orderdate) % 2 = 0 scenario_changed, o_totalprice > 100000 comparable, o_totalprice > 200000 matched, o_totalprice < 400000 diagnostic, day(o_orderdate) < 5 sc_min from orders join customer on c_custkey = o_custkey"""


@query(f"""with s as ({_ASKED}), r as (select o_orderkey, analysis, source, metric, case when not model then 'MODEL_NOT_LOADED'
when source = 'SCENARIO_DELTA' then case when analysis = 'LF' and lf_current and scenario_changed then '' else 'GA_LF_NOT_CALCULATED_OR_STALE' end
when source <> 'GA' and not reference then 'PF_NOT_LOADED' when source <> 'GA' and not slot then 'PF_REFERENCE_SLOT_NOT_LOADED'
when source = 'EXPLORATORY_DELTA' then case when not diagnostic then 'DIAGNOSTIC_OPT_IN_REQUIRED' when analysis = 'LF' and not lf_current then 'GA_LF_NOT_CALCULATED_OR_STALE' when scenario_changed then 'PF_SCENARIO_IDENTITY_UNVERIFIED' when matched then '' else 'NO_IDENTITY_MATCHED_DIAGNOSTIC_CELLS' end
when analysis = 'SC' then case source when 'DELTA' then 'GA_IEC60909_METHOD_AND_EDITION_UNVERIFIED' when 'PF' then case when metric = 'skssMva' then 'PF_SKSS_REFERENCE_NOT_AVAILABLE' when sc_min then 'PF_SC_MIN_REFERENCE_NOT_AVAILABLE' else '' end else case when not sc_current then 'GA_IEC60909_NOT_COMPUTABLE' when metric not in ('ikssKa', 'maxIkssKa', 'ikss3FKa', 'skssMva') then 'SC_METRIC_NOT_IMPLEMENTED' else '' end end
when analysis = 'N1' then case when source = 'DELTA' then 'NOT_COMPARABLE_PF_MISSING' when source = 'GA' and not n1_post and not n1_current then 'GA_N1_NOT_CALCULATED_OR_STALE' when source = 'GA' and not n1_post and metric not in ('postLoadingPercent', 'postPmw') then 'GA_DC_P_ONLY' else '' end
when source = 'GA' and not lf_current then 'GA_LF_NOT_CALCULATED' when source = 'DELTA' and not lf_current then 'GA_LF_NOT_CALCULATED_OR_STALE' when source = 'DELTA' and not comparable then 'METHOD_MISMATCH' else '' end reason from s)
select *, reason = '' enabled from r""")
def map_gates(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    digit, segment, month = F.substring("o_orderpriority", 1, 1), F.col("c_mktsegment"), F.month("o_orderdate")
    priority, price = F.col("o_orderpriority"), F.col("o_totalprice")
    asked = o.select(
        "o_orderkey",
        F.when(digit == "2", "N1").when(digit == "3", "SC").otherwise("LF").alias("analysis"),
        F.when(F.col("o_orderstatus") == "F", "PF").when(F.col("o_orderstatus") == "O", "GA").when(priority == "5-LOW", "EXPLORATORY_DELTA").when(priority == "4-NOT SPECIFIED", "SCENARIO_DELTA").otherwise("DELTA").alias("source"),
        F.when(segment == "BUILDING", "voltagePu").when(segment == "MACHINERY", "skssMva").when(segment == "AUTOMOBILE", "postPmw").otherwise("ikssKa").alias("metric"),
        *[(F.col("c_acctbal") > least).alias(name) for name, least in (("model", -800), ("reference", -500), ("slot", 0))],
        (month < 10).alias("lf_current"), (month > 2).alias("sc_current"), (month > 4).alias("n1_current"), (month == 12).alias("n1_post"), (F.year("o_orderdate") % 2 == 0).alias("scenario_changed"),
        (price > 100000).alias("comparable"), (price > 200000).alias("matched"), (price < 400000).alias("diagnostic"), (F.dayofmonth("o_orderdate") < 5).alias("sc_min"),
    )
    return maps.gated(asked).select("o_orderkey", "analysis", "source", "metric", "reason", "enabled")
