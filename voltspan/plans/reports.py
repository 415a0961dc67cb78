"""Enriched rows, exports, audits and study steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.functions import text
from voltspan.operators import graph, kernels
from voltspan.plans import network
from voltspan.plans.base import n, query


@query("select l_orderkey, l_linenumber, l_partkey, sn.n_name from_site, case when l_orderkey % 13 = 0 then null else cn.n_name end to_site, p_brand as type_name, p_retailprice rating from lineitem join supplier on s_suppkey = l_suppkey join nation sn on sn.n_nationkey = s_nationkey left join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey left join nation cn on cn.n_nationkey = c_nationkey left join part on p_partkey = l_partkey")
def endpoint_names(t):
    name = t.nation.select("n_nationkey", "n_name")
    a = t.supplier.join(name, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("from_site"))
    b = t.customer.join(name, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("to_site"))
    owners = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(b, "o_custkey", "left")
    types = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("type_name"), F.col("p_retailprice").alias("rating"))
    joined = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(a, "l_suppkey").join(owners, "l_orderkey", "left").join(types, "l_partkey", "left")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "from_site", F.when(F.col("l_orderkey") % 13 != 0, F.col("to_site")).alias("to_site"), "type_name", "rating")


@query("select c_custkey, n_name || ' / ' || r_name parents, coalesce(e.equipment, '') equipment, coalesce(e.n, 0)::bigint n_equipment from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey left join (select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderkey) equipment, count(*) n from orders where o_orderstatus = 'P' group by 1) e on o_custkey = c_custkey")
def row_context(t):
    parents = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.concat_ws(" / ", "n_name", "r_name").alias("parents"))
    held = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("e"))
    joined = t.customer.join(parents, "c_nationkey").join(held, "c_custkey", "left")
    return joined.select("c_custkey", "parents", F.coalesce(F.array_join(F.transform("e", lambda x: x.cast("string")), ","), F.lit("")).alias("equipment"), F.coalesce(F.size("e"), F.lit(0)).cast("long").alias("n_equipment"))


@query("select p_partkey, case when p_size % 8 = 0 then '—' when p_size % 8 = 1 then '0' else (floor(p_size / 10) % 10)::bigint || ',' || (p_size % 10) end as shown from part")
def measurement_format(t):
    v = F.when(F.col("p_size") % 8 == 0, None).when(F.col("p_size") % 8 == 1, -0.0).otherwise((F.col("p_size") % 100) / 10.0)
    return t.part.select("p_partkey", text.measurement(v).alias("shown"))


@query("select c_custkey, to_json(struct_pack(id := c_custkey, name := c_name, tags := [c_mktsegment, c_nationkey::varchar]))::varchar as json from customer")
def raw_json_rows(t):
    return t.customer.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("tags"))).alias("json"))


@query("select l_suppkey k, metric, value from (select l_suppkey, min(l_discount) dmin, max(l_discount) dmax, count(*)::double cnt from lineitem group by 1) unpivot (value for metric in (dmin, dmax, cnt))")
def metric_map_rows(t):
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.create_map(F.lit("dmin"), F.min("l_discount"), F.lit("dmax"), F.max("l_discount"), F.lit("cnt"), F.count("*").cast("double")).alias("m"))
    return m.select("k", F.explode("m").alias("metric", "value"))


#: severity, code, table, predicate; the predicates mean the same in both engines.
RULES = [
    ("BLOCKER", "NO_KEY", "orders", "o_orderkey is null"),
    ("BLOCKER", "NO_OWNER", "orders", "o_custkey is null"),
    ("BLOCKER", "ZERO_PRICE", "part", "p_retailprice <= 0"),
    ("ERROR", "TAP_RANGE", "part", "p_size <= 2 or p_size >= 48"),
    ("ERROR", "NO_TYPE", "part", "p_type is null or p_type = ''"),
    ("ERROR", "NEGATIVE_BALANCE", "supplier", "s_acctbal < -500"),
    ("ERROR", "Q_LIMITS_REVERSED", "lineitem", "l_discount > l_tax + 0.08"),
    ("ERROR", "QUANTITY_RANGE", "lineitem", "l_quantity < 1 or l_quantity > 49"),
    ("ERROR", "NEGATIVE_LENGTH", "lineitem", "l_extendedprice < 0"),
    ("WARNING", "LOW_PRICE", "part", "p_retailprice < 920"),
    ("WARNING", "SHORT_NAME", "part", "length(p_name) < 8"),
    ("WARNING", "HIGH_DISCOUNT", "lineitem", "l_discount >= 0.09"),
    ("WARNING", "NO_TAX", "lineitem", "l_tax = 0"),
    ("WARNING", "PARTIAL", "orders", "o_orderstatus = 'P'"),
    ("WARNING", "UNSET_PRIORITY", "orders", "o_orderpriority = '4-NOT SPECIFIED'"),
    ("WARNING", "OVERDRAWN", "customer", "c_acctbal < 0"),
    ("WARNING", "SENTINEL", "customer", "abs(c_acctbal) >= 99999"),
    ("INFO", "SEGMENT", "customer", "c_mktsegment not in ('BUILDING', 'MACHINERY')"),
    ("INFO", "LARGE_ORDER", "orders", "o_totalprice > 400000"),
    ("INFO", "LAST_LINE", "lineitem", "l_linenumber = 7"),
    ("INFO", "ROUND_SIZE", "part", "p_size % 10 = 0"),
    ("INFO", "RICH", "supplier", "s_acctbal > 9000"),
]


@query(" union all ".join(f"select '{s}' severity, '{c}' code, count(*)::bigint n, (select count(*) from {table})::bigint checked from {table} where {p}" for s, c, table, p in RULES))
def quality_audit(t):
    found = []
    for table in sorted({r[2] for r in RULES}):
        own = [r for r in RULES if r[2] == table]
        # One pass over a table serves all of its rules.
        wide = getattr(t, table).agg(n("checked"), *(F.count_if(F.expr(p)).cast("long").alias(c) for _, c, _, p in own))
        rows = F.array(*(F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.col(c).alias("n")) for s, c, _, _ in own))
        found.append(wide.select(F.explode(rows).alias("r"), "checked").select("r.severity", "r.code", "r.n", "checked"))
    return reduce(DataFrame.unionByName, found)


@query(f"select severity, count(*) filter (n > 0)::bigint broken, sum(n)::bigint findings from ({' union all '.join(f'''select '{s}' severity, count(*) n from {table} where {p}''' for s, c, table, p in RULES)}) group by 1")
def quality_summary(t):
    return quality_audit(t).groupBy("severity").agg(F.count_if(F.col("n") > 0).cast("long").alias("broken"), F.sum("n").alias("findings"))


@query("""with c as (select l_orderkey k, l_linenumber ln, l_partkey pk, l_returnflag cls, l_tax > 0 live, l_discount > 0.005 rated, case when l_tax = 0 then 'OUT_OF_SERVICE' when l_discount <= 0.005 then 'NO_RATING' when l_quantity < 2 then 'NO_IMPEDANCE' else 'SCREENABLE' end state from lineitem)
select cls, state, count(*)::bigint n from c group by all""")
def candidate_catalog(t):
    state = F.when(F.col("l_tax") == 0, "OUT_OF_SERVICE").when(F.col("l_discount") <= 0.005, "NO_RATING").when(F.col("l_quantity") < 2, "NO_IMPEDANCE").otherwise("SCREENABLE")
    return t.lineitem.groupBy(F.col("l_returnflag").alias("cls"), state.alias("state")).agg(n())


@query("""select l_suppkey k, bool_and(l_tax < 0.085) solved, case when bool_and(l_tax < 0.085) and max(l_discount) <= 0.095 then 'CONTROL_VERIFIED' else 'PARTIAL' end fidelity, nullif(concat_ws(',', case when not bool_and(l_tax < 0.085) then 'NOT_SOLVED' end, case when max(l_discount) > 0.095 then 'OUT_OF_BAND' end, case when count(*) filter (l_quantity > 49.5) > 0 then 'SATURATED' end), '') reasons from lineitem group by 1""")
def control_evidence(t):
    solved, far, full = F.bool_and(F.col("l_tax") < 0.085), F.max("l_discount") > 0.095, F.count_if(F.col("l_quantity") > 49.5) > 0
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(solved.alias("solved"), far.alias("far"), full.alias("full"))
    reasons = F.array_compact(F.array(F.when(~F.col("solved"), "NOT_SOLVED"), F.when(F.col("far"), "OUT_OF_BAND"), F.when(F.col("full"), "SATURATED")))
    return per.select("k", "solved", F.when(F.col("solved") & ~F.col("far"), "CONTROL_VERIFIED").otherwise("PARTIAL").alias("fidelity"), F.nullif(F.array_join(reasons, ","), F.lit("")).alias("reasons"))


@query("""with s as (select o_orderkey k, case when o_orderkey % 3 = 0 then null else o_custkey % 100 end tolerance, case o_orderkey % 2 when 0 then 'AC' else 'DC' end kind from orders)
select k, '{' || case when kind = 'AC' then '"inner":"' || least(greatest(coalesce(tolerance, 30), 10), 60) || '",' else '' end || '"kind":"' || kind || '"}' as settings from s""")
def settings_snapshot(t):
    k = F.col("o_orderkey")
    kind = F.when(k % 2 == 0, "AC").otherwise("DC")
    inner = F.least(F.greatest(F.coalesce(F.when(k % 3 != 0, F.col("o_custkey") % 100), F.lit(30)), F.lit(10)), F.lit(60))
    return t.orders.select(k.alias("k"), text.stable_json(F.create_map(F.lit("kind"), kind, F.lit("inner"), F.when(kind == "AC", inner.cast("string")))).alias("settings"))


@query("""select o_orderkey, nullif(concat_ws(',', case when o_orderpriority = '1-URGENT' then 'EXPLICIT' end, case when o_totalprice > 400000 then 'VIOLATION' end, case when o_orderstatus = 'P' then 'ISLANDING' end, case when o_custkey % 10 = 0 then 'VOLTAGE_CONTROL' end), '') reasons from orders where o_orderpriority = '1-URGENT' or o_totalprice > 400000 or o_orderstatus = 'P' or o_custkey % 10 = 0""")
def promotion_reasons(t):
    gates = {"EXPLICIT": F.col("o_orderpriority") == "1-URGENT", "VIOLATION": F.col("o_totalprice") > 400000, "ISLANDING": F.col("o_orderstatus") == "P", "VOLTAGE_CONTROL": F.col("o_custkey") % 10 == 0}
    reasons = F.array_compact(F.array(*(F.when(g, k) for k, g in gates.items())))
    return t.orders.select("o_orderkey", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


@query("""select a.s_suppkey coupler, a.s_nationkey site, case when abs(va - vb) > 3.08 then 'AMBIGUOUS' when a.feeders > 30 and b.feeders > 30 then 'STRUCTURAL' else 'HEURISTIC' end confidence
from (select s_suppkey, s_nationkey, 154 + s_acctbal / 2500 va, (select count(*) from lineitem where l_suppkey = s_suppkey) feeders from supplier) a join (select s_suppkey, s_nationkey, 154 + s_acctbal / 2500 vb, (select count(*) from lineitem where l_suppkey = s_suppkey) feeders from supplier) b on b.s_nationkey = a.s_nationkey and b.s_suppkey = a.s_suppkey + 25""")
def split_bus(t):
    feeders = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("feeders"))
    bus = t.supplier.join(feeders, "s_suppkey", "left").select("s_suppkey", "s_nationkey", (154 + F.col("s_acctbal") / 2500).alias("v"), F.coalesce("feeders", F.lit(0)).alias("feeders"))
    other = bus.select((F.col("s_suppkey") - 25).alias("s_suppkey"), "s_nationkey", F.col("v").alias("vb"), F.col("feeders").alias("fb"))
    confidence = F.when(F.abs(F.col("v") - F.col("vb")) > 3.08, "AMBIGUOUS").when((F.col("feeders") > 30) & (F.col("fb") > 30), "STRUCTURAL").otherwise("HEURISTIC")
    return bus.join(other, ["s_suppkey", "s_nationkey"]).select(F.col("s_suppkey").alias("coupler"), F.col("s_nationkey").alias("site"), confidence.alias("confidence"))


@query(f"""with recursive {network._CHAINS}, p as (select c_custkey src, c_custkey tip, c_custkey::varchar path, 0 hops from customer where c_custkey % 10 = 4 union all select p.src, d.b, p.path || '-' || d.b, p.hops + 1 from p join d on d.a = p.tip where p.hops < 14 and p.tip % 13 <> 0 and not contains('-' || p.path || '-', '-' || d.b || '-'))
select src, arg_min(path, (hops, path)) path, min(hops)::bigint hops from p where tip % 13 = 0 group by 1""")
def energization_path(t):
    start = t.customer.where("c_custkey % 10 = 4").select(F.col("c_custkey").alias("node"))
    return graph.paths(network._chains(t), start, F.col("tip") % 13 == 0, 14).select("src", "path", "hops")


@query()
def outage_detail(t):
    b = network._branches(t)
    return kernels.outage_detail(b, b.where("id % 40 = 2").select("island", F.col("id").alias("outage"))).withColumn("flow", F.round("flow", 6))


@query()
def ac_contingency(t):
    """The first five branches of each island are lost in turn."""
    b = network._branches(t).where("island < 3").select("island", "id", "a", "b", "r", "x", F.lit(0.001).alias("charging"), F.lit(1.0).alias("tap"))
    cases = b.groupBy("island").agg(F.slice(F.array_sort(F.collect_list("id")), 1, 5).alias("c")).select("island", F.explode("c").alias("lost"))
    key = F.col("island") * 1_000_000 + F.col("lost")
    left = b.join(cases, "island").where(F.col("id") != F.col("lost")).withColumn("island", key)
    ends = b.select("island", F.explode(F.array("a", "b")).alias("node")).distinct()
    first = ends.groupBy("island").agg(F.min("node").alias("slack"))
    nodes = ends.join(first, "island").join(t.customer.select(F.col("c_custkey").alias("node"), "c_acctbal"), "node")
    nodes = nodes.join(cases.select((F.col("island") + 0).alias("island"), F.col("lost").alias("case")), "island")
    nodes = nodes.select((F.col("island") * 1_000_000 + F.col("case")).alias("island"), "node", F.when(F.col("node") == F.col("slack"), 0).otherwise(2).alias("kind"), (-F.col("c_acctbal") / 3e6).alias("p"), (-F.col("c_acctbal") / 9e6).alias("q"), F.lit(1.02).alias("v"), F.lit(None).cast("double").alias("q_low"), F.lit(None).cast("double").alias("q_high"))
    solved = kernels.ac_flow(left.drop("id", "lost"), nodes)
    per = solved.groupBy("island").agg(F.first("status").alias("status"), F.round(F.min("v"), 6).alias("v_min"), F.round(F.max("v"), 6).alias("v_max"))
    return per.select(F.floor(F.col("island") / 1_000_000).alias("island"), (F.col("island") % 1_000_000).alias("lost"), "status", "v_min", "v_max")
