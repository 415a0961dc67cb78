"""Comparisons of scenarios, result mapping, station audits and compact study rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltspan.operators import filters, matching
from voltspan.plans.base import n, query

# Branch flows by the two-port equations: from supplier balance and line values, per unit on 100 MVA.
_PORT = "b as (select l_orderkey k, l_linenumber ln, l_partkey pk, 0.001 + l_discount / 10 r, 0.01 + l_tax x, 1 + l_quantity / 1000 va, 1.01 vb, l_discount - 0.04 d, 1 + l_tax / 4 t from lineitem), y as (select *, r / (r * r + x * x) g, -x / (r * r + x * x) s from b), f as (select k, ln, pk, r, x, 100 * (g * va * va / t / t - va / t * 1.01 * (g * cos(d) + s * sin(d))) p, 100 * (-s * va * va / t / t - va / t * 1.01 * (g * sin(d) - s * cos(d))) q, 100 * (g * 1.01 * 1.01 - va / t * 1.01 * (g * cos(d) - s * sin(d))) pt, va from y)"


@query(f"with {_PORT} select k, ln, pk, round(p, 6) p, round(q, 6) q, round(p + pt, 6) loss, round(sqrt(p * p + q * q) * 1000 / (sqrt(3) * va * 154), 4) amps from f")
def branch_results(t):
    b = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), (0.001 + F.col("l_discount") / 10).alias("r"), (0.01 + F.col("l_tax")).alias("x"), (1 + F.col("l_quantity") / 1000).alias("va"), (F.col("l_discount") - 0.04).alias("d"), (1 + F.col("l_tax") / 4).alias("t"))
    p, q, back = _two_port(*(F.col(c) for c in ("r", "x", "va")), F.lit(1.01), F.col("d"), F.col("t"))
    f = b.withColumns({"p": p, "q": q, "back": back})
    s = F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q"))
    return f.select("k", "ln", "pk", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), F.round(F.col("p") + F.col("back"), 6).alias("loss"), F.round(s * 1000 / (F.sqrt(F.lit(3.0)) * F.col("va") * 154), 4).alias("amps"))


def _two_port(r: Column, x: Column, va: Column, vb: Column, angle: Column, tap: Column, base: float = 100.0) -> tuple[Column, Column, Column]:
    """P and Q into a branch at its tapped end, and P at the other, from series impedance, magnitudes and angle difference."""
    g, s, u = r / (r * r + x * x), -x / (r * r + x * x), va / tap
    p = g * u * u - u * vb * (g * F.cos(angle) + s * F.sin(angle))
    q = -s * u * u - u * vb * (g * F.sin(angle) - s * F.cos(angle))
    return base * p, base * q, base * (g * vb * vb - u * vb * (g * F.cos(angle) - s * F.sin(angle)))


_RUNS = "a as (select p_partkey k, p_retailprice v, p_size % 10 <> 0 live from part where p_partkey % 7 <> 0), b as (select p_partkey k, p_retailprice * (1 + p_size / 100.0::double) v, p_size % 11 <> 0 live from part where p_partkey % 5 <> 0)"
_CHANGE = "case when a.k is null then 'NO_BASE' when b.k is null then 'NO_SCENARIO' when k % 13 = 0 then 'PARTITION' when k % 17 = 0 then 'ANGLE_REFERENCE' else 'OK' end"


@query(f"with {_RUNS}, j as (select k, {_CHANGE} reason, case when a.live then a.v when a.k is not null then 0 end pre, case when b.live then b.v when b.k is not null then 0 end post from a full join b using (k)) select k, reason, round(pre, 6) pre, round(post, 6) post, case when reason = 'OK' then round(post - pre, 6) end delta from j")
def scenario_comparison(t):
    part = lambda keep, v, live: t.part.where(keep).select(F.col("p_partkey").alias("k"), v.alias("v"), live.alias("live"))
    z, price = F.col("p_size"), F.col("p_retailprice")
    a = part("p_partkey % 7 <> 0", price, z % 10 != 0).select("k", F.struct("v", "live").alias("a"))
    b = part("p_partkey % 5 <> 0", price * (1 + z / 100.0), z % 11 != 0).select("k", F.struct("v", "live").alias("b"))
    # Out of service is 0; what isn't there is missing.
    value = lambda c: F.when(F.col(c).isNotNull(), F.when(F.col(f"{c}.live"), F.col(f"{c}.v")).otherwise(0.0))
    j = a.join(b, "k", "full_outer").withColumns({"pre": value("a"), "post": value("b")})
    reason = filters.first_reason({"NO_BASE": F.col("a").isNull(), "NO_SCENARIO": F.col("b").isNull(), "PARTITION": F.col("k") % 13 == 0, "ANGLE_REFERENCE": F.col("k") % 17 == 0})
    return j.select("k", reason.alias("reason"), F.round("pre", 6).alias("pre"), F.round("post", 6).alias("post"), F.when(reason == "OK", F.round(F.col("post") - F.col("pre"), 6)).alias("delta"))


@query("""with c as (select l_orderkey k, l_linenumber ln, l_partkey pk, case when l_tax > 0 then l_quantity * 2 end base, case when l_discount > 0 then l_quantity * 2 * (1 + l_discount) end post, case when l_linenumber = 6 then null else 60.0 end cap from lineitem)
select k, ln, pk, round(100 * base / cap, 6) base_pct, round(100 * post / cap, 6) post_pct, round(100 * (post - base) / cap, 6) delta_pct, case when cap is null then 'CAPACITY' when base is null then 'BASE' when post is null then 'POST' end as cause from c""")
def post_contingency(t):
    q = F.col("l_quantity") * 2
    c = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.when(F.col("l_tax") > 0, q).alias("base"), F.when(F.col("l_discount") > 0, q * (1 + F.col("l_discount"))).alias("post"), F.when(F.col("l_linenumber") != 6, 60.0).alias("cap"))
    pct = lambda v, name: F.round(100 * v / F.col("cap"), 6).alias(name)
    cause = F.when(F.col("cap").isNull(), "CAPACITY").when(F.col("base").isNull(), "BASE").when(F.col("post").isNull(), "POST")
    return c.select("k", "ln", "pk", pct(F.col("base"), "base_pct"), pct(F.col("post"), "post_pct"), pct(F.col("post") - F.col("base"), "delta_pct"), cause.alias("cause"))


@query("""with r as (select s_suppkey k, s_acctbal ref, case when s_suppkey % 4 = 0 then s_acctbal * 1.00000001 when s_suppkey % 4 = 1 then s_acctbal + 1 when s_suppkey % 4 = 2 then null else s_acctbal end calc from supplier)
select k, case when calc is null then 'MISSING' when abs(calc - ref) <= greatest(1e-4, 1e-6 * greatest(abs(calc), abs(ref))) then 'EQUAL' else 'DIFFERENT' end state from r""")
def context_tolerance(t):
    k, ref = F.col("s_suppkey"), F.col("s_acctbal")
    calc = F.when(k % 4 == 0, ref * 1.00000001).when(k % 4 == 1, ref + 1).when(k % 4 == 3, ref)
    near = F.abs(calc - ref) <= F.greatest(F.lit(1e-4), 1e-6 * F.greatest(F.abs(calc), F.abs(ref)))
    return t.supplier.select(k.alias("k"), F.when(calc.isNull(), "MISSING").when(near, "EQUAL").otherwise("DIFFERENT").alias("state"))


@query("""with w as (select l_orderkey k, l_linenumber ln, l_partkey pk, l_suppkey winding, case when l_orderkey % 8 = 0 then l_suppkey + 1 else l_suppkey end cubicle, case when l_orderkey % 12 = 0 then null else s_nationkey end terminal from lineitem left join supplier on s_suppkey = l_suppkey)
select case when terminal is null then 'NO_TERMINAL' when cubicle <> winding then 'CUBICLE_DIFFERS' else 'AGREES' end status, count(*)::bigint n from w group by 1""")
def station_audit(t):
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("terminal"))
    w = t.lineitem.join(s, "l_suppkey", "left").select("l_suppkey", F.when(F.col("l_orderkey") % 8 == 0, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey")).alias("cubicle"), F.when(F.col("l_orderkey") % 12 != 0, F.col("terminal")).alias("terminal"))
    status = filters.first_reason({"NO_TERMINAL": F.col("terminal").isNull(), "CUBICLE_DIFFERS": F.col("cubicle") != F.col("l_suppkey")}, "AGREES")
    return w.groupBy(status.alias("status")).agg(n())


@query("""select n_nationkey site, count(distinct s_suppkey)::bigint sections, count(distinct c_custkey)::bigint feeders, case when count(distinct s_suppkey) = 0 then 'NO_SECTION' when count(distinct c_custkey) > 5 * count(distinct s_suppkey) then 'CROWDED' else 'OK' end issue from nation left join supplier on s_nationkey = n_nationkey left join customer on c_nationkey = n_nationkey group by 1""")
def station_graph(t):
    s = t.supplier.groupBy(F.col("s_nationkey").alias("site")).agg(n("sections"))
    c = t.customer.groupBy(F.col("c_nationkey").alias("site")).agg(n("feeders"))
    j = t.nation.select(F.col("n_nationkey").alias("site")).join(s, "site", "left").join(c, "site", "left").na.fill(0, ["sections", "feeders"])
    return j.withColumn("issue", filters.first_reason({"NO_SECTION": F.col("sections") == 0, "CROWDED": F.col("feeders") > 5 * F.col("sections")}))


@query("select 'N1' kind, l_orderkey id, max(l_extendedprice) v from lineitem where l_quantity > 48 group by 2 union all select 'SC', s_suppkey, s_acctbal from supplier where s_acctbal > 5000 union all select 'LF', c_custkey, c_acctbal from customer where c_acctbal < 0")
def compact_rows(t):
    parts = [t.lineitem.where("l_quantity > 48").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_extendedprice").alias("v")).select(F.lit("N1").alias("kind"), "id", "v"), t.supplier.where("s_acctbal > 5000").select(F.lit("SC").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v")), t.customer.where("c_acctbal < 0").select(F.lit("LF").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))]
    return reduce(DataFrame.unionByName, parts)


@query("""with s as (select s_nationkey site, max(case when s_acctbal > 5000 then 154 else 33 end) lv, avg(s_acctbal) v from supplier group by 1) select n_nationkey site, case when lv is null then 'NO_DATA' when lv < 66 then 'BELOW' when n_regionkey = 2 then 'OUT_OF_SCOPE' else 'SHOWN' end gate, case when lv >= 66 and n_regionkey <> 2 then round(v, 4) end shown from nation left join s on site = n_nationkey""")
def map_projection(t):
    s = t.supplier.groupBy(F.col("s_nationkey").alias("site")).agg(F.max(F.when(F.col("s_acctbal") > 5000, 154).otherwise(33)).alias("lv"), F.avg("s_acctbal").alias("v"))
    j = t.nation.select(F.col("n_nationkey").alias("site"), "n_regionkey").join(s, "site", "left")
    gate = filters.first_reason({"NO_DATA": F.col("lv").isNull(), "BELOW": F.col("lv") < 66, "OUT_OF_SCOPE": F.col("n_regionkey") == 2}, "SHOWN")
    return j.select("site", gate.alias("gate"), F.when(gate == "SHOWN", F.round("v", 4)).alias("shown"))


@query("""with p as (select event_id, props::json->>'k' k, props::json->>'legacy' legacy, event_type from events) select event_id, '{"k":"' || k || '","type":"' || event_type || '"}' as record from p where k is not null""")
def whitelisted_records(t):
    # Known fields stay, others go; records without the required one are refused.
    p = t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type").where("k is not null")
    return p.select("event_id", F.to_json(F.struct("k", F.col("event_type").alias("type"))).alias("record"))


@query("""with r as (select p_partkey k, p_size % 4 mode, p_brand prof, case when p_size % 5 = 0 then 'x' else p_type end src from part) select k, mode = 1 and prof < 'Brand#2' and src = 'ECONOMY' admissible from r""")
def admissible_results(t):
    current = {"mode": F.col("p_size") % 4 == 1, "profile": F.col("p_brand") < "Brand#2", "source": F.when(F.col("p_size") % 5 == 0, "x").otherwise(F.col("p_type")) == "ECONOMY"}
    return t.part.select(F.col("p_partkey").alias("k"), reduce(Column.__and__, current.values()).alias("admissible"))


@query("""with m as (select l_suppkey k, l_partkey % 10 m from lineitem group by all), r as (select k, string_agg(m::varchar, ',' order by m) s from m group by 1) select 'terminals' section, count(*)::bigint n from m union all select 'buses', count(*) from r union all select 'split', count(*) from (select s from r group by 1 having count(*) > 1) union all select 'blocked', count(*) from m where m = 9""")
def topology_report(t):
    m = t.lineitem.select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 10).alias("m")).distinct()
    r = m.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("m")), ",").alias("s"))
    split = r.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    parts = {"terminals": m, "buses": r, "split": split, "blocked": m.where("m = 9")}
    return reduce(DataFrame.unionByName, (df.agg(n()).select(F.lit(k).alias("section"), "n") for k, df in parts.items()))


@query("""with u as (select s_nationkey g, s_suppkey id, greatest(s_acctbal, 0) w from supplier), o as (select *, sum(w) over (partition by g) total, count(*) over (partition by g) c from u) select id, round(case when total > 1e-9 then 100 * w / total else 100.0 / c end, 8) pct, matched.n::bigint n_orders from o left join (select o_custkey % 100 k, count(*) n from orders group by 1) matched on matched.k = id""")
def generator_split(t):
    from voltspan.operators import catalog

    u = catalog.shares(t.supplier.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("w")), "g", "w")
    held = t.orders.groupBy((F.col("o_custkey") % 100).alias("id")).agg(n("n_orders"))
    return u.select("id", F.round(100 * F.col("share"), 8).alias("pct")).join(held, "id", "left")


@query("with s as (select l_suppkey k, l_partkey m from lineitem where l_quantity > 25 group by all) select a.k a, b.k b, count(*)::bigint shared from s a join s b on a.m = b.m and a.k < b.k where a.k % 10 = 0 and b.k % 10 = 0 group by all having count(*) > 2")
def shared_sites(t):
    s = t.lineitem.where("l_quantity > 25 and l_suppkey % 10 = 0").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set("l_partkey").alias("m"))
    flat = matching.aliases(s, "m", "part")
    pairs = flat.join(flat.select(F.col("k").alias("b"), "part"), "part").where("k < b")
    return pairs.groupBy(F.col("k").alias("a"), "b").agg(n("shared")).where("shared > 2")
