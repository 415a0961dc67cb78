"""Filters, scopes, gates and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.operators import filters
from voltspan.plans.base import n, query

# Sites of an order: the nations of its lines' suppliers; the area of a site is its region.
_SITES = "s as (select l_orderkey, list_sort(list(distinct s_nationkey)) sites from lineitem join supplier on s_suppkey = l_suppkey group by 1)"


def _sites(t) -> DataFrame:
    joined = t.lineitem.select("l_orderkey", "l_suppkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return joined.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("s_nationkey")).alias("sites"))


@query(f"with {_SITES} select l_orderkey, array_to_string(sites, ',') sites from s where list_contains(sites, 4)")
def site_filter(t):
    return _sites(t).where(filters.has_any("sites", [4])).select("l_orderkey", F.array_join("sites", ",").alias("sites"))


@query(f"with {_SITES} select l_orderkey, len(sites)::bigint n_sites from s where exists (select 1 from (select unnest(sites) k) join nation on n_nationkey = k where n_regionkey = 2)")
def area_filter(t):
    return filters.in_area(_sites(t), "sites", t.nation.where("n_regionkey = 2").select("n_nationkey")).select("l_orderkey", F.size("sites").cast("long").alias("n_sites"))


@query(f"with {_SITES} select 'site' kind, l_orderkey id from s where list_contains(sites, 7) union all select 'line', o_orderkey from orders where o_custkey = 7")
def exact_voltage(t):
    sites = _sites(t).where(filters.has_any("sites", [7])).select(F.lit("site").alias("kind"), F.col("l_orderkey").alias("id"))
    return sites.unionByName(t.orders.where("o_custkey = 7").select(F.lit("line").alias("kind"), F.col("o_orderkey").alias("id")))


# A branch is a line item from its supplier's site to its customer's; every 13th has an unknown end.
_ENDS = """ends as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, sn.n_regionkey a, case when l_orderkey % 13 = 0 then null else cn.n_regionkey end b, s_nationkey sa, c_nationkey sb
from lineitem join supplier on s_suppkey = l_suppkey join nation sn on sn.n_nationkey = s_nationkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation cn on cn.n_nationkey = c_nationkey)"""


def _ends(t) -> DataFrame:
    region = t.nation.select("n_nationkey", "n_regionkey")
    a = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("sa")).join(region.toDF("sa", "a"), "sa")
    b = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("sb")).join(region.toDF("sb", "b"), "sb")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    joined = lines.join(a, "l_suppkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(b, "o_custkey")
    return joined.withColumn("b", F.when(F.col("l_orderkey") % 13 != 0, F.col("b")))


@query(f"with {_ENDS} select case when b is null then 'UNKNOWN' when a in (1, 3) and b in (1, 3) then 'INTERNAL' when a in (1, 3) or b in (1, 3) then 'BOUNDARY' else 'OUTSIDE' end as scope, count(*)::bigint n from ends group by 1")
def endpoint_scope(t):
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<int>"))
    return _ends(t).groupBy(filters.endpoint_scope(one("a"), one("b"), [1, 3]).alias("scope")).agg(n())


@query(f"""with {_ENDS} select l_orderkey, l_linenumber, l_partkey from ends where l_quantity between 10 and 40 and l_discount > 0 and (l_extendedprice between 20000 and 30000 or l_extendedprice between 28000 and 50000)
and b is not null and (a in (1, 3)) <> (b in (1, 3)) and (sa = 5 or sb = 5) and contains(l_orderkey || ' ' || l_partkey, '7')""")
def candidate_filter(t):
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<int>"))
    df = _ends(t).where(F.col("l_quantity").between(10, 40) & (F.col("l_discount") > 0))
    df = df.where(filters.in_ranges(F.col("l_extendedprice"), [(20000, 30000), (28000, 50000)]))
    df = df.where((filters.endpoint_scope(one("a"), one("b"), [1, 3]) == "BOUNDARY") & filters.has_any(F.array("sa", "sb"), [5]))
    return df.where(F.contains(F.concat_ws(" ", "l_orderkey", "l_partkey"), F.lit("7"))).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select o_orderkey from orders where o_orderstatus in ('F', 'P') and o_orderpriority in ('1-URGENT', '5-LOW') and year(o_orderdate) in (1996, 1998)")
def study_row_filter(t):
    chosen = [(F.col("o_orderstatus"), ["F", "P"]), (F.col("o_orderpriority"), ["1-URGENT", "5-LOW"]), (F.year("o_orderdate"), [1996, 1998]), (F.col("o_custkey"), [])]
    return filters.multi_select(t.orders, chosen).select("o_orderkey")


_RANKED = "row_number() over (partition by l_suppkey order by coalesce(l_extendedprice, -1) desc, l_discount desc, l_quantity desc, l_orderkey, l_linenumber, l_partkey)"


@query(f"select l_suppkey, l_orderkey, l_linenumber, l_partkey from (select *, {_RANKED} r from lineitem where l_returnflag = 'R' and l_tax > 0.02) where r = 1")
def operator_group_filter(t):
    # Members are filtered before the critical one of a group is chosen.
    order = [F.coalesce("l_extendedprice", F.lit(-1.0)).desc(), F.desc("l_discount"), F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return filters.critical(t.lineitem.where("l_returnflag = 'R' and l_tax > 0.02"), ["l_suppkey"], order).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("select c_custkey from customer join nation on n_nationkey = c_nationkey where c_acctbal > 0 and n_regionkey = 1 and c_nationkey in (1, 6, 11) and c_acctbal between 1000 and 6000 and contains(lower(c_name), '00')")
def fault_terminals(t):
    area = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    df = t.customer.where("c_acctbal > 0").join(area, "c_nationkey", "left_semi").where(F.col("c_nationkey").isin(1, 6, 11) & F.col("c_acctbal").between(1000, 6000))
    return df.where(F.contains(F.lower("c_name"), F.lit("00"))).select("c_custkey")


_FINDINGS = "f as (select l_orderkey id, l_linenumber ln, l_partkey pk, case when l_orderkey % 5 = 0 then null else s_nationkey end site, case when l_discount >= 0.09 then 'ERROR' else 'WARNING' end severity from lineitem join supplier on s_suppkey = l_suppkey where l_tax = 0)"


def _findings(t) -> DataFrame:
    joined = t.lineitem.where("l_tax = 0").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return joined.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.when(F.col("l_orderkey") % 5 != 0, F.col("s_nationkey")).alias("site"), F.when(F.col("l_discount") >= 0.09, "ERROR").otherwise("WARNING").alias("severity"))


@query(f"with {_FINDINGS} select 'none' as scope, severity, count(*)::bigint n from f group by all union all select 'sites', severity, count(*) from f where site in (2, 3) group by all")
def finding_filter(t):
    f = _findings(t)
    parts = {"none": filters.scoped(f, "site", None), "sites": filters.scoped(f, "site", [2, 3])}
    every = [df.groupBy("severity").agg(n()).select(F.lit(k).alias("scope"), "severity", "n") for k, df in parts.items()]
    return every[0].unionByName(every[1])


@query("select 'ALL' mode, count(*)::bigint n from nation union all select 'NONE', 0 union all select 'SELECTED', count(*) from nation where n_regionkey in (0, 4)")
def area_scope_modes(t):
    out = None
    for mode, areas in (("ALL", []), ("NONE", []), ("SELECTED", [0, 4])):
        df = t.nation.where(filters.area_scope(F.col("n_regionkey"), mode, areas)).agg(n()).select(F.lit(mode).alias("mode"), "n")
        out = df if out is None else out.unionByName(df)
    return out


@query("select c_custkey, (25.0 + c_custkey % 30)::double lat, (20.0 + c_custkey % 31)::double lon from customer where 25.0 + c_custkey % 30 between 30 and 46 and 20.0 + c_custkey % 31 between 25 and 46")
def geo_bounds(t):
    df = t.customer.select("c_custkey", (25.0 + F.col("c_custkey") % 30).alias("lat"), (20.0 + F.col("c_custkey") % 31).alias("lon"))
    return df.where(filters.on_map(F.col("lat"), F.col("lon")))


_GATE = "case when not isfinite(r) or not isfinite(x) then 'NOT_FINITE' when sqrt(r * r + x * x) < 1e-6 then 'ZERO_IMPEDANCE' when tap <= 0 then 'TAP' else 'OK' end"
_BRANCH = "b as (select l_orderkey, l_linenumber, l_partkey, case when l_orderkey % 17 = 0 then 'nan'::double when l_orderkey % 19 = 0 then 0 else l_discount end r, case when l_orderkey % 19 = 0 then 1e-7 else l_tax + 0.01 end x, case when l_linenumber = 7 then 0.0 else 1.0 end tap from lineitem)"


@query(f"with {_BRANCH} select {_GATE} status, count(*)::bigint n from b group by 1")
def branch_gates(t):
    k = F.col("l_orderkey")
    df = t.lineitem.select(F.when(k % 17 == 0, float("nan")).when(k % 19 == 0, 0.0).otherwise(F.col("l_discount")).alias("r"), F.when(k % 19 == 0, 1e-7).otherwise(F.col("l_tax") + 0.01).alias("x"), F.when(F.col("l_linenumber") == 7, 0.0).otherwise(1.0).alias("tap"))
    return df.groupBy(filters.branch_gate(F.col("r"), F.col("x"), F.col("tap")).alias("status")).agg(n())


@query("with v as (select o_orderkey, case when o_orderkey % 10 = 0 then 9999 when o_orderkey % 10 = 1 then -9999 when o_orderkey % 10 = 2 then null else o_totalprice end v from orders) select o_orderkey, case when abs(v) = 9999 or abs(v) >= 99999 then null else v end as value, coalesce(abs(v) = 9999 or abs(v) >= 99999, false) flagged from v")
def sentinels(t):
    k = F.col("o_orderkey") % 10
    v = F.when(k == 0, 9999.0).when(k == 1, -9999.0).when(k != 2, F.col("o_totalprice"))
    return t.orders.select("o_orderkey", filters.without_sentinel(v).alias("value"), filters.is_sentinel(v).alias("flagged"))


_IDENTITY = "a as (select o_orderkey k, o_orderstatus st, o_orderpriority pr, case when o_orderkey % 4 = 0 then null else o_custkey end cu from orders), b as (select o_orderkey k, case when o_orderkey % 6 = 0 then 'X' else o_orderstatus end st, o_orderpriority pr, case when o_orderkey % 8 = 0 then null else o_custkey end cu from orders where o_orderkey % 3 <> 1)"


@query(f"with {_IDENTITY} select case when b.k is null then 'NONE' when a.st is not distinct from b.st and a.pr is not distinct from b.pr and a.cu is not distinct from b.cu then 'CURRENT' else 'STALE' end state, count(*)::bigint n from a left join b using (k) group by 1")
def staleness(t):
    k = F.col("o_orderkey")
    a = t.orders.select(k.alias("k"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"), F.when(k % 4 != 0, F.col("o_custkey")).alias("cu"))
    b = t.orders.where(k % 3 != 1).select(k.alias("k"), F.when(k % 6 == 0, "X").otherwise(F.col("o_orderstatus")).alias("st"), F.col("o_orderpriority").alias("pr"), F.when(k % 8 != 0, F.col("o_custkey")).alias("cu"))
    return filters.staleness(a, b, "k", ["st", "pr", "cu"]).groupBy("state").agg(n())


@query("""select p_partkey, sqrt(p_size * p_size + p_retailprice * p_retailprice) * 1000 / (sqrt(3) * 154) amps, p_size * 154.0 / 100 kv, degrees(p_size / 50.0) as angle, sqrt(p_size * p_size + p_retailprice * p_retailprice) apparent from part""")
def unit_projections(t):
    p, q = F.col("p_size"), F.col("p_retailprice")
    s = F.sqrt(p * p + q * q)
    return t.part.select("p_partkey", (s * 1000 / (F.sqrt(F.lit(3.0)) * 154)).alias("amps"), (p * F.lit(154.0) / 100).alias("kv"), F.degrees(p / F.lit(50.0)).alias("angle"), s.alias("apparent"))


@query("select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then null else 'A' || o_custkey % 9 end, '—') || ' → ' || coalesce(case when o_orderkey % 4 = 0 then null else o_orderpriority end, '—') path, case o_orderstatus when 'F' then 'out of service' when 'O' then 'in service' else o_orderstatus end state, case when o_orderkey % 7 = 0 then 'cbk' when o_orderkey % 7 = 1 then 'dct' when o_orderkey % 7 = 2 then 'sdc' else 'other' end as usage from orders")
def semantic_cells(t):
    k = F.col("o_orderkey")
    arrow = filters.arrow(F.when(k % 3 != 0, F.concat(F.lit("A"), F.col("o_custkey") % 9)), F.when(k % 4 != 0, F.col("o_orderpriority")))
    state = filters.decoded(F.col("o_orderstatus"), {"F": "out of service", "O": "in service"})
    code = F.when(k % 7 == 0, "cbk").when(k % 7 == 1, "dct").when(k % 7 == 2, "sdc")
    return t.orders.select("o_orderkey", arrow.alias("path"), state.alias("state"), F.coalesce(code, F.lit("other")).alias("usage"))


@query("select p_brand, count(*) filter (p_size % 5 = 0)::bigint tap_fallback, count(*) filter (p_size > 45)::bigint bad_step, count(*) filter (p_retailprice < 950)::bigint no_limits, case when count(*) filter (p_size % 5 = 0 or p_size > 45 or p_retailprice < 950) = 0 then 'SOURCE_EXACT' else 'PARTIAL' end fidelity from part group by 1")
def source_fidelity(t):
    flaws = {"tap_fallback": F.col("p_size") % 5 == 0, "bad_step": F.col("p_size") > 45, "no_limits": F.col("p_retailprice") < 950}
    return filters.fidelity(t.part, ["p_brand"], flaws)


@query("""select l_orderkey, l_linenumber, l_partkey, case when l_orderkey % 4 = 0 then null else 100 * greatest(l_quantity, l_discount * 400) / nullif(case when l_linenumber = 2 then null else l_tax * 500 end, 0) end as loading,
case when l_orderkey % 4 = 0 then 'NOT_CONVERGED' when coalesce(case when l_linenumber = 2 then null else l_tax * 500 end, 0) = 0 then 'UNKNOWN_CAPACITY' else 'OK' end reason from lineitem""")
def branch_loading(t):
    limit = F.when(F.col("l_linenumber") != 2, F.col("l_tax") * 500)
    loading, reason = filters.loading(F.col("l_quantity"), F.col("l_discount") * 400, limit, F.col("l_orderkey") % 4 != 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", loading.alias("loading"), reason.alias("reason"))


_GATES = "case when not ran then 'NOT_RUN' when base is null or other is null then 'UNKNOWN_CAPACITY' when k % 7 = 0 then 'IDENTITY' when abs(lim - lim2) > 1e-9 then 'DENOMINATOR' else 'OK' end"


@query(f"""with x as (select p_partkey k, p_size % 9 <> 0 ran, case when p_size % 5 = 0 then null else p_retailprice end base, p_retailprice * 1.1 as other, p_size lim, case when p_size > 40 then p_size + 1 else p_size end lim2 from part)
select k, {_GATES} reason, case when {_GATES} = 'OK' then round(other - base, 6) end delta from x""")
def loading_difference(t):
    df = t.part.select(F.col("p_partkey").alias("k"), (F.col("p_size") % 9 != 0).alias("ran"), F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")).alias("base"), (F.col("p_retailprice") * 1.1).alias("other"), F.col("p_size").alias("lim"), F.when(F.col("p_size") > 40, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("lim2"))
    reason = filters.first_reason({"NOT_RUN": ~F.col("ran"), "UNKNOWN_CAPACITY": F.col("base").isNull() | F.col("other").isNull(), "IDENTITY": F.col("k") % 7 == 0, "DENOMINATOR": F.abs(F.col("lim") - F.col("lim2")) > 1e-9})
    return df.select("k", reason.alias("reason"), F.when(reason == "OK", F.round(F.col("other") - F.col("base"), 6)).alias("delta"))


@query("""select o_orderkey, case when o_orderkey % 2 = 0 then 'NO_BASE' when o_orderkey % 3 = 0 then 'SCENARIO_STALE' when o_orderkey % 5 = 0 then 'MODEL' when o_orderkey % 7 = 0 then 'SETTINGS' when o_orderkey % 11 = 0 then 'ENGINE' when o_orderkey % 13 = 0 then 'NOT_CONVERGED' else 'OK' end reason from orders""")
def identity_precedence(t):
    k = F.col("o_orderkey")
    gates = dict(zip(("NO_BASE", "SCENARIO_STALE", "MODEL", "SETTINGS", "ENGINE", "NOT_CONVERGED"), (k % p == 0 for p in (2, 3, 5, 7, 11, 13)), strict=True))
    return t.orders.select("o_orderkey", filters.first_reason(gates).alias("reason"))


_SEASON = "v as (select p_partkey k, p_retailprice nominal, case when p_size % 3 = 0 then p_retailprice + 0.5 when p_size % 3 = 1 then p_retailprice * 0.9 end summer, case when p_size % 4 = 0 then p_retailprice * 1.2 end winter, case when p_size = 10 then 777.0 end manual from part)"


@query(f"""with {_SEASON} select k, coalesce(manual, summer, nominal) as limit_value, case when manual is not null then 'MANUAL' when summer is not null then 'SUMMER' else 'NOMINAL' end basis, coalesce(abs(nominal - summer) <= 1, false) matched from v""")
def seasonal_limit(t):
    p, k = F.col("p_retailprice"), F.col("p_size")
    df = t.part.select(F.col("p_partkey").alias("k"), p.alias("nominal"), F.when(k % 3 == 0, p + 0.5).when(k % 3 == 1, p * 0.9).alias("summer"), F.when(k % 4 == 0, p * 1.2).alias("winter"), F.when(k == 10, 777.0).alias("manual"))
    limit, basis, matched = filters.seasonal_limit("summer")
    return df.select("k", limit.alias("limit_value"), basis.alias("basis"), matched.alias("matched"))


@query("""select p_partkey, round(p_retailprice * 0.9 * p_size / 50, 6) capacity, nullif(concat_ws(',', case when p_size % 10 = 0 then 'NO_TYPE' end, case when p_retailprice > 1800 then 'NO_SECTION' end, case when p_size = 1 then 'FACTOR' end), '') reasons from part""")
def capacity_reasons(t):
    reasons = filters.reasons({"NO_TYPE": F.col("p_size") % 10 == 0, "NO_SECTION": F.col("p_retailprice") > 1800, "FACTOR": F.col("p_size") == 1})
    return t.part.select("p_partkey", F.round(F.col("p_retailprice") * 0.9 * F.col("p_size") / 50, 6).alias("capacity"), F.nullif(F.array_join(reasons, ","), F.lit("")).alias("reasons"))


@query("""select l_orderkey, l_linenumber, l_partkey, case when l_tax = 0 then 'NOT_APPLICABLE' when l_discount = 0 then 'INSUFFICIENT' when l_quantity * 3000 > 2e5 and l_discount < 0.02 then 'UNVERIFIED' when l_extendedprice > l_quantity * 2000 then 'FAIL' else 'PASS' end verdict from lineitem""")
def duty_verdict(t):
    verdict = filters.first_reason({"NOT_APPLICABLE": F.col("l_tax") == 0, "INSUFFICIENT": F.col("l_discount") == 0, "UNVERIFIED": (F.col("l_quantity") * 3000 > 2e5) & (F.col("l_discount") < 0.02), "FAIL": F.col("l_extendedprice") > F.col("l_quantity") * 2000}, "PASS")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", verdict.alias("verdict"))


@query("""with c as (select s_suppkey k, s_nationkey u, s_acctbal v, count(*) over (partition by s_nationkey) owners from supplier)
select k, case when v < -800 then 'OFF' when u = 3 then 'REMOTE_UNRESOLVED' when k % 12 = 0 then 'UNSUPPORTED_MODE' when v between 0 and 500 then 'NO_HEADROOM' when owners > 1 and k % 3 = 0 then 'DUPLICATE_OWNER' when v / 5000 not between 0.5 and 1.5 then 'SETPOINT' else 'ADMISSIBLE' end status from c""")
def controller_admissibility(t):
    owners = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("owners"))
    k, v = F.col("s_suppkey"), F.col("s_acctbal")
    chain = {"OFF": v < -800, "REMOTE_UNRESOLVED": F.col("s_nationkey") == 3, "UNSUPPORTED_MODE": k % 12 == 0, "NO_HEADROOM": v.between(0, 500), "DUPLICATE_OWNER": (F.col("owners") > 1) & (k % 3 == 0), "SETPOINT": ~(v / 5000).between(0.5, 1.5)}
    return t.supplier.join(owners, "s_nationkey").select(k.alias("k"), filters.first_reason(chain, "ADMISSIBLE").alias("status"))


@query("""select case when p_type like '%STEEL%' or p_size % 4 = 0 then 'PHYSICAL_BUS' when p_size % 4 = 1 then 'FEEDER' when p_size % 4 = 2 then 'AUXILIARY' else 'UNCLASSIFIED' end kind, count(*)::bigint n from part group by 1""")
def node_classes(t):
    k = F.col("p_size") % 4
    kind = filters.first_reason({"PHYSICAL_BUS": F.col("p_type").contains("STEEL") | (k == 0), "FEEDER": k == 1, "AUXILIARY": k == 2}, "UNCLASSIFIED")
    return t.part.groupBy(kind.alias("kind")).agg(n())


@query("""select o_custkey, count(*)::bigint n_cases, count(*) filter (o_orderstatus = 'F')::bigint solved, case when count(*) filter (o_orderstatus = 'F') = count(*) then 'COMPLETE' when count(*) filter (o_orderstatus = 'F') = 0 then 'NONE' else 'PARTIAL' end completeness from orders group by 1""")
def solve_completeness(t):
    solved = F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.groupBy("o_custkey").agg(n("n_cases"), solved.cast("long").alias("solved"), F.when(solved == F.count("*"), "COMPLETE").when(solved == 0, "NONE").otherwise("PARTIAL").alias("completeness"))


@query("""select s_suppkey, round(x, 8) x, round(0.1 * x, 8) r from (select s_suppkey, case when s_acctbal > 0 then 1.1 * 154 * 154 / (s_acctbal * sqrt(1 + 0.1 * 0.1)) end x from supplier)""")
def source_impedance(t):
    x = F.when(F.col("s_acctbal") > 0, 1.1 * 154 * 154 / (F.col("s_acctbal") * F.sqrt(F.lit(1 + 0.1 * 0.1))))
    return t.supplier.select("s_suppkey", F.round(x, 8).alias("x"), F.round(0.1 * x, 8).alias("r"))
