"""Registered queries over the star schema, each with the SQL that gives the same rows.

An equipment row is an order or line item, the type table is part, the hierarchy is region, nation, customer, order; the
reference is l_extendedprice and the calculated value p_retailprice * l_quantity.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltspan.functions import stats
from voltspan.operators import catalog, graph, hierarchy
from voltspan.plans.base import QUERIES, SQL, Tables, n, query

__all__ = ["QUERIES", "SQL", "Tables"]


@query("select c_custkey, c_name, c_acctbal from customer where contains(lower(c_name || ' ' || c_custkey), '11') order by c_acctbal desc nulls last, c_custkey limit 20 offset 20")
def catalog_search_page(t):
    return catalog.page(catalog.search(t.customer, "11", "c_name", "c_custkey").select("c_custkey", "c_name", "c_acctbal"), [F.desc_nulls_last("c_acctbal"), F.asc("c_custkey")], 1)


BANDS = ("low", "mid", "high", "top")


@query("select o_orderkey, band from (select o_orderkey, case when o_orderkey % 7 = 0 then null when o_totalprice >= 300000 then 'top' when o_totalprice >= 200000 then 'high' when o_totalprice >= 100000 then 'mid' else 'low' end band from orders) where band in ('mid', 'top')")
def catalog_band_filter(t):
    value = F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_totalprice"))
    df = t.orders.select("o_orderkey", catalog.band(value, (float("-inf"), 100000, 200000, 300000), BANDS).alias("band"))
    return catalog.band_filter(df, F.col("band"), ("mid", "top"), BANDS)


@query("select o_orderkey, o_totalprice from orders where o_totalprice between 50000 and 120000 or o_totalprice between 110000 and 170000")
def overlap_band_filter(t):
    return t.orders.where(catalog.overlapping(F.col("o_totalprice"), [(50000, 120000), (110000, 170000)])).select("o_orderkey", "o_totalprice")


@query("select r_name, n_name, count(*)::bigint n_customers, string_agg(distinct c_mktsegment, ' / ' order by c_mktsegment desc) segments from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by all")
def hierarchy_rollup(t):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(n("n_customers"), F.array_join(F.reverse(F.array_sort(F.collect_set("c_mktsegment"))), " / ").alias("segments"))


@query("""with recursive node as (select 'C' || c_custkey id, 'N' || c_nationkey parent from customer union all select 'N' || n_nationkey, 'R' || n_regionkey from nation union all select 'R' || r_regionkey, null from region),
chain as (select id, id anc, parent, 0 depth from node where id like 'C%' union all select c.id, n.id, n.parent, c.depth + 1 from chain c join node n on n.id = c.parent where c.depth < 24)
select id, anc as ancestor, depth::bigint depth from chain where parent is null""")
def ancestor_chain(t):
    node = t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.concat(F.lit("N"), "c_nationkey").alias("parent"))
    tree = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("up"), F.concat(F.lit("R"), "n_regionkey").alias("above"))
    tree = tree.unionByName(t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("up"), F.lit(None).cast("string").alias("above")))
    chains = hierarchy.ancestors(node.select("id", "parent"), tree.select(F.col("up").alias("id"), F.col("above").alias("parent")), 24)
    return chains.groupBy("id").agg(F.max_by("ancestor", "depth").alias("ancestor"), F.max("depth").alias("depth"))


@query("select n_name, count(*)::bigint n_lines, round(sum(l_quantity), 4) quantity from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey group by all")
def two_hop_join(t):
    joined = t.lineitem.select("l_orderkey", "l_quantity").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_name").agg(n("n_lines"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query("select coalesce(case when p_size % 5 = 0 then null else p_brand end, p_type, '-') kind, count(*)::bigint n, round(sum(l_quantity), 4) quantity from lineitem left join part on l_partkey = p_partkey group by 1")
def type_enrichment(t):
    joined = t.lineitem.select("l_partkey", "l_quantity").join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.groupBy(F.coalesce(F.when(F.col("p_size") % 5 != 0, F.col("p_brand")), "p_type", F.lit("-")).alias("kind")).agg(n(), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query("select l_orderkey, round(sum(l_quantity * l_discount), 6) total, min(l_extendedprice) least, arg_min(l_linenumber, (l_extendedprice, l_linenumber))::bigint limiting from lineitem group by 1")
def section_sum_min(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")), 6).alias("total"), F.min("l_extendedprice").alias("least"), F.min_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).cast("long").alias("limiting"))


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def last_duplicate_wins(t):
    return catalog.last_wins(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("select c_custkey, o_orderkey from customer left join (select o_custkey, min(o_orderkey) o_orderkey from orders where o_orderstatus = 'P' group by 1 having count(*) = 1) on o_custkey = c_custkey")
def ambiguity_null_join(t):
    right = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return catalog.unambiguous_join(t.customer.select("c_custkey"), right, "c_custkey")


@query("select case when o_orderkey % 10 = 3 then 'X' else o_orderstatus end status, count(*)::bigint n from orders group by 1")
def overlay_apply(t):
    overrides = t.orders.where("o_orderkey % 10 = 3").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return catalog.overlay(t.orders.select("o_orderkey", "o_orderstatus"), overrides, "o_orderkey", "o_orderstatus").groupBy(F.col("o_orderstatus").alias("status")).agg(n())


def _year(t, year: int) -> DataFrame:
    return t.orders.where((F.col("o_orderdate") >= f"{year}-01-01") & (F.col("o_orderdate") < f"{year + 1}-01-01")).groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


_YEARS = "a as (select o_custkey, round(sum(o_totalprice), 2) total from orders where year(o_orderdate) = 1996 group by 1), b as (select o_custkey, round(sum(o_totalprice), 2) total from orders where year(o_orderdate) = 1997 group by 1)"


@query(f"with {_YEARS} select o_custkey, a.total base, b.total other, case when a.total is null then 'ADDED' when b.total is null then 'REMOVED' else 'COMPARED' end state, round(b.total - a.total, 2) delta from a full join b using (o_custkey)")
def full_outer_delta(t):
    return catalog.full_delta(_year(t, 1996), _year(t, 1997), "o_custkey", "total").withColumn("delta", F.round("delta", 2))


@query(f"with {_YEARS} select o_custkey, reason, case when reason = 'OK' then round(b - a, 2) end delta from (select o_custkey, a.total a, b.total b, case when a.total is null then 'NO_BASE' when b.total is null then 'NO_SCENARIO' when o_custkey % 11 = 0 then 'IDENTITY' when a.total < 100000 then 'DENOMINATOR' else 'OK' end reason from a full join b using (o_custkey))")
def gated_delta(t):
    d = catalog.full_delta(_year(t, 1996), _year(t, 1997), "o_custkey", "total")
    reason = F.when(F.col("base").isNull(), "NO_BASE").when(F.col("other").isNull(), "NO_SCENARIO").when(F.col("o_custkey") % 11 == 0, "IDENTITY").when(F.col("base") < 100000, "DENOMINATOR").otherwise("OK")
    return d.withColumn("reason", reason).select("o_custkey", "reason", F.when(F.col("reason") == "OK", F.round("delta", 2)).alias("delta"))


def _large_partial(t) -> DataFrame:
    return t.orders.where("o_orderstatus = 'P' and o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_totalprice > 350000)")
def unmatched_anti(t):
    return t.customer.select("c_custkey").join(_large_partial(t), "c_custkey", "left_anti")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_totalprice > 350000)")
def matched_semi(t):
    return t.customer.select("c_custkey").join(_large_partial(t), "c_custkey", "left_semi")


_LIMITS = [(0, None, 10.0), (3, None, 20.0), (None, "BUILDING", 30.0), (3, "BUILDING", 40.0), (7, "MACHINERY", 50.0), (None, None, 5.0)]


@query("""with p(nation, segment, cap) as (values (0, null, 10.0::double), (3, null, 20.0), (null, 'BUILDING', 30.0), (3, 'BUILDING', 40.0), (7, 'MACHINERY', 50.0), (null, null, 5.0)),
m as (select c_custkey, cap, rank() over (partition by c_custkey order by (nation is not null)::int + (segment is not null)::int desc) r from customer join p on (nation is null or nation = c_nationkey) and (segment is null or segment = c_mktsegment))
select c_custkey, case when count(distinct cap) = 1 then min(cap) end cap, count(distinct cap) > 1 conflict from m where r = 1 group by 1""")
def specificity_limits(t):
    p = t.spark.createDataFrame(_LIMITS, "nation int, segment string, cap double")
    joined = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment").join(F.broadcast(p), (F.col("nation").isNull() | (F.col("nation") == F.col("c_nationkey"))) & (F.col("segment").isNull() | (F.col("segment") == F.col("c_mktsegment"))))
    exact = F.col("nation").isNotNull().cast("int") + F.col("segment").isNotNull().cast("int")
    best = joined.withColumn("r", F.rank().over(Window.partitionBy("c_custkey").orderBy(exact.desc()))).where("r = 1")
    kinds = F.count_distinct("cap")
    return best.groupBy("c_custkey").agg(F.when(kinds == 1, F.min("cap")).alias("cap"), (kinds > 1).alias("conflict"))


@query("with s as (select l_suppkey, l_orderkey, list_sort(list(distinct l_partkey % 20)) k from lineitem group by all), g as (select k, count(*) c, min(l_orderkey) f from s group by 1 having count(*) > 1) select array_to_string(k, ',') members, c::bigint n, f as first_order from g")
def set_keyed_match(t):
    sets = t.lineitem.groupBy("l_suppkey", "l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 20)).alias("k"))
    return sets.groupBy(F.array_join("k", ",").alias("members")).agg(n(), F.min("l_orderkey").alias("first_order")).where("n > 1")


def _set_ops(customers: DataFrame, suppliers: DataFrame, others: DataFrame) -> DataFrame:
    c = customers.select(F.col("c_nationkey").cast("long").alias("k"))
    s, some = (x.select(F.col("s_nationkey").cast("long").alias("k")) for x in (suppliers, others))
    parts = {"union": c.union(s).distinct(), "except": c.subtract(some), "intersect": c.intersect(some)}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("op"), "k")
        out = df if out is None else out.unionByName(df)
    return out


@query("select 'union' op, k::bigint k from (select c_nationkey k from customer union select s_nationkey from supplier) union all select 'except', k from (select c_nationkey k from customer except select s_nationkey from supplier) union all select 'intersect', k from (select c_nationkey k from customer intersect select s_nationkey from supplier)")
def set_ops(t):
    return _set_ops(t.customer, t.supplier, t.supplier)


@query("select l_suppkey, l_orderkey, l_linenumber, r::bigint as rank from (select *, row_number() over (partition by l_suppkey order by coalesce(case when l_orderkey % 9 = 0 then null else l_extendedprice end, -1) desc, abs(l_discount) desc, l_orderkey, l_linenumber, l_partkey) r from lineitem) where r <= 10")
def topk_impacts(t):
    loading = F.coalesce(F.when(F.col("l_orderkey") % 9 != 0, F.col("l_extendedprice")), F.lit(-1.0))
    return catalog.top_k(t.lineitem, ["l_suppkey"], [loading.desc(), F.abs("l_discount").desc(), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 10).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("select l_partkey, count(*)::bigint n, count(distinct l_suppkey)::bigint n_suppliers, max(l_extendedprice) max_price, max(abs(l_discount - 0.05)) max_off from lineitem group by 1")
def critical_constraints(t):
    return t.lineitem.groupBy("l_partkey").agg(n(), F.count_distinct("l_suppkey").cast("long").alias("n_suppliers"), F.max("l_extendedprice").alias("max_price"), F.max(F.abs(F.col("l_discount") - 0.05)).alias("max_off"))


@query(f"with {_YEARS} select state, count(*)::bigint n from (select case when a.total is null then 'NEW' when b.total is null then 'RELIEVED' when b.total - a.total > 1e-9 then 'WORSENED' else 'PERSISTENT' end state from a full join b using (o_custkey)) group by 1")
def state_machine(t):
    d = catalog.full_delta(_year(t, 1996), _year(t, 1997), "o_custkey", "total")
    state = F.when(F.col("base").isNull(), "NEW").when(F.col("other").isNull(), "RELIEVED").when(F.col("other") - F.col("base") > 1e-9, "WORSENED").otherwise("PERSISTENT")
    return d.groupBy(state.alias("state")).agg(n())


@query("select o_orderpriority, count(*) filter (o_orderstatus = 'F')::bigint solved, count(*) filter (o_orderstatus = 'O')::bigint pending, count(*) filter (o_orderstatus = 'P')::bigint partial, count(*) filter (o_orderstatus not in ('F', 'O', 'P'))::bigint other from orders group by 1")
def case_outcomes(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_orderpriority").agg(*(F.count_if(c).cast("long").alias(k) for k, c in (("solved", s == "F"), ("pending", s == "O"), ("partial", s == "P"), ("other", ~s.isin("F", "O", "P")))))


@query("""with f as (select 'ERROR' severity, 'QUANTITY' code, count(*) filter (l_quantity > 45) c from lineitem union all select 'WARNING', 'DISCOUNT', count(*) filter (l_discount >= 0.09) from lineitem union all select 'INFO', 'TAX', count(*) filter (l_tax = 0) from lineitem)
select s.severity, coalesce(sum(c), 0)::bigint n, count(c)::bigint n_rules from (values ('BLOCKER'), ('ERROR'), ('WARNING'), ('INFO')) s(severity) left join f using (severity) group by 1""")
def quality_findings(t):
    rules = [("ERROR", "QUANTITY", F.col("l_quantity") > 45), ("WARNING", "DISCOUNT", F.col("l_discount") >= 0.09), ("INFO", "TAX", F.col("l_tax") == 0)]
    wide = t.lineitem.agg(*(F.count_if(c).alias(code) for _, code, c in rules))
    found = wide.select(F.explode(F.array(*(F.struct(F.lit(s).alias("severity"), F.col(code).alias("c")) for s, code, _ in rules))).alias("f")).select("f.*")
    grid = t.spark.createDataFrame([("BLOCKER",), ("ERROR",), ("WARNING",), ("INFO",)], "severity string")
    return grid.join(found, "severity", "left").groupBy("severity").agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"), F.count("c").cast("long").alias("n_rules"))


def _metric(t) -> DataFrame:
    return t.lineitem.join(t.part.select("p_partkey", "p_retailprice", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "p_brand", F.col("l_extendedprice").alias("ref"), (F.col("p_retailprice") * F.col("l_quantity")).alias("calc"))


_METRIC = "m as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus, p_brand, l_extendedprice ref, p_retailprice * l_quantity calc from lineitem join part on l_partkey = p_partkey)"


@query(f"with {_METRIC} select l_returnflag, count(*)::bigint n, round(avg(abs(abs(calc) - abs(ref))), 4) mean_abs, round(100 * sum(abs(abs(calc) - abs(ref))) / sum(abs(ref)), 6) normalised, round(avg(calc - ref), 4) bias, count(*) filter (sign(calc) <> sign(ref) and abs(ref) > 1e-6)::bigint sign_differs from m group by 1")
def kpi_abs_avg(t):
    out = _metric(t).groupBy("l_returnflag").agg(*stats.absolute_kpi("calc", "ref"))
    return out.withColumns({"mean_abs": F.round("mean_abs", 4), "normalised": F.round("normalised", 6), "bias": F.round("bias", 4)})


@query("""with k as (select l_returnflag, l_extendedprice v, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 k, count(*) over (partition by l_returnflag) n from lineitem)
select l_returnflag, quantile_disc(v, 0.95) nearest, round(quantile_cont(v, 0.95), 6) interpolated, max(case when k = floor((n - 1) * 0.95) then v end) floor_index, max(case when k = floor(n / 2) then v end) upper_median, max(case when k = floor((n - 1) / 2) then v end) lower_median from k group by 1""")
def quantile_suite(t):
    df = t.lineitem.select("l_returnflag", "l_extendedprice")
    out = df.groupBy("l_returnflag").agg(stats.nearest_rank("l_extendedprice", 0.95).alias("nearest"), F.round(stats.interpolated("l_extendedprice", 0.95), 6).alias("interpolated"))
    size = F.col("n")
    places = {"floor_index": F.floor((size - 1) * 0.95), "upper_median": F.floor(size / 2), "lower_median": F.floor((size - 1) / 2)}
    return out.join(stats.at_places(df, "l_returnflag", "l_extendedprice", places), "l_returnflag")


@query(f"with {_METRIC} select l_returnflag, l_linestatus, count(*)::bigint n, round(avg(abs(calc - ref)), 4) mae, round(sqrt(avg((calc - ref) * (calc - ref))), 4) rmse from m group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())")
def error_grouping_sets(t):
    e = F.col("calc") - F.col("ref")
    sets = [[F.col("l_returnflag"), F.col("l_linestatus")], [F.col("l_returnflag")], []]
    return _metric(t).groupingSets(sets, "l_returnflag", "l_linestatus").agg(n(), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"))


@query(f"""with {_METRIC}, s as (select p_brand, count(*)::bigint eligible, count(*) filter (l_linenumber % 5 <> 0)::bigint matched, count(*) filter (l_linenumber % 5 <> 0 and abs(calc - ref) <= 100 + 0.5 * abs(ref))::bigint n_within from m where l_returnflag = 'R' group by 1)
select g.p_brand, coalesce(eligible, 0) eligible, coalesce(matched, 0) matched, coalesce(n_within, 0) n_within, round(matched / nullif(eligible, 0), 6) coverage, round(n_within / nullif(matched, 0), 6) agreement from (select distinct p_brand from part union select 'Brand#none') g left join s using (p_brand)""")
def scorecard(t):
    ok = F.col("l_linenumber") % 5 != 0
    s = _metric(t).where("l_returnflag = 'R'").groupBy("p_brand").agg(n("eligible"), F.count_if(ok).alias("matched"), F.count_if(ok & (F.abs(F.col("calc") - F.col("ref")) <= 100 + 0.5 * F.abs("ref"))).alias("n_within"))
    grid = t.part.select("p_brand").union(t.spark.createDataFrame([("Brand#none",)], "p_brand string")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return grid.join(s, "p_brand", "left").select("p_brand", zero("eligible"), zero("matched"), zero("n_within"), F.round(F.col("matched") / F.nullif("eligible", F.lit(0)), 6).alias("coverage"), F.round(F.col("n_within") / F.nullif("matched", F.lit(0)), 6).alias("agreement"))


@query("select l_orderkey, case when max(l_discount) - min(l_discount) <= 0.03 then min(l_discount) end discount from lineitem group by 1")
def consistency_groups(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.when(F.max("l_discount") - F.min("l_discount") <= 0.03, F.min("l_discount")).alias("discount"))


@query("select c_custkey, round(case when s > 1e-9 then greatest(c_acctbal, 0) / s else 1.0 / k end, 10) share from (select *, sum(greatest(c_acctbal, 0)) over (partition by c_nationkey) s, count(*) over (partition by c_nationkey) k from customer)")
def participation_weights(t):
    return catalog.shares(t.customer, "c_nationkey", "c_acctbal").select("c_custkey", F.round("share", 10).alias("share"))


@query("""with c as (select p_brand, p_size s, avg(p_retailprice) v from part where p_size % 10 = 0 group by all), q as (select p_partkey, p_brand, p_size from part),
lo as (select p_partkey, max(s) s0 from q join c using (p_brand) where s <= p_size group by 1), hi as (select p_partkey, min(s) s1 from q join c using (p_brand) where s >= p_size group by 1)
select q.p_partkey, round(case when lo.s0 is null then h.v when hi.s1 is null then l.v when hi.s1 = lo.s0 then l.v else l.v + (h.v - l.v) * (p_size - lo.s0) / (hi.s1 - lo.s0) end, 6) price from q left join lo using (p_partkey) left join hi using (p_partkey) left join c l on l.p_brand = q.p_brand and l.s = lo.s0 left join c h on h.p_brand = q.p_brand and h.s = hi.s1""")
def interpolate_curve(t):
    curve = t.part.where("p_size % 10 = 0").groupBy("p_brand", F.col("p_size").alias("s")).agg(F.avg("p_retailprice").alias("v"))
    price = catalog.interpolated(t.part.select("p_partkey", "p_brand", "p_size"), curve, "p_brand", "p_size", "s", "v")
    return price.select("p_partkey", F.round("value", 6).alias("price"))


def _edges(t) -> DataFrame:
    """All links between suppliers and parts: one component holds nearly all nodes."""
    return t.lineitem.select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")).distinct()


_EDGES = "e as (select distinct l_suppkey * 2 a, l_partkey * 2 + 1 b from lineitem), d as (select a, b from e union all select b, a from e)"


# Labels spread along links while they fall; each node keeps the last.
_LABELS = f"{_EDGES}, r(node, component) using key (node) as (select distinct a, a from d union select d.b, min(r.component) from r join d on d.a = r.node join recurring.r q on q.node = d.b where r.component < q.component group by d.b)"


@query(f"with recursive {_LABELS} select node, component from r")
def components_bipartite(t):
    return graph.components(_edges(t))


@query(f"with recursive {_LABELS} select component, count(*)::bigint n_nodes, count(*) filter (node % 2 = 0)::bigint n_suppliers, max(node) largest from r group by 1")
def component_stats(t):
    return _component_stats(graph.components(_edges(t)))


def _component_stats(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(n("n_nodes"), F.count_if(F.col("node") % 2 == 0).cast("long").alias("n_suppliers"), F.max("node").alias("largest"))


@query(f"with recursive {_EDGES}, r as (select min(a) node, 0 hops from e union select b, hops + 1 from r join d on d.a = r.node where hops < 4) select node, min(hops)::bigint hops from r group by 1")
def bfs_bounded(t):
    return _four_hops(_edges(t))


def _four_hops(edges: DataFrame) -> DataFrame:
    return graph.within(edges, edges.agg(F.min("a").alias("node")), 4)


@query(f"with {_EDGES}, s as (select a i, a j, 1 y from e union all select b, b, 1 from e union all select a, b, -1 from e union all select b, a, -1 from e) select i, j, sum(y)::bigint y from s group by all")
def ybus_assembly(t):
    return _ybus(_edges(t))


def _ybus(edges: DataFrame) -> DataFrame:
    stamp = lambda i, j, y: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(y).alias("y"))
    return edges.select(F.explode(F.array(stamp("a", "a", 1), stamp("b", "b", 1), stamp("a", "b", -1), stamp("b", "a", -1))).alias("s")).groupBy("s.i", "s.j").agg(F.sum("s.y").cast("long").alias("y"))


@query("select k::bigint nation, round(sum(v), 4) injection from (select c_nationkey k, -c_acctbal v from customer union all select s_nationkey, s_acctbal from supplier) group by 1")
def nodal_injection(t):
    both = t.customer.select(F.col("c_nationkey").alias("k"), (-F.col("c_acctbal")).alias("v")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v")))
    return both.groupBy(F.col("k").cast("long").alias("nation")).agg(F.round(F.sum("v"), 4).alias("injection"))


@query("select l_orderkey, l_linenumber, l_partkey, metric, value from (select l_orderkey, l_linenumber, l_partkey, l_quantity quantity, l_discount discount, l_tax tax from lineitem) unpivot (value for metric in (quantity, discount, tax))")
def unpivot_metrics(t):
    return _metrics(t.lineitem)


def _metrics(lines: DataFrame) -> DataFrame:
    return lines.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], [F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")], "metric", "value")


def _points(t) -> DataFrame:
    cells = t.embeddings.select("vec_id", F.posexplode("embedding").alias("col", "val"))
    return cells.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("p"))


@query("select vec_id, len(embedding)::bigint n, array_to_string(list_transform(embedding, lambda x: floor(x::double * 1e9)::bigint), ',') as points from embeddings")
def matrix_to_points(t):
    # In whole units of 1e-9, since the engines write floats differently.
    whole = F.transform("p", lambda x: F.floor(x["val"].cast("double") * F.lit(1e9)).cast("string"))
    return _points(t).select("vec_id", F.size("p").cast("long").alias("n"), F.array_join(whole, ",").alias("points"))


@query("select user_id, event_id, event_type, lag(event_type) over w before, round(value - lag(value) over w, 6) change from events window w as (partition by user_id order by ts, event_id)")
def event_diff(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_id", "event_type", F.lag("event_type").over(w).alias("before"), F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"))


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_state(t):
    return catalog.last_wins(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("""select c_custkey, '"' || replace(case when regexp_matches(v, '^[\\s\\x00-\\x1f]*[=+@-]') then '''' || v else v end, '"', '""') || '"' as cell, '"' || replace(c_acctbal::varchar, '.', ',') || '"' as balance from (select c_custkey, c_acctbal, case when c_custkey % 3 = 0 then '=' || c_name when c_custkey % 3 = 1 then c_name || '"x' else ' -' || c_name end v from customer)""")
def csv_escape(t):
    k = F.col("c_custkey") % 3
    v = F.when(k == 0, F.concat(F.lit("="), "c_name")).when(k == 1, F.concat("c_name", F.lit('"x'))).otherwise(F.concat(F.lit(" -"), "c_name"))
    safe = F.when(F.regexp_like(v, F.lit(r"^[\s\x00-\x1f]*[=+@-]")), F.concat(F.lit("'"), v)).otherwise(v)
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return t.customer.select("c_custkey", quote(safe).alias("cell"), quote(F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))).alias("balance"))


@query("""select o_orderkey, sha256('{"key":"' || o_orderkey || '","priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') as signature from orders""")
def stable_signature(t):
    entries = F.array_sort(F.map_entries(F.create_map(F.lit("status"), "o_orderstatus", F.lit("key"), F.col("o_orderkey").cast("string"), F.lit("priority"), "o_orderpriority")))
    return t.orders.select("o_orderkey", F.sha2(F.to_json(F.map_from_entries(entries)), 256).alias("signature"))


@query("select doc_id, sha256(regexp_replace(lower(strip_accents(text)), '[^a-z0-9_]+', '', 'g')) as key from documents")
def text_normalise(t):
    # Compatibility decomposition and removal of marks: a JVM expression has no such function, so Arrow batches do it.
    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))

    return t.documents.select("doc_id", F.sha2(F.regexp_replace(F.lower(plain("text")), "[^a-z0-9_]+", ""), 256).alias("key"))


from voltspan.plans import analytics, energization, joins, ledger, maps, network, ordering, outages, overlays, predicates, presets, reports, rowlevel, scalars, slots, stations, storage, studies  # noqa: E402, F401
