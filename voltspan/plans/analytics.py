"""Aggregations of studies, comparisons and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltspan.functions import stats
from voltspan.operators.tables import settle
from voltspan.plans.base import n, query


@query("select class, n from (select 'customer' as class, count(*)::bigint n from customer union all select 'supplier', count(*) from supplier union all select 'part', count(*) from part union all select 'total', (select count(*) from customer) + (select count(*) from supplier) + (select count(*) from part))")
def class_counts(t):
    counts = None
    for name in ("customer", "supplier", "part"):
        df = getattr(t, name).agg(n()).select(F.lit(name).alias("class"), "n")
        counts = df if counts is None else counts.unionByName(df)
    return counts.rollup("class").agg(F.sum("n").alias("n")).select(F.coalesce("class", F.lit("total")).alias("class"), "n")


@query("select count(*)::bigint n, count(*) filter (c_acctbal > 0)::bigint live, count(*) filter (c_acctbal <= 0)::bigint virtual, count(distinct c_nationkey)::bigint sites, count(*) filter (c_mktsegment = 'BUILDING')::bigint with_geo from customer")
def statistics_card(t):
    positive = F.col("c_acctbal") > 0
    return t.customer.agg(n(), F.count_if(positive).cast("long").alias("live"), F.count_if(~positive).cast("long").alias("virtual"), F.count_distinct("c_nationkey").cast("long").alias("sites"), F.count_if(F.col("c_mktsegment") == "BUILDING").cast("long").alias("with_geo"))


@query("with u as (select s_nationkey bus, s_acctbal p, case when s_suppkey % 7 = 0 then null else s_acctbal * 2 end q from supplier) select bus, round(sum(p), 4) p, case when bool_and(q is not null) then round(sum(q), 4) end q_limit, count(*)::bigint n from u group by 1")
def pv_grouping(t):
    q = F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal") * 2)
    return t.supplier.groupBy(F.col("s_nationkey").alias("bus")).agg(F.round(F.sum("s_acctbal"), 4).alias("p"), F.when(F.bool_and(q.isNotNull()), F.round(F.sum(q), 4)).alias("q_limit"), n())


@query("""select n_regionkey::bigint island, round(coalesce(sum(g), 0), 4) generation, round(coalesce(sum(l), 0), 4) load, round(coalesce(sum(g), 0) - coalesce(sum(l), 0), 4) net, string_agg(distinct src, ',' order by src) refs
from nation left join (select s_nationkey k, s_acctbal g, null::double l, case when s_acctbal > 9000 then 'S' || s_suppkey end src from supplier union all select c_nationkey, null, greatest(c_acctbal, 0), null from customer) on k = n_nationkey group by 1""")
def island_balance(t):
    gen = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("g"), F.lit(None).cast("double").alias("l"), F.when(F.col("s_acctbal") > 9000, F.concat(F.lit("S"), "s_suppkey")).alias("src"))
    load = t.customer.select(F.col("c_nationkey").alias("k"), F.lit(None).cast("double").alias("g"), F.greatest("c_acctbal", F.lit(0.0)).alias("l"), F.lit(None).cast("string").alias("src"))
    joined = t.nation.join(gen.unionByName(load), F.col("k") == F.col("n_nationkey"), "left")
    g, load_sum = F.coalesce(F.sum("g"), F.lit(0.0)), F.coalesce(F.sum("l"), F.lit(0.0))
    refs = F.nullif(F.array_join(F.array_sort(F.collect_set("src")), ","), F.lit(""))
    return joined.groupBy(F.col("n_regionkey").cast("long").alias("island")).agg(F.round(g, 4).alias("generation"), F.round(load_sum, 4).alias("load"), F.round(g - load_sum, 4).alias("net"), refs.alias("refs"))


@query("with c as (select l_suppkey k, list(struct_pack(a := l_orderkey, b := l_extendedprice) order by l_orderkey) v from lineitem where l_quantity > 48 group by 1) select k, count(*)::bigint n, round(sum(x.b), 2) total from (select k, unnest(v) x from c) group by 1")
def violation_rows(t):
    packed = t.lineitem.where("l_quantity > 48").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_list(F.struct(F.col("l_orderkey").alias("a"), F.col("l_extendedprice").alias("b"))).alias("v"))
    return packed.select("k", F.explode("v").alias("x")).groupBy("k").agg(n(), F.round(F.sum("x.b"), 2).alias("total"))


@query("""with f as (select 'Q' code, l_partkey id, l_orderkey % 4 as origin, case when l_discount > 0.08 then 0 when l_discount > 0.04 then 1 else 2 end rank, l_returnflag ev from lineitem where l_quantity > 40)
select code, id, min(rank)::bigint as rank, string_agg(distinct origin::varchar, ',' order by origin::varchar) origins, string_agg(distinct ev, ',' order by ev) evidence, count(*)::bigint n from f group by 1, 2""")
def finding_merge(t):
    rank = F.when(F.col("l_discount") > 0.08, 0).when(F.col("l_discount") > 0.04, 1).otherwise(2)
    union = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return t.lineitem.where("l_quantity > 40").groupBy(F.lit("Q").alias("code"), F.col("l_partkey").alias("id")).agg(F.min(rank).cast("long").alias("rank"), union((F.col("l_orderkey") % 4).cast("string")).alias("origins"), union(F.col("l_returnflag")).alias("evidence"), n())


_METRIC = "m as (select l_orderkey, l_linenumber, l_partkey, l_returnflag, l_suppkey, case when l_orderkey % 9 = 0 then null else l_extendedprice end ref, case when l_orderkey % 7 = 0 then null else p_retailprice * l_quantity end calc from lineitem join part on l_partkey = p_partkey)"


def _metric(t) -> DataFrame:
    joined = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    k = F.col("l_orderkey")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_suppkey", F.when(k % 9 != 0, F.col("l_extendedprice")).alias("ref"), F.when(k % 7 != 0, F.col("p_retailprice") * F.col("l_quantity")).alias("calc"))


_STATS = """count(*)::bigint n, count(calc)::bigint matched, count(e)::bigint comparable, count(*) filter (calc is null)::bigint no_result, count(*) filter (calc is not null and ref is null)::bigint no_reference, round(avg(e), 4) bias, round(quantile_cont(e, 0.5), 6) median, round(avg(abs(e)), 4) mae, round(sqrt(avg(e * e)), 4) rmse,
quantile_disc(abs(e), 0.5) p50, quantile_disc(abs(e), 0.95) p95, quantile_disc(abs(e), 0.99) p99, max(abs(e)) worst, arg_max(id, (abs(e), id)) filter (e is not null) worst_id"""


def _statistics() -> list:
    e, has = F.col("e"), F.col("calc").isNotNull()
    return [
        n(),
        F.count("calc").cast("long").alias("matched"),
        F.count("e").cast("long").alias("comparable"),
        F.count_if(~has).cast("long").alias("no_result"),
        F.count_if(has & F.col("ref").isNull()).cast("long").alias("no_reference"),
        F.round(F.avg(e), 4).alias("bias"),
        F.round(F.avg(F.abs(e)), 4).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
        F.max(F.abs(e)).alias("worst"),
        F.max_by("id", F.when(e.isNotNull(), F.struct(F.abs(e), F.col("id")))).alias("worst_id"),
    ]


@query(f"with {_METRIC}, e as (select *, calc - ref e, l_orderkey * 10 + l_linenumber id from m) select l_returnflag, {_STATS} from e group by 1")
def metric_statistics(t):
    df = _metric(t).withColumns({"e": F.col("calc") - F.col("ref"), "id": F.col("l_orderkey") * 10 + F.col("l_linenumber")})
    # Quantiles by place: an aggregate of them would hold all values of a flag in one task. A null flag is a group too.
    flag = F.coalesce(F.concat(F.lit("="), F.col("l_returnflag")), F.lit("")).alias("flag")
    held = settle(df.where("e is not null").select(flag, "e", F.abs("e").alias("size")), "errors")
    size = F.col("n")
    middle = stats.at_places(held, "flag", "e", {"low": F.floor((size - 1) / 2), "high": F.floor(size / 2)})
    # The place is ceil(n p), in whole numbers.
    places = stats.at_places(held, "flag", "size", {f"p{p}": F.floor((size * p + 99) / 100) - 1 for p in (50, 95, 99)})
    out = df.groupBy("l_returnflag").agg(*_statistics()).withColumn("flag", flag).join(middle, "flag", "left").join(places, "flag", "left")
    return out.withColumn("median", F.round((F.col("low") + F.col("high")) / 2, 6)).drop("flag", "low", "high")


@query(f"""with {_METRIC}, d as (select l_orderkey, l_returnflag, l_suppkey % 5 band, min(calc - ref) e from m where calc is not null and ref is not null group by all)
select case when grouping(l_returnflag) = 0 then 'METRIC' when grouping(band) = 0 then 'BAND' else 'ALL' end dimension, coalesce(l_returnflag, band::varchar, '') as grp, count(*)::bigint n, round(avg(abs(e)), 4) mae, round(max(abs(e)), 4) worst from d group by grouping sets ((l_returnflag), (band), ())""")
def diagnostic_statistics(t):
    # One value counts once for each source cell, here an order, flag and band.
    cells = _metric(t).where("calc is not null and ref is not null").groupBy("l_orderkey", "l_returnflag", (F.col("l_suppkey") % 5).alias("band")).agg(F.min(F.col("calc") - F.col("ref")).alias("e"))
    out = cells.groupingSets([[F.col("l_returnflag")], [F.col("band")], []], "l_returnflag", "band").agg(F.grouping("l_returnflag").alias("gr"), F.grouping("band").alias("gb"), n(), F.round(F.avg(F.abs("e")), 4).alias("mae"), F.round(F.max(F.abs("e")), 4).alias("worst"))
    dimension = F.when(F.col("gr") == 0, "METRIC").when(F.col("gb") == 0, "BAND").otherwise("ALL")
    return out.select(dimension.alias("dimension"), F.coalesce("l_returnflag", F.col("band").cast("string"), F.lit("")).alias("grp"), "n", "mae", "worst")


_REASON = "case when calc is null then 'NO_RESULT' when ref is null then 'NO_REFERENCE' when l_linenumber = 3 then 'IDENTITY' else 'OK' end"


@query(f"""with {_METRIC}, e as (select *, {_REASON} reason, abs(calc - ref) e from m), h as (select l_returnflag, reason, count(*) c from e group by all)
select l_returnflag, count(*)::bigint eligible, count(*) filter (reason = 'OK')::bigint matched, count(*) filter (reason = 'OK' and e <= 50 + 0.2 * abs(ref))::bigint n_within, round(avg(e) filter (reason = 'OK'), 4) mae, quantile_disc(e, 0.95) filter (reason = 'OK') p95, max(e) filter (reason = 'OK') worst,
(select string_agg(reason || '=' || c, ';' order by reason) from h where h.l_returnflag = e.l_returnflag) reasons from e group by 1""")
def scorecard_detail(t):
    reason = F.when(F.col("calc").isNull(), "NO_RESULT").when(F.col("ref").isNull(), "NO_REFERENCE").when(F.col("l_linenumber") == 3, "IDENTITY").otherwise("OK")
    df = _metric(t).withColumns({"reason": reason, "e": F.abs(F.col("calc") - F.col("ref"))}).withColumn("ok", F.when(F.col("reason") == "OK", F.col("e")))
    out = df.groupBy("l_returnflag").agg(n("eligible"), F.count("ok").cast("long").alias("matched"), F.count_if(F.col("ok") <= 50 + 0.2 * F.abs("ref")).cast("long").alias("n_within"), F.round(F.avg("ok"), 4).alias("mae"), F.expr("percentile_disc(0.95) within group (order by ok)").alias("p95"), F.max("ok").alias("worst"))
    kinds = df.groupBy("l_returnflag", "reason").agg(F.count("*").alias("c"))
    histogram = kinds.groupBy("l_returnflag").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "reason", "c"))), ";").alias("reasons"))
    return out.join(histogram, "l_returnflag")


@query(f"""with {_METRIC} select l_returnflag, round(avg(calc - ref), 4) signed, count(*) filter (sign(calc - 20000) <> sign(ref - 20000) and abs(ref - 20000) > 1e-6)::bigint sign_differs, round(quantile_cont(abs(abs(calc) - abs(ref)), 0.95), 6) p95, max(abs(abs(calc) - abs(ref))) worst from m where calc is not null and ref is not null group by 1""")
def kpi_secondary(t):
    a, b = F.col("calc") - 20000, F.col("ref") - 20000
    df = _metric(t).where("calc is not null and ref is not null").withColumn("off", F.abs(F.abs("calc") - F.abs("ref")))
    return df.groupBy("l_returnflag").agg(F.round(F.avg(F.col("calc") - F.col("ref")), 4).alias("signed"), F.count_if((F.signum(a) != F.signum(b)) & (F.abs(b) > 1e-6)).cast("long").alias("sign_differs"), F.round(F.expr("percentile_cont(0.95) within group (order by off)"), 6).alias("p95"), F.max("off").alias("worst"))


@query("""with r as (select o_custkey island, o_totalprice / 1000 resid, o_orderkey = min(o_orderkey) over (partition by o_custkey) and o_custkey % 2 = 0 as is_ref, row_number() over (partition by o_custkey order by o_totalprice) - 1 k, count(*) over (partition by o_custkey) c from orders),
o as (select island, coalesce(max(resid) filter (is_ref), max(resid) filter (k = c // 2)) as offset_value from r group by 1) select island, round(offset_value, 6) offset_value, round(max(abs(resid - offset_value)), 6) spread from o join r using (island) group by all""")
def island_angle_offset(t):
    df = t.orders.select(F.col("o_custkey").alias("island"), (F.col("o_totalprice") / 1000).alias("resid"), "o_orderkey")
    # Islands are bounded by their buses, so the sorted residuals of one are an array.
    per = df.groupBy("island").agg(F.array_sort(F.collect_list("resid")).alias("sorted"), F.min_by("resid", "o_orderkey").alias("first"))
    offset = F.when(F.col("island") % 2 == 0, F.col("first")).otherwise(F.element_at("sorted", (F.floor(F.size("sorted") / 2) + 1).cast("int")))
    per = per.withColumn("o", offset)
    return per.select("island", F.round("o", 6).alias("offset_value"), F.round(F.array_max(F.transform("sorted", lambda x: F.abs(x - F.col("o")))), 6).alias("spread"))


_VOLT = "v as (select s_nationkey site, s_suppkey id, s_suppkey % 3 kv, case when s_suppkey % 10 = 9 then null else 1 + s_acctbal / 100000 end v from supplier)"


def _volt(t) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("site"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).alias("kv"), F.when(F.col("s_suppkey") % 10 != 9, 1 + F.col("s_acctbal") / 100000).alias("v"))


@query(f"with {_VOLT} select site, kv, min(v) low, max(v) high, arg_max(v, (abs(v - 1), -id)) worst from v where v is not null group by all")
def site_voltages(t):
    return _volt(t).where("v is not null").groupBy("site", "kv").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max_by("v", F.struct(F.abs(F.col("v") - 1), -F.col("id"))).alias("worst"))


@query("""with a as (select s_nationkey site, s_suppkey id, s_suppkey % 3 island, s_acctbal / 100 angle from supplier), g as (select site, island, count(*) c from a group by all), d as (select site, arg_max(island, (c, -island)) island from g group by 1),
r as (select a.*, row_number() over (partition by site order by angle) - 1 k, count(*) over (partition by site) c from a join d using (site, island))
select site, island, round(quantile_cont(angle, 0.5), 8) median, max(angle) filter (k = (c - 1) // 2) representative from r group by all""")
def site_angles(t):
    a = t.supplier.select(F.col("s_nationkey").alias("site"), (F.col("s_suppkey") % 3).alias("island"), (F.col("s_acctbal") / 100).alias("angle"))
    sizes = a.groupBy("site", "island").agg(F.count("*").alias("c"))
    dominant = sizes.groupBy("site").agg(F.max_by("island", F.struct("c", -F.col("island"))).alias("island"))
    kept = a.join(dominant, ["site", "island"])
    # The lower of two middle values is the nearest-rank median.
    return kept.groupBy("site", "island").agg(F.round(F.expr("percentile_cont(0.5) within group (order by angle)"), 8).alias("median"), F.expr("percentile_disc(0.5) within group (order by angle)").alias("representative"))


@query(f"""with {_VOLT}, r as (select *, row_number() over (partition by site order by abs(v - 1) desc, id) k from v where v is not null)
select site, arg_min(id, k) worst, string_agg(kv || '@' || id, ' ' order by k) filter (k <= 32) as levels from r group by 1""")
def site_worst_levels(t):
    w = Window.partitionBy("site").orderBy(F.abs(F.col("v") - 1).desc(), "id")
    top = _volt(t).where("v is not null").withColumn("k", F.row_number().over(w)).where("k <= 32")
    rows = F.array_sort(F.collect_list(F.struct("k", "kv", "id")))
    return top.groupBy("site").agg(F.min_by("id", "k").alias("worst"), F.array_join(F.transform(rows, lambda x: F.concat_ws("@", x["kv"], x["id"])), " ").alias("levels"))


@query("""with p as (select l_returnflag f, l_quantity * 4 base, case when l_partkey % 12 = 0 then null else l_quantity * 4 * (0.8 + l_discount * 4) end post, l_tax dq from lineitem)
select f, count(*) filter (base < 100 and post >= 100)::bigint new_overloads, count(*) filter (base >= 100 and post < 100)::bigint resolved, round(max(abs(post - base)), 6) max_delta, case when count(post) > 0 then max(abs(dq)) end max_dq from p group by 1""")
def delta_summary(t):
    base = F.col("l_quantity") * 4
    df = t.lineitem.select(F.col("l_returnflag").alias("f"), base.alias("base"), F.when(F.col("l_partkey") % 12 != 0, base * (0.8 + F.col("l_discount") * 4)).alias("post"), F.col("l_tax").alias("dq"))
    return df.groupBy("f").agg(F.count_if((F.col("base") < 100) & (F.col("post") >= 100)).cast("long").alias("new_overloads"), F.count_if((F.col("base") >= 100) & (F.col("post") < 100)).cast("long").alias("resolved"), F.round(F.max(F.abs(F.col("post") - F.col("base"))), 6).alias("max_delta"), F.when(F.count("post") > 0, F.max(F.abs("dq"))).alias("max_dq"))


@query("select l_returnflag status, count(*)::bigint n_rows, count(distinct l_partkey)::bigint n_buses, count(distinct l_partkey) filter (l_linestatus = 'O')::bigint pending from lineitem group by 1")
def study_counts(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("status")).agg(n("n_rows"), F.count_distinct("l_partkey").cast("long").alias("n_buses"), F.count_distinct(F.when(F.col("l_linestatus") == "O", F.col("l_partkey"))).cast("long").alias("pending"))


@query("with b as (select l_partkey bus, l_extendedprice v, l_returnflag f from lineitem qualify row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc, l_suppkey desc, l_extendedprice desc) = 1) select f, count(*)::bigint n, round(avg(v), 4) mean, max(v) most from b group by 1")
def reference_summary(t):
    # Each electrical bus weighs the same; its last alias counts.
    last = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    buses = t.lineitem.groupBy("l_partkey").agg(F.max_by(F.struct(F.col("l_extendedprice").alias("v"), F.col("l_returnflag").alias("f")), last).alias("x"))
    return buses.groupBy("x.f").agg(n(), F.round(F.avg("x.v"), 4).alias("mean"), F.max("x.v").alias("most"))


@query("select l_suppkey k, count(*)::bigint n, count(*) filter (l_linenumber % 2 = 0)::bigint even, sum(count(*)) over ()::bigint total from lineitem group by 1")
def component_totals(t):
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(n(), F.count_if(F.col("l_linenumber") % 2 == 0).cast("long").alias("even"))
    return per.join(per.agg(F.sum("n").alias("total")))


@query("select s_nationkey site, max(s_suppkey % 5 * 100 + 50) highest from supplier where s_suppkey % 5 * 100 + 50 between 100 and 400 group by 1")
def highest_level(t):
    kv = F.col("s_suppkey") % 5 * 100 + 50
    return t.supplier.where(kv.between(100, 400)).groupBy(F.col("s_nationkey").alias("site")).agg(F.max(kv).alias("highest"))


@query(f"with {_VOLT}, bad as (select site, kv from v group by all having count(*) filter (id % 17 = 0) > 0) select site, kv, arg_max(id, (v, -id)) bus, count(*)::bigint n from v anti join bad using (site, kv) where v is not null group by all")
def highest_bus(t):
    v = _volt(t)
    bad = v.groupBy("site", "kv").agg(F.count_if(F.col("id") % 17 == 0).alias("c")).where("c > 0")
    return v.join(bad, ["site", "kv"], "left_anti").where("v is not null").groupBy("site", "kv").agg(F.max_by("id", F.struct("v", -F.col("id"))).alias("bus"), n())


@query("with g as (select c_nationkey site, c_custkey % 4 island, count(*) c from customer group by all) select site, arg_max(island, (c, -island)) dominant, count(*)::bigint n_islands from g group by 1")
def dominant_island(t):
    g = t.customer.groupBy(F.col("c_nationkey").alias("site"), (F.col("c_custkey") % 4).alias("island")).agg(F.count("*").alias("c"))
    return g.groupBy("site").agg(F.max_by("island", F.struct("c", -F.col("island"))).alias("dominant"), n("n_islands"))


@query("""with s as (select s_nationkey site, s_suppkey id, s_acctbal lat from supplier where s_suppkey % 6 <> 0), a as (select site, count(*) c, max(lat) - min(lat) spread from s group by 1)
select n_nationkey site, case when c is null then 'MISSING' when c > 1 and spread > 8000 then 'CONFLICTING' else 'OK' end status from nation left join a on site = n_nationkey""")
def coordinate_audit(t):
    a = t.supplier.where("s_suppkey % 6 <> 0").groupBy(F.col("s_nationkey").alias("site")).agg(F.count("*").alias("c"), (F.max("s_acctbal") - F.min("s_acctbal")).alias("spread"))
    status = F.when(F.col("c").isNull(), "MISSING").when((F.col("c") > 1) & (F.col("spread") > 8000), "CONFLICTING").otherwise("OK")
    return t.nation.select(F.col("n_nationkey").alias("site")).join(a, "site", "left").select("site", status.alias("status"))


@query("""with r as (select o_orderkey id, case when o_orderkey % 4 = 0 then null else o_custkey end a, case when o_orderkey % 6 = 0 then null else o_totalprice end b from orders)
select case when a is null and b is null then 'BLOCKED' when a is null or b is null then 'PARTIAL' else 'READY' end status, nullif(concat_ws(',', case when a is null then 'a' end, case when b is null then 'b' end), '') missing, count(*)::bigint n from r group by all""")
def readiness_audit(t):
    k = F.col("o_orderkey")
    lacks = F.array_compact(F.array(F.when((k % 4 == 0) | F.col("o_custkey").isNull(), "a"), F.when((k % 6 == 0) | F.col("o_totalprice").isNull(), "b")))
    df = t.orders.select(lacks.alias("l"))
    status = F.when(F.size("l") == 2, "BLOCKED").when(F.size("l") == 1, "PARTIAL").otherwise("READY")
    return df.groupBy(status.alias("status"), F.nullif(F.array_join("l", ","), F.lit("")).alias("missing")).agg(n())


@query("""with v as (select l_returnflag grp, year(l_shipdate) ver, count(*) filter (l_discount > 0.05) w, count(*) c, string_agg(distinct l_linestatus, '' order by l_linestatus) ev from lineitem where l_shipdate is not null group by all)
select a.grp, a.ver::bigint ver, round(b.w / b.c - a.w / a.c, 8) trend from v a join v b on b.grp = a.grp and b.ver = a.ver + 1 and a.ev = b.ev""")
def scorecard_trend(t):
    v = t.lineitem.where("l_shipdate is not null").groupBy(F.col("l_returnflag").alias("grp"), F.year("l_shipdate").cast("long").alias("ver")).agg((F.count_if(F.col("l_discount") > 0.05) / F.count("*")).alias("w"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), "").alias("ev"))
    later = v.select("grp", (F.col("ver") - 1).alias("ver"), F.col("w").alias("w2"), "ev")
    return v.join(later, ["grp", "ver", "ev"]).select("grp", "ver", F.round(F.col("w2") - F.col("w"), 8).alias("trend"))


@query("""select quantity, status, count(*)::bigint n from (select case when p_size > 0 then 'OK' else 'NONE' end p, case when p_size > 25 then 'OK' else 'PARTIAL' end q, case when p_retailprice > 1000 then 'OK' else 'NONE' end v from part) unpivot (status for quantity in (p, q, v)) group by all""")
def support_matrix(t):
    df = t.part.select(F.when(F.col("p_size") > 0, "OK").otherwise("NONE").alias("p"), F.when(F.col("p_size") > 25, "OK").otherwise("PARTIAL").alias("q"), F.when(F.col("p_retailprice") > 1000, "OK").otherwise("NONE").alias("v"))
    return df.unpivot([], ["p", "q", "v"], "quantity", "status").groupBy("quantity", "status").agg(n())


@query("select count(*)::bigint physical, count(distinct l_partkey)::bigint electrical, count(*) filter (l_orderkey % 21 = 0)::bigint unmapped, count(distinct l_suppkey)::bigint partitions from lineitem")
def fault_catalog_counts(t):
    return t.lineitem.agg(n("physical"), F.count_distinct("l_partkey").cast("long").alias("electrical"), F.count_if(F.col("l_orderkey") % 21 == 0).cast("long").alias("unmapped"), F.count_distinct("l_suppkey").cast("long").alias("partitions"))


@query("""with r as (select l_orderkey k, l_linenumber ln, l_partkey pk, l_quantity p, l_discount * 100 q from lineitem) select k, ln, pk, metric, value from (select k, ln, pk, p, q, sqrt(p * p + q * q) s from r) unpivot (value for metric in (p, q, s))""")
def metric_rows(t):
    r = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_quantity").alias("p"), (F.col("l_discount") * 100).alias("q"))
    return r.withColumn("s", F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q"))).unpivot(["k", "ln", "pk"], ["p", "q", "s"], "metric", "value")


@query("""with c as (select l_suppkey k, l_partkey el, l_extendedprice v from lineitem where l_quantity > 30) select el, count(*)::bigint n_cases, arg_max(k, (v, -k)) worst_case, max(v) worst from c group by 1""")
def operator_groups(t):
    c = t.lineitem.where("l_quantity > 30").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("el"), F.col("l_extendedprice").alias("v"))
    return c.groupBy("el").agg(n("n_cases"), F.max_by("k", F.struct("v", -F.col("k"))).alias("worst_case"), F.max("v").alias("worst"))


_STATES = "case when base_v is null and post_v is null then 'UNSOLVED_ISLAND' when cap is null then 'UNKNOWN_RATING' when k % 17 = 0 then 'IDENTITY_UNVERIFIED' when base_v > cap and post_v is null then 'RELIEVED' when base_v > cap and post_v <= cap then 'RELIEVED' when coalesce(base_v, 0) <= cap and post_v > cap then 'NEW' when post_v > cap and post_v - base_v > 1e-9 then 'WORSENED' when post_v > cap then 'PERSISTENT' else 'NONE' end"


@query(f"with s as (select p_partkey k, case when p_size % 9 = 0 then null else p_size * 2.0 end base_v, case when p_size % 6 = 0 then null when p_size % 5 = 0 then p_size * 2.0 else p_size * 2.2 end post_v, case when p_size = 7 then null when p_size % 4 = 0 then 30.0 else 60.0 end cap from part) select {_STATES} state, count(*)::bigint n from s group by 1")
def constraint_states(t):
    z = F.col("p_size")
    s = t.part.select(F.col("p_partkey").alias("k"), F.when(z % 9 != 0, z * 2.0).alias("b"), F.when(z % 6 == 0, None).when(z % 5 == 0, z * 2.0).otherwise(z * 2.2).alias("p"), F.when(z == 7, None).when(z % 4 == 0, 30.0).otherwise(60.0).alias("cap"))
    b, p, cap = F.col("b"), F.col("p"), F.col("cap")
    state = F.when(b.isNull() & p.isNull(), "UNSOLVED_ISLAND").when(cap.isNull(), "UNKNOWN_RATING").when(F.col("k") % 17 == 0, "IDENTITY_UNVERIFIED").when((b > cap) & (p.isNull() | (p <= cap)), "RELIEVED").when((F.coalesce(b, F.lit(0.0)) <= cap) & (p > cap), "NEW").when((p > cap) & (p - b > 1e-9), "WORSENED").when(p > cap, "PERSISTENT").otherwise("NONE")
    return s.groupBy(state.alias("state")).agg(n())
