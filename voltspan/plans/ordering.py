"""Orders, pages, queues and window-like queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltspan.operators import filters, matching, ordering
from voltspan.plans.base import query

_CELL = "case when p_partkey % 11 = 0 then null when p_partkey % 11 = 1 then '' when p_partkey % 3 = 0 then p_name else (p_size * 10 - 100)::varchar end"
_KIND = "case when v is null or v = '' then 2 when regexp_matches(v, '^[+-]?[0-9]+$') then 0 else 1 end"


def _cells(t):
    k = F.col("p_partkey")
    v = F.when(k % 11 == 0, None).when(k % 11 == 1, "").when(k % 3 == 0, F.col("p_name")).otherwise((F.col("p_size") * 10 - 100).cast("string"))
    return t.part.select(k.alias("id"), v.alias("v"))


@query(f"select id, v, row_number() over (order by {_KIND}, case when {_KIND} = 0 then v::int end, case when {_KIND} = 1 then v end, id)::bigint as place from (select p_partkey id, {_CELL} v from part) order by place limit 400")
def sort_mixed_up(t):
    return _placed(_cells(t), [*ordering.mixed(F.col("v")), F.asc("id")], 400)


@query(f"select id, v, row_number() over (order by case {_KIND} when 2 then 2 when 1 then 0 else 1 end, case when {_KIND} = 0 then v::int end desc nulls last, case when {_KIND} = 1 then v end desc nulls last, id)::bigint as place from (select p_partkey id, {_CELL} v from part) order by place limit 400")
def sort_mixed_down(t):
    return _placed(_cells(t), [*ordering.mixed(F.col("v"), True), F.asc("id")], 400)


def _placed(df, order, k: int):
    from pyspark.sql import Window

    # The head of the order is found first, so only it is numbered in one task.
    return df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query("select p_partkey, row_number() over (order by p_brand nulls last, case when p_size % 4 = 0 then null else p_size end nulls last, p_retailprice desc nulls last, p_partkey)::bigint place from part order by place limit 300")
def sort_composite(t):
    size = F.when(F.col("p_size") % 4 != 0, F.col("p_size"))
    return _placed(t.part, [F.asc_nulls_last("p_brand"), size.asc_nulls_last(), F.desc_nulls_last("p_retailprice"), F.asc("p_partkey")], 300).select("p_partkey", "place")


@query("select c_custkey, row_number() over (order by abs(case when c_custkey % 6 = 0 then null else c_acctbal end) desc nulls last, c_custkey)::bigint place from customer order by place limit 300")
def sort_by_size(t):
    v = F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal"))
    return _placed(t.customer, [ordering.by_size(v), F.asc("c_custkey")], 300).select("c_custkey", "place")


@query("select o_orderkey, row_number() over (order by o_orderpriority, o_orderstatus desc, o_totalprice desc, o_orderkey)::bigint place from orders order by place limit 300")
def sort_multi_key(t):
    return _placed(t.orders, [F.asc("o_orderpriority"), F.desc("o_orderstatus"), F.desc("o_totalprice"), F.asc("o_orderkey")], 300).select("o_orderkey", "place")


@query("select o_orderkey, row_number() over (order by coalesce(case when o_orderkey % 5 = 0 then null else o_totalprice end, -1), o_orderkey)::bigint place from orders order by place limit 300")
def sort_missing_low(t):
    v = ordering.missing_as(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
    return _placed(t.orders, [v.asc(), F.asc("o_orderkey")], 300).select("o_orderkey", "place")


_SEVERITY = "case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 when '4-NOT SPECIFIED' then 3 else 4 end"


@query(f"select o_orderkey, row_number() over (order by {_SEVERITY}, o_orderkey desc)::bigint place from orders order by place limit 300")
def sort_severity(t):
    rank = ordering.ranked(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"])
    return _placed(t.orders, [rank.asc(), F.desc("o_orderkey")], 300).select("o_orderkey", "place")


@query("""with c as (select l_suppkey k, case when min(l_discount) < 0.005 and l_suppkey % 6 = 0 then 'ISLANDING' when max(l_quantity) > 49 then 'VIOLATION' else 'CLEAR' end status, count(*) filter (l_quantity > 45) v, max(l_extendedprice) load, max(abs(l_tax - 0.04)) d from lineitem group by 1)
select k, status, row_number() over (order by case status when 'ISLANDING' then 0 when 'VIOLATION' then 1 else 2 end, v desc, load desc, d desc, k)::bigint place from c""")
def screening_rank(t):
    status = F.when((F.min("l_discount") < 0.005) & (F.col("l_suppkey") % 6 == 0), "ISLANDING").when(F.max("l_quantity") > 49, "VIOLATION").otherwise("CLEAR")
    c = t.lineitem.groupBy("l_suppkey").agg(status.alias("status"), F.count_if(F.col("l_quantity") > 45).alias("v"), F.max("l_extendedprice").alias("load"), F.max(F.abs(F.col("l_tax") - 0.04)).alias("d"))
    order = [ordering.ranked(F.col("status"), ["ISLANDING", "VIOLATION"]).asc(), F.desc("v"), F.desc("load"), F.desc("d"), F.asc("l_suppkey")]
    return _placed(c, order, 1 << 30).select(F.col("l_suppkey").alias("k"), "status", "place")


@query("select k, row_number() over (order by lpad(regexp_extract(k, '([0-9]+)$', 1), 20, '0'), p)::bigint place from (select p_partkey p, 'N' || p_partkey k from part) order by place limit 300")
def sort_natural(t):
    df = t.part.select(F.concat(F.lit("N"), "p_partkey").alias("k"))
    return _placed(df, [ordering.natural(F.col("k")).asc()], 300).select("k", "place")


@query("select class, id, v from (select 'customer' as class, c_custkey id, c_acctbal v from customer union all select 'supplier', s_suppkey, s_acctbal from supplier) order by v desc, id, class limit 30 offset 60")
def merged_page(t):
    parts = {"customer": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v")), "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))}
    return ordering.merged_page(parts, [F.desc("v"), F.asc("id"), F.asc("class")], 2, 30)


@query("with b as (select c_custkey, c_acctbal from customer where c_nationkey = 3) select * from b order by c_acctbal, c_custkey limit 50 offset (select (count(*) - 1) // 50 * 50 from b)")
def clamped_page(t):
    return ordering.bounded_page(t.customer.where("c_nationkey = 3").select("c_custkey", "c_acctbal"), [F.asc("c_acctbal"), F.asc("c_custkey")], 10**6)


@query("select p_partkey, p_name, (select count(*) from part where contains(p_name, 'ring'))::bigint total from part where contains(p_name, 'ring') order by p_name, p_partkey limit 50")
def choice_list(t):
    hits = t.part.where(F.contains("p_name", F.lit("ring"))).select("p_partkey", "p_name")
    return ordering.first_matches(hits, [F.asc("p_name"), F.asc("p_partkey")])


@query("""with q as (select o_orderkey, case when o_orderstatus = 'P' then 'risk' else 'direct' end kind, row_number() over (partition by o_orderstatus = 'P' order by o_totalprice desc, o_orderkey) turn from orders)
select o_orderkey, row_number() over (order by turn, kind = 'direct')::bigint place from q order by place limit 40""")
def queue_interleaved(t):
    kind = F.when(F.col("o_orderstatus") == "P", "risk").otherwise("direct")
    return ordering.interleaved(t.orders, kind, [F.desc("o_totalprice"), F.asc("o_orderkey")], ["risk", "direct"], 40).select("o_orderkey", "place")


@query("select o_orderkey from orders where o_orderstatus = 'F' order by o_orderkey limit 25")
def clear_sample(t):
    return t.orders.where("o_orderstatus = 'F'").select("o_orderkey").orderBy("o_orderkey").limit(25)


@query("select o_custkey, o_orderkey, case when k = 1 then o_custkey::varchar else o_custkey || ':' || k end occurrence from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) k from orders)")
def occurrence_suffix(t):
    return ordering.occurrence(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "occurrence").select("o_custkey", "o_orderkey", "occurrence")


@query("select l_suppkey, l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_suppkey order by case when l_returnflag = 'R' then 0 else 1 end, l_extendedprice desc, l_discount desc, l_tax desc, l_orderkey, l_linenumber, l_partkey) r from lineitem) where r = 1")
def critical_member(t):
    order = [(F.col("l_returnflag") != "R").asc(), F.desc("l_extendedprice"), F.desc("l_discount"), F.desc("l_tax"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return filters.critical(t.lineitem, ["l_suppkey"], order).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("select c_nationkey, arg_min(c_acctbal, c_custkey) value, min(c_custkey) source from customer where c_acctbal > 0 group by 1")
def first_valid(t):
    return t.customer.where("c_acctbal > 0").groupBy("c_nationkey").agg(F.min_by("c_acctbal", "c_custkey").alias("value"), F.min("c_custkey").alias("source"))


_PAIR = "least(s_nationkey::varchar, c_nationkey::varchar) || '|' || greatest(s_nationkey::varchar, c_nationkey::varchar)"


@query(f"select o_orderkey, s_suppkey, pair, row_number() over (partition by pair order by o_orderkey, s_suppkey)::bigint - 1 as index, count(*) over (partition by pair)::bigint count from (select distinct o_orderkey, s_suppkey, {_PAIR} pair from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey where o_orderstatus = 'P')")
def parallel_edges(t):
    lines = t.lineitem.select("l_orderkey", "l_suppkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    owners = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    edges = lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.col("l_suppkey").alias("s_suppkey"), matching.unordered(F.col("s_nationkey"), F.col("c_nationkey")).alias("pair")).distinct()
    return ordering.parallels(edges, "pair", ["o_orderkey", "s_suppkey"])
