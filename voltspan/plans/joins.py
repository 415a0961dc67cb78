"""Joins with rules for what is ambiguous, missing, or matched by several keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.operators import hierarchy, matching
from voltspan.plans.base import n, query


@query("select l_orderkey, string_agg(l_partkey || ':' || l_quantity::bigint, ',' order by l_linenumber, l_partkey, l_suppkey, l_quantity) sections, count(*)::bigint n from lineitem group by 1")
def ordered_sections(t):
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    sections = F.transform(F.array_sort(F.collect_list(key)), lambda s: F.concat_ws(":", s["l_partkey"], s["l_quantity"].cast("long")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(sections, ",").alias("sections"), n())


_CLASSES = "c as (select c_custkey id, 'customer' as class from customer where c_custkey % 3 <> 0 union all select s_suppkey * 2, 'supplier' from supplier union all select p_partkey * 5, 'part' from part)"


@query(f"with {_CLASSES}, u as (select id, min(class) as class from c group by 1 having count(distinct class) = 1) select o_orderkey, class as kind from orders left join u on id = o_custkey")
def unambiguous_reference(t):
    classes = {"customer": t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id")), "supplier": t.supplier.select((F.col("s_suppkey") * 2).alias("id")), "part": t.part.select((F.col("p_partkey") * 5).alias("id"))}
    return t.orders.select("o_orderkey", F.col("o_custkey").alias("id")).join(hierarchy.unambiguous_class(classes), "id", "left").select("o_orderkey", F.col("class").alias("kind"))


# A node's parent is its key halved; every 29th points to itself, every 31st to nothing known, and keys over 40 that divide by 37 stand twice.
_TREE = "node as (select c_custkey id, case when c_custkey = 0 then null when c_custkey % 29 = 0 then c_custkey when c_custkey % 31 = 0 then -1 else c_custkey // 2 end parent from customer), twin as (select * from node union all select * from node where id > 40 and id % 37 = 0), once as (select id, min(parent) parent from twin group by 1 having count(*) = 1)"
_CHAIN = f"with recursive {_TREE}, chain as (select id, id anc, parent, 0 depth, [id] seen from node union all select c.id, o.id, o.parent, c.depth + 1, list_append(c.seen, o.id) from chain c join once o on o.id = c.parent where c.depth < 24 and not list_contains(c.seen, c.parent))"


def _tree(t) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    node = t.customer.select(k.alias("id"), F.when(k == 0, None).when(k % 29 == 0, k).when(k % 31 == 0, -1).otherwise(F.floor(k / 2)).cast("long").alias("parent"))
    return node, node.unionByName(node.where("id > 40 and id % 37 = 0"))


@query(f"{_CHAIN} select id, max(depth)::bigint depth, arg_max(anc, depth) as top from chain group by 1")
def parent_chain(t):
    chains = hierarchy.ancestors(*_tree(t))
    return chains.groupBy("id").agg(F.max("depth").alias("depth"), F.max_by("ancestor", "depth").alias("top"))


@query(f"{_CHAIN} select id, arg_min(anc, depth) site from chain where anc % 5 = 0 group by 1")
def nearest_site(t):
    chains = hierarchy.ancestors(*_tree(t))
    return hierarchy.nearest(chains, chains.where("ancestor % 5 = 0").select("ancestor")).select("id", F.col("ancestor").alias("site"))


@query("select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then c_nationkey end, s.site) site from orders left join customer on c_custkey = o_custkey left join (select l_orderkey, arg_min(s_nationkey, (l_linenumber, l_suppkey)) site from lineitem join supplier on s_suppkey = l_suppkey group by 1) s on l_orderkey = o_orderkey")
def fallback_site(t):
    first = t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_suppkey")).alias("m")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("m.l_suppkey").alias("s_suppkey"))
    by_bus = first.join(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey").select("o_orderkey", F.col("s_nationkey").alias("site"))
    owned = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("c_nationkey")).alias("parent"))
    return owned.join(by_bus, "o_orderkey", "left").select("o_orderkey", F.coalesce("parent", "site").alias("site"))


_REFS = """r as (select c_custkey ref, case when c_custkey % 4 = 0 then c_custkey end k1, case when c_custkey % 5 = 0 then 'm' || (c_custkey // 3) end k2, 'n' || (c_custkey // 2) k3 from customer),
a as (select c_custkey actual, case when c_custkey % 8 = 0 then c_custkey end k1, 'm' || (c_custkey // 3) k2, 'n' || (c_custkey // 2 + c_custkey % 2 * 100000) k3 from customer)"""


@query(f"""with {_REFS}, h as (select ref, 0 rk, min(actual) act, count(*) c from r join a using (k1) group by 1 union all select ref, 1, min(actual), count(*) from r join a using (k2) group by 1 union all select ref, 2, min(actual), count(*) from r join a using (k3) group by 1),
f as (select * from h qualify row_number() over (partition by ref order by rk) = 1), p as (select ref, rk, act, case when c = 1 then row_number() over (partition by case when c = 1 then act end order by rk, ref) end place from f)
select r.ref, case when place = 1 then act end actual, case when p.ref is null then 'UNMATCHED' when place = 1 then ['k1', 'k2', 'k3'][rk + 1] else 'AMBIGUOUS' end as method from r left join p on p.ref = r.ref""")
def cascading_match(t):
    k = F.col("c_custkey")
    third, half = F.floor(k / 3).cast("string"), F.floor(k / 2)
    refs = t.customer.select(k.alias("ref"), F.when(k % 4 == 0, k).alias("k1"), F.when(k % 5 == 0, F.concat(F.lit("m"), third)).alias("k2"), F.concat(F.lit("n"), half.cast("string")).alias("k3"))
    actuals = t.customer.select(k.alias("actual"), F.when(k % 8 == 0, k).alias("k1"), F.concat(F.lit("m"), third).alias("k2"), F.concat(F.lit("n"), (half + k % 2 * 100000).cast("string")).alias("k3"))
    return matching.cascade(refs, actuals, "ref", "actual", ["k1", "k2", "k3"])


@query("select least(s_nationkey::varchar, c_nationkey::varchar) || '|' || greatest(s_nationkey::varchar, c_nationkey::varchar) pair, count(*)::bigint n from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey group by 1")
def unordered_endpoints(t):
    return _pairs(t).groupBy(matching.unordered(F.col("s_nationkey"), F.col("c_nationkey")).alias("pair")).agg(n())


def _pairs(t) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    owners = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal >= -1e6)")
def required_subset(t):
    selected = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return matching.require_subset(selected, t.customer.where("c_acctbal >= -1e6").select("c_custkey"), "c_custkey").select("o_orderkey")


@query("with b as (select l_orderkey bus, list_sort(list(distinct l_suppkey)) members, sum(l_quantity) v from lineitem group by 1) select bus, unnest(members) terminal, v from b")
def alias_rows(t):
    buses = t.lineitem.groupBy(F.col("l_orderkey").alias("bus")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("members"), F.sum("l_quantity").alias("v"))
    return matching.aliases(buses, "members", "terminal")


@query("select l_partkey, min(l_suppkey) boundary from lineitem where l_returnflag = 'R' and l_orderkey % 7 < 2 group by 1 having count(distinct l_suppkey) = 1")
def boundary_routing(t):
    links = t.lineitem.where("l_returnflag = 'R' and l_orderkey % 7 < 2")
    return matching.single_neighbour(links, "l_partkey", "l_suppkey").withColumnRenamed("l_suppkey", "boundary")


@query("select o_orderkey, k.pos from orders left join (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey)::bigint pos from customer where c_custkey % 4 <> 0) k on c_custkey = o_custkey order by pos nulls last, o_orderkey limit 50 offset 25")
def external_sort_key(t):
    from pyspark.sql import Window

    keys = t.customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("pos"))
    joined = t.orders.select("o_orderkey", "o_custkey").join(keys, "o_custkey", "left").select("o_orderkey", "pos")
    return joined.orderBy(F.asc_nulls_last("pos"), "o_orderkey").offset(25).limit(50)


@query("with c as (select o_custkey fid, 'order' kind, min(o_totalprice) v from orders where o_orderstatus = 'P' and o_orderkey % 5 = 0 group by 1 having count(*) = 1) select c_custkey fid, v, case when v is null then 'MISSING' else 'MATCHED' end state from customer left join c on fid = c_custkey")
def single_match_join(t):
    computed = t.orders.where("o_orderstatus = 'P' and o_orderkey % 5 = 0").groupBy(F.col("o_custkey").alias("fid")).agg(F.count("*").alias("k"), F.min("o_totalprice").alias("v")).where("k = 1").drop("k")
    return t.customer.select(F.col("c_custkey").alias("fid")).join(computed, "fid", "left").withColumn("state", F.when(F.col("v").isNull(), "MISSING").otherwise("MATCHED"))


@query("""with a as (select l_suppkey k, l_partkey % 50 m from lineitem where l_orderkey % 2 = 0 and l_suppkey % 9 <> 4), b as (select l_suppkey k, l_partkey % 50 m from lineitem where l_orderkey % 2 = 1 and l_suppkey % 9 <> 5),
x as (select k, list_sort(list(distinct m)) l from a group by 1), y as (select k, list_sort(list(distinct m)) r from b group by 1)
select k, case when l is null then 'ONLY_RIGHT' when r is null then 'ONLY_LEFT' when not list_has_all(r, l) and not list_has_all(l, r) then 'OVERLAP' when not list_has_all(r, l) then 'LEFT_LARGER' when not list_has_all(l, r) then 'RIGHT_LARGER' else 'EQUAL' end reason from x full join y using (k)""")
def partition_audit(t):
    members = t.lineitem.select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 50).alias("m"), (F.col("l_orderkey") % 2).alias("side"))
    return matching.partition_audit(members.where("side = 0 and k % 9 <> 4"), members.where("side = 1 and k % 9 <> 5"), "k", "m")


@query("select s_suppkey, c_custkey from supplier join customer on abs(s_acctbal - c_acctbal) < 0.5")
def tolerance_join(t):
    return matching.within_tolerance(t.supplier.select("s_suppkey", "s_acctbal"), t.customer.select("c_custkey", "c_acctbal"), "s_acctbal", "c_acctbal", 0.5).select("s_suppkey", "c_custkey")


@query("select o_custkey, o_orderkey, o_orderpriority from orders qualify row_number() over (partition by o_custkey order by o_orderdate < '1999-01-01', case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end, o_orderkey) = 1")
def snapshot_priority(t):
    stale = (F.col("o_orderdate") < "1999-01-01").asc()
    source = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2).asc()
    return matching.by_priority(t.orders, ["o_custkey"], [stale, source], ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""with p as (select l_orderkey k, l_linenumber ln, l_partkey pk, l_quantity base, l_quantity * (1 + l_discount) post, case when l_tax = 0 then null else l_returnflag end ba, case when l_tax = 0 then null when l_partkey % 6 = 0 then 'X' else l_returnflag end pa from lineitem)
select k, ln, pk, round(post - base, 6) delta from p where ba is not distinct from pa""")
def compatible_pairs(t):
    zero = F.col("l_tax") == 0
    basis = F.when(~zero, F.col("l_returnflag"))
    after = F.when(~zero, F.when(F.col("l_partkey") % 6 == 0, "X").otherwise(F.col("l_returnflag")))
    return t.lineitem.where(basis.eqNullSafe(after)).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.round(F.col("l_quantity") * (1 + F.col("l_discount")) - F.col("l_quantity"), 6).alias("delta"))


@query("""with nw as (select o_orderkey k, o_orderpriority s, case when o_orderkey % 3 = 0 then o_totalprice end v from orders), pr as (select o_orderkey k, case when o_orderkey % 5 = 0 then 'X' else o_orderpriority end s, o_totalprice * 2 v from orders where o_orderkey % 2 = 0)
select k, coalesce(nw.v, case when nw.s is not distinct from pr.s then pr.v end) v from nw left join pr using (k)""")
def case_retention(t):
    k = F.col("o_orderkey")
    new = t.orders.select(k.alias("k"), F.col("o_orderpriority").alias("s"), F.when(k % 3 == 0, F.col("o_totalprice")).alias("v"))
    prior = t.orders.where(k % 2 == 0).select(k.alias("k"), F.when(k % 5 == 0, "X").otherwise(F.col("o_orderpriority")).alias("s"), (F.col("o_totalprice") * 2).alias("v"))
    return matching.carried(new, prior, ["k"], ["s"], ["v"]).select("k", "v")


@query("""with s as (select l_suppkey k, year(l_shipdate) y, list_sort(list(distinct l_partkey % 3)) m, sum(l_quantity) v from lineitem where l_shipdate is not null group by all)
select a.k, a.y::bigint as yr, round(b.v - a.v, 4) delta from s a join s b on b.k = a.k and b.y = a.y + 1 and a.m = b.m""")
def same_set_delta(t):
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").cast("long").alias("yr")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 3)).alias("m"), F.sum("l_quantity").alias("v"))
    later = s.select("k", (F.col("yr") - 1).alias("yr"), "m", F.col("v").alias("w"))
    return s.join(later, ["k", "yr", "m"]).select("k", "yr", F.round(F.col("w") - F.col("v"), 4).alias("delta"))


@query("""with r as (select p_partkey id, p_size sz, p_retailprice rp from part), o as (select id, 'source' kind, sz v from r union all select id, 'scenario', sz + 1 from r where id % 2 = 0 union all select id, 'solved', rp from r where id % 3 = 0)
select id, max(case when kind = 'source' then v end)::double source, max(case when kind = 'scenario' then v end)::double scenario, max(case when kind = 'solved' then v end) solved from o group by 1""")
def operating_triples(t):
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("source"))
    scenario = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 1).cast("double").alias("scenario"))
    solved = t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("solved"))
    return p.join(scenario, "id", "left").join(solved, "id", "left")


@query("""with ob as (select l_suppkey % 7 family, l_suppkey id from lineitem where l_suppkey % 5 <> 0), ex as (select s_suppkey % 7 family, s_suppkey id from supplier where s_suppkey % 11 <> 0)
select coalesce(o.family, e.family)::bigint family, count(e.id)::bigint expected, count(o.id)::bigint observed, count(*) filter (o.id is null)::bigint n_missing, count(*) filter (e.id is null)::bigint extra from (select distinct family, id from ob) o full join ex e on e.id = o.id group by 1""")
def method_coverage(t):
    observed = t.lineitem.where("l_suppkey % 5 <> 0").select(F.col("l_suppkey").alias("id")).distinct().withColumn("o", F.lit(1))
    expected = t.supplier.where("s_suppkey % 11 <> 0").select(F.col("s_suppkey").alias("id"), F.lit(1).alias("e"))
    both = observed.join(expected, "id", "full_outer")
    return both.groupBy((F.col("id") % 7).alias("family")).agg(F.count("e").cast("long").alias("expected"), F.count("o").cast("long").alias("observed"), F.count_if(F.col("o").isNull()).cast("long").alias("n_missing"), F.count_if(F.col("e").isNull()).cast("long").alias("extra"))
