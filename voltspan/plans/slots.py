"""Reference slots made of line items by return flag, of parts by line status, and of a customer's orders by status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.operators import digests
from voltspan.plans.base import query

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_VALUES = ["l_quantity"]
# The incoming tables lack slot R; in N amounts differ, some rows are gone, and some are new.
_PAIR = """a as (select l_returnflag slot, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::bigint l_quantity from lineitem),
b as (select l_returnflag slot, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::bigint + case when l_returnflag = 'N' and l_discount = 0.1 then 1 else 0 end l_quantity from lineitem where l_returnflag <> 'R' and not (l_returnflag = 'N' and l_tax = 0.08)
  union all select l_returnflag, -l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::bigint from lineitem where l_returnflag = 'N' and l_discount = 0.09),
d as (select slot, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, sum(k) k from (select *, 1 k from a union all select *, -1 from b) group by all having sum(k) <> 0)"""


def _pair(t) -> tuple[DataFrame, DataFrame]:
    rows = t.lineitem.select(F.col("l_returnflag").alias("slot"), *_KEYS, F.col("l_quantity").cast("long").alias("l_quantity"), "l_discount", "l_tax")
    n = F.col("slot") == "N"
    kept = rows.where((F.col("slot") != "R") & ~(n & (F.col("l_tax") == 0.08)))
    kept = kept.withColumn("l_quantity", F.col("l_quantity") + F.when(n & (F.col("l_discount") == 0.1), 1).otherwise(0))
    new = rows.where(n & (F.col("l_discount") == 0.09)).withColumn("l_orderkey", -F.col("l_orderkey"))
    out = ["slot", *_KEYS, *_VALUES]
    return rows.select(*out), kept.select(*out).unionByName(new.select(*out))


@query(f"""with {_PAIR}, x as (select slot, count(*) n from a group by 1), y as (select slot, count(*) n from b group by 1)
select coalesce(x.slot, y.slot) slot, case when y.slot is null then 'ONLY_PREVIOUS' when x.slot is null then 'ONLY_INCOMING' when coalesce(x.slot, y.slot) not in (select slot from d) then 'EQUAL' else 'DIFFERS' end status, coalesce(x.n, 0) n_previous, coalesce(y.n, 0) n_incoming from x full join y using (slot)""")
def slot_status(t):
    return digests.slot_status(*_pair(t), ["slot"], [*_KEYS, *_VALUES])


@query(f"""with {_PAIR}, k as (select distinct slot, l_orderkey, l_linenumber, l_partkey, l_suppkey from d)
select k.*, case when not exists (from b where (b.slot, b.l_orderkey, b.l_linenumber, b.l_partkey, b.l_suppkey) = (k.slot, k.l_orderkey, k.l_linenumber, k.l_partkey, k.l_suppkey)) then 'REMOVED' when not exists (from a where (a.slot, a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey) = (k.slot, k.l_orderkey, k.l_linenumber, k.l_partkey, k.l_suppkey)) then 'ADDED' else 'CHANGED' end state from k""")
def slot_differences(t):
    return digests.changes(*_pair(t), ["slot", *_KEYS], _VALUES)


@query("""with i as (select l_linestatus side, l_partkey package, l_returnflag slot, unnest(['maxLine', 'minLine']) field, unnest([max(l_linenumber), min(l_linenumber)])::varchar value from lineitem group by 1, 2, 3),
first as (select package, min(slot) slot from i where side = 'O' group by 1),
wrong as (select p.package, min(p.slot || ' ' || p.field) reason from i p join first f on f.package = p.package join i n on n.side = 'O' and n.package = p.package and n.slot = f.slot and n.field = p.field where p.side = 'F' and p.value <> n.value group by 1),
s as (select package, slot, bool_or(side = 'O') new from i group by 1, 2)
select package, slot, case when reason is not null then 'REFUSED' when new then 'INCOMING' else 'PREVIOUS' end taken_from, reason from s left join wrong using (package)""")
def slot_merge(t):
    per = t.lineitem.groupBy("l_linestatus", F.col("l_partkey").alias("package"), F.col("l_returnflag").alias("slot")).agg(F.max("l_linenumber").cast("string").alias("maxLine"), F.min("l_linenumber").cast("string").alias("minLine"))
    long = per.unpivot(["l_linestatus", "package", "slot"], ["maxLine", "minLine"], "field", "value")
    return digests.merged_slots(long.where("l_linestatus = 'F'"), long.where("l_linestatus = 'O'"), "package")


@query("""with o as (select o_custkey, list_sort(list(distinct o_orderpriority) filter (o_orderstatus = 'F')) ref, list_sort(list(distinct o_orderpriority) filter (o_orderstatus = 'O')) res, bool_or(o_orderstatus = 'P') method from orders group by 1)
select c_custkey, case when c_acctbal < -900 or ref is null then 'NOT_COMPARABLE' when c_mktsegment = 'BUILDING' then 'BLOCKED' when not method or res is null then 'NOT_COMPARABLE' when ref <> res then 'EXPLORATORY_ONLY' else 'COMPARABLE_PARTIAL' end status,
case when c_acctbal < -900 then 'MODEL_NOT_LOADED' when ref is null then 'LF_REFERENCE_NOT_LOADED' when c_mktsegment = 'BUILDING' then 'MODEL_STUDY_CASE_MISMATCH' when not method then 'LF_METHOD_UNVERIFIED' when res is null then 'GA_NOT_CALCULATED' when ref <> res then 'IDENTITY_NOT_VERIFIED' end reason
from customer left join o on o_custkey = c_custkey""")
def comparison_preflight(t):
    of = t.orders.select("o_custkey", "o_orderstatus", "o_orderpriority").distinct()
    one = lambda status, name: digests.digests(of.where(F.col("o_orderstatus") == status), ["o_custkey"], ["o_orderpriority"]).select(F.col("o_custkey").alias("c_custkey"), F.struct(*digests.DIGEST).alias(name))
    cases = t.customer.join(one("F", "ref"), "c_custkey", "left").join(one("O", "res"), "c_custkey", "left").join(one("P", "method"), "c_custkey", "left")
    found = digests.preflight(cases, F.col("c_acctbal") >= -900, F.col("ref").isNotNull(), F.col("c_mktsegment") != "BUILDING", F.col("method").isNotNull(), F.col("res").isNotNull(), digests.same("ref", "res"))
    return found.select("c_custkey", "status", "reason")


@query("""with r as (select 'bus' kind, [c_custkey::varchar, c_nationkey::varchar, c_mktsegment] v from customer union all select 'branch', [o_orderkey::varchar, o_custkey::varchar, o_orderpriority] from orders),
h as (select kind, sha256(array_to_string(list_transform(v, lambda x: length(x) || ':' || x), '')) h from r)
select kind, count(*) n, sum(('0x' || h[1:15])::bigint)::varchar s0, sum(('0x' || h[16:30])::bigint)::varchar s1, sum(('0x' || h[31:45])::bigint)::varchar s2, sum(('0x' || h[46:60])::bigint)::varchar s3 from h group by 1""")
def topology_digest(t):
    bus = digests.digests(t.customer.withColumn("kind", F.lit("bus")), ["kind"], ["c_custkey", "c_nationkey", "c_mktsegment"])
    branch = digests.digests(t.orders.withColumn("kind", F.lit("branch")), ["kind"], ["o_orderkey", "o_custkey", "o_orderpriority"])
    return bus.unionByName(branch).withColumns({p: F.col(p).cast("string") for p in digests.PIECES})
