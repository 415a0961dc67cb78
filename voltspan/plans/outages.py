"""What the loss of a branch leaves, on a network of customers and their orders.

A customer's orders follow each other by date from the customer on. Consecutive orders of one priority have a second, parallel
branch, urgent orders lead straight back to the customer, and customers of a nation and segment are linked in order of their
balances. Node numbers are shuffled, so nothing can be told from their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltspan.operators import tours
from voltspan.plans.base import query

_NET = """o as (select o_orderkey, o_custkey, o_orderpriority pri, o_totalprice, lag(o_orderkey) over w prev, lag(o_orderpriority) over w prev_pri from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
c as (select c_custkey, c_acctbal, lag(c_custkey) over (partition by c_nationkey, c_mktsegment order by c_acctbal, c_custkey) prev from customer),
x as (select o_orderkey * 8 id, case when prev is null then o_custkey else prev end k, prev is null own, o_orderkey j, o_totalprice p from o
union all select o_orderkey * 8 + 1, prev, false, o_orderkey, o_totalprice from o where pri = prev_pri
union all select o_orderkey * 8 + 2, o_custkey, true, o_orderkey, o_totalprice from o where pri = '1-URGENT'),
e as materialized (select id, (k * 48271) % 2147483647 * 2 + own::int a, (j * 48271) % 2147483647 * 2 b, 0.01 + p / 1e6 x from x
union all select c_custkey * 8 + 3, (prev * 48271) % 2147483647 * 2 + 1, (c_custkey * 48271) % 2147483647 * 2 + 1, 0.02 from c where prev is not null)"""

# Every edge is taken out in turn, and both of its ends search on.
_SIDES = f"""{_NET},
p as materialized (select least(a, b) u, greatest(a, b) v, min(a) a, min(b) b, count(*) k from e where a <> b group by 1, 2),
d as materialized (select u, v, u x, v y from p union all select u, v, v, u from p),
ra as (select u, v, a tip from p where k = 1 union select ra.u, ra.v, d.y from ra join d on d.x = ra.tip where d.u <> ra.u or d.v <> ra.v),
cut as materialized (select u, v, a, b from p where k = 1 and not exists (select 1 from ra where ra.u = p.u and ra.v = p.v and ra.tip = p.b)),
rb as (select u, v, b tip from cut union select rb.u, rb.v, d.y from rb join d on d.x = rb.tip where d.u <> rb.u or d.v <> rb.v)"""


def _node(key: str):
    return F.col(key) * 48271 % 2147483647 * 2


def network(t) -> DataFrame:
    """id, a, b, x of the branches."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", (0.01 + F.col("o_totalprice") / 1e6).alias("x"), F.lag("o_orderkey").over(by).alias("prev"), F.lag("o_orderpriority").over(by).alias("prev_priority"))
    c = t.customer.select("c_custkey", F.lag("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_acctbal", "c_custkey")).alias("prev"))
    branch = lambda rows, key, kind, a, b, x: rows.select((F.col(key) * 8 + kind).alias("id"), a.alias("a"), b.alias("b"), x.alias("x"))
    order, customer = _node("o_orderkey"), _node("o_custkey") + 1
    return (
        branch(o, "o_orderkey", 0, F.coalesce(_node("prev"), customer), order, F.col("x"))
        .unionByName(branch(o.where("o_orderpriority = prev_priority"), "o_orderkey", 1, _node("prev"), order, F.col("x")))
        .unionByName(branch(o.where("o_orderpriority = '1-URGENT'"), "o_orderkey", 2, customer, order, F.col("x")))
        .unionByName(branch(c.where("prev is not null"), "c_custkey", 3, _node("prev") + 1, _node("c_custkey") + 1, F.lit(0.02)))
    )


@query(f"with recursive {_SIDES}, t as (select u, v, min(tip) low from (select u, v, tip from ra union all select u, v, tip from rb) group by 1, 2) select low component, a, b from cut join t using (u, v)")
def bridges(t):
    return tours.bridges(network(t))


@query(f"""with recursive {_SIDES},
h as (select (c_custkey * 48271) % 2147483647 * 2 + 1 node, c_acctbal p, (c_acctbal > 8000)::int source from customer union all select (o_orderkey * 48271) % 2147483647 * 2, -o_totalprice, 0 from orders),
s as (select 'a' side, u, v, tip from ra semi join cut using (u, v) union all select 'b', u, v, tip from rb),
g as (select u, v, min(tip) component, count(*) filter (side = 'a') na, count(*) filter (side = 'b') nb, sum(p) filter (side = 'a') pa, sum(p) filter (side = 'b') pb, sum(source) filter (side = 'a') sa, sum(source) filter (side = 'b') sb from s join h on node = tip group by 1, 2)
select component, a, b, na::bigint a_nodes, nb::bigint b_nodes, round(pa, 2) a_injection, round(pb, 2) b_injection, sa::bigint a_sources, sb::bigint b_sources, case when sa > 0 then 'REFERENCED' else 'UNREFERENCED' end a_status, case when sb > 0 then 'REFERENCED' else 'UNREFERENCED' end b_status from g join cut using (u, v)""")
def outage_sides(t):
    held = t.customer.select((_node("c_custkey") + 1).alias("node"), F.col("c_acctbal").alias("injection"), (F.col("c_acctbal") > 8000).cast("long").alias("sources"))
    held = held.unionByName(t.orders.select(_node("o_orderkey").alias("node"), (-F.col("o_totalprice")).alias("injection"), F.lit(0).cast("long").alias("sources")))
    found = tours.sides(network(t), held, ["injection", "sources"])
    for side in "ab":
        found = found.withColumns({f"{side}_injection": F.round(f"{side}_injection", 2), f"{side}_sources": F.round(f"{side}_sources").cast("long")})
        found = found.withColumn(f"{side}_status", F.when(F.col(f"{side}_sources") > 0, "REFERENCED").otherwise("UNREFERENCED"))
    return found


@query(f"""with recursive {_NET},
t as materialized (select id, 0 side, a node, b far, x from e union all select id, 1, b, a, x from e),
i as materialized (select node from t group by 1 having count(*) = 2),
w as (select id id0, side side0, node a, id, side, far tip, 1 n, x from t where node not in (from i)
union all select w.id0, w.side0, w.a, t.id, t.side, t.far, w.n + 1, w.x + t.x from w join i on i.node = w.tip join t on t.node = w.tip where t.id <> w.id or t.side <> 1 - w.side)
select id0 "first", id "last", a, tip b, n::bigint n, round(x, 6) x from w where tip not in (from i) and id0 * 2 + side0 < id * 2 + 1 - side
union all select id, id, a, b, 1, round(x, 6) from e where id not in (select id from w)""")
def series_absorption(t):
    # Rounded as in SQL, by the product; by the decimal digits, halves would go another way.
    return tours.absorbed(network(t), ["x"]).withColumn("x", F.round(F.col("x") * 1e6) / 1e6)
