"""Energization: customers are terminals, coupled in order of balance within a nation and segment, and orders are lines between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltspan.operators import energization
from voltspan.operators.scans import before
from voltspan.operators.tables import settle
from voltspan.plans.base import query

# Ways of up to 14 couplers from each line end; levels; the nearest terminal in service; and back by least coupler.
_WAYS = """c as (select c_custkey id, c_acctbal > 6000 in_service, lag(c_custkey) over (partition by c_nationkey, c_mktsegment order by hash_place, c_custkey) prev from (select *, c_custkey * 7919 % 10007 hash_place from customer)),
k as (select id, prev a, id b, id % 3 <> 0 closed, id % 11 <> 5 in_service from c where prev is not null),
line as (select o_orderkey id, o_custkey a, lead(o_custkey) over (order by o_orderkey) b from orders),
e as materialized (select id line, 'a' side, a start from line union all select id, 'b', b from line where b is not null),
d as materialized (select a x, b y, id::varchar via from k where in_service union all select b, a, id::varchar from k where in_service),
r as (select distinct start, start node, 0 h from e union select start, y, h + 1 from r join d on x = node where h < 14),
lev as materialized (select start, node, min(h) h from r group by 1, 2),
hit as (select start, arg_min(node, (h, node)) node, min(h) h from lev where node in (select id from c where in_service) group by 1),
pred as materialized (select l.start, l.node, min((via, p.node)) m from lev l join d on y = l.node join lev p on p.start = l.start and p.node = x and p.h = l.h - 1 group by 1, 2),
way as (select start, h step, node from hit union all select way.start, step - 1, m[2] from way join pred on pred.start = way.start and pred.node = way.node where step > 0),
s as materialized (select line, side, e.start, step::bigint step, case when step > 0 then m[1] end coupler, way.node terminal, coalesce(step > 0 and not k.closed, false) closes, not c.in_service restores from e join way using (start) left join pred on pred.start = way.start and pred.node = way.node and step > 0 left join k on k.id::varchar = m[1] join c on c.id = way.node),
w as (select o_orderkey id, o_orderkey line, o_orderpriority <> '4-NOT SPECIFIED' closed, o_orderpriority <> '5-LOW' in_service from orders)"""

# The same without a bound: from a terminal in service no way goes on, and none comes to a terminal twice.
_ALL_WAYS = _WAYS.replace(
    "select distinct start, start node, 0 h from e union select start, y, h + 1 from r join d on x = node where h < 14",
    "select distinct start, start node, 0 h, [start] seen from e union all select start, y, h + 1, list_append(seen, y) from r join d on x = node where not list_contains(seen, y) and node not in (select id from c where in_service)",
)


def _tables(t) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    k = F.col("c_custkey")
    by = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(k * 7919 % 10007, k)
    c = t.customer.select(k.alias("id"), (F.col("c_acctbal") > 6000).alias("in_service"), F.lag(k).over(by).alias("prev"))
    couplers = c.where("prev is not null").select("id", F.col("prev").alias("a"), F.col("id").alias("b"), (F.col("id") % 3 != 0).alias("closed"), (F.col("id") % 11 != 5).alias("in_service"))
    # The next order's customer, by numbers of the orders and not in one task.
    after = before(t.orders.select("o_orderkey", "o_custkey", F.lit(0).alias("all")), ["all"], [F.col("o_orderkey").desc()], F.col("o_custkey"), "b")
    lines = settle(after.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("a"), "b"), "lines")
    switches = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("line"), (F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("closed"), (F.col("o_orderpriority") != "5-LOW").alias("in_service"))
    return lines, settle(c.select("id", "in_service"), "terminals"), settle(couplers, "couplers"), switches


@query(f"with recursive {_WAYS} select * from s")
def energization_steps(t):
    lines, terminals, couplers, _ = _tables(t)
    return energization.steps(lines, terminals, couplers, 14)


@query(f"""with recursive {_ALL_WAYS},
i as (select line, 'closes' kind, coupler item from s where closes union select line, 'restores', terminal::varchar from s where restores union select line, 'ways', side from s
union select line, 'closes', 'S' || id from w where in_service and not closed union select line, 'blockers', 'OUT_OF_SERVICE:' || id from w where not in_service
union select id, 'blockers', 'NO_PATH:' || side from line, (values ('a'), ('b')) v(side) where not exists (select 1 from s where s.line = line.id and s.side = v.side)),
g as (select line, count(*) filter (kind = 'ways')::int n_ways, count(*) filter (kind = 'blockers') nb, coalesce(string_agg(item, ' ' order by item) filter (kind = 'closes'), '') closes, coalesce(string_agg(item, ' ' order by item) filter (kind = 'restores'), '') restores, coalesce(string_agg(item, ' ' order by item) filter (kind = 'blockers'), '') blockers from i group by 1)
select line, n_ways = 2 and nb = 0 ready, n_ways, closes, restores, blockers from g""")
def energization_plans(t):
    lines, terminals, couplers, switches = _tables(t)
    found = energization.plans(lines, settle(energization.steps(lines, terminals, couplers), "ways"), switches)
    return found.withColumns({c: F.array_join(c, " ") for c in ("closes", "restores", "blockers")})
