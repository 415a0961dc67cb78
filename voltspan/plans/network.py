"""Topology and solves. Terminals are customers, suppliers feed them, and 25 islands are meshed networks of the customers whose
keys leave one remainder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.functions import text
from voltspan.operators import graph, kernels, topology
from voltspan.plans.base import n, query

# Couplers join a terminal with the next; the fourth of each run is open, so a node has at most four terminals.
_TERMINALS = "t as (select c_custkey id, case when c_custkey % 23 = 5 then 150.0 when c_custkey % 40 < 20 then 154.0 else 33.0 end kv, c_acctbal > -900 live from customer)"
_COUPLERS = f"{_TERMINALS}, k as (select x.id a, y.id b from t x join t y on y.id = x.id + 1 where x.id % 4 <> 3 and x.id % 7 <> 0 and x.live and y.live and abs(x.kv - y.kv) <= 0.02 * greatest(x.kv, y.kv))"
_NODES = f"{_COUPLERS}, d as (select a, b from k union all select b, a from k), r as (select id, id tip from t where live union select r.id, d.b from r join d on d.a = r.tip), node as (select id, min(tip) node from r group by 1)"


def _terminals(t) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), F.when(k % 23 == 5, 150.0).when(k % 40 < 20, 154.0).otherwise(33.0).alias("kv"), (F.col("c_acctbal") > -900).alias("in_service"))


def _nodes(t) -> DataFrame:
    k = F.col("c_custkey")
    couplers = t.customer.select(k.alias("a"), (k + 1).alias("b"), (k % 4 != 3).alias("closed"), (k % 7 != 0).alias("in_service"))
    return topology.contracted(_terminals(t), couplers)


@query(f"with recursive {_NODES} select id, node from node")
def contracted_nodes(t):
    return _nodes(t)


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where not (l_partkey % 9 = 4 and l_returnflag = 'R')")
def unblocked_equipment(t):
    equipment = t.lineitem.select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    switches = equipment.select("id", (~((F.col("l_partkey") % 9 == 4) & (F.col("l_returnflag") == "R"))).alias("closed"))
    return topology.connected(equipment, switches).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"with recursive {_NODES} select node, count(distinct node.id)::bigint n_terminals, count(o_orderkey)::bigint n_equipment from node left join orders on o_custkey = id and o_orderstatus = 'P' group by 1 having count(o_orderkey) > 0")
def bus_table(t):
    equipment = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("equipment"), F.col("o_custkey").alias("terminal"))
    return topology.buses(_nodes(t), equipment)


# Chains of ten customers, with every seventh link out.
_CHAINS = "b as (select c_custkey a, c_custkey + 1 b from customer where c_custkey % 10 <> 9 and c_custkey % 7 <> 3 and c_custkey + 1 in (select c_custkey from customer)), d as (select a, b from b union all select b, a from b), r as (select c_custkey id, c_custkey tip from customer union select r.id, d.b from r join d on d.a = r.tip), c as (select id, min(tip) component from r group by 1)"


def _chains(t) -> DataFrame:
    k = F.col("c_custkey")
    links = t.customer.where((k % 10 != 9) & (k % 7 != 3)).select(k.alias("a"), (k + 1).alias("b"))
    return links.join(t.customer.select(k.alias("b")), "b", "left_semi").select("a", "b")


@query(f"with recursive {_CHAINS} select component, count(*)::bigint n_buses, case when (select count(distinct component) from c) = 1 then 'NORMAL' when count(*) filter (id % 13 = 0) > 0 then 'TRUE_ISLAND' else 'UNSUPPLIED' end kind from c group by 1")
def island_classes(t):
    bus = t.customer.select(F.col("c_custkey").alias("node"))
    return topology.islands(bus, _chains(t), bus.where("node % 13 = 0"))


@query(f"with recursive {_CHAINS}, p as (select component, count(*) c, min(id) lo, max(id) hi from c group by 1 having count(*) > 1) select b.a, b.b, (b.a - lo + 1)::bigint left_size, (hi - b.a)::bigint right_size from b join c on c.id = b.a join p using (component)")
def outage_components(t):
    # What a chain falls into when a link is lost; with loops the link would be no bridge and nothing falls apart.
    edges = _chains(t)
    labels = graph.components(edges)
    cut = graph.bridges(edges, labels)
    sizes = labels.groupBy("component").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    return cut.join(sizes, "component").select("a", "b", (F.col("a") - F.col("lo") + 1).alias("left_size"), (F.col("hi") - F.col("a")).alias("right_size"))


@query(f"""with recursive {_CHAINS}, m as (select component, string_agg(id::varchar, ',' order by id::varchar) members from c group by 1)
select component, upper(to_base(list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(members, ''), lambda x: ord(x)::bigint)), lambda h, b: (xor(h, b) * 16777619) % 4294967296), 36)) as identity from m""")
def component_identity(t):
    labels = graph.components(_chains(t))
    of = t.customer.select(F.col("c_custkey").alias("node")).join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    members = of.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list(F.col("node").cast("string"))), ",").alias("members"))
    return members.select("component", F.conv(text.fnv1a(F.col("members")).cast("string"), 10, 36).alias("identity"))


@query(f"""with recursive {_CHAINS}, p as (select id, component, c_acctbal - avg(c_acctbal) over (partition by component) p from c join customer on c_custkey = id), f as (select id, sum(p) over (partition by component order by id) flow from p) select a, b, round(flow, 4) flow from b join f on f.id = b.a""")
def switch_flow(t):
    edges = _chains(t)
    labels = graph.components(edges)
    power = labels.join(t.customer.select(F.col("c_custkey").alias("node"), "c_acctbal"), "node")
    mean = power.groupBy("component").agg(F.avg("c_acctbal").alias("mean"))
    balanced = power.join(mean, "component").select("node", (F.col("c_acctbal") - F.col("mean")).alias("p"))
    return graph.bridge_flows(edges, balanced).select("a", "b", F.round("flow", 4).alias("flow"))


@query("select sha256(string_agg(c_custkey || ':' || c_nationkey, ';' order by c_custkey)) as identity from customer where c_nationkey < 3")
def topology_identity(t):
    rows = t.customer.where("c_nationkey < 3").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_nationkey"))).alias("r"))
    return rows.select(F.sha2(F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["c_custkey"], x["c_nationkey"])), ";"), 256).alias("identity"))


@query(f"""with recursive {_CHAINS.replace("b as (select c_custkey a, c_custkey + 1 b from customer where", "b as (select c_custkey a, c_custkey + 1 b from customer where c_custkey % 10 not in (0, 5) and (c_custkey + 1) % 10 not in (0, 5) and")},
l as (select c_custkey a, c_custkey + 1 b from customer where c_custkey % 10 <> 9 and c_custkey % 7 <> 3 and c_custkey + 1 in (select c_custkey from customer)), e as (select a, b from l union all select b, a from l),
o as (select component, min(e.b) node from c join e on e.a = c.id where c.id % 10 not in (0, 5) and e.b % 10 in (0, 5) group by 1 having count(distinct e.b) = 1),
p as (select c_custkey node, c_acctbal p from customer where c_custkey % 10 in (0, 5) union all select o.node, c_acctbal from customer join c on c.id = c_custkey join o using (component) where c_custkey % 10 not in (0, 5))
select node, round(sum(p), 4) p from p group by 1""")
def voltage_reduction(t):
    k = F.col("c_custkey")
    levels = t.customer.select(k.alias("id"), F.when(k % 5 == 0, 154.0).otherwise(33.0).alias("kv"))
    folded = topology.folded(t.customer.select(k.alias("id"), F.col("c_acctbal").alias("p")), levels, _chains(t), 66.0)
    return folded.select("node", F.round("p", 4).alias("p"))


def _branches(t) -> DataFrame:
    """Trees with chords: a node is linked to its half and to the one three places on."""
    k = t.customer.select((F.col("c_custkey") % 25).alias("island"), F.floor(F.col("c_custkey") / 25).alias("m"), "c_acctbal")
    size = k.groupBy("island").agg(F.max("m").alias("last"))
    k = k.join(size, "island")
    pairs = k.select("island", "m", F.explode(F.array(F.struct(F.floor((F.col("m") - 1) / 2).alias("o"), F.lit(0).alias("s")), F.struct((F.col("m") + 3).alias("o"), F.lit(1).alias("s")))).alias("x"), "last")
    pairs = pairs.where((F.col("m") > 0) & (F.col("x.o") <= F.col("last")) & ((F.col("x.s") == 0) | (F.col("m") % 2 == 1)))
    node = lambda m: m * 25 + F.col("island")
    out = pairs.select("island", (F.col("m") * 2 + F.col("x.s")).alias("id"), node(F.col("m")).alias("a"), node(F.col("x.o")).alias("b"), (0.02 + F.col("m") % 7 * 0.01).alias("x"))
    power = t.customer.select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 100).alias("p"))
    out = out.join(power.toDF("a", "pa"), "a").join(power.toDF("b", "pb"), "b")
    return out.withColumn("rating", F.when(F.col("id") % 6 != 0, 40.0 + F.col("id") % 50)).withColumn("r", F.col("x") / 4)


@query()
def dc_flow(t):
    return kernels.dc_flow(_branches(t)).withColumn("flow", F.round("flow", 6))


@query()
def lodf_screen(t):
    return kernels.outage_screen(_branches(t)).withColumns({c: F.round(c, 6) for c in ("delta", "post", "pct")})


@query()
def outage_statuses(t):
    return kernels.outage_screen(_branches(t)).where("rank = 1 or rank is null").groupBy("status").agg(n())


@query()
def short_circuit(t):
    b = _branches(t)
    sources = b.groupBy("island").agg(F.min("a").alias("node")).select("island", "node", F.lit(0.02).alias("r"), F.lit(0.5).alias("x"))
    return kernels.short_circuit(b, sources, 154.0).withColumns({"ikss_ka": F.round("ikss_ka", 6), "skss_mva": F.round("skss_mva", 4)})


@query()
def ac_flow(t):
    return _ac_flow(t, False)


@query()
def fast_ac_flow(t):
    return _ac_flow(t, True)


def _ac_flow(t, fast: bool) -> DataFrame:
    b = _branches(t)
    ends = b.select("island", F.explode(F.array("a", "b")).alias("node")).distinct()
    first = ends.groupBy("island").agg(F.min("node").alias("slack"))
    nodes = ends.join(first, "island").join(t.customer.select(F.col("c_custkey").alias("node"), "c_acctbal"), "node")
    kind = F.when(F.col("node") == F.col("slack"), 0).when(F.floor(F.col("node") / 25) % 10 == 3, 1).otherwise(2)
    nodes = nodes.select((F.col("node") % 25).alias("island"), "node", kind.alias("kind"), (-F.col("c_acctbal") / 3e6).alias("p"), (-F.col("c_acctbal") / 9e6).alias("q"), F.lit(1.02).alias("v"), F.lit(-0.05).alias("q_low"), F.lit(0.05).alias("q_high"))
    return kernels.ac_flow(b.select("island", "a", "b", "r", "x", F.lit(0.001).alias("charging"), F.lit(1.0).alias("tap")), nodes, fast).withColumns({c: F.round(c, 6) for c in ("v", "angle_deg", "p", "q")})


@query()
def node_ordering(t):
    return kernels.ordering(_branches(t))


@query("""with u as (select s_nationkey g, s_suppkey id, greatest(s_acctbal, 1) w, 3000.0 cap from supplier), s as (select *, row_number() over (partition by g order by cap / w, id) place, sum(cap) over wa - cap below, sum(w) over wb above, least(2000.0 * count(*) over (partition by g), sum(cap) over (partition by g)) total from u window wa as (partition by g order by cap / w, id rows unbounded preceding), wb as (partition by g order by cap / w, id rows between current row and unbounded following)),
l as (select g, arg_min((total - below) / above, place) filter ((total - below) / above <= cap / w * (1 + 1e-12)) lv, max(cap / w) most from s group by 1) select id, round(least(cap, coalesce(lv, most) * w), 6) share from s join l using (g)""")
def water_filling(t):
    from voltspan.operators import dispatch

    u = t.supplier.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("id"), F.greatest("s_acctbal", F.lit(1.0)).alias("w"), F.lit(3000.0).alias("cap"))
    return dispatch.filled(u, "g", "w", "cap", F.lit(2000.0) * F.count("*")).select("id", F.round("share", 6).alias("share"))


@query("""with u as (select s_nationkey g, s_suppkey id, case when s_nationkey % 3 = 0 or s_suppkey % 7 <> 0 then (s_suppkey % 9)::double end pct, greatest(s_acctbal, 0) p from supplier),
k as (select g, bool_and(pct is not null) and sum(pct) > 1e-9 explicit, sum(pct) sp, sum(p) tp, count(*) c from u group by 1) select id, round(case when explicit then pct / sp when tp > 1e-9 then p / tp else 1.0 / c end, 10) share, explicit from u join k using (g)""")
def participation(t):
    from voltspan.operators import dispatch

    k = F.col("s_suppkey")
    u = t.supplier.select(F.col("s_nationkey").alias("g"), k.alias("id"), F.when((F.col("s_nationkey") % 3 == 0) | (k % 7 != 0), (k % 9).cast("double")).alias("pct"), F.greatest("s_acctbal", F.lit(0.0)).alias("p"))
    return dispatch.participation(u, "g", "pct", "p").select("id", F.round("share", 10).alias("share"), "explicit")
