"""A study of orders in stages, with a budget: it stops after its second stage and is resumed from the ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.operators import cursors, studies
from voltspan.operators.tables import shared
from voltspan.plans.base import query

BUDGET = 200

# Loading is the price's share of a customer's greatest order; what is not known of it makes a direct case.
_CASES = """c as (select o_orderkey id, o_orderpriority = '1-URGENT' and o_totalprice > 450000 explicit, case when o_orderpriority <> '5-LOW' then round(100 * o_totalprice / max(o_totalprice) over (partition by o_custkey), 3) end loading, o_orderpriority = '5-LOW' direct, o_orderstatus = 'P' islanding from orders),
s as (select *, coalesce(loading, 0) >= 100 violation, explicit or coalesce(loading, 0) >= 80 or direct promoted from c),
k as (select *, case when explicit then 0 when islanding then 3 when direct then 1 else 2 end kind from s where promoted),
i as (select *, row_number() over (partition by kind order by violation desc, loading desc nulls last, id) - 1 i, count(*) filter (kind = 0) over () n0, count(*) filter (kind = 1) over () n1, count(*) filter (kind = 2) over () n2 from k),
q as (select id, case kind when 0 then i when 3 then n0 + n1 + n2 + i else case when i >= least(n1, n2) then n0 + least(n1, n2) + i when kind = 1 then n0 + 2 * i + 1 else n0 + 2 * i end end slot from i)"""


def _catalog(t) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")


def _screened(catalog: DataFrame) -> DataFrame:
    most = catalog.groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"))
    loading = F.when(F.col("o_orderpriority") != "5-LOW", F.round(100 * F.col("o_totalprice") / F.col("most"), 3))
    found = catalog.join(most, "o_custkey").select("id", ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 450000)).alias("explicit"), loading.alias("loading"), (F.col("o_orderpriority") == "5-LOW").alias("direct"), (F.col("o_orderstatus") == "P").alias("islanding"))
    high = lambda least: F.coalesce(F.col("loading") >= least, F.lit(False))
    return found.withColumns({"violation": high(100), "promoted": F.col("explicit") | high(80) | F.col("direct")})


@query(f"with {_CASES} select id, slot::bigint slot, case when slot < {BUDGET} then 'RUN' else 'NOT_RUN_BUDGET' end status from q")
def study_queue(t):
    return studies.queued(_screened(_catalog(t)), BUDGET)


@query(f"with {_CASES} select s.id, case when slot is null then 'DC_CLEAR' when slot < {BUDGET} then 'RUN' else 'NOT_RUN_BUDGET' end status, loading from s left join q on q.id = s.id")
def study_resumed(t):
    def result(screened: DataFrame) -> DataFrame:
        return screened.join(studies.queued(screened, BUDGET), "id", "left").select("id", F.coalesce("status", F.lit("DC_CLEAR")).alias("status"), "loading")

    stages = [("CATALOG", lambda _: _catalog(t)), ("DC_SCREEN", _screened), ("RESULT", result)]
    ledger = studies.Ledger(t.spark, f"{shared(t.spark)}/study-{uuid.uuid4().hex}")
    identity = str(cursors.identity(_catalog(t)))
    ledger.run("area", identity, stages[:2])
    return ledger.run("area", identity, stages)
