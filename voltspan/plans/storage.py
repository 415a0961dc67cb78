"""Keyed persistence and pages bound to a snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voltspan.operators import cursors
from voltspan.operators.tables import shared
from voltspan.plans.base import query
from voltspan.sinks.keyed import Keyed

# Delivered orders first; then the scope of urgent orders starts anew with the open ones, and the pending ones follow.
_PUTS = "o as (select case o_orderstatus when 'F' then 1 when 'O' then 3 else 4 end v, o_custkey || '/' || o_orderpriority as key, o_orderpriority as scope, o_orderkey::varchar as value from orders)"


@query(f"""with {_PUTS}, n as (select key, scope, v, max(value) as value from o group by all)
select key, scope, value from n where v = (select max(v) from n m where m.key = n.key) and not (scope = '1-URGENT' and v < 3)""")
def keyed_persistence(t):
    store = Keyed(t.spark, f"{shared(t.spark)}/keyed-{uuid.uuid4().hex}")
    rows = lambda status: t.orders.where(F.col("o_orderstatus") == status).select(F.concat_ws("/", "o_custkey", "o_orderpriority").alias("key"), F.col("o_orderpriority").alias("scope"), F.col("o_orderkey").cast("string").alias("value"))
    store.put(rows("F"))
    store.put(rows("O"), reset=["1-URGENT"])
    store.compact()
    store.put(rows("P"))
    return store.read()


@query("select c_custkey, c_acctbal, (r // 50)::bigint page, (r % 50)::bigint place from (select *, row_number() over (order by c_acctbal desc, c_custkey) - 1 r from customer)")
def fetched_pages(t):
    rows = t.customer.select("c_custkey", "c_acctbal")
    return cursors.snapshot(rows, F.col("c_acctbal").desc(), F.col("c_custkey")).pages(t.customer.select("c_custkey", "c_acctbal"), 50)
