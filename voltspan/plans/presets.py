"""Presets over solved branches, and cells of customers as a raw table."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltspan.operators import presets
from voltspan.plans.base import query

_HEADERS = ["name", "balance", "nation", "note"]
# Balances of some segments are no numbers, sentinels, zero or missing.
_RAW = """r as (select c_custkey id, c_name as name, case c_mktsegment when 'BUILDING' then 'n/a' when 'MACHINERY' then case when c_acctbal < 0 then '-9999' else ' 12.5e1 ' end when 'FURNITURE' then '' when 'AUTOMOBILE' then case when c_acctbal > 5000 then null else '0' end else floor(c_acctbal)::bigint::varchar end balance, (c_nationkey * 9000)::varchar nation, '.5' note from customer)"""


@query(f"""with {_RAW}, u as (select id, unnest(['balance', 'nation', 'note', 'area']) field, unnest(['B', 'C', 'D', '']) letter, unnest([balance, nation, note, null]) t from r),
n as (select *, case when regexp_full_match(trim(t), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') then trim(t)::double end v from u)
select id, field, letter, v as value, coalesce(t, '') text, case when field = 'area' then 'MISSING_ATTRIBUTE' when coalesce(t, '') = '' then 'NOT_RECORDED' when v = 0 then 'RECORDED_NUMERIC_ZERO' when v is not null then 'RECORDED' else 'INVALID' end availability,
case when field = 'area' then 'MISSING_ATTRIBUTE' when coalesce(t, '') <> '' and v is null then 'NON_NUMERIC' when abs(v) = 9999 or abs(v) >= 99999 then 'SENTINEL_CANDIDATE' else '' end flags from n""")
def raw_cells(t):
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    text = F.when(segment == "BUILDING", "n/a").when(segment == "MACHINERY", F.when(balance < 0, "-9999").otherwise(" 12.5e1 ")).when(segment == "FURNITURE", "").when(segment == "AUTOMOBILE", F.when(~(balance > 5000), "0")).otherwise(F.floor(balance).cast("string"))
    raw = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), text.alias("balance"), (F.col("c_nationkey") * 9000).cast("string").alias("nation"), F.lit(".5").alias("note"))
    return presets.read_cells(raw, "id", _HEADERS, ["balance", "nation", "note", "area"]).withColumn("flags", F.array_join("flags", ","))


@query("""with b as (select o_orderkey id, o_orderpriority as name, o_custkey as voltage, o_custkey % 97 p, o_custkey % 89 q, o_orderkey % 83 sp, o_orderkey % 79 sq from orders),
m as (select id, unnest(range(13))::int place, unnest(['name', 'voltage', 'baseP', 'baseQ', 'baseLoad', 'scenarioP', 'scenarioQ', 'scenarioLoad', 'deltaP', 'deltaQ', 'deltaLoad', 'deltaPLoss', 'deltaQLoss']) metric, unnest([name, voltage::varchar, p::varchar, q::varchar, null, sp::varchar, sq::varchar, null, (sp - p)::varchar, (sq - q)::varchar, null, null, null]) as value from b) select * from m""")
def result_preset(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = t.orders.select(k.alias("id"), F.col("o_orderpriority").alias("name"), c.alias("voltage"), (c % 97).alias("baseP"), (c % 89).alias("baseQ"), (k % 83).alias("scenarioP"), (k % 79).alias("scenarioQ"))
    rows = rows.withColumns({"deltaP": F.col("scenarioP") - F.col("baseP"), "deltaQ": F.col("scenarioQ") - F.col("baseQ")})
    return presets.shown(rows, "id", "line", "delta")
