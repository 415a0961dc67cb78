"""Scalar families, unpivoted records and text in and out."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltspan.functions import text
from voltspan.plans.base import n, query


@query("""with v as (select p_partkey k, case p_size % 6 when 0 then '1.' || lpad((p_size * 7)::varchar, 3, '0') || ',5' when 1 then p_size || ',25' when 2 then p_size || '.5' when 3 then 'n/a' when 4 then ' ' || p_size || 'e2 ' end t from part)
select k, case when regexp_matches(trim(t), '^([0-9]{1,3}([.][0-9]{3})+|[0-9]+),[0-9]+$') then replace(replace(trim(t), '.', ''), ',', '.')::double when regexp_matches(trim(t), '^[0-9]+([.][0-9]*)?(e[0-9]+)?$') then trim(t)::double end as value from v""")
def parse_numbers(t):
    z = F.col("p_size")
    v = F.when(z % 6 == 0, F.concat(F.lit("1."), F.lpad((z * 7).cast("string"), 3, "0"), F.lit(",5"))).when(z % 6 == 1, F.concat(z, F.lit(",25"))).when(z % 6 == 2, F.concat(z, F.lit(".5"))).when(z % 6 == 3, "n/a").when(z % 6 == 4, F.concat(F.lit(" "), z, F.lit("e2 ")))
    return t.part.select(F.col("p_partkey").alias("k"), text.number(v).alias("value"))


@query("""select o_orderkey, case when o_orderkey % 4 = 3 then null else strftime(o_orderdate, '%Y-%m-%d') end as day, date_diff('day', date '1995-01-01', o_orderdate::date)::bigint as age, year(o_orderdate)::bigint * 100 + month(o_orderdate) as month from orders""")
def parse_dates(t):
    k = F.col("o_orderkey") % 4
    written = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).when(k == 2, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("soon")
    return t.orders.select("o_orderkey", text.day(written).cast("string").alias("day"), F.date_diff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long").alias("age"), (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("month"))


@query("select p_partkey, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(p_name || p_partkey, ''), lambda x: ord(x)::bigint)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) as hash from part")
def fnv_hash(t):
    return t.part.select("p_partkey", text.fnv1a(F.concat("p_name", F.col("p_partkey").cast("string"))).alias("hash"))


@query("select p_partkey, case when c > 702 then chr((65 + ((c - 703) // 676) % 26)::int) else '' end || case when c > 26 then chr((65 + ((c - 27) // 26) % 26)::int) else '' end || chr((65 + (c - 1) % 26)::int) letters from (select p_partkey, p_partkey * 7 % 1500 + 1 c from part)")
def column_letters(t):
    return t.part.select("p_partkey", text.column_letters(F.col("p_partkey") * 7 % 1500 + 1).alias("letters"))


@query("""with g as (select s_suppkey k, 36 + s_suppkey % 7 * 0.8 lat, 26 + s_suppkey % 11 * 1.5 lon from supplier)
select k, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(39.9 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(39.9)) * pow(sin(radians(32.8 - lon) / 2), 2))), 6) km, sqrt(pow(lat - 39.9, 2) + pow(lon - 32.8, 2)) > 0.12 far from g""")
def distances(t):
    k = F.col("s_suppkey")
    g = t.supplier.select(k.alias("k"), (36 + k % 7 * F.lit(0.8)).alias("lat"), (26 + k % 11 * F.lit(1.5)).alias("lon"))
    lat, lon = F.lit(39.9), F.lit(32.8)
    return g.select("k", F.round(text.haversine(F.col("lat"), F.col("lon"), lat, lon), 6).alias("km"), (F.hypot(F.col("lat") - lat, F.col("lon") - lon) > 0.12).alias("far"))


@query("""with c as (select o_orderkey k, case o_orderkey % 3 when 0 then 'N1:ElmLne:' || o_custkey when 1 then 'N1:ElmTr2:T ' || o_orderkey else 'N1:ElmLod:' || o_custkey end id from orders)
select k, nullif(regexp_extract(id, '^N1:(ElmLne|ElmTr2):(.+)$', 1), '') as class, nullif(regexp_extract(id, '^N1:(ElmLne|ElmTr2):(.+)$', 2), '') as key from c""")
def case_ids(t):
    k = F.col("o_orderkey")
    written = F.when(k % 3 == 0, F.concat(F.lit("N1:ElmLne:"), "o_custkey")).when(k % 3 == 1, F.concat(F.lit("N1:ElmTr2:T "), "o_orderkey")).otherwise(F.concat(F.lit("N1:ElmLod:"), "o_custkey"))
    kind, key = text.case_id(written)
    return t.orders.select(k.alias("k"), kind.alias("class"), key.alias("key"))


@query("select event_type, count(*)::bigint n, sum((props::json->>'k')::bigint)::bigint total, count(*) filter ((props::json->>'none') is null)::bigint absent from events group by 1")
def json_fields(t):
    df = t.events.select("event_type", F.from_json("props", "k long, none string").alias("p"))
    return df.groupBy("event_type").agg(n(), F.sum("p.k").alias("total"), F.count_if(F.col("p.none").isNull()).cast("long").alias("absent"))


@query("""select p_partkey, '{' || concat_ws(',', '"brand":"' || p_brand || '"', case when p_size % 3 <> 0 then '"size":"' || p_size || '"' end, '"type":"' || p_type || '"') || '}' as json from part""")
def stable_json(t):
    values = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string")), F.lit("brand"), F.col("p_brand"))
    return t.part.select("p_partkey", text.stable_json(values).alias("json"))


@query("""with e as (select user_id, event_type field, max(value) v, count(*) c from events group by all) select user_id, max(case when field = 'click' then v end) click, max(case when field = 'error' then v end) error, max(case when field = 'purchase' then v end) purchase, count(*) filter (c > 1)::bigint duplicates, case when count(*) filter (field in ('click', 'error')) = 2 then 'OK' else 'INCOMPLETE' end status from e group by 1""")
def attribute_rows(t):
    e = t.events.groupBy("user_id", F.col("event_type").alias("field")).agg(F.max("value").alias("v"), F.count("*").alias("c"))
    pick = lambda k: F.max(F.when(F.col("field") == k, F.col("v"))).alias(k)
    return e.groupBy("user_id").agg(pick("click"), pick("error"), pick("purchase"), F.count_if(F.col("c") > 1).cast("long").alias("duplicates"), F.when(F.count_if(F.col("field").isin("click", "error")) == 2, "OK").otherwise("INCOMPLETE").alias("status"))


@query("select 'customer' kind, c_custkey id, c_acctbal balance, null::varchar as brand, null::int size from customer union all select 'part', p_partkey, null, p_brand, p_size from part")
def rectangular_union(t):
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""select user_id, string_agg(case when event_type = 'click' then 'c' else 'x' end, ';' order by event_id) tags, count(*)::bigint n, list_contains(list(event_type), 'error') has_error, bool_and(value > 0) all_positive from events group by 1""")
def array_family(t):
    e = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("e"))
    tags = F.array_join(F.transform("e", lambda x: F.when(x["event_type"] == "click", "c").otherwise("x")), ";")
    return e.select("user_id", tags.alias("tags"), F.size("e").cast("long").alias("n"), F.exists("e", lambda x: x["event_type"] == "error").alias("has_error"), F.forall("e", lambda x: x["value"] > 0).alias("all_positive"))


@query("""with r as (select p_partkey, concat_ws(';', p_partkey::varchar, replace(p_retailprice::varchar, '.', ','), case when p_size % 7 = 0 then null else p_size::varchar end) line from part)
select p_partkey, replace(string_split(line, ';')[2], ',', '.')::double price, try_cast(string_split(line, ';')[3] as double) size from r where len(string_split(line, ';')) >= 3""")
def numeric_csv(t):
    size = F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("string"))
    line = F.concat_ws(";", "p_partkey", F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")), size)
    cells = t.part.select("p_partkey", F.split(line, ";").alias("c")).where(F.size("c") >= 3)
    return cells.select("p_partkey", F.replace(F.col("c")[1], F.lit(","), F.lit(".")).try_cast("double").alias("price"), F.col("c")[2].try_cast("double").alias("size"))
