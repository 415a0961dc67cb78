"""Queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltspan.llm import centroids, fingerprint, html, langid, mixing, packing, ppm, quality, setjoin, suffix_dedup, toxicity, vector_codes, warc
from voltspan.llm._io import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op10_setjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.link(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("multiplicity")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _op11_sql() -> str:
    """Lloyd's rounds unrolled: in each, distances to all centroids, and the floor of the means by component."""
    near = "list_transform(range(len(c)), lambda j: {'d': list_sum(list_transform(range(1, 65), lambda i: (q[i] - c[j + 1][i]) * (q[i] - c[j + 1][i]))), 'j': j})"
    sql = """with kept as materialized (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) q from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select list(q order by h) c from (select q, sha256('1:' || vec_id) h from kept order by h limit 16))"""
    for r in range(4):
        sql += f",\na{r} as materialized (select vec_id, q, list_min({near}) m from kept, c{r})"
        if r < 3:
            sql += f""",
m{r} as (select j, list(x order by i) q from (select m.j j, i, sum(q[i]) // count(*) - case when sum(q[i]) < 0 and sum(q[i]) % count(*) <> 0 then 1 else 0 end x from a{r}, range(1, 65) s(i) group by 1, 2) group by 1),
c{r + 1} as materialized (select list(coalesce(m{r}.q, c[k.j + 1])::bigint[] order by k.j) c from c{r}, range(0, len(c)) k(j) left join m{r} on m{r}.j = k.j)"""
    return sql + "\nselect vec_id, m.j::int as cluster, m.d::bigint distance, (sum(m.d) over (partition by m.j))::bigint cluster_inertia, (sum(m.d) over ())::bigint inertia, sha256(array_to_string(c[m.j + 1], ',')) centroid_sha256 from a3, c3"


def _op12_sql() -> str:
    """Codebooks by rounds unrolled, with all distances in each."""
    sql = """with kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) q from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
part as materialized (select vec_id, label, p, q[p * 8 + 1 : p * 8 + 8] q from kept, range(0, 8) s(p)),
c0 as materialized (select p, list(q order by vec_id) c from part where vec_id in (select vec_id from kept order by vec_id limit 16) group by 1)"""
    near = "list_min(list_transform(range(len(c)), lambda j: {'d': list_sum(list_transform(range(1, 9), lambda i: (q[i] - c[j + 1][i]) * (q[i] - c[j + 1][i]))), 'j': j}))"
    for r in range(7):
        sql += f",\na{r} as materialized (select vec_id, label, p, q, {near} m from part join c{r} using (p))"
        if r < 6:
            sql += f""",
m{r} as (select p, j, list(x order by i) q from (select p, m.j j, i, sum(q[i]) // count(*) - case when sum(q[i]) < 0 and sum(q[i]) % count(*) <> 0 then 1 else 0 end x from a{r}, range(1, 9) s(i) group by 1, 2, 3) group by 1, 2),
e{r} as (select p, unnest(range(len(c))) j, unnest(c) old from c{r}),
c{r + 1} as materialized (select e{r}.p, list(coalesce(m{r}.q, old)::bigint[] order by e{r}.j) c from e{r} left join m{r} on m{r}.p = e{r}.p and m{r}.j = e{r}.j group by 1)"""
    return sql + """,
v as (select vec_id, label, lower(string_agg(printf('%02x', m.j), '' order by p)) code, sum(m.d)::bigint error from a6 group by 1, 2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, (select sha256(string_agg(array_to_string(flatten(c), ','), ',' order by p)) from c6) codebooks_sha256 from v"""


OP13_SQL = """with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, strlen(html)::bigint payload_bytes, sha1(html) h, max(page_id) over (partition by html) last from p)
select page_id, payload_bytes, translate(array_to_string(list_transform(range(4), lambda i: to_base(('0x' || h[i * 10 + 1 : i * 10 + 10])::bigint, 32, 8)), ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') payload_digest,
case when page_id = last then 'response' else 'revisit' end record_type, case when page_id <> last then last end refers_to from d"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_suffix_dedup, op3_toxicity, op4_quality, op5_language, op6_ppm, op7_html, op8_fingerprint, op9_packing, op10_setjoin, op11_centroids, op12_vector_codes, op13_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op11_centroids": _op11_sql(), "op12_vector_codes": _op12_sql(), "op13_warc": OP13_SQL}
