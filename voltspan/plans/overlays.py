"""Overlays from the event log: users take items, and a user's error gives all of its items back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.operators import overlays
from voltspan.operators.tables import settle
from voltspan.plans.base import query

_VERSIONS = r"""with log as (select event_id pos, user_id owner, regexp_extract(props, '(\d+)', 1)::bigint item, event_type = 'error' rollback, event_type from events),
g as (select *, last_value(case when rollback then pos end ignore nulls) over (partition by owner order by pos rows between unbounded preceding and 1 preceding) after,
  first_value(case when rollback then pos end ignore nulls) over (partition by owner order by pos rows between 1 following and unbounded following) "end" from log),
h as (select owner, item, min(pos) start, "end" from g where event_type in ('click', 'purchase') group by owner, item, after, "end"),
f as (select *, greatest(start, coalesce(max(coalesce("end", 9223372036854775807)) over (partition by item order by start rows between unbounded preceding and 1 preceding), start)) valid_from from h),
v as (select item, owner, start, valid_from, "end" valid_to from f where valid_from < coalesce("end", 9223372036854775807)),
w as (select *, case when lag(valid_to) over (partition by item order by valid_from) = valid_from then lag(owner) over (partition by item order by valid_from) end from_owner from v)"""


def _log(t) -> DataFrame:
    item = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    kinds = t.events.where("event_type in ('click', 'purchase', 'error')")
    return kinds.select(F.col("event_id").alias("at"), F.col("user_id").alias("owner"), item.alias("item"), (F.col("event_type") == "error").alias("rollback"))


@query(f"{_VERSIONS} select * from w")
def overlay_versions(t):
    return overlays.versions(overlays.holdings(_log(t)))


@query(f"{_VERSIONS} select l.pos event_id, l.item, w.owner, w.valid_from from log l left join w on w.item = l.item and w.valid_from < l.pos and (w.valid_to is null or l.pos < w.valid_to) where event_type = 'view'")
def overlay_as_of(t):
    probes = t.events.where("event_type = 'view'").select("event_id", F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("item"))
    found = settle(overlays.versions(overlays.holdings(_log(t))), "versions")
    return overlays.as_of(probes, "item", F.col("event_id"), found, ["owner", "valid_from"])
