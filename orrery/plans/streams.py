"""Batch forms of the streaming aggregations, and other engine extras over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.streaming import events as e
from orrery.tables import table

QUERIES = {
    "st_windows": lambda s, d: e.windowed(table(s, d, "events").where("ts is not null")).withColumn("total", F.round("total", 6)),
    "st_sessions": lambda s, d: e.sessions(table(s, d, "events").where("ts is not null")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", F.round("total", 6).alias("total")),
    "st_once": lambda s, d: e.once(table(s, d, "events")).agg(F.count("*").alias("n")),
}
ORACLE = {
    "st_windows": "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events where ts is not null group by all",
    "st_sessions": """with x as (select *, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as nw from events where ts is not null window w as (partition by user_id order by ts)),
y as (select *, sum(nw) over (partition by user_id order by ts, event_id) as i from x) select user_id, min(ts) as start, max(ts) + interval '30 minutes' as "end", count(*) as n, round(sum(value), 6) as total from y group by user_id, i""",
    "st_once": "select count(distinct event_id) as n from events",
}
