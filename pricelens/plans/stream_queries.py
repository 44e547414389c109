"""Registered queries: the streaming jobs, driven to completion with
``availableNow`` and compared with their batch equivalents."""

from __future__ import annotations


from .. import adapters as A
from ..session import scratch_path
from . import landing as L
from ..streaming import jobs as J
from ..streaming.live_alerts import run_alerts
from .alert_browse_queries import FIRE_SQL, fire_out
from .common import iso_date, r6
from .registry import query
from .sql_text import rnd


def _events(d: str) -> str:
    """The table as a pattern: a stream takes a pattern's match whether it is
    one file or a folder of files, a plain path only if it is a folder."""
    return f"{d.rstrip('/')}/events.parque[t]"


def _ticks(spark, d: str):
    return J.tick_stream(spark, _events(d))


@query("stream_alerts", "T1 J7 J2", ["first_fire"], FIRE_SQL)
def q_stream_alerts(spark, d):
    ticks = _ticks(spark, d)
    reqs = J.request_stream(spark, _events(d))
    fires, _ = run_alerts(spark, ticks, reqs)
    return fire_out(fires)


@query("stream_daily_last", "T2 D2", ["daily"], f"""
SELECT product_name, strftime(ds, '%Y-%m-%d') AS ds, {rnd('y', 6)} AS y FROM daily""")
def q_stream_daily_last(spark, d):
    ticks = _ticks(spark, d)
    out = J.run_to_table(spark, J.daily_last_stream(ticks), "daily", "update", sink=J.upsert_by_day())
    return out.select("product_name", iso_date("ds").alias("ds"), r6("y").alias("y"))


@query("stream_ingest", "T3 S7 S11", ["price_obs"], """
SELECT product_name, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp", price, false AS price_defaulted
FROM price_obs""")
def q_stream_ingest(spark, d):
    landing = scratch_path(spark, "landing") + "/pages"
    L.price_pages(A.price_obs(spark, d)).write.parquet(landing)
    out = J.run_to_table(spark, J.ingest_stream(spark, landing), "ingest", "append")
    return out.select("product_name", "timestamp", "price", "price_defaulted")


@query("stream_quarantine", "T3 S11", ["price_obs"], """
SELECT page_id, url, 'invalid_url' AS status FROM pages""")
def q_stream_quarantine(spark, d):
    landing = scratch_path(spark, "landing") + "/pages"
    L.price_pages(A.price_obs(spark, d)).unionByName(A.table(spark, d, "pages")).write.parquet(landing)
    out = J.run_to_table(spark, J.quarantine_stream(spark, landing), "quarantine", "append")
    return out.select("page_id", "url", "status")
