"""Time-series queries over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions.numeric import parse_numeric, unzigzag, zigzag
from loomstone.operators import timeseries as ts
from loomstone.plans.registry import Tables, query
from loomstone.sources.tables import micros

DAY = 86_400_000_000
START, END = 1_704_088_800_000_000, 1_706_162_400_000_000  # 2024-01-01 06:00 to 2024-01-25 06:00, off midnight on purpose


def points(t: Tables):
    """(series, us, value, text): each value also as text in five forms, one of them no number."""
    n = F.floor("value").cast("string")
    form = (
        F.when(F.col("event_id") % 5 == 0, n).when(F.col("event_id") % 5 == 1, F.concat(F.lit("temperature:"), n)).when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"value": '), n, F.lit("}")))
        .when(F.col("event_id") % 5 == 3, F.lit("not-a-number")).otherwise(F.concat(F.lit('{"value":"x","avg":'), n, F.lit("}")))
    )
    return t.events.select(F.col("user_id").alias("series"), micros("ts").alias("us"), "value", "event_type", "event_id", form.alias("text"))


PARSED = "CASE WHEN event_id % 5 <> 3 THEN floor(value) END"
RANGE = f"epoch_us(ts) >= {START} AND epoch_us(ts) < {END}"


@query(f"SELECT event_id, epoch_us(ts) AS us, round(value, 6) AS value FROM events WHERE user_id = 13 AND {RANGE}")
def ts_scan_range(t: Tables):
    return ts.scan(points(t), START, END, 13, ts="us").select("event_id", "us", F.round("value", 6).alias("value"))


@query(f"SELECT user_id AS series, max(epoch_us(ts)) AS us, round(arg_max(value, ts), 6) AS value FROM events WHERE epoch_us(ts) <= {END} GROUP BY user_id")
def ts_latest_before(t: Tables):
    return ts.latest_before(points(t), END, ts="us").select("series", "us", F.round("value", 6).alias("value"))


@query(
    """SELECT p.event_id, round(c.value, 6) AS asof_value, epoch_us(c.ts) AS asof_ts
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts"""
)
def ts_asof(t: Tables):
    p = points(t).select("series", F.col("us").alias("ts"), "event_id", "event_type", "value")
    probes = p.filter("event_type = 'purchase'").select("series", "ts", "event_id")
    out = ts.asof(probes, p.filter("event_type = 'click'").select("series", "ts", "value"), size=DAY)
    return out.select("event_id", F.round("asof_value", 6).alias("asof_value"), "asof_ts")


def _parsed(t: Tables):
    return ts.scan(points(t), START, END, ts="us").withColumn("number", parse_numeric(F.col("text")))


for _kind in ts.KINDS:
    _made = "count(*)" if _kind == "count" else f"{_kind}({PARSED})"
    _sql = f"SELECT user_id AS series, {_made if _kind == 'count' else f'round({_made}, 6)'} AS {_kind} FROM events WHERE {RANGE} GROUP BY user_id"

    @query(_sql, name=f"ts_{_kind}")
    def _aggregate(t: Tables, kind=_kind):
        out = ts.aggregate(_parsed(t), kind, "number", ("series",))
        return out if kind == "count" else out.withColumn(kind, F.round(kind, 6))

    _sql = f"""SELECT {START} + ((epoch_us(ts) - {START}) // {DAY}) * {DAY} AS window_start, {_made if _kind == 'count' else f'round({_made}, 6)'} AS {_kind},
    least({START} + ((epoch_us(ts) - {START}) // {DAY} + 1) * {DAY}, {END}) AS window_end FROM events WHERE {RANGE} GROUP BY ALL"""

    @query(_sql, name=f"ts_downsample_{_kind}")
    def _downsample(t: Tables, kind=_kind):
        rows = points(t).withColumn("number", parse_numeric(F.col("text")))
        out = ts.downsample(rows, START, END, DAY, kind, "number", "us")
        return out if kind == "count" else out.withColumn(kind, F.round(kind, 6))


@query(
    f"""SELECT user_id AS series, {START} + ((epoch_us(ts) - {START}) // (7 * {DAY})) * (7 * {DAY}) AS window_start, round(sum(value), 4) AS sum,
    least({START} + ((epoch_us(ts) - {START}) // (7 * {DAY}) + 1) * (7 * {DAY}), {END}) AS window_end FROM events WHERE {RANGE} GROUP BY ALL"""
)
def ts_downsample_by_series(t: Tables):
    return ts.downsample(points(t), START, END, 7 * DAY, "sum", "value", "us", ("series",)).withColumn("sum", F.round("sum", 4))


@query(
    """WITH w AS (SELECT user_id AS series, epoch_us(ts) // 3600000000 AS hour, event_id, value FROM events)
    SELECT series, hour, max(event_id) AS event_id FROM w GROUP BY series, hour"""
)
def ts_dedupe_last(t: Tables):
    p = points(t).select("series", F.floor(F.col("us") / 3_600_000_000).cast("long").alias("hour"), "event_id", "value")
    return ts.last_write(p.withColumn("seq", F.col("event_id")), "seq", ts="hour").select("series", "hour", "event_id")


@query("SELECT event_id FROM events e WHERE event_id % 7 <> 0")
def ts_tombstones(t: Tables):
    p = points(t).select("series", F.col("us").alias("ts"), "event_id")
    return ts.without(p, p.filter("event_id % 7 = 0")).select("event_id")


@query("SELECT epoch_us(ts) // 3600000000 AS bucket, (epoch_us(ts) // 3600000000) * 3600000000 AS bucket_start, count(*) AS points, count(DISTINCT user_id) AS series FROM events GROUP BY ALL")
def ts_bucket(t: Tables):
    b = points(t).withColumn("bucket", ts.bucket(F.col("us"), 3_600_000_000))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("points"), F.countDistinct("series").alias("series")).select("bucket", ts.bucket_start(F.col("bucket"), 3_600_000_000).alias("bucket_start"), "points", "series")


@query(f"SELECT event_id FROM events e JOIN (SELECT user_id, max(epoch_us(ts)) AS m FROM events GROUP BY 1) n USING (user_id) WHERE epoch_us(ts) >= m - 5 * {DAY}")
def ts_retention_age(t: Tables):
    return ts.keep_age(points(t), 5 * DAY, F.col("us")).select("event_id")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 3")
def ts_retention_points(t: Tables):
    return ts.keep_last(points(t), 3, ts="us").select("event_id")


@query(f"SELECT event_id FROM events WHERE epoch_us(ts) >= {END}")
def ts_retention_until(t: Tables):
    return ts.keep_since(points(t), END, "us").select("event_id")


@query(
    """SELECT event_id, CASE WHEN lag(us) OVER w IS NULL THEN us WHEN lag(us, 2) OVER w IS NULL THEN us - lag(us) OVER w
    ELSE us - 2 * lag(us) OVER w + lag(us, 2) OVER w END AS dod FROM (SELECT event_id, user_id, epoch_us(ts) AS us FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY us)"""
)
def ts_delta_of_delta(t: Tables):
    return ts.delta_of_delta(points(t), "us", ts="us").select("event_id", "dod")


@query("SELECT event_id, epoch_us(ts) AS us FROM events")
def ts_delta_of_delta_decode(t: Tables):
    coded = ts.delta_of_delta(points(t).withColumn("pos", F.col("us")), "us", ts="us").select("series", "pos", "event_id", "dod")
    return ts.undelta_of_delta(coded).select("event_id", F.col("value").cast("long").alias("us"))


@query(
    """SELECT event_id, d AS delta, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS zigzag
    FROM (SELECT event_id, v - coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY ts), 0) AS d FROM (SELECT event_id, user_id, ts, floor(value)::BIGINT AS v FROM events))"""
)
def ts_delta_zigzag(t: Tables):
    """Differences of values, of which about half are negative."""
    whole = points(t).withColumn("whole", F.floor("value").cast("long"))
    return ts.delta(whole, "whole", ts="us").select("event_id", "delta", zigzag(F.col("delta")).alias("zigzag"))


@query("SELECT event_id, event_id - 500 AS n, CASE WHEN event_id >= 500 THEN 2 * (event_id - 500) ELSE 2 * (500 - event_id) - 1 END AS coded, event_id - 500 AS back FROM events")
def ts_zigzag(t: Tables):
    n = t.events.select("event_id", (F.col("event_id") - 500).alias("n")).withColumn("coded", zigzag(F.col("n")))
    return n.withColumn("back", unzigzag(F.col("coded")))


@query("SELECT event_id, value FROM events")
def ts_xor_round_trip(t: Tables):
    p = points(t).select("series", "us", "value", "event_id")
    back = ts.unxor_bits(ts.xor_bits(p, ts="us"), ts="us")
    return back.join(p.select("series", "us", "event_id"), ["series", "us"]).select("event_id", "value")


_TEXT = """CASE event_id % 5 WHEN 0 THEN n WHEN 1 THEN 'temperature:' || n WHEN 2 THEN '{"value": ' || n || '}' WHEN 3 THEN 'not-a-number' ELSE '{"value":"x","avg":' || n || '}' END"""


@query(f"SELECT count(*) AS points, count(DISTINCT user_id) AS series, sum(strlen({_TEXT}))::BIGINT AS bytes FROM (SELECT *, floor(value)::BIGINT::VARCHAR AS n FROM events)")
def ts_stats(t: Tables):
    return ts.stats(points(t), value="text")


@query(f"SELECT event_id, value FROM events WHERE user_id = 13 AND epoch_us(ts) = (SELECT min(epoch_us(ts)) FROM events WHERE user_id = 13 AND epoch_us(ts) >= {START})")
def ts_get(t: Tables):
    p = points(t)
    at = p.filter((F.col("series") == 13) & (F.col("us") >= START)).agg(F.min("us").alias("m")).scalar()
    return ts.get(p, at, 13, ts="us").select("event_id", "value")


@query("SELECT user_id AS series, epoch_us(ts) // 3600000000 AS bucket, count(*) AS points FROM events GROUP BY ALL")
def ts_bucket_points(t: Tables):
    return ts.bucket_points(points(t), 3_600_000_000, ts="us")


@query(f"SELECT event_id, {PARSED} AS number FROM events")
def fn_parse_numeric(t: Tables):
    return points(t).select("event_id", parse_numeric(F.col("text")).alias("number"))
