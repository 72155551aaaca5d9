"""Relational queries, data checks, catalog listings and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone.operators import bands, maintenance
from loomstone.plans.registry import Tables, query
from loomstone.sources import catalog, shared
from loomstone.sources.tables import micros
from loomstone.streaming import windows

Q1 = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""


@query(Q1)
def rel_aggregate(t: Tables):
    li = t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n")
    )


@query("SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def rel_inner_join(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def rel_left_join(t: Tables):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def rel_semi_join(t: Tables):
    return t.customer.join(t.orders.filter("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000 AND o_orderstatus = 'F')")
def rel_anti_join(t: Tables):
    large = t.orders.filter("o_totalprice > 300000 AND o_orderstatus = 'F'")
    return t.customer.join(large, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT n_name, s_name FROM nation FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 9000) s ON n_nationkey = s_nationkey")
def rel_full_join(t: Tables):
    return t.nation.join(t.supplier.filter("s_acctbal > 9000"), F.col("n_nationkey") == F.col("s_nationkey"), "full").select("n_name", "s_name")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rel_rollup(t: Tables):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rel_cube(t: Tables):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def rel_grouping_sets(t: Tables):
    s, q = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.groupingSets([[s], [q]], s, q).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, rank() OVER w AS rnk, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)")
def rel_window(t: Tables):
    w = Window.partitionBy("o_custkey")
    running = F.sum("o_totalprice").over(w.orderBy("o_orderkey").rowsBetween(-2, 0))
    return t.orders.select("o_orderkey", F.rank().over(w.orderBy(F.desc("o_totalprice"))).cast("long").alias("rnk"), F.round(running, 2).alias("running"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def rel_set_operations(t: Tables):
    both = t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))
    return both.subtract(t.nation.filter("n_regionkey = 0").select("n_nationkey"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def rel_distinct(t: Tables):
    return t.lineitem.agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def rel_top_k(t: Tables):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY event_type")
def rel_json(t: Tables):
    return t.events.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))


@query("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, upper(substr(min(o_orderpriority), 1, 3)) AS p FROM orders GROUP BY ALL")
def rel_dates_strings(t: Tables):
    return t.orders.groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.upper(F.substring(F.min("o_orderpriority"), 1, 3)).alias("p"))


@query("SELECT p.p_partkey, count(*) AS cheaper FROM part p JOIN part q ON q.p_brand = p.p_brand AND q.p_retailprice BETWEEN p.p_retailprice - 20 AND p.p_retailprice - 10 GROUP BY p.p_partkey")
def rel_range_join(t: Tables):
    """A band join that only counts: places in the order of prices give the counts, no pairs are made."""
    price = F.col("p_retailprice")
    a = t.part.select("p_partkey", F.col("p_brand").alias("by"), (price - 20).alias("low"), (price - 10).alias("high"))
    return bands.counts(a, t.part.select(F.col("p_brand").alias("by"), price.alias("value")), "p_partkey").withColumnRenamed("n", "cheaper")


# checks and statistics

@query("SELECT 'lineitem.l_suppkey' AS reference, count(*) AS rows, count(*) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) AS missing FROM lineitem UNION ALL SELECT 'orders.o_custkey', count(*), count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM orders")
def verify_fk(t: Tables):
    return maintenance.references("lineitem.l_suppkey", t.lineitem, "l_suppkey", t.supplier, "s_suppkey").unionByName(maintenance.references("orders.o_custkey", t.orders, "o_custkey", t.customer, "c_custkey"))


@query("SELECT 'orders.o_orderkey' AS name, count(*) AS rows, count(*) - count(o_orderkey) AS nulls, count(*) - count(DISTINCT o_orderkey) AS repeats FROM orders UNION ALL SELECT 'lineitem.l_orderkey', count(*), count(*) - count(l_orderkey), count(*) - count(DISTINCT l_orderkey) FROM lineitem")
def verify_keys(t: Tables):
    return maintenance.keys("orders.o_orderkey", t.orders, "o_orderkey").unionByName(maintenance.keys("lineitem.l_orderkey", t.lineitem, "l_orderkey"))


@query("SELECT floor(o_totalprice / 50000)::BIGINT AS bin, count(*) AS n, round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high FROM orders GROUP BY 1")
def stats_histogram(t: Tables):
    return maintenance.histogram(t.orders, "o_totalprice", 50_000.0)


_EVERY = ", ".join(f"('{c}')" for c in sorted({c for v in catalog.CAPABILITIES.values() for c in v}))
_HAVE = ", ".join(f"('{k}', '{c}')" for k, v in catalog.CAPABILITIES.items() for c in v)


@query(f"WITH have(kind, capability) AS (VALUES {_HAVE}), every(capability) AS (VALUES {_EVERY}) SELECT k.kind, every.capability, (k.kind, every.capability) IN (SELECT (kind, capability) FROM have) AS supported FROM (SELECT DISTINCT kind FROM have) k, every")
def capabilities(t: Tables):
    return catalog.capabilities(t.spark)


@query("SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean FROM orders")
def stats_distribution(t: Tables):
    return maintenance.distribution(t.orders, "o_totalprice").select("n", "low", "high", F.round("mean", 4).alias("mean"))


@query("SELECT o_custkey, o_total, n FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS o_total, count(*) AS n FROM orders GROUP BY o_custkey) WHERE o_total > (SELECT 2 * avg(s) FROM (SELECT sum(o_totalprice) AS s FROM orders GROUP BY o_custkey))")
def rel_subquery(t: Tables):
    """A scalar subquery over an aggregate, by a view that only this session sees."""
    each = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    twice = each.agg((2 * F.avg("s")).alias("m")).scalar()
    return each.filter(F.round("s", 2) > twice).select("o_custkey", F.round("s", 2).alias("o_total"), "n")


# streams

LATE = "400 days"  # batches of files come in any order here, so no event may be too late


def _stream(t: Tables):
    log = windows.read_log(t.spark, t.folder, t.events.schema, "events.parquet")
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


def _paths(t: Tables, name: str) -> tuple[str, str]:
    at = shared.fresh(t.spark, name)
    return f"{at}/out", f"{at}/state"


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(t: Tables):
    """The same windows as a batch gives, from a file stream that ends: every changed window is written, the last row of each counts."""
    stream = windows.tumbling(_stream(t), "1 day", LATE, by=("event_type",))
    out = windows.run_updates(stream, *_paths(t, "tumbling"), ("window_start", "event_type"))
    return out.select(micros("window_start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """SELECT epoch_us(d) - k * 43200000000 AS start_us, count(*) AS n, round(sum(value), 4) AS total
    FROM (SELECT time_bucket(INTERVAL 12 HOUR, ts) AS d, value FROM events), (VALUES (0), (1)) s(k) GROUP BY ALL"""
)
def stream_sliding(t: Tables):
    out = windows.run_updates(windows.sliding(_stream(t), "1 day", "12 hours", LATE), *_paths(t, "sliding"), ("window_start", "window_end"))
    return out.select(micros("window_start").alias("start_us"), "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(t: Tables):
    out = windows.run_complete(windows.sessions(_stream(t), "6 hours", LATE, "user_id"), *_paths(t, "sessions"))
    return out.select("user_id", micros("session_start").alias("start_us"), micros("session_end").alias("end_us"), "n")


@query("SELECT event_type, user_id FROM events GROUP BY ALL")
def stream_distinct(t: Tables):
    """Each pair of type and user once, however often it comes."""
    seen = _stream(t).select("event_type", "user_id", "ts", F.concat_ws("/", "event_type", "user_id").alias("pair"))
    out, state = _paths(t, "distinct")
    windows.run_to(windows.distinct_events(seen, "pair", LATE), out, state)
    return t.spark.read.parquet(out).select("event_type", "user_id")


@query("SELECT user_id, max(epoch_us(ts)) AS last_us, round(arg_max(value, ts), 6) AS last_value FROM events GROUP BY user_id")
def stream_last_value(t: Tables):
    """The newest point of each user, kept as state by a function of our own."""
    out = windows.run_updates(windows.running_last(_stream(t), "user_id"), *_paths(t, "last"), ("user_id",))
    return out.select("user_id", "last_us", F.round("last_value", 6).alias("last_value"))
