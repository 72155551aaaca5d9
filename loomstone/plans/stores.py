"""Key-value, index, membership, version and log queries over `orders` and `customer`."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions.checksums import digest, intact
from loomstone.operators import kv, maintenance, mvcc
from loomstone.operators.graph import on_cycles
from loomstone.operators.membership import Bloom, Composite, Member, expected_fpr, hashes_for
from loomstone.plans.predicates import compile_predicate, p
from loomstone.plans.registry import Tables, query
from loomstone.sources import append_log


def rows(t: Tables):
    """(key, value): zero-padded order keys, so that text order is number order."""
    return t.orders.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key"), F.col("o_orderpriority").alias("value"))


def keyed(t: Tables):
    return t.orders.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("k"))


KV = "SELECT lpad(o_orderkey::varchar, 12, '0') AS key, o_orderpriority AS value, o_orderkey AS k FROM orders"
WITH = f"WITH kv AS ({KV})"
A, B = "000000000500", "000000000900"


@query(f"{WITH} SELECT key, value FROM kv")
def kv_scan_full(t: Tables):
    return kv.scan(rows(t))


@query(f"{WITH} SELECT key, value FROM kv WHERE key LIKE '0000000001%'")
def kv_scan_prefix(t: Tables):
    return kv.scan(kv.prefix(rows(t), "0000000001"))


@query(f"{WITH} SELECT key, value FROM kv WHERE key >= '{A}' AND key < '{B}'")
def kv_scan_range(t: Tables):
    return kv.scan(kv.between(rows(t), A, B))


@query(f"{WITH} SELECT key, value FROM kv WHERE key > '{A}' AND key <= '{B}'")
def kv_scan_range_open_closed(t: Tables):
    return kv.scan(kv.between(rows(t), A, B, low_open=True, high_open=False))


@query(f"{WITH} SELECT key, value FROM kv WHERE key >= '{B}'")
def kv_scan_unbounded(t: Tables):
    return kv.scan(kv.between(rows(t), low=B))


@query(f"{WITH} SELECT key, value FROM kv")
def kv_scan_reverse(t: Tables):
    return kv.scan(rows(t), reverse=True)


@query(f"{WITH} SELECT key, value FROM kv ORDER BY key DESC LIMIT 50")
def kv_last_entries(t: Tables):
    return kv.scan(rows(t), reverse=True, first=50)


@query(f"{WITH} (SELECT 'first' AS place, key, value FROM kv ORDER BY key LIMIT 1) UNION ALL (SELECT 'last', key, value FROM kv ORDER BY key DESC LIMIT 1)")
def kv_first_last(t: Tables):
    one, two = kv.scan(rows(t), first=1), kv.scan(rows(t), reverse=True, first=1)
    return one.select(F.lit("first").alias("place"), "key", "value").unionByName(two.select(F.lit("last").alias("place"), "key", "value"))


@query(f"{WITH} SELECT key, value FROM kv WHERE key >= '0000000005x' ORDER BY key LIMIT 1")
def kv_seek(t: Tables):
    return kv.seek(rows(t), "0000000005x")


@query(f"{WITH} SELECT key, value FROM kv WHERE key <= '0000000005x' ORDER BY key DESC LIMIT 1")
def kv_floor(t: Tables):
    return kv.seek_back(rows(t), "0000000005x")


@query(f"{WITH} SELECT key, value FROM kv WHERE key = '{A}'")
def kv_get(t: Tables):
    return kv.get(rows(t), A)


def _asked(t: Tables):
    """The keys of all lines' orders, and one that no table holds."""
    return t.lineitem.select(F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("key")).distinct().unionByName(t.spark.sql("SELECT 'absent' AS key"))


ASKED = "asked AS (SELECT DISTINCT lpad(l_orderkey::varchar, 12, '0') AS key FROM lineitem UNION ALL SELECT 'absent')"


@query(f"{WITH}, {ASKED} SELECT key, value FROM asked LEFT JOIN kv USING (key)")
def kv_batch_get(t: Tables):
    return kv.batch_get(_asked(t), rows(t))


@query(f"{WITH}, {ASKED} SELECT key, key IN (SELECT key FROM kv) AS found FROM asked")
def kv_contains(t: Tables):
    return kv.contains(_asked(t), rows(t))


def _changes(t: Tables):
    """Every 5th order with another value, half of them under keys that do not exist."""
    some = keyed(t).filter("k % 5 = 0")
    return some.select(F.when(F.col("k") % 2 == 0, F.col("key")).otherwise(F.concat(F.lit("n"), "key")).alias("key"), F.concat(F.lit("new-"), "value").alias("value"))


CHANGES = "changes AS (SELECT CASE WHEN k % 2 = 0 THEN key ELSE 'n' || key END AS key, 'new-' || value AS value FROM kv WHERE k % 5 = 0)"


@query(f"{WITH}, {CHANGES} SELECT key, value FROM changes WHERE key IN (SELECT key FROM kv)")
def kv_insert_conflicts(t: Tables):
    return kv.insert_conflicts(rows(t), _changes(t))


@query(f"{WITH}, {CHANGES} SELECT key, value FROM kv UNION ALL SELECT key, value FROM changes WHERE key NOT IN (SELECT key FROM kv)")
def kv_insert(t: Tables):
    return kv.insert(rows(t), _changes(t))


@query(f"{WITH}, {CHANGES} SELECT key, value FROM changes WHERE key NOT IN (SELECT key FROM kv)")
def kv_update_misses(t: Tables):
    return kv.update_misses(rows(t), _changes(t))


@query(f"{WITH}, {CHANGES} SELECT coalesce(c.key, kv.key) AS key, coalesce(c.value, kv.value) AS value, CASE WHEN c.key IS NOT NULL THEN kv.key IS NOT NULL END AS updated FROM kv FULL JOIN changes c ON kv.key = c.key")
def kv_upsert(t: Tables):
    return kv.upsert(rows(t), _changes(t))


@query(f"{WITH} SELECT key, value FROM kv WHERE k % 3 <> 0")
def kv_delete(t: Tables):
    return kv.delete(rows(t), keyed(t).filter("k % 3 = 0"))


@query(f"{WITH} SELECT key, value FROM kv WHERE NOT (key >= '{A}' AND key < '{B}')")
def kv_range_delete(t: Tables):
    return kv.range_delete(rows(t), A, B)


@query(f"{WITH} SELECT count(*) AS deleted FROM kv WHERE key > '{A}' AND key <= '{B}'")
def kv_range_count(t: Tables):
    return kv.range_count(rows(t), A, B, low_open=True, high_open=False)


def _ops(t: Tables):
    """Puts, then deletes of some of them, then puts again of a few; merges do nothing."""
    k = keyed(t)
    part = lambda cond, op, seq, value: k.filter(cond).select("key", F.lit(op).alias("op"), (F.col("k") + F.lit(seq)).alias("seq"), value.alias("value"))
    none = F.lit(None).cast("string")
    return part("k % 4 = 0", "put", 0, F.lit("v1")).unionByName(part("k % 8 = 0", "delete", 10**9, none)).unionByName(part("k % 16 = 0", "put", 2 * 10**9, F.lit("v2"))).unionByName(part("k % 9 = 0", "merge", 3 * 10**9, F.lit("m")))


@query(
    f"""{WITH} SELECT key, CASE WHEN k % 16 = 0 THEN 'v2' WHEN k % 4 = 0 THEN 'v1' ELSE value END AS value FROM kv
    WHERE (k % 8 <> 0 OR k % 16 = 0) AND NOT (key >= '{A}' AND key < '{B}' AND k % 16 <> 0)"""
)
def kv_batch_apply(t: Tables):
    """All operations, and a range delete after the deletes and before the last puts."""
    return kv.apply_batch(rows(t), _ops(t).unionByName(t.spark.sql(f"SELECT '{A}' AS key, 'range_delete' AS op, 1500000000L AS seq, '{B}' AS value")))


@query(
    f"""{WITH} SELECT count(*) FILTER (k % 4 = 0) + count(*) FILTER (k % 8 = 0) + count(*) FILTER (k % 16 = 0) + count(*) FILTER (k % 9 = 0) AS attempted,
    count(*) FILTER (k % 4 = 0) + count(*) FILTER (k % 8 = 0) + count(*) FILTER (k % 16 = 0) AS applied, count(*) FILTER (k % 8 = 0) AS deleted,
    (14 * (count(*) FILTER (k % 4 = 0) + count(*) FILTER (k % 16 = 0)))::BIGINT AS bytes_written FROM kv"""
)
def kv_batch_report(t: Tables):
    return kv.batch_report(_ops(t))


@query(
    f"""{WITH} SELECT key, CASE WHEN k % 10 = 0 THEN 'run3' WHEN k % 3 = 0 THEN 'run2' ELSE value END AS value FROM kv WHERE NOT (k % 10 = 0 AND k % 20 = 0)"""
)
def lsm_merge(t: Tables):
    k = keyed(t)
    base = k.select("key", "value", F.lit(False).alias("is_deleted"))
    second = k.filter("k % 3 = 0").select("key", F.lit("run2").alias("value"), F.lit(False).alias("is_deleted"))
    third = k.filter("k % 10 = 0").select("key", F.lit("run3").alias("value"), (F.col("k") % 20 == 0).alias("is_deleted"))
    return kv.merge_runs([third, second, base])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment || ':' || lpad(c_custkey::varchar, 10, '0') >= 'BUILDING:' AND c_mktsegment || ':' || lpad(c_custkey::varchar, 10, '0') < 'BUILDING:0000000800'")
def idx_composite_key(t: Tables):
    entry = F.concat("c_mktsegment", F.lit(":"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    c = t.customer
    return kv.index_lookup(kv.index_of(c, entry, "c_custkey"), c, "c_custkey", "BUILDING:", "BUILDING:0000000800").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def idx_secondary_lookup(t: Tables):
    index = kv.index_of(t.customer, F.col("c_mktsegment"), "c_custkey")
    hit = kv.get(index, "MACHINERY", "index_key").select(F.col("primary_key").alias("o_custkey"))
    return t.orders.join(hit, "o_custkey").select("o_orderkey", "o_totalprice")


@query(f"{WITH} SELECT key AS index_key, value AS primary_key FROM kv WHERE key >= '{A}' AND key < '{B}'")
def idx_scan(t: Tables):
    return kv.scan(kv.between(kv.index_of(rows(t), F.col("key"), "value"), A, B, key="index_key"), key="index_key")


@query(
    f"""{WITH} SELECT count(*) AS rows, min(strlen(key)) AS min_key_bytes, max(strlen(key)) AS max_key_bytes, round(avg(strlen(key)), 6) AS avg_key_bytes, min(strlen(value)) AS min_value_bytes,
    max(strlen(value)) AS max_value_bytes, round(avg(strlen(value)), 6) AS avg_value_bytes, sum(strlen(key) + strlen(value))::BIGINT AS total_bytes FROM kv"""
)
def stats_table(t: Tables):
    return kv.statistics(rows(t))


# predicates

_LINE = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "
_PREDICATES = {
    "eq": (p("eq", "l_returnflag", "R"), "l_returnflag = 'R'"),
    "range": (p("range", "l_quantity", 10.0, 20.0, True, False), "l_quantity >= 10 AND l_quantity < 20"),
    "range_open": (p("range", "l_quantity", None, 5.0, True, True), "l_quantity <= 5"),
    "prefix": (p("prefix", "l_linestatus", "O"), "l_linestatus LIKE 'O%'"),
    "in": (p("in", "l_linenumber", (1, 3)), "l_linenumber IN (1, 3)"),
    "between": (p("between", "l_discount", 0.02, 0.04), "l_discount BETWEEN 0.02::DOUBLE AND 0.04::DOUBLE"),
    "and": (p("and", p("eq", "l_returnflag", "A"), p("range", "l_quantity", 40.0, None, True, True)), "l_returnflag = 'A' AND l_quantity >= 40"),
    "or": (p("or", p("eq", "l_linenumber", 7), p("eq", "l_quantity", 1.0)), "l_linenumber = 7 OR l_quantity = 1"),
    "not": (p("not", p("eq", "l_returnflag", "N")), "NOT l_returnflag = 'N'"),
}
for _name, (_p, _where) in _PREDICATES.items():

    @query(_LINE + _where, name=f"pred_{_name}")
    def _predicate(t: Tables, x=_p):
        return t.lineitem.filter(compile_predicate(x)).select("l_orderkey", "l_linenumber", "l_quantity")


_NOTED = "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END AS note FROM lineitem) WHERE "
for _name in ("is_null", "is_not_null"):

    @query(_NOTED + f"note {_name.upper().replace('_', ' ')}", name=f"pred_{_name}")
    def _predicate_of_null(t: Tables, op=_name):
        noted = t.lineitem.withColumn("note", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")))
        return noted.filter(compile_predicate(p(op, "note"))).select("l_orderkey", "l_linenumber", "l_quantity")


_TOKEN = "list_contains(list_transform(string_split_regex(trim(text), '\\s+'), lambda w: lower(regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g'))), 'licensed')"


@query(f"SELECT doc_id FROM documents WHERE {_TOKEN}")
def pred_text(t: Tables):
    return t.documents.filter(compile_predicate(p("text", "text", "licensed"))).select("doc_id")


@query("SELECT vec_id FROM embeddings WHERE list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) <= 10.5")
def pred_knn(t: Tables):
    q = t.embeddings.filter("vec_id = 0").first()["embedding"]
    return t.embeddings.filter(compile_predicate(p("knn", "embedding", q, "euclidean", 10.5))).select("vec_id")


# membership

@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def bloom_membership(t: Tables):
    """What the filter lets through is checked exactly, so the result has no false positives."""
    members = t.customer.filter("c_custkey % 3 = 0")
    bloom = Bloom.build(members, "c_custkey", 20_000)
    maybe = bloom.probe(t.orders, "o_custkey").filter("maybe")
    return maybe.join(members, maybe["o_custkey"] == members["c_custkey"], "left_semi").select("o_orderkey")


@query("SELECT count(*) AS members, 0::BIGINT AS missed FROM customer WHERE c_custkey % 3 = 0")
def bloom_no_false_negatives(t: Tables):
    members = t.customer.filter("c_custkey % 3 = 0")
    return Bloom.build(members, "c_custkey", 20_000).probe(members, "c_custkey").agg(F.count(F.lit(1)).alias("members"), F.count_if(~F.col("maybe")).alias("missed"))


@query("SELECT n, round(CASE WHEN n = 0 THEN 0 ELSE power(1 - exp(-7 * n / 10000.0::DOUBLE), 7) END, 9) AS fpr FROM (SELECT range * 100 AS n FROM range(0, 21))")
def bloom_fpr(t: Tables):
    n = t.spark.range(0, 21).select((F.col("id") * 100).alias("n"))
    return n.select("n", F.round(expected_fpr(F.col("n"), F.lit(10_000.0), F.lit(hashes_for(10))), 9).alias("fpr"))


def _composite(t: Tables) -> tuple[Composite, object]:
    primary = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    buyers = Member.of(t.orders.select(F.col("o_custkey").alias("key")).distinct(), 100_000)
    rich = Member.of(t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("key")), 100_000)
    keys = t.customer.select(F.col("c_custkey").alias("key")).unionByName(t.customer.select((F.col("c_custkey") + 10**9).alias("key")))
    return Composite(primary, before=[buyers], after=[rich]), keys


_BUYS, _RICH = "key IN (SELECT o_custkey FROM orders)", "key IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"
_KEYS = "WITH asked AS (SELECT c_custkey AS key FROM customer UNION ALL SELECT c_custkey + 1000000000 FROM customer)"


@query(f"{_KEYS} SELECT key, c_name AS value FROM asked JOIN customer ON c_custkey = key WHERE {_BUYS}")
def composite_bloom_first(t: Tables):
    c, keys = _composite(t)
    return c.bloom_first(keys)


@query(f"{_KEYS} SELECT key, c_name AS value FROM asked JOIN customer ON c_custkey = key WHERE {_RICH}")
def composite_primary_first(t: Tables):
    c, keys = _composite(t)
    return c.primary_first(keys)


@query(f"{_KEYS} SELECT key, c_name AS value, 3 AS tables_consulted FROM asked JOIN customer ON c_custkey = key WHERE {_BUYS} AND {_RICH}")
def composite_parallel(t: Tables):
    c, keys = _composite(t)
    return c.parallel(keys)


@query(f"{_KEYS} SELECT key, c_name AS value FROM asked LEFT JOIN customer ON c_custkey = key")
def composite_sequential(t: Tables):
    c, keys = _composite(t)
    return c.sequential(keys)


@query(f"{_KEYS} SELECT key, {_BUYS} AS maybe FROM asked")
def composite_might_contain(t: Tables):
    c, keys = _composite(t)
    return c.might_contain(keys)


@query(f"{_KEYS} SELECT key, {_BUYS} AND key IN (SELECT c_custkey FROM customer) AS found, NOT {_BUYS} AS pre_filtered, CASE WHEN {_BUYS} THEN 2 ELSE 1 END AS tables_consulted FROM asked")
def composite_trace(t: Tables):
    c, keys = _composite(t)
    return c.trace(keys)


# versions

def change_log(t: Tables):
    """Up to three versions of each order key; some uncommitted, some tombstones."""
    each = t.orders.select("o_orderkey", F.explode(F.lit([1, 2, 3])).alias("i")).filter("o_orderkey % i = 0")
    k, i = F.col("o_orderkey"), F.col("i")
    return each.select(
        k.cast("string").alias("key"), F.concat(F.lit("v"), i.cast("string")).alias("value"), ((k + i) % 17 == 0).alias("is_deleted"), ((k * 3 + i) % 50).alias("txn_id"),
        F.when((k + i) % 11 != 0, (k * 7 + i * 13) % 1000 + 1).alias("commit_lsn"), i.cast("long").alias("seq"),
    )


LOG = """log AS (SELECT o_orderkey::varchar AS key, 'v' || i AS value, (o_orderkey + i) % 17 = 0 AS is_deleted, (o_orderkey * 3 + i) % 50 AS txn_id,
  CASE WHEN (o_orderkey + i) % 11 <> 0 THEN (o_orderkey * 7 + i * 13) % 1000 + 1 END AS commit_lsn, i AS seq
  FROM orders, (VALUES (1::BIGINT), (2), (3)) v(i) WHERE o_orderkey % i = 0)"""


def _at(cond: str) -> str:
    return f"WITH {LOG} SELECT key, value FROM (SELECT * FROM log WHERE {cond} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT is_deleted"


@query(_at("commit_lsn <= 600"))
def mvcc_visible_at(t: Tables):
    return mvcc.visible(change_log(t), 600).select("key", "value")


@query(_at("commit_lsn <= 600 AND txn_id NOT IN (3, 7, 11)"))
def mvcc_active_excluded(t: Tables):
    return mvcc.visible(change_log(t), 600, active=(3, 7, 11)).select("key", "value")


@query(_at("commit_lsn <= 300 OR txn_id = 7"))
def mvcc_read_own_writes(t: Tables):
    return mvcc.visible(change_log(t), 300, own=7).select("key", "value")


@query(f"WITH {LOG} SELECT key, seq, commit_lsn, lead(commit_lsn) OVER (PARTITION BY key ORDER BY seq) AS replaced_lsn FROM log WHERE commit_lsn IS NOT NULL")
def mvcc_history(t: Tables):
    return mvcc.history(change_log(t)).select("key", "seq", "commit_lsn", "replaced_lsn")


@query(f"WITH {LOG}, old AS (SELECT key, max(seq) AS m FROM log WHERE commit_lsn < 500 GROUP BY key) SELECT key, seq FROM log LEFT JOIN old USING (key) WHERE commit_lsn IS NULL OR commit_lsn >= 500 OR seq = m")
def mvcc_vacuum(t: Tables):
    return mvcc.vacuum(change_log(t), 500).select("key", "seq")


@query(f"WITH {LOG} SELECT key, seq, CASE WHEN txn_id = 7 AND commit_lsn IS NULL THEN 2000 ELSE commit_lsn END AS commit_lsn FROM log")
def mvcc_commit(t: Tables):
    return mvcc.commit(change_log(t), 7, 2000).select("key", "seq", "commit_lsn")


@query(f"WITH {LOG} SELECT key, seq FROM log WHERE NOT (txn_id = 7 AND commit_lsn IS NULL)")
def mvcc_rollback(t: Tables):
    return mvcc.rollback(change_log(t), 7).select("key", "seq")


def _locks(t: Tables):
    """Orders as transactions on rows of two tables, each of which begins a little after the one before it on its row."""
    k = F.col("o_orderkey")
    start = F.call_function("div", k, F.lit(100)) * 20 + k % 7
    return t.orders.select((k % 2).alias("table_id"), (k % 100).alias("key"), k.alias("txn_id"), start.alias("start"), (start + 5 + k % 61).alias("finish"))


@query(
    """WITH l AS (SELECT o_orderkey % 2 AS table_id, o_orderkey % 100 AS key, o_orderkey AS txn_id, (o_orderkey // 100) * 20 + o_orderkey % 7 AS start, (o_orderkey // 100) * 20 + o_orderkey % 7 + 5 + o_orderkey % 61 AS finish FROM orders)
    SELECT a.table_id, a.key, arg_max(b.txn_id, struct_pack(f := b.finish, t := b.txn_id)) AS holder, a.txn_id AS loser
    FROM l a JOIN l b ON a.table_id = b.table_id AND a.key = b.key AND (b.start < a.start OR b.start = a.start AND b.txn_id < a.txn_id) AND b.finish > a.start GROUP BY ALL"""
)
def txn_write_conflicts(t: Tables):
    return mvcc.write_conflicts(_locks(t))


@query(
    f"""WITH {LOG}, r AS (SELECT key, txn_id, 200 AS begin_lsn, 200 + txn_id * 10 AS end_lsn FROM log WHERE seq = 1), w AS (SELECT * FROM log WHERE seq > 1 AND commit_lsn IS NOT NULL)
    SELECT r.txn_id, r.key, w.txn_id AS writer FROM r JOIN w ON r.key = w.key AND r.txn_id <> w.txn_id AND w.commit_lsn > r.begin_lsn AND w.commit_lsn <= r.end_lsn"""
)
def txn_rw_conflicts(t: Tables):
    log = change_log(t)
    reads = log.filter("seq = 1").select("key", "txn_id", F.lit(200).alias("begin_lsn"), (200 + F.col("txn_id") * 10).alias("end_lsn"))
    return mvcc.read_conflicts(reads, log.filter("seq > 1 AND commit_lsn IS NOT NULL").select("key", "txn_id", "commit_lsn"))


@query(
    """WITH RECURSIVE e AS (SELECT s_suppkey AS src, CASE WHEN s_suppkey % 5 < 4 THEN s_suppkey + 1 WHEN (s_suppkey // 5) % 2 = 0 THEN s_suppkey - 4 ELSE s_suppkey + 1 END AS dst FROM supplier),
    r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src AS vertex FROM r WHERE src = dst"""
)
def txn_deadlock_cycles(t: Tables):
    """Suppliers who wait for the next one, in blocks of five; the last of every other block waits for its first."""
    k = F.col("s_suppkey")
    back = F.when(F.call_function("div", k, F.lit(5)) % 2 == 0, k - 4).otherwise(k + 1)
    return on_cycles(t.supplier.select(k.alias("src"), F.when(k % 5 < 4, k + 1).otherwise(back).alias("dst")))


def _wal(t: Tables):
    """begin, write and commit or rollback records; every seventh transaction has no end."""
    k = F.col("o_orderkey")
    base = t.orders.select((k * 10).alias("lsn"), k.alias("txn_id"), F.lit("begin").alias("kind"), F.lit(None).cast("string").alias("key"))
    write = t.orders.select((k * 10 + 1).alias("lsn"), k.alias("txn_id"), F.lit("write").alias("kind"), (k % 100).cast("string").alias("key"))
    end = t.orders.filter("o_orderkey % 7 <> 0").select((k * 10 + 2).alias("lsn"), k.alias("txn_id"), F.when(k % 5 == 0, "rollback").otherwise("commit").alias("kind"), F.lit(None).cast("string").alias("key"))
    return base.unionByName(write).unionByName(end)


@query("SELECT o_orderkey * 10 + 1 AS lsn, o_orderkey AS txn_id, (o_orderkey % 100)::varchar AS key FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0")
def wal_replay(t: Tables):
    return mvcc.replay(_wal(t)).select("lsn", "txn_id", "key")


@query("SELECT o_orderkey AS txn_id FROM orders WHERE o_orderkey % 7 = 0")
def wal_active_txns(t: Tables):
    return mvcc.still_active(_wal(t))


@query("SELECT count(*) AS n, min(o_orderkey) AS first_txn FROM orders WHERE o_orderkey * 10 >= 5000")
def wal_seek(t: Tables):
    return mvcc.from_lsn(_wal(t), 5000).filter("kind = 'begin'").agg(F.count(F.lit(1)).alias("n"), F.min("txn_id").alias("first_txn"))


# append logs

def _entries(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select((k % 3000).cast("string").alias("key"), F.when(k % 13 != 0, F.col("o_orderpriority")).alias("value"), k.alias("seq"))


@query("SELECT o_orderkey AS seq FROM orders WHERE o_orderkey // 1000 >= (SELECT min(s) FROM (SELECT DISTINCT o_orderkey // 1000 AS s FROM orders ORDER BY 1 DESC LIMIT 4))")
def log_retention_segments(t: Tables):
    return append_log.keep_segments(append_log.segments(_entries(t), 1000), 3).select("seq")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def log_retention_age(t: Tables):
    return append_log.keep_age(t.orders, F.lit("1996-01-01").cast("timestamp_ntz"), "o_orderdate").select("o_orderkey")


@query("SELECT (o_orderkey % 3000)::varchar AS key, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY 1 HAVING max(o_orderkey) % 13 <> 0")
def log_state(t: Tables):
    return append_log.state(_entries(t))


@query(f"WITH {LOG} SELECT 'repeated seq' AS problem, count(*) AS n FROM (SELECT key, seq FROM log GROUP BY key, seq HAVING count(*) > 1) UNION ALL SELECT 'no seq', 0 UNION ALL SELECT 'no transaction', 0")
def verify_log(t: Tables):
    return mvcc.verify(change_log(t))


@query("SELECT (o_orderkey % 3000)::varchar AS key, arg_max(o_orderpriority, o_orderkey) AS value FROM orders WHERE o_orderkey <= 9000 GROUP BY 1 HAVING max(o_orderkey) % 13 <> 0")
def log_state_at(t: Tables):
    return append_log.state_at(_entries(t), 9000)


@query("SELECT c_custkey, c_custkey % 3 = 0 AND c_custkey % 6 <> 0 AS held FROM customer")
def bloom_rollback(t: Tables):
    """Keys that were inserted and taken back are not held, though their bits are set."""
    members = t.customer.filter("c_custkey % 3 = 0")
    bloom = Bloom.build(members, "c_custkey", 20_000).roll_back(t.customer.filter("c_custkey % 6 = 0"), "c_custkey")
    held = members.select(F.col("c_custkey").alias("_m"))
    asked = bloom.probe(t.customer.select("c_custkey"), "c_custkey", "held")
    # what the filter lets through by chance is settled by the members
    return asked.join(held, asked["c_custkey"] == held["_m"], "left").select("c_custkey", (F.col("held") & F.col("_m").isNotNull()).alias("held"))


@query("SELECT 'outside' AS problem, 0::BIGINT AS n UNION ALL SELECT 'repeated', 0 UNION ALL SELECT 'bare', 0")
def bloom_verify(t: Tables):
    return Bloom.build(t.customer, "c_custkey", 20_000).verify()


@query(
    """SELECT lpad(o_orderkey::varchar, 12, '0') AS key, CASE WHEN o_orderkey % 10 <> 0 THEN 'nothing' WHEN o_orderkey % 20 = 0 THEN 'tombstone' ELSE 'value' END AS said FROM orders"""
)
def lsm_run_holds(t: Tables):
    k = keyed(t)
    return kv.run_holds(k.select("key"), k.filter("k % 10 = 0").select("key", "value", (F.col("k") % 20 == 0).alias("is_deleted")))


@query("SELECT o_orderkey // 1000 AS file FROM orders GROUP BY 1 HAVING max(o_orderkey) >= 2500 AND min(o_orderkey) <= 7200")
def lsm_overlapping_files(t: Tables):
    files = t.orders.groupBy(F.call_function("div", F.col("o_orderkey"), F.lit(1000)).alias("file")).agg(F.min("o_orderkey").alias("min_key"), F.max("o_orderkey").alias("max_key"))
    return kv.overlapping(files, 2500, 7200).select("file")


@query("SELECT 'dangling' AS problem, count(*) FILTER (c_custkey % 11 = 0) AS n FROM customer UNION ALL SELECT 'missing', count(*) FILTER (c_custkey % 13 = 0) FROM customer")
def verify_index(t: Tables):
    """An index that lacks some rows and still names others that are gone."""
    c = t.customer
    index = kv.index_of(c.filter("c_custkey % 13 <> 0"), F.col("c_mktsegment"), "c_custkey")
    old = kv.index_of(c.filter("c_custkey % 11 = 0").withColumn("c_custkey", -F.col("c_custkey") - 1), F.col("c_mktsegment"), "c_custkey")
    return maintenance.index_problems(index.unionByName(old), c, "c_custkey")


@query("SELECT sum(l_extendedprice::BIGINT)::BIGINT AS flushed, (sum(l_extendedprice::BIGINT) FILTER (l_linenumber > 2))::BIGINT AS compacted, round(1 + (sum(l_extendedprice::BIGINT) FILTER (l_linenumber > 2))::DOUBLE / sum(l_extendedprice::BIGINT), 6) AS ratio FROM (SELECT l_linenumber, round(l_extendedprice) AS l_extendedprice FROM lineitem)")
def stats_write_amplification(t: Tables):
    files = t.lineitem.select(F.round("l_extendedprice").cast("long").alias("bytes"), "l_linenumber")
    return maintenance.write_amplification(files, files.filter("l_linenumber > 2"))


@query("SELECT o_orderkey, sha256(o_orderpriority) AS digest, o_orderkey % 7 <> 0 AS intact FROM orders")
def fn_checksums(t: Tables):
    """Digests of values, some of which have changed since."""
    stored = t.orders.select("o_orderkey", F.encode("o_orderpriority", "UTF-8").alias("v")).withColumn("digest", digest(F.col("v")))
    now = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.col("v"), F.lit("!").cast("binary"))).otherwise(F.col("v"))
    return stored.select("o_orderkey", "digest", intact(now, F.col("digest")).alias("intact"))
