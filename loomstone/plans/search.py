"""Full-text, vector, spatial and graph queries."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from loomstone.functions import tokens
from loomstone.functions.boxes import Box, hilbert
from loomstone.functions.distance import distance
from loomstone.operators import fulltext, graph, mvcc, spatial, timeseries, vector
from loomstone.plans.predicates import compile_predicate, p
from loomstone.plans.registry import Tables, query
from loomstone.sources.tables import micros

# full text

_WORDS = "string_split_regex(regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g'), '[\\s]+')"
_NORMAL = f"list_filter(list_transform({_WORDS}, lambda w: lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g'))), lambda w: strlen(w) >= 2)"
_STOP = ", ".join(f"'{w}'" for w in tokens.STOP_WORDS)
_SIMPLE = f"list_filter({_NORMAL}, lambda w: NOT list_contains([{_STOP}], w))"
_POSTED = f"posted AS (SELECT doc_id, unnest({_SIMPLE}) AS term FROM documents)"
QUERY = ["licensed", "apache", "thing", "licensed"]
_QUERY = "query AS (SELECT 'licensed' AS term, 2 AS times UNION ALL SELECT 'apache', 1 UNION ALL SELECT 'thing', 1)"
_SCORED = f"""WITH {_POSTED}, {_QUERY}, tf AS (SELECT doc_id, term, count(*) AS tf FROM posted WHERE term IN (SELECT term FROM query) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
scored AS (SELECT doc_id, sum(tf * times * log10(n / df)) AS score FROM tf JOIN df USING (term) JOIN query USING (term), n GROUP BY doc_id)"""


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest(list_filter({_WORDS}, lambda w: strlen(w) >= 1)) AS term FROM documents) GROUP BY term")
def fts_tokens_whitespace(t: Tables):
    return t.documents.select(F.explode(tokens.whitespace(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_SIMPLE}) AS term FROM documents) GROUP BY term")
def fts_tokens_simple(t: Tables):
    return t.documents.select(F.explode(tokens.simple(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _stem_sql() -> str:
    """The stemmer's stages as nested CASE expressions over a column named in each subquery."""
    s = "CASE WHEN w LIKE '%sses' THEN w[:-3] WHEN w LIKE '%ies' THEN CASE WHEN strlen(w) > 4 THEN w[:-4] ELSE w END WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END"
    e = "CASE WHEN a LIKE '%eed' THEN CASE WHEN strlen(a) > 4 THEN a[:-2] ELSE a END WHEN a LIKE '%ed' AND strlen(a) > 4 THEN CASE WHEN regexp_matches(a[:-3], '[aeiou]') THEN a[:-3] ELSE a END WHEN a LIKE '%ing' AND strlen(a) > 5 THEN CASE WHEN regexp_matches(a[:-4], '[aeiou]') THEN a[:-4] ELSE a END ELSE a END"
    y = "CASE WHEN b LIKE '%y' AND strlen(b) > 2 AND regexp_matches(b[:-2], '[aeiou]') THEN b[:-2] || 'i' ELSE b END"
    last = " ".join(f"WHEN c LIKE '%{x}' AND strlen(c) > {len(x) + 2} THEN c[:-{len(x) + 1}]" for x in tokens.ENDINGS)
    return f"SELECT CASE {last} ELSE c END AS term FROM (SELECT {y} AS c FROM (SELECT {e} AS b FROM (SELECT {s} AS a FROM (SELECT unnest({_SIMPLE}) AS w FROM documents))))"


@query(f"SELECT term, count(*) AS n FROM ({_stem_sql()}) GROUP BY term")
def fts_tokens_stemming(t: Tables):
    return t.documents.select(F.explode(tokens.stemming(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_SCORED} SELECT doc_id, round(score, 6) AS score FROM scored")
def fts_scores(t: Tables):
    return fulltext.score(t.documents, QUERY).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_SCORED} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def fts_search(t: Tables):
    hits = fulltext.score(t.documents, QUERY).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(20)
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query(_SCORED.replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 3 <> 0)") + " SELECT doc_id, round(score, 6) AS score FROM scored")
def fts_after_delete(t: Tables):
    d = t.documents
    return fulltext.score(fulltext.remove(d, d.filter("doc_id % 3 = 0")), QUERY).select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH f AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS boost, unnest({_SIMPLE}) AS term FROM conversations),
    e AS (SELECT conv_id, turn, boost, term, count(*) AS c FROM f WHERE term IN ('thing', 'here') GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM e GROUP BY term),
    g AS (SELECT conv_id, term, sum(c) AS tf, sum(boost) AS boost FROM e GROUP BY ALL)
    SELECT conv_id, round(sum(tf * boost * log10((SELECT count(DISTINCT conv_id) FROM conversations) / df)), 6) AS score FROM g JOIN d USING (term) GROUP BY conv_id"""
)
def fts_field_scores(t: Tables):
    """Conversations as documents with a field for each turn; what users say counts twice."""
    boost = F.when(F.col("role") == "user", 2.0).otherwise(1.0)
    docs = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").cast("string").alias("name"), "text", boost.alias("boost"))).alias("fields"))
    return fulltext.score_fields(docs, ["thing", "here"], doc="conv_id").select("conv_id", F.round("score", 6).alias("score"))


@query(f"WITH {_POSTED} SELECT term, count(DISTINCT doc_id) AS df FROM posted GROUP BY term")
def fts_doc_freq(t: Tables):
    return fulltext.document_frequencies(t.documents)


@query(f"WITH t AS MATERIALIZED (SELECT doc_id, {_SIMPLE} AS tk FROM documents), u AS (SELECT doc_id, unnest(tk) AS w, unnest(range(len(tk))) AS pos FROM t) SELECT doc_id, pos FROM u WHERE w = 'licensed'")
def fts_positions(t: Tables):
    return fulltext.postings(t.documents).filter("term = 'licensed'").select("doc_id", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_POSTED} SELECT (SELECT count(DISTINCT term) FROM posted) AS terms, (SELECT count(*) FROM posted) AS positions, (SELECT count(*) FROM documents) AS documents")
def fts_stats(t: Tables):
    return fulltext.stats(t.documents)


@query(f"SELECT doc_id FROM (SELECT doc_id, {_SIMPLE} AS tk FROM documents) WHERE ' ' || array_to_string(tk, ' ') || ' ' LIKE '% licensed under apache license %'")
def fts_phrase(t: Tables):
    return fulltext.phrase(t.documents, ["licensed", "under", "apache", "license"])


@query(f"SELECT doc_id FROM documents WHERE len({_SIMPLE}) = 0")
def fts_unindexed(t: Tables):
    return fulltext.unindexed(t.documents, fulltext.postings(t.documents)).select("doc_id")


# vectors

_V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0)"
_DISTANCE = {
    "cosine": "1 - list_sum(list_transform(list_zip(e, q), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x))))",
    "dot": "-list_sum(list_transform(list_zip(e, q), lambda z: z[1] * z[2]))",
    "euclidean": "sqrt(list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))",
    "manhattan": "list_sum(list_transform(list_zip(e, q), lambda z: abs(z[1] - z[2])))",
}
for _metric, _sql in _DISTANCE.items():

    @query(f"{_V} SELECT vec_id, round({_sql}, 6) + 0.0 AS distance FROM v, q ORDER BY round({_sql}, 9), vec_id LIMIT 10", name=f"vec_knn_{_metric}")
    def _knn(t: Tables, metric=_metric):
        e = t.embeddings
        out = e.select("vec_id", F.round(distance(F.col("embedding"), vector.of_key(e, 0), metric), 9).alias("distance")).orderBy("distance", "vec_id").limit(10)
        return out.select("vec_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query(f"{_V} SELECT vec_id, round({_DISTANCE['euclidean']}, 6) AS distance FROM v, q WHERE label = 3 ORDER BY 2, 1 LIMIT 5")
def vec_filtered_knn(t: Tables):
    out = vector.knn(t.embeddings, vector.of_key(t.embeddings, 0), 5, "euclidean", where=F.col("label") == 3)
    return out.select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT vec_id, 'duplicate' AS reason FROM embeddings WHERE vec_id % 10 = 0 UNION ALL SELECT vec_id + 1000000, 'dimension' FROM embeddings WHERE vec_id % 25 = 1")
def vec_insert_check(t: Tables):
    e = t.embeddings
    new = e.filter("vec_id % 10 = 0").select("vec_id", "embedding").unionByName(e.filter("vec_id % 25 = 1").select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.slice("embedding", 1, 60).alias("embedding")))
    return vector.insert_errors(e, new, 64)


@query("SELECT vec_id FROM embeddings WHERE label <> 2")
def vec_delete(t: Tables):
    return vector.remove(t.embeddings, t.embeddings.filter("label = 2")).select("vec_id")


@query("SELECT count(*) AS vectors, 64 AS min_dim, 64 AS max_dim FROM embeddings")
def vec_stats(t: Tables):
    return vector.stats(t.embeddings)


@query()
def vec_ann(t: Tables):
    q = t.embeddings.filter("vec_id = 0").first()["embedding"]
    return vector.ann(t.embeddings, q, 10, length=6.0, tables=12)


_LISTS = f"""{_V}, c AS (SELECT vec_id AS list, e AS q FROM v WHERE vec_id < 8), away AS (SELECT v.vec_id, c.list, list_distance(v.e, c.q) AS d FROM v, c),
  near AS (SELECT vec_id, arg_min(list, struct_pack(d := d, l := list)) AS list FROM away GROUP BY vec_id)"""


def _centroids(t: Tables) -> list[list[float]]:
    """The first eight vectors."""
    some = t.embeddings.filter("vec_id < 8").orderBy("vec_id").select(F.col("embedding").cast("array<double>").alias("e"))
    return [r["e"] for r in some.collect()]


@query(f"{_LISTS} SELECT vec_id, list FROM near")
def vec_ivf_lists(t: Tables):
    """The list of the nearest of eight given centroids."""
    return vector.assign(t.embeddings, _centroids(t)).select("vec_id", F.col("list").cast("long").alias("list"))


@query(
    f"""{_LISTS} SELECT vec_id, round({_DISTANCE['euclidean']}, 6) AS distance FROM near JOIN v USING (vec_id), q
    WHERE list IN (SELECT list FROM away WHERE vec_id = 0 ORDER BY d, list LIMIT 3) ORDER BY 2, 1 LIMIT 10"""
)
def vec_ivf_probe(t: Tables):
    """The nearest in the three lists whose centroids are nearest."""
    centroids = _centroids(t)
    out = vector.probe(vector.assign(t.embeddings, centroids), centroids, vector.of_key(t.embeddings, 0), 10, 3)
    return out.select("vec_id", F.round("distance", 6).alias("distance"))


# geometry

def boxes(t: Tables):
    """(id, box): the first two elements as a point, and label / 100 as half a side."""
    x, y, r = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), F.col("label").cast("double") / 100
    return t.embeddings.select(F.col("vec_id").alias("id"), (x - r).alias("min_x"), (y - r).alias("min_y"), (x + r).alias("max_x"), (y + r).alias("max_y"))


_B = """b AS (SELECT vec_id AS id, embedding[1]::DOUBLE - label::DOUBLE / 100 AS min_x, embedding[2]::DOUBLE - label::DOUBLE / 100 AS min_y,
  embedding[1]::DOUBLE + label::DOUBLE / 100 AS max_x, embedding[2]::DOUBLE + label::DOUBLE / 100 AS max_y FROM embeddings)"""


@query(f"WITH {_B} SELECT id FROM b WHERE min_x <= 0.5::DOUBLE AND max_x >= -0.5::DOUBLE AND min_y <= 0.25::DOUBLE AND max_y >= -0.25::DOUBLE")
def geo_intersects(t: Tables):
    return spatial.hits(boxes(t), (-0.5, -0.25, 0.5, 0.25)).select("id")


@query(f"WITH {_B} SELECT id FROM b WHERE min_x <= 0.5::DOUBLE AND max_x >= 0.0::DOUBLE AND min_y <= 0.5::DOUBLE AND max_y >= 0.0::DOUBLE")
def pred_intersects(t: Tables):
    return boxes(t).filter(compile_predicate(p("intersects", spatial.COLUMNS, (0.0, 0.0, 0.5, 0.5)))).select("id")


_D = "sqrt(power(greatest(min_x - 0.1::DOUBLE, 0, 0.1::DOUBLE - max_x), 2) + power(greatest(min_y - 0.2::DOUBLE, 0, 0.2::DOUBLE - max_y), 2))"


@query(f"WITH {_B} SELECT id, round({_D}, 6) AS distance FROM b ORDER BY {_D}, id LIMIT 15")
def geo_nearest(t: Tables):
    return spatial.nearest(boxes(t), 0.1, 0.2, 15).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_B} SELECT l.id AS left_id, r.id AS right_id FROM b l JOIN b r ON l.id < r.id AND l.min_x <= r.max_x AND l.max_x >= r.min_x AND l.min_y <= r.max_y AND l.max_y >= r.min_y")
def geo_box_join(t: Tables):
    return spatial.box_join(boxes(t), boxes(t), 0.25, ordered=True)


@query(
    f"""WITH {_B}, q AS (SELECT *, -0.3::DOUBLE AS a, -0.2::DOUBLE AS b1, 0.4::DOUBLE AS c, 0.3::DOUBLE AS d FROM b)
    SELECT id, round((max_x - min_x) * (max_y - min_y), 6) AS area, round(2 * ((max_x - min_x) + (max_y - min_y)), 6) AS perimeter, round((max_x - min_x) + (max_y - min_y), 6) AS margin,
    round((greatest(max_x, c) - least(min_x, a)) * (greatest(max_y, d) - least(min_y, b1)), 6) AS union_area,
    round(CASE WHEN min_x <= c AND max_x >= a AND min_y <= d AND max_y >= b1 THEN (least(max_x, c) - greatest(min_x, a)) * (least(max_y, d) - greatest(min_y, b1)) ELSE 0 END, 6) + 0.0 AS overlap_area,
    round((greatest(max_x, c) - least(min_x, a)) * (greatest(max_y, d) - least(min_y, b1)) - (max_x - min_x) * (max_y - min_y), 6) AS area_increase,
    a <= min_x AND b1 <= min_y AND c >= max_x AND d >= max_y AS inside,
    round(sqrt(power(greatest(abs(0.1::DOUBLE - min_x), abs(0.1::DOUBLE - max_x)), 2) + power(greatest(abs(0.2::DOUBLE - min_y), abs(0.2::DOUBLE - max_y)), 2)), 6) AS max_distance,
    round(sqrt(power((min_x + max_x) / 2 - (a + c) / 2, 2) + power((min_y + max_y) / 2 - (b1 + d) / 2, 2)), 6) AS center_distance FROM q"""
)
def geo_mbr_algebra(t: Tables):
    b, q = Box.of(), Box.lit(-0.3, -0.2, 0.4, 0.3)
    r = lambda c: F.round(c, 6)
    return boxes(t).select(
        "id", r(b.area()).alias("area"), r(b.perimeter()).alias("perimeter"), r(b.margin()).alias("margin"), r(b.union(q).area()).alias("union_area"),
        (r(b.overlap_area(q)) + F.lit(0.0)).alias("overlap_area"), r(b.area_increase(q)).alias("area_increase"), q.contains(b).alias("inside"),
        r(b.max_distance(F.lit(0.1), F.lit(0.2))).alias("max_distance"), r(b.center_distance(q)).alias("center_distance"),
    )


@query(f"""WITH {_B}, c AS (SELECT id, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y FROM b), s AS (SELECT *, ntile(5) OVER (ORDER BY x, y, id) AS slice FROM c)
    SELECT id, slice, ntile(4) OVER (PARTITION BY slice ORDER BY y, x, id) AS tile FROM s""")
def geo_str_tiles(t: Tables):
    return spatial.str_tiles(boxes(t), 5, 4)


@query(f"WITH {_B} SELECT label, round(min(min_x), 6) AS min_x, round(min(min_y), 6) AS min_y, round(max(max_x), 6) AS max_x, round(max(max_y), 6) AS max_y FROM b JOIN embeddings ON vec_id = id GROUP BY label")
def geo_bounds(t: Tables):
    b = boxes(t).join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "id")
    return spatial.bounds(b, "label").select("label", *(F.round(c, 6).alias(c) for c in spatial.COLUMNS))


def _geometry(kind: str, order: str, a: float, b: float, c: float, d: float) -> bytes:
    """Well-known binary with the corners (a, b) and (c, d)."""
    head = lambda n: struct.pack(f"{order}BI", order == "<", n)
    xy = lambda *v: struct.pack(f"{order}{len(v)}d", *v)
    n = lambda k: struct.pack(f"{order}I", k)
    if kind == "line":
        return head(2) + n(2) + xy(a, b, c, d)
    if kind == "polygon":
        return head(3) + n(1) + n(5) + xy(a, b, c, b, c, d, a, d, a, b)
    if kind == "points":
        return head(4) + n(2) + head(1) + xy(c, d) + head(1) + xy(a, b)
    return head(7) + n(2) + head(1) + xy(a, d) + head(2) + n(2) + xy(c, b, a, d)


@query(f"WITH {_B} SELECT id, round(min_x, 9) AS min_x, round(min_y, 9) AS min_y, round(max_x, 9) AS max_x, round(max_y, 9) AS max_y FROM b")
def geo_wkb_mbr(t: Tables):
    """Each box's corners written as a line, a polygon, points or a collection, in either byte order, and read back."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def write(i, a, b, c, d):
        import pandas as pd

        kinds = ("line", "polygon", "points", "collection")
        return pd.Series([_geometry(kinds[v[0] % 4], "<>"[v[0] // 4 % 2], *v[1:]) for v in zip(i, a, b, c, d, strict=True)])

    made = boxes(t).select("id", write("id", *spatial.COLUMNS).alias("wkb")).select("id", spatial.wkb_boxes(F.col("wkb")).alias("m"))
    return made.select("id", *(F.round(F.col("m")[c], 9).alias(c) for c in spatial.COLUMNS))


@query(
    f"""WITH RECURSIVE {_B}, g AS (SELECT id, greatest(0, least(255, floor((min_x + 5) / 10 * 255)))::BIGINT AS x, greatest(0, least(255, floor((min_y + 5) / 10 * 255)))::BIGINT AS y FROM b),
    w AS (SELECT id, 128::BIGINT AS side, x, y, 0::BIGINT AS d FROM g
      UNION ALL SELECT id, side // 2,
        CASE WHEN y >= side THEN x % side WHEN x >= side THEN side - 1 - y ELSE y END,
        CASE WHEN y >= side THEN y % side WHEN x >= side THEN 2 * side - 1 - x ELSE x END,
        d + side * side * CASE WHEN y >= side THEN CASE WHEN x >= side THEN 2 ELSE 1 END WHEN x >= side THEN 3 ELSE 0 END
      FROM w WHERE side > 0)
    SELECT id, max(d) AS h FROM w GROUP BY id"""
)
def geo_hilbert(t: Tables):
    """The place of each box's lower corner on the curve; the SQL walks down the quadrants with coordinates."""
    return boxes(t).select("id", hilbert(F.col("min_x"), F.col("min_y"), -5.0, 5.0, 8).alias("h"))


# graphs

def edges(t: Tables):
    """part -> supplier, labelled by return flag, weighted by quantity; suppliers are numbered below parts."""
    return t.lineitem.select(F.col("l_partkey").alias("src"), F.concat(F.lit("e"), F.col("l_orderkey").cast("string")).alias("edge_id"), F.col("l_returnflag").alias("label"), (-F.col("l_suppkey")).alias("dst"), F.col("l_quantity").alias("weight"))


_E = "e AS (SELECT l_partkey AS src, 'e' || l_orderkey AS edge_id, l_returnflag AS label, -l_suppkey AS dst, l_quantity AS weight FROM lineitem)"


def tree(t: Tables):
    """region -> nation -> customer, as strings."""
    n = t.nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"))
    c = t.customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dst"))
    return n.unionByName(c).select(F.concat("src", F.lit("-"), "dst").alias("edge_id"), "src", F.lit("has").alias("label"), "dst", F.lit(1.0).alias("weight"))


_T = "t AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


@query(f"WITH {_E} SELECT edge_id, dst, weight FROM e WHERE src = 5 AND label = 'R'")
def graph_outgoing(t: Tables):
    return graph.outgoing(edges(t), 5, "R").select("edge_id", "dst", "weight")


@query(f"WITH {_E} SELECT edge_id, src, weight FROM e WHERE dst = -5")
def graph_incoming(t: Tables):
    return graph.incoming(edges(t), -5).select("edge_id", "src", "weight")


@query(f"WITH {_E} SELECT dst FROM e WHERE src = 9")
def graph_neighbors(t: Tables):
    return graph.neighbours(edges(t), 9)


@query(f"WITH {_E} SELECT a.range AS src, b.range - 60 AS dst, (a.range, b.range - 60) IN (SELECT (src, dst) FROM e) AS found FROM range(0, 97, 9) a, range(0, 60, 9) b")
def graph_has_edge(t: Tables):
    s = t.spark
    pairs = s.range(0, 97, 9).withColumnRenamed("id", "src").crossJoin(s.range(0, 60, 9).select((F.col("id") - 60).alias("dst")))  # 77 pairs
    return graph.has_edge(edges(t), pairs)


@query(f"WITH {_E} SELECT vertex, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS vertex, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY vertex")
def graph_degree(t: Tables):
    return graph.degrees(edges(t))


@query(f"WITH RECURSIVE {_T}, w AS (SELECT 'r1' AS vertex, 0 AS depth UNION SELECT t.dst, w.depth + 1 FROM w JOIN t ON t.src = w.vertex) SELECT vertex, min(depth) AS depth FROM w GROUP BY vertex")
def graph_bfs(t: Tables):
    return graph.bfs(tree(t), "r1")


@query(f"WITH RECURSIVE {_E}, u AS (SELECT DISTINCT src AS a, dst AS b FROM e WHERE label = 'A' UNION SELECT dst, src FROM e WHERE label = 'A'), w AS (SELECT 5::BIGINT AS vertex UNION SELECT b FROM w JOIN u ON a = vertex) SELECT vertex FROM w")
def graph_reachable(t: Tables):
    return graph.reachable(graph.undirected(edges(t).filter("label = 'A'")), 5)


@query(f"WITH {_T} SELECT r.dst AS vertex, 'r2/' || r.dst AS path, 1 AS depth FROM t r WHERE src = 'r2' UNION ALL SELECT c.dst, 'r2/' || r.dst || '/' || c.dst, 2 FROM t r JOIN t c ON c.src = r.dst WHERE r.src = 'r2' UNION ALL SELECT 'r2', 'r2', 0")
def graph_dfs_preorder(t: Tables):
    return graph.preorder(tree(t), "r2", 5)


@query(f"WITH {_E} SELECT edge_id, src, label, dst, weight FROM e UNION ALL SELECT edge_id, dst, label, src, NULL FROM e")
def graph_undirected(t: Tables):
    return graph.undirected(edges(t)).select("edge_id", "src", "label", "dst", "weight")


@query(f"WITH {_E} SELECT label, count(*) AS edges, count(DISTINCT src) AS sources FROM e GROUP BY label")
def graph_labels(t: Tables):
    return graph.labels(edges(t))


@query(f"WITH {_E} SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS vertices")
def graph_stats(t: Tables):
    return graph.stats(edges(t))


@query("SELECT o_custkey AS src, o_orderstatus AS label, 'x' AS edge_id, arg_max(o_orderpriority, o_orderkey) AS dst FROM orders GROUP BY ALL")
def graph_latest_edge(t: Tables):
    e = t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("label"), F.lit("x").alias("edge_id"), F.col("o_orderpriority").alias("dst"), F.col("o_orderkey").alias("seq"))
    return graph.latest(e)


@query(f"WITH {_T} SELECT src, dst FROM t WHERE src <> 'n3'")
def graph_remove_edges(t: Tables):
    e = tree(t)
    return graph.remove(e, e.filter("src = 'n3'")).select("src", "dst")


# specialty tables as of an LSN

def _versions(df, key: str):
    """A change log of df: every row is written at an LSN of its own key, some are deleted later, some of these written again."""
    k = F.col(key)
    meta = lambda gone, lsn, seq: (F.lit(gone).alias("is_deleted"), (k % 9).cast("long").alias("txn_id"), lsn.cast("long").alias("commit_lsn"), F.lit(seq).cast("long").alias("seq"))
    first = df.select("*", *meta(False, k % 50 + 1, 1))
    gone = df.filter(k % 7 == 0).select("*", *meta(True, k % 50 + 60, 2))
    again = df.filter(k % 21 == 0).select("*", *meta(False, k % 50 + 120, 3))
    return first.unionByName(gone).unionByName(again)


def _live(key: str, lsn: int) -> str:
    """What of df is there at an LSN, by the rules of _versions()."""
    return f"({key} % 50 + 1 <= {lsn} AND NOT ({key} % 7 = 0 AND {key} % 50 + 60 <= {lsn}) OR {key} % 21 = 0 AND {key} % 50 + 120 <= {lsn})"


@query(f"{_V} SELECT vec_id, round({_DISTANCE['euclidean']}, 6) AS distance FROM v, q WHERE {_live('vec_id', 90)} ORDER BY 2, 1 LIMIT 10")
def vec_knn_at(t: Tables):
    now = vector.visible(_versions(t.embeddings.select("vec_id", "embedding"), "vec_id"), 90)
    return vector.knn(now, vector.of_key(t.embeddings, 0), 10, "euclidean").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_B} SELECT id FROM b WHERE min_x <= 0.5::DOUBLE AND max_x >= -0.5::DOUBLE AND min_y <= 0.5::DOUBLE AND max_y >= -0.5::DOUBLE AND {_live('id', 130)}")
def geo_intersects_at(t: Tables):
    return spatial.hits(spatial.visible(_versions(boxes(t), "id"), 130), (-0.5, -0.5, 0.5, 0.5)).select("id")


@query(f"WITH {_B} SELECT id, round({_D}, 6) AS distance FROM b WHERE {_live('id', 30)} ORDER BY {_D}, id LIMIT 15")
def geo_nearest_at(t: Tables):
    return spatial.nearest(spatial.visible(_versions(boxes(t), "id"), 30), 0.1, 0.2, 15).select("id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_B} SELECT id, round(min_x, 9) AS min_x FROM b WHERE id % 5 <> 0 UNION ALL SELECT id, round(min_x - 1, 9) FROM b WHERE id % 10 = 0")
def geo_insert_delete(t: Tables):
    """Boxes of every fifth key go, half of them come back as lines further left; keys that are not there change nothing."""
    b = boxes(t)
    left = spatial.remove(b, b.filter("id % 5 = 0").select("id").unionByName(b.select((F.col("id") + 10**9).alias("id"))))
    moved = b.filter("id % 10 = 0").select("id", *((F.col(c) - (1 if c.endswith("x") else 0)).alias(c) for c in spatial.COLUMNS))
    return spatial.insert(left, moved).select("id", F.round("min_x", 9).alias("min_x"))


@query(f"WITH {_B} SELECT 'inverted' AS problem, count(*) FILTER (id % 11 = 0 AND max_x > min_x) AS n FROM b UNION ALL SELECT 'no number', count(*) FILTER (id % 13 = 0) FROM b WHERE id % 11 <> 0 UNION ALL SELECT 'repeated key', 0")
def geo_verify(t: Tables):
    """Boxes some of which were turned round or lost a corner."""
    turn, lost = F.col("id") % 11 == 0, (F.col("id") % 13 == 0) & (F.col("id") % 11 != 0)
    x1, x2 = F.when(turn, F.col("max_x")).otherwise(F.col("min_x")), F.when(turn, F.col("min_x")).when(lost, F.lit(None)).otherwise(F.col("max_x"))
    return spatial.verify(boxes(t).select("id", x1.alias("min_x"), "min_y", x2.alias("max_x"), "max_y"))


@query(f"SELECT o_orderkey AS edge, o_custkey AS dst FROM orders WHERE o_orderpriority = '1-URGENT' AND {_live('o_orderkey', 100)}")
def graph_outgoing_at(t: Tables):
    """Edges from priorities to the customers who ordered with them."""
    o = t.orders.select(F.col("o_orderkey").alias("edge_id"), F.col("o_orderpriority").alias("src"), F.col("o_orderstatus").alias("label"), F.col("o_custkey").alias("dst"), F.col("o_totalprice").alias("weight"))
    return graph.outgoing(graph.visible(_versions(o, "edge_id"), 100), "1-URGENT").select(F.col("edge_id").alias("edge"), "dst")


@query(f"SELECT event_id, epoch_us(ts) AS ts FROM events WHERE event_id % 4 = 1 AND {_live('event_id', 70)} AND epoch_us(ts) >= 1704400000000000 AND epoch_us(ts) < 1705400000000000")
def ts_scan_at(t: Tables):
    points = t.events.select((F.col("event_id") % 4).alias("series"), micros("ts").alias("ts"), "event_id")
    now = timeseries.visible(_versions(points, "event_id"), 70, by="event_id")
    return timeseries.scan(now, 1_704_400_000_000_000, 1_705_400_000_000_000, 1).select("event_id", "ts")


@query(_SCORED.replace("FROM documents", f"FROM (SELECT * FROM documents WHERE {_live('doc_id', 110)})") + " SELECT doc_id, round(score, 6) AS score FROM scored")
def fts_search_at(t: Tables):
    now = mvcc.visible(_versions(t.documents.select("doc_id", "text"), "doc_id"), 110, keys=("doc_id",))
    return fulltext.score(now, QUERY).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT 'dangling' AS problem, count(*) FILTER (doc_id % 4 = 0 AND n > 0) AS n FROM (SELECT doc_id, len(" + _SIMPLE + ") AS n FROM documents) UNION ALL SELECT 'unindexed', count(*) FILTER (doc_id % 4 <> 0 AND (n = 0 OR doc_id % 9 = 0)) FROM (SELECT doc_id, len(" + _SIMPLE + ") AS n FROM documents) UNION ALL SELECT 'repeated position', 0")
def fts_verify(t: Tables):
    """An index of which some documents are gone, and some were never indexed."""
    d = t.documents
    post = fulltext.postings(d.filter("doc_id % 4 = 0 OR doc_id % 9 <> 0"))
    return fulltext.verify(d.filter("doc_id % 4 <> 0"), post)


@query(f"WITH {_E} SELECT src AS vertex, count(*) AS edges FROM e GROUP BY src HAVING count(*) > 30")
def graph_crowded(t: Tables):
    return graph.Shape(weighted=True, most_edges=30).crowded(edges(t))
