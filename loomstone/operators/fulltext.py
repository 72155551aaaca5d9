"""Full-text search: postings, term statistics and TF-IDF ranking, as joins and aggregations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.tokens import simple


def postings(docs: DataFrame, text: str = "text", doc: str = "doc_id", tokens: Callable[[Column], Column] = simple) -> DataFrame:
    """(doc, term, pos): positions count kept tokens from 0."""
    return docs.select(F.col(doc), F.posexplode(tokens(F.col(text))).alias("pos", "term"))


def field_postings(docs: DataFrame, doc: str = "doc_id", fields: str = "fields", tokens: Callable[[Column], Column] = simple) -> DataFrame:
    """(doc, field, boost, term, pos) of documents with an array of (name, text, boost)."""
    each = docs.select(F.col(doc), F.explode(fields).alias("_f"))
    return each.select(doc, F.col("_f.name").alias("field"), F.col("_f.boost").cast("double").alias("boost"), F.posexplode(tokens(F.col("_f.text"))).alias("pos", "term"))


def term_frequencies(post: DataFrame, doc: str = "doc_id") -> DataFrame:
    return post.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame, text: str = "text", tokens: Callable[[Column], Column] = simple) -> DataFrame:
    """(term, df): each document gives a term once, so counts are added up before the one shuffle."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def score(docs: DataFrame, query: list[str], text: str = "text", doc: str = "doc_id", boost: float = 1.0, tokens: Callable[[Column], Column] = simple) -> DataFrame:
    """(doc, score) of every document with a query term: the sum of tf * log10(N / df) * boost.

    A term said twice in the query counts twice. Only query terms leave the scan: tokens are filtered
    before they are exploded, so the shuffle carries a row for each hit and not for each word.
    """
    wanted = list(dict.fromkeys(query))
    hits = docs.select(F.col(doc), F.explode(F.filter(tokens(F.col(text)), lambda w: w.isin(*wanted))).alias("term"))
    tf = term_frequencies(hits, doc)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    times = docs.sparkSession.createDataFrame([(w, query.count(w)) for w in wanted], "term string, times int")
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    weight = df.join(times, "term").select("term", (F.col("times") * F.log10(n / F.col("df")) * boost).alias("w"))
    return tf.join(F.broadcast(weight), "term").groupBy(doc).agg(F.sum(F.col("tf") * F.col("w")).alias("score"))


def score_fields(docs: DataFrame, query: list[str], doc: str = "doc_id", fields: str = "fields", tokens: Callable[[Column], Column] = simple) -> DataFrame:
    """(doc, score) over documents with several boosted fields.

    Each field that holds a term is an entry: df counts entries, and a document's occurrences of the term
    in all its fields count with the boost of each entry.
    """
    wanted = list(dict.fromkeys(query))
    each = docs.select(F.col(doc), F.posexplode(fields).alias("_n", "_f"))
    hits = each.select(doc, "_n", F.col("_f.boost").cast("double").alias("boost"), F.explode(F.filter(tokens(F.col("_f.text")), lambda w: w.isin(*wanted))).alias("term"))
    entry = hits.groupBy(doc, "term", "_n", "boost").agg(F.count(F.lit(1)).alias("c"))
    total = entry.groupBy(doc, "term").agg(F.sum("c").alias("tf"), F.sum("boost").alias("boost"), F.count(F.lit(1)).alias("entries"))
    df = total.groupBy("term").agg(F.sum("entries").alias("df"))
    times = docs.sparkSession.createDataFrame([(w, query.count(w)) for w in wanted], "term string, times int")
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    weight = df.join(times, "term").select("term", (F.col("times") * F.log10(n / F.col("df"))).alias("w"))
    return total.join(F.broadcast(weight), "term").groupBy(doc).agg(F.sum(F.col("tf") * F.col("w") * F.col("boost")).alias("score"))


def search(docs: DataFrame, query: list[str], limit: int, **how) -> DataFrame:
    """The best documents by score, ties by document."""
    doc = how.get("doc", "doc_id")
    return score(docs, query, **how).orderBy(F.desc("score"), doc).limit(limit)


def phrase(docs: DataFrame, words: list[str], text: str = "text", doc: str = "doc_id", tokens: Callable[[Column], Column] = simple) -> DataFrame:
    """Documents whose tokens hold the words in a row; no words are in every document.

    A text is tokenised once: the tokens are bound to a variable before positions are looked at, and only
    positions of the first word are.
    """
    if not words:
        return docs.select(doc)

    def holds(t: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: F.element_at(t, i) == words[0])
        return F.when(F.arrays_overlap(t, F.array(F.lit(words[0]))), F.exists(first, lambda i: F.slice(t, i, len(words)) == F.array(*map(F.lit, words)))).otherwise(F.lit(False))

    return docs.filter(F.element_at(F.transform(F.array(tokens(F.col(text))), holds), 1)).select(doc)


def remove(docs: DataFrame, gone: DataFrame, doc: str = "doc_id") -> DataFrame:
    return docs.join(gone.select(doc), doc, "left_anti")


def replace(docs: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    """docs after the documents of `new` were indexed again."""
    return remove(docs, new, doc).unionByName(new)


def stats(docs: DataFrame, **how) -> DataFrame:
    post = postings(docs, **how)
    return post.agg(F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("positions")).crossJoin(docs.agg(F.count(F.lit(1)).alias("documents")))


def verify(docs: DataFrame, post: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(problem, n) of an index: postings of documents that are gone, documents without postings, and
    positions that are said twice."""
    gone = post.join(docs.select(doc), doc, "left_anti").select(doc).distinct().agg(F.lit("dangling").alias("problem"), F.count(F.lit(1)).alias("n"))
    bare = unindexed(docs, post, doc).agg(F.lit("unindexed").alias("problem"), F.count(F.lit(1)).alias("n"))
    twice = post.groupBy(doc, "pos").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").agg(F.lit("repeated position").alias("problem"), F.count(F.lit(1)).alias("n"))
    return gone.unionByName(bare).unionByName(twice)


def vacuum(post: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Postings without those of documents that are gone."""
    return post.join(docs.select(doc).distinct(), doc, "left_semi")


def unindexed(docs: DataFrame, post: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents without a posting."""
    return docs.join(post.select(doc).distinct(), doc, "left_anti")
