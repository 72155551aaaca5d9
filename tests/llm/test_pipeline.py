import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomstone.llm import exact_dedup, nbsvm, pii

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= left
        left = docs.count()
    groups = exact_dedup.exact_groups(docs)
    assert groups.filter("NOT kept").count() <= 1  # redaction may make two texts alike
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == left


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_odd_rows(spark):
    rows = [(1, None, "en", None, None, 1), (2, "", "en", "s", 0, 2), (2, "", "en", "s", 0, 2), (3, "word " * 90_000, None, "s", 450_000, 3), (None, "a lone row", "en", "s", 10, 4), (4, "mail a@b.co", "en", "s", 11, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_sha256 int")
    key = lambda r: (-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "")[:30], r["text_sha256"])
    got = {name: sorted(map(key, stage(spark, docs, SF).collect())) for name, stage in corpus_pipeline.STAGES[:-1]}
    every = sorted((-1 if r[0] is None else r[0], (r[1] or "")[:30], r[5]) for r in rows)
    assert set(got["quality"]) <= set(every)
    assert got["exact_dedup"] == [(-1, "a lone row", 4), (1, "", 1), (3, ("word " * 6), 3), (4, "mail a@b.co", 5)]  # null and empty texts are equal
    assert got["near_dedup"] == every  # texts without words are linked with nothing
    assert got["pii"] == sorted((i, t.replace("a@b.co", "<EMAIL>"), k) for i, t, k in every)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"), F.count("*").alias("c")).collect()
    assert {r["doc_id"] for r in packed} == {None, 1, 2, 3, 4} and all(r["n"] == r["t"] * (2 if r["doc_id"] == 2 else 1) for r in packed)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return (text or "").encode().lower().decode()


def test_run_equals_a_plain_computation(spark, tmp_path):
    """All stages by loops over the same model and trees: rejected documents, copies, groups, redaction, tokens."""
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in ("documents", "labels"))
    score = {r["doc_id"]: r["score"] for r in nbsvm.scores(docs, nbsvm.train(docs, labels)).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if score[r["doc_id"]] >= 0.3]
    first = {}
    for i, t in sorted(rows):
        first.setdefault(lowered(t), (i, t))
    rows = sorted(first.values())
    sets = {}
    for i, t in rows:
        w = WORD.findall(lowered(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                name[max(x, y)] = min(x, y)
    trees, library = pii.train(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in rows:
        if root(i) == i:
            clean = pii.redacted(t or "", pii.all_spans(t or "", trees)[1])
            want[i] = [*library.encode(clean, add_special_tokens=False).ids, 1]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == want.keys() and 0 < len(want) < len(score)
    covered = {i: 0 for i in want}
    for r in got:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4")) and r["doc_tokens"] == len(want[r["doc_id"]]) and len(ids) == r["length"]
        covered[r["doc_id"]] += r["length"]
    assert all(covered[i] == len(ids) for i, ids in want.items())
