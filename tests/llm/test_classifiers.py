import zlib

import numpy as np
import pytest

from loomstone.llm import nbsvm, toxicity
from loomstone.llm.features import indicators

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(12)
    words = [f"w{i}" for i in range(300)]
    bad = ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(900):
        w = [words[int(k)] for k in r.integers(0, 300, size=int(r.integers(3, 60)))]
        y = i % 4 == 0
        if y:
            w.insert(int(r.integers(len(w))), bad[int(r.integers(3))])
        rows.append((i, " ".join(w), 9))
        labels.append((i, int(not y), int(y)))
    rows += [(None, "w1 w2", 1), (2000, None, 1), (2001, "", 1), (2001, "", 1), (2002, "w1 " * 60_000, 1)]
    labels += [(None, 1, 1), (2000, None, None), (99_999, 1, 1), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("run", "field", "mod", "rest", "cut"), [(nbsvm.quality, "quality", 5, 0, 0.3), (toxicity.toxicity, "toxic", 3, 1, 0.7)])
def test_held_out_accuracy(made, run, field, mod, rest, cut):
    docs, labels = made
    want = {r["doc_id"]: r[field] for r in labels.collect()}
    got = run(docs, labels).collect()
    assert len(got) == docs.count()
    fold = [r for r in got if r["held_out"] and want.get(r["doc_id"]) is not None]
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [None]
    got = [r for r in got if r["doc_id"] is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut) for r in got)
    assert np.mean([r["predicted"] == want[r["doc_id"]] for r in fold]) > 0.95


@pytest.mark.parametrize("run", [nbsvm.quality, toxicity.toxicity])
def test_held_out_labels_are_not_read(made, run):
    docs, labels = made
    mod, rest = (5, 0) if run is nbsvm.quality else (3, 1)
    hidden = labels.selectExpr("doc_id", f"if(crc32(cast(doc_id as string)) % {mod} = {rest}, 1 - quality, quality) quality", f"if(crc32(cast(doc_id as string)) % {mod} = {rest}, 1 - toxic, toxic) toxic")
    key = lambda r: (r["doc_id"] or -1, r["score"])
    assert sorted(map(key, run(docs, labels).collect())) == sorted(map(key, run(docs, hidden).collect()))


@pytest.mark.parametrize("run", [nbsvm.quality, toxicity.toxicity])
def test_no_labels_and_no_documents(spark, made, run):
    docs, labels = made
    some = run(docs.limit(5), labels.limit(0)).collect()
    assert len(some) == 5 and len({r["score"] for r in some}) == 1
    assert run(docs.limit(0), labels).collect() == []


def test_keep_good_leaves_columns_alone(made):
    docs, labels = made
    kept = nbsvm.keep_good(docs, labels)
    assert kept.columns == docs.columns and 500 < kept.count() < docs.count()


def test_nearest_equals_brute_force():
    r = np.random.default_rng(13)
    for n, terms, share in ((500, 40, 0.15), (700, 300, 0.02), (10, 20, 0.3)):
        dense = np.where(r.random((n, terms)) < share, r.random((n, terms)) ** 4, 0)
        norm = np.linalg.norm(dense, axis=1)
        dense = dense[norm > 0] / norm[norm > 0, None]
        index = toxicity.Index(toxicity.Terms(np.arange(terms, dtype=np.uint64)), np.ones(terms), *(np.zeros(len(dense)),) * 3)
        index.fill([(np.flatnonzero(v), v[v > 0]) for v in dense])
        for k in range(150):
            q = np.where(r.random(terms) < 0.2, r.random(terms) ** 6, 0)
            if not q.any():
                continue
            q /= np.linalg.norm(q)
            t, but = np.flatnonzero(q), k % len(dense) if k % 2 else -1
            every = dense @ q
            if but >= 0:
                every[but] = 0
            got = index.nearest(t, q[t], but=but)
            want = np.sort(every)[::-1][:24]
            assert np.allclose([s for s, _ in got], want[want > 0]) and all(abs(every[i] - s) < 1e-9 for s, i in got)


def test_scores_equal_a_plain_computation(spark):
    """Words and first bytes as text, all examples compared with all documents, no hashes and no index."""
    r = np.random.default_rng(17)
    words = [f"{a}{b}" for a in ("alpha", "be", "gammadelta", "ep") for b in range(12)]
    texts, toxic = [], {}
    for i in range(240):
        w = [words[int(k)] for k in r.integers(0, len(words), size=int(r.integers(1, 25)))]
        if i % 5 == 0:
            w += [["grubby", "grubbing", "Slimeball"][int(r.integers(3))]] * int(r.integers(1, 4))
        texts.append(" ".join(w))
        if i % 3:
            toxic[i] = int(i % 5 == 0)
    texts += ["", None, "nothing known here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, labels).collect()}

    def terms(text):
        out = {}
        for w in (text or "").lower().split():
            for t in [("word", w), *((n, w[:n]) for n in toxicity.HEADS if len(w) > n)]:
                out[t] = out.get(t, 0) + 1
        return out

    bags = [terms(t) for t in texts]
    learnt = [i for i in toxic if zlib.crc32(str(i).encode()) % 3 != 1]
    n = [sum(toxic[i] == k for i in learnt) for k in (0, 1)]
    chosen = {}
    for t in {t for i in learnt for t in bags[i]}:
        seen = [sum(t in bags[i] for i in learnt if toxic[i] == k) for k in (0, 1)]
        total = sum(seen)
        rest = total * (sum(n) - total) * n[0] * n[1]
        chi = sum(n) * (seen[1] * (n[0] - seen[0]) - seen[0] * (n[1] - seen[1])) ** 2 / max(1, rest)
        if chi >= toxicity.LEAST_CHI and total >= toxicity.LEAST_SEEN:
            chosen[t] = np.log((len(texts) + 1) / (sum(t in b for b in bags) + 1)) + 1e-9

    def vector(bag):
        v = {t: (1 + np.log(c)) * chosen[t] for t, c in bag.items() if t in chosen}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()}

    held = [(i, v) for i in learnt if (v := vector(bags[i]))]

    def vote(v, but=None):
        near = sorted((-sum(x * u.get(t, 0) for t, x in v.items()), i) for i, u in held if i != but)
        near = [(-s, i) for s, i in near if s < 0]
        cut = near[toxicity.NEIGHBOURS - 1][0] if len(near) > toxicity.NEIGHBOURS else 0
        sure = [x for x in near if x[0] > cut + 1e-9]
        if sum(abs(s - cut) < 1e-9 for s, _ in near) > toxicity.NEIGHBOURS - len(sure):
            return None  # a tie at the last place: the index's order decides
        near = near[: toxicity.NEIGHBOURS]
        w = [1 / (max(0, 1 - s) + toxicity.NEAREST_FLOOR) for s, _ in near]
        return sum(x for x, (_, i) in zip(w, near, strict=True) if toxic[i]) / sum(w) if near else 0.0

    index = toxicity.train(docs, labels.filter("crc32(cast(doc_id as string)) % 3 <> 1"))
    assert len(index.terms.hashes) == len(chosen) > 3 and sorted(index.ids.tolist()) == sorted(i for i, _ in held)
    sure = 0
    for i, bag in enumerate(bags):
        v = vote(vector(bag))
        if v is not None:
            sure += 1
            assert abs(got[i]["score"] - 1 / (1 + np.exp(-(index.a * v + index.b)))) < 1e-9
    assert sure > 50
    assert all(e["cosine"] <= 1 + 1e-9 for x in got.values() for e in x["evidence"])


def test_descent_separates():
    r = np.random.default_rng(14)
    x = [(np.array([int(k)]), np.ones(1)) for k in r.integers(0, 10, size=300)]
    y = np.array([int(f[0] < 5) for f, _ in x])
    w = nbsvm.descend(x, y, 10, np.full(300, 1.0))
    assert all((w[f] @ v + w[10] > 0) == t for (f, v), t in zip(x, y, strict=True))


def test_descent_reaches_the_optimum_of_the_dual():
    r = np.random.default_rng(15)
    n, dim = 40, 12
    dense = np.where(r.random((n, dim)) < 0.4, r.standard_normal((n, dim)), 0)
    y, c = r.integers(0, 2, size=n), r.uniform(0.1, 2.0, size=n)
    w = nbsvm.descend([(np.flatnonzero(v), v[v != 0]) for v in dense], y, dim, c, epochs=4000)
    x = np.hstack([dense, np.ones((n, 1))]) * (2 * y - 1)[:, None]
    alpha, rate = np.zeros(n), 1 / np.linalg.eigvalsh(x @ x.T)[-1]
    for _ in range(200_000):  # projected gradient ascent of sum(alpha) - |x' alpha|^2 / 2
        alpha = np.clip(alpha + rate * (1 - x @ (x.T @ alpha)), 0, c)
    want = x.T @ alpha
    primal = lambda v: v @ v / 2 + c @ np.maximum(0, 1 - x @ v)
    assert abs(primal(want) - (alpha.sum() - want @ want / 2)) < 1e-6  # the brute force has converged
    assert abs(primal(w) - primal(want)) < 1e-3 * primal(want) and np.abs(w - want).max() < 1e-2


def test_ratios_and_scores_equal_counting_by_hand():
    import pyarrow as pa

    r = np.random.default_rng(16)
    texts = [" ".join(f"w{int(k)}" for k in r.integers(0, 40, size=int(r.integers(1, 30)))) for _ in range(200)]
    row, feature = indicators(pa.array(texts), nbsvm.BITS, tails=nbsvm.TAILS)
    sets = [set(feature[row == i].tolist()) for i in range(len(texts))]
    label = [int(k) for k in r.integers(0, 2, size=200)]
    ratio = nbsvm.log_ratios([(np.array(sorted(s)), y) for s, y in zip(sets, label, strict=True)], 1 << nbsvm.BITS)
    n = [label.count(0), label.count(1)]
    for f in set().union(*sets):
        seen = [sum(f in s for s, y in zip(sets, label, strict=True) if y == k) for k in (0, 1)]
        want = np.log((seen[1] + 1) / (n[1] + 2) / ((seen[0] + 1) / (n[0] + 2))) if sum(seen) >= nbsvm.LEAST_SEEN else 0.0
        assert abs(ratio[f] - want) < 1e-12
    assert np.count_nonzero(ratio) <= len(set().union(*sets))
    weight = r.standard_normal(1 << nbsvm.BITS)
    model = nbsvm.Model(ratio * weight, ratio**2, 0.3, 1.7, -0.2)
    got = model.score(pa.array([*texts, None, ""]))
    for s, g in zip([*sets, set(), set()], got, strict=True):
        norm = sum(ratio[f] ** 2 for f in s) ** 0.5
        margin = sum(ratio[f] / norm * weight[f] for f in s) + 0.3 if norm else 0.3
        assert abs(g - 1 / (1 + np.exp(-(1.7 * margin - 0.2)))) < 1e-9


def test_indicators_see_repeats():
    import pyarrow as pa

    row, feature = indicators(pa.array(["a b", None, "", "a a a a"]), 18)
    assert set(row.tolist()) == {0, 3} and len(set(zip(row.tolist(), feature.tolist(), strict=True))) == len(row)
