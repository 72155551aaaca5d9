import re

import numpy as np
import pytest

from loomstone.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    name = {i: i for i, _ in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                name[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(seed=3, bases=6, copies=14):
    r = np.random.default_rng(seed)
    rows, k = [], 0
    common = " ".join(f"law{i}" for i in range(60))
    for b in range(bases):
        base = [f"w{b}_{i}" for i in range(int(r.integers(20, 160)))]
        for _ in range(copies):
            w = list(base)
            for _ in range(int(r.integers(0, 1 + len(w) // 20))):
                w[int(r.integers(len(w)))] = f"x{r.integers(10**6)}"
            text = " ".join(w) + ("\n" + common if r.random() < 0.3 else "")
            rows.append((k, text.upper() if r.random() < 0.1 else text))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \t\n"), (k + 3, "one two"), (k + 4, "One\ttwo"), (k + 5, "one two three"), (k + 6, "a b c d e"), (k + 7, "é" * 5000)]
    return rows


@pytest.mark.parametrize("group_shingles", [ngram_join.GROUP_SHINGLES, 1500, 40])
def test_components_equal_brute_force(spark, group_shingles):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rep string")
    got = ngram_join.near_components(df, group_shingles=group_shingles)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_chain_is_followed_beyond_the_first_search():
    sets = [np.arange(k * 5, k * 5 + 100, dtype=np.uint64) for k in range(12)]
    assert ngram_join.linked(sets, 80, 100) == [0] * 12
    assert ngram_join.linked([s for s in sets[::4]], 80, 100) == [0, 1, 2]


def test_search_counts_overlaps_exactly():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 300, size=int(r.integers(1, 200))).astype(np.uint64)) for _ in range(60)]
    lists = ngram_join.Lists(sets)
    for x in range(60):
        for num in (60, 80):
            want = {}
            for y, s in enumerate(sets):
                both = len(np.intersect1d(s, sets[x]))
                if both * 100 >= num * (len(s) + len(sets[x]) - both):
                    want[y] = both
            assert lists.search(x, num, 100) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_components(df).collect() == []


def test_drop_near_keeps_other_columns(spark):
    df = spark.createDataFrame([(5, "a b c d e f", 1), (2, "a b c d e f", 2), (9, "", 3)], "doc_id long, text string, token int")
    assert sorted(map(tuple, ngram_join.drop_near(df).collect())) == [(2, "a b c d e f", 2), (9, "", 3)]


def test_long_lists_and_many_copies(spark):
    r = np.random.default_rng(4)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(300):
        w = list(base)
        w[int(r.integers(80))] = f"x{i}"
        if i % 3 == 0:
            w[int(r.integers(80))] = f"y{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    for group_shingles in (ngram_join.GROUP_SHINGLES, 3000, 50):
        assert sorted(map(tuple, ngram_join.near_components(df, group_shingles=group_shingles).collect())) == want


def test_links_to_a_class_with_many_copies_in_one_batch(spark):
    r = np.random.default_rng(6)
    base = [f"b{i}" for i in range(120)]
    rows = [(1000 + i, " ".join(base)) for i in range(60)]
    for i in range(40):
        w = list(base)
        w[int(r.integers(120))] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, ngram_join.near_components(df).collect())) == brute(rows)


def test_chain_whose_open_sets_are_all_held_by_two_leaders(spark):
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[k : k + 104])) for i, k in ((1, 0), (3, 9), (4, 18), (2, 27))]
    want = brute(rows)
    assert [c for _, _, c in want] == [1, 1, 1, 1]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group_shingles in (ngram_join.GROUP_SHINGLES, 100):
        assert sorted(map(tuple, ngram_join.near_components(df, group_shingles=group_shingles).collect())) == want


def test_pairs_of_short_lists_are_verified_query_by_query(spark):
    r = np.random.default_rng(8)
    rows = []
    for g in range(60):  # small groups that rare phrases of others chain to one candidate group
        base = [f"g{g}_{i}" for i in range(60)] + [f"link{g}_{i}" for i in range(6)] + [f"link{(g + 1) % 60}_{i}" for i in range(6)]
        for k in range(int(r.integers(1, 5))):
            w = list(base)
            for _ in range(k):
                w[int(r.integers(60))] = f"e{r.integers(10**9)}"
            rows.append((1000 * g + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for group_shingles in (ngram_join.GROUP_SHINGLES, 300):
        assert sorted(map(tuple, ngram_join.near_components(df, group_shingles=group_shingles).collect())) == brute(rows)


def test_odd_rows(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(None, a, 1), (None, b, 2), (None, b, 3), (5, a, 4), (5, c, 5), (7, c, 6), (7, c, 7), (8, "", 8), (8, "", 9), (8, b + " x", 10), (9, b + " x", 11), (None, None, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id int")
    got = sorted(map(tuple, ngram_join.near_components(df).collect()), key=str)
    want = [(5, 3, 5), (5, 3, 5), (7, 3, 5), (7, 3, 5), (8, 0, 8), (8, 0, 8), (8, 4, 8), (9, 4, 8), (None, 0, None), (None, 3, 5), (None, 3, None), (None, 3, None)]
    assert got == sorted(want, key=str)
    stays = {r["kept_id"] for r in ngram_join.drop_near(df).collect()}
    # of (5, a) and (5, c), which are apart, component 5 holds both ids; null ids stay unless a document has their set
    assert {2, 3, 8, 9, 10, 12} <= stays and 1 not in stays and not stays & {6, 7, 11}
