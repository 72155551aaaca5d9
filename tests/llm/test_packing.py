import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomstone.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_fast_ids_equal_the_library():
    encode, library = packing.ByteTokenizer(FILE), Tokenizer.from_file(FILE)
    r = np.random.default_rng(2)
    pool = [chr(c) for c in range(0x250)] + [" ", "  ", "\n", "\r\n", "'s", "don't", "the ", "ing", "123", "é", "<|endoftext|>", "中", "😀", " ", "x" * 500, " " * 450]
    for _ in range(4000):
        text = "".join(pool[int(i)] for i in r.integers(0, len(pool), size=int(r.integers(0, 30))))
        assert encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_knapsack_is_optimal():
    r = np.random.default_rng(3)
    for _ in range(20):
        price, cap = r.random(7), 12
        value, counts = packing.knapsack(price, cap)
        assert counts @ np.arange(1, 8) <= cap and abs(counts @ price - value) < 1e-9
        best = np.zeros(cap + 1)
        for c in range(1, cap + 1):
            best[c] = max([best[c - 1], *(best[c - i - 1] + price[i] for i in range(7) if i < c)])
        assert abs(best[cap] - value) < 1e-9


def test_plan_places_all_items_within_capacity():
    r = np.random.default_rng(4)
    shapes = [r.integers(0, 300, size=16), r.integers(0, 300, size=64), np.eye(1, 64, 63, dtype=np.int64)[0] * 7, np.eye(1, 32, 20, dtype=np.int64)[0] * 500, np.eye(1, 8, 0, dtype=np.int64)[0], np.zeros(8, dtype=np.int64)]
    for demand in shapes:
        cap = len(demand)
        plan = packing.cutting_plan(demand, cap)
        cls = np.repeat(np.arange(cap), demand)
        got = plan.places(cls, np.concatenate([np.arange(n) for n in demand] or [[]]).astype(np.int64))
        steps = np.where(got["steps"] > 0, got["steps"], cls[got["item"]] + 1 - got["skip"]) if len(cls) else np.zeros(0, dtype=np.int64)
        load = np.bincount(got["sequence"], weights=steps, minlength=plan.sequences) if len(cls) else np.zeros(0)
        assert plan.sequences == 0 or load.max() <= cap
        assert len(set(zip(got["sequence"].tolist(), got["slot"].tolist(), strict=True))) == len(steps)
        for i in range(len(cls)):  # an item's pieces lie one after another
            mine = sorted(zip(got["skip"][got["item"] == i].tolist(), steps[got["item"] == i].tolist(), strict=True))
            at = 0
            for skip, n in mine:
                assert skip == at and n > 0
                at += n
            assert at == cls[i] + 1
        assert plan.sequences <= -(-(demand @ np.arange(1, cap + 1)) // cap) * 1.01 + 1


@pytest.mark.parametrize("most_starts", [2_000_000, 0])
def test_pack(spark, most_starts):
    r = np.random.default_rng(5)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(r.integers(0, 900, size=150))]
    rows += [(1000, None), (1001, ""), (1002, "the " * 9000), (1002, "the " * 9000), (1003, "a" * 30_000), (None, "no id " * 40)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, sequence_id int").repartition(3)
    got = packing.pack(df, FILE, with_ids=True, most_starts=most_starts).collect()
    library = Tokenizer.from_file(FILE)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    seen, filled = {}, {}
    for p in got:
        ids = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        raw = np.array(ids, dtype="<u4").tobytes()
        assert p["ids_crc32"] == zlib.crc32(raw) and p["ids"] == raw and p["doc_tokens"] == len(want[p["doc_id"]])
        seen.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        filled.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, ids in want.items():
        times = 2 if i == 1002 else 1
        covered = np.zeros(len(ids), dtype=np.int64)
        for start, n in seen[i]:
            covered[start : start + n] += 1
        assert (covered == times).all()
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(n for parts in filled.values() for _, n in parts) > 0.97 * 2048 * len(filled)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), FILE).collect() == []
