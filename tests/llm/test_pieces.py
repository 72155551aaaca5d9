import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, models

from loomstone.llm import pieces

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(FILE)


def texts(n):
    r = np.random.default_rng(6)
    pool = [*" abcdefghijklmnopqrstuvwxyzABC.,!?0123456789\n\t'\"/", "  ", "   ", "▁", "é", "ñ", "中", "日本", "😀", "\x00", "б", "the ", "ing", "<s>", "</s>", "aaaa", "\xa0", "==", "    "]
    return ["".join(pool[int(i)] for i in r.integers(0, len(pool), size=int(r.integers(0, 40)))) for _ in range(n)]


def test_encoding_equals_the_library(vocabulary):
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=FILE), pieces.MergeEncoder(vocabulary)
    names = list(vocabulary.ids)
    r = np.random.default_rng(7)
    joint = ["".join(names[int(i)] for i in r.integers(0, len(names), size=4)).replace("▁", " ") for _ in range(3000)]
    for t in [*texts(5000), *joint, "a" * 5000, "ab" * 3000, " " * 3000, "ha" * 4000]:
        assert memoryview(encoder.encode(t)).cast("I").tolist() == library.encode(t, add_bos=True, add_eos=True), t


def test_counts_equal_the_unigram_library(vocabulary):
    vocab = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + list(vocabulary.scores.items())
    library, counter = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True)), pieces.UnigramCounter(vocabulary)
    for t in [*texts(5000), "a" * 3000, " " * 500, "zq" * 900]:
        want = len(library.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
        assert counter.count(t) == want, t


def test_a_full_cache_changes_nothing(vocabulary):
    encoder = pieces.MergeEncoder(vocabulary)
    small = pieces.MergeEncoder(vocabulary)
    small.encoded.limit = small.fits.limit = 3
    for t in texts(300):
        assert encoder.encode(t) == small.encode(t)


def test_queries(spark):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (3, ""), (4, "é中" * 20_000)]
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, ids binary")
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(library.decode(ids).encode())))
    assert sorted(map(tuple, pieces.encoding_digests(df, FILE).collect())) == sorted(want)
    full = pieces.encode_documents(df, FILE).collect()
    assert sorted((r["doc_id"], len(r["ids"]) // 4, sha(r["ids"]), sha(r["decoded"].encode())) for r in full) == sorted(want)
    assert sorted(r["n_tokens"] for r in pieces.token_counts(df, FILE).collect())[:3] == [0, 0, 0]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encoding_digests(empty, FILE).collect() == [] and pieces.token_counts(empty, FILE).collect() == []


def test_rows_without_an_id_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "Hello world", 7, b"x"), (None, None, 8, b"y"), (1, "Hello world", 9, b"z")], "doc_id long, text string, n_tokens int, decoded binary")
    for run in (pieces.encoding_digests, pieces.token_counts):
        got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in run(df, FILE).collect())
        assert [g[0] for g in got] == [0, 0, 1] and got[1][1] == got[2][1] > got[0][1]
