"""SentencePiece vocabularies: merge-type encoding by backtracking, decoding, and unigram token counts.

Encoding (merge type). The escaped text falls apart where no vocabulary piece can cross: before a run
of escaped blanks, and around characters that no piece holds. Each chunk is encoded by backtracking:
an Aho-Corasick automaton finds all pieces in one pass; from the left, the longest piece is tried
first, a piece may follow another only if merging their joint text again gives just these two, and a
bitfield marks positions from which no continuation exists, so none is tried twice. Chunks that start with
two blanks, whose pieces share one score, and chunks with characters that only longer pieces hold are
merged directly by a heap, as pair checks alone don't define their order: none of the 4.1 million chunks of
the sf0.1 documents. Encoded chunks are kept in a cache of bounded size, which changes no result.

Counting (unigram type). The vocabulary's pieces and scores are read as a unigram model. The automaton
enumerates all matches; dynamic programming over chunk positions carries the best score and its piece
count. Ties go to the candidate that starts first (the longest), as a strict comparison in order of
start positions decides; a character with no piece of its own costs the least score less 10 and counts
as its UTF-8 bytes. Scores are whole numbers, so sums in doubles are exact and chunks are independent.

Null and empty texts: encoded as begin and end id only, decoded to empty, 0 pieces; a null doc_id stays null.
Repeated rows give equal rows. Texts of any length are read whole. Other columns of the input are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from loomstone.llm.common import docs_of, map_batches

BLANK = "▁"
NORMAL, CONTROL, BYTE = 1, 3, 6
CACHE_CHUNKS = 600_000
LONG_CHUNK = 256


class Cache(dict):
    """Results by key, computed when missing, forgotten when there are too many or a key is long."""

    def __init__(self, compute, limit: int = CACHE_CHUNKS):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if not isinstance(key, str) or len(key) <= LONG_CHUNK:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class Vocabulary:
    """The pieces of a .model file, and the chunks into which any text falls apart."""

    def __init__(self, model_file: str):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser with a dummy prefix is supported")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.bos = next(i for i, p in enumerate(proto.pieces) if p.piece == "<s>" and p.type == CONTROL)
        self.eos = next(i for i, p in enumerate(proto.pieces) if p.piece == "</s>" and p.type == CONTROL)
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:-1], 16)] = i
            elif p.type == NORMAL:
                self.ids[p.piece] = i
                self.scores[p.piece] = p.score
        held = {c for p in self.ids for c in p} - {BLANK}
        self.shaky = {c for c in held if c not in self.ids}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece holds a blank after another character")
        known = "".join(f"\\U{ord(c):08x}" for c in sorted(held))
        self.chunks = re.compile(f"{BLANK}+[{known}]*|[{known}]+|[^{known}{BLANK}]+").findall
        self.held = held

    def automaton(self, wanted=lambda piece: True) -> ahocorasick.Automaton:
        """Finds (length, id, score) of the wanted pieces."""
        out = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if wanted(p):
                out.add_word(p, (len(p), i, self.scores[p]))
        out.make_automaton()
        return out

    def split(self, text: str) -> list[str]:
        return self.chunks(BLANK + text.replace(" ", BLANK)) if text else []

    def unknown(self, chunk: str) -> bool:
        return chunk[0] not in self.held and chunk[0] != BLANK


class MergeEncoder:
    """Exact merge-type encoding."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.names = {i: p for p, i in vocabulary.ids.items()}
        self.fits = Cache(self._fits, 1_000_000)
        # a piece that its own merges do not give is in no encoding
        found = vocabulary.automaton(lambda p: len(p) == 1 or self.merge(p) == [vocabulary.ids[p]])
        self.find, self.longest = found.iter, found.iter_long
        self.encoded = Cache(self._chunk)

    def merge(self, text: str) -> list[int]:
        """Merges of the best-scored adjacent pair, the leftmost among equals, until none is left."""
        if len(text) > 32:
            return self._ids(self._merge_long(text))
        part, score = list(text), self.v.scores.get
        none = float("-inf")
        pair = [score(a + b, none) for a, b in zip(part, part[1:], strict=False)]
        while pair and (best := max(pair)) > none:
            k = pair.index(best)
            part[k : k + 2] = [part[k] + part[k + 1]]
            del pair[k]
            if k:
                pair[k - 1] = score(part[k - 1] + part[k], none)
            if k < len(pair):
                pair[k] = score(part[k] + part[k + 1], none)
        return self._ids(part)

    def _ids(self, parts: list[str]) -> list[int]:
        ids = self.v.ids
        out: list[int] = []
        for p in parts:
            out += [ids[p]] if p in ids else [self.v.byte_ids[x] for x in p.encode()]
        return out

    def _merge_long(self, text: str) -> list[str]:
        scores = self.v.scores
        part: list[str | None] = list(text)
        prev, nxt = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := scores.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-s, a, b, part[a] + part[b]))

        for a in range(len(part) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, joint = heapq.heappop(heap)
            if part[a] is None or part[b] is None or nxt[a] != b or part[a] + part[b] != joint:
                continue
            part[a], part[b] = joint, None
            nxt[a] = nxt[b]
            if nxt[b] >= 0:
                prev[nxt[b]] = a
            offer(prev[a], a)
            offer(a, nxt[a])
        return [p for p in part if p is not None]

    def _fits(self, pair: tuple[int, int]) -> bool:
        return self.merge(self.names[pair[0]] + self.names[pair[1]]) == list(pair)

    def greedy(self, chunk: str) -> list[int] | None:
        """The longest matches from the left, if all neighbours fit: what backtracking tries first."""
        out, fits, last = [], self.fits, -1
        for _, (_, i, _) in self.longest(chunk):
            if last >= 0 and not fits[last, i]:
                return None
            out.append(i)
            last = i
        return out

    def backtrack(self, chunk: str) -> list[int]:
        at: list[list[tuple[int, int]]] = [[] for _ in chunk]
        for end, (length, i, _) in self.find(chunk):
            at[end - length + 1].append((length, i))  # shorter pieces come first
        open_, fits, n = (1 << (len(chunk) + 1)) - 1, self.fits, len(chunk)
        out: list[int] = []
        taken: list[tuple[int, int]] = []  # start, index into at[start]
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            options = at[pos]
            while k >= 0:
                length, i = options[k]
                if open_ >> (pos + length) & 1 and (not out or fits[out[-1], i]):
                    break
                k -= 1
            if k >= 0:
                out.append(i)
                taken.append((pos, k))
                pos += length
                k = len(at[pos]) - 1 if pos < n else -1
            else:
                open_ &= ~(1 << pos)
                out.pop()
                pos, k = taken.pop()
        return out

    def _chunk(self, chunk: str) -> bytes:
        if self.v.unknown(chunk):
            ids = [self.v.byte_ids[b] for b in chunk.encode()]
        elif chunk.startswith(BLANK * 2) or (self.v.shaky and not self.v.shaky.isdisjoint(chunk)):
            ids = self.merge(chunk)
        else:
            ids = self.greedy(chunk) or self.backtrack(chunk)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids, with begin and end ids, as little-endian unsigned 32-bit integers."""
        middle = b"".join(map(self.encoded.__getitem__, self.v.split(text)))
        return struct.pack("<I", self.v.bos) + middle + struct.pack("<I", self.v.eos)


class UnigramCounter:
    """Viterbi piece counts; no ids are kept."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.unknown_score = min(0.0, min(vocabulary.scores.values())) - 10.0
        self.find = vocabulary.automaton().iter
        self.counted = Cache(self._chunk)

    def _chunk(self, chunk: str) -> int:
        if self.v.unknown(chunk):
            return len(chunk.encode())
        n = len(chunk)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        single = [False] * n
        done = 0

        def settle(to: int) -> None:
            """Ends before `to` have seen all matches; characters without a piece take the unknown step."""
            nonlocal done
            while done < to:
                if not single[done]:
                    cand = best[done] + self.unknown_score
                    if best[done + 1] is None or cand > best[done + 1]:
                        best[done + 1], count[done + 1] = cand, count[done] + len(chunk[done].encode())
                done += 1

        for end, (length, _, score) in self.find(chunk):
            settle(end)
            start = end - length + 1
            if length == 1:
                single[start] = True
            cand = best[start] + score
            if best[end + 1] is None or cand > best[end + 1]:
                best[end + 1], count[end + 1] = cand, count[start] + 1
        settle(n)
        return count[n]

    def count(self, text: str) -> int:
        return sum(map(self.counted.__getitem__, self.v.split(text)))


@functools.lru_cache(maxsize=2)
def _encoder(model_file: str) -> MergeEncoder:
    """One for each worker process, so that tasks find its cache warm."""
    return MergeEncoder(Vocabulary(model_file))


@functools.lru_cache(maxsize=2)
def _counter(model_file: str) -> UnigramCounter:
    return UnigramCounter(Vocabulary(model_file))


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit, begin and end ids included), decoded (text)."""

    def make():
        encoder = _encoder(model_file)
        processor = sentencepiece.SentencePieceProcessor(model_file=model_file)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            decoded = [processor.decode(memoryview(b).cast("I").tolist()) for b in ids]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

        return step

    return map_batches(docs_of(docs), make, "doc_id long, ids binary, decoded string")


def encoding_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of encode_documents, made where the ids are."""

    def make():
        encoder = _encoder(model_file)
        processor = sentencepiece.SentencePieceProcessor(model_file=model_file)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, of_ids, of_text = [], [], []
            for t in batch.column(1).to_pylist():
                b = encoder.encode(t)
                sizes.append(len(b) // 4)
                of_ids.append(hashlib.sha256(b).hexdigest())
                of_text.append(hashlib.sha256(processor.decode(memoryview(b).cast("I").tolist()).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_batches(docs_of(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens: pieces of the best unigram segmentation."""

    def make():
        counter = _counter(model_file)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes = [counter.count(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

        return step

    return map_batches(docs_of(docs), make, "doc_id long, n_tokens long")
