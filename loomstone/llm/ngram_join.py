"""N-gram Jaccard join: links between word-shingle sets by T-occurrence search (DivideSkip).

1. `sketch`: over all documents, how many hold each shingle, in a table of fixed size.
2. `signatures`: per document the size of its set, a 128-bit key of the set, and its prefix: under one
   global order (sketched count, then hash: rare shingles first) two sets with Jaccard >= t share one
   of the first n - ceil(t n) + 1 shingles. The order decides speed only, so the sketch need not be exact.
3. Documents with equal sets become one class. Classes that share a prefix shingle meet in its list. A list
   of at most SHORT postings gives the pairs whose sizes and positions allow enough overlap; a longer one
   is linked as a star, at once where a batch of documents holds it, so no list's pairs are emitted beyond
   SHORT for each posting. (A 64-bit class hash serves here: a collision could only add candidates.)
4. Connected candidates of at most `group_shingles` are one group. In it, T-occurrence searches go over the
   inverted lists of whole sets. A search for x returns all sets with Jaccard >= t and those in a wider
   ring. Jaccard distance is a metric, so what lies outside the ring can't link to a set near x, and sets
   near x are in x's component at once: they need a search of their own only where the ring is not empty.
   No link that joins components is lost.
5. Candidates of more shingles are not searched as one. What long lists join is a dense group; pairs of
   short lists outside dense groups are verified query by query. Dense groups above `group_shingles` go
   through rounds in which a leader's set meets all others, dealt in parts by size, and what is open after
   that in pairs of blocks of bounded size.
6. Connected components of the links found.

Null and empty texts have empty sets and link with nothing; fewer words than a shingle make one shingle.
Ties: the smallest doc_id stands for a class and names a component. A doc_id that occurs in several rows
with different texts counts as one document for each text. Rows with a null doc_id name no component:
theirs is that of the documents with the same set, else null.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import textvec
from loomstone.llm.common import docs_of, map_batches, pick_rows, slices, small_batches, written
from loomstone.llm.components import components

SKETCH_BITS = 22
GROUP_SHINGLES = 200_000  # 1.6 MB of sets: more is searched in parts
SPLIT = 12
CHUNK = 1 << 14
SHORT = 32  # longest list whose pairs are looked at one by one
HOT, LINK = -2, -1


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    hashes, row = textvec.hashed_words(column)
    n = len(column)
    grams, gram_row = textvec.grams(hashes, row, width)
    at, word_at = textvec.per_row(grams, gram_row, n), textvec.per_row(hashes, row, n)
    out = []
    for i in range(n):
        if at[i + 1] > at[i]:
            out.append(np.unique(grams[at[i] : at[i + 1]]))
        elif word_at[i + 1] > word_at[i]:
            out.append(np.array([textvec.whole(hashes[word_at[i] : word_at[i + 1]])], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.astype("<u8").tobytes(), digest_size=16).digest()


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame, width: int = 5) -> np.ndarray:
    """Documents per bucket of shingles: 2**SKETCH_BITS counts, whatever the size of the corpus."""

    def count(batches):
        total = None
        for batch in slices(batches):
            total = np.zeros(1 << SKETCH_BITS, dtype=np.int32) if total is None else total
            np.add.at(total, _bucket(np.concatenate(shingle_sets(batch.column(0), width))), 1)
        if total is not None:
            parts = [zlib.compress(p.astype("<i8").tobytes(), 1) for p in total.reshape(-1, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(b), dtype="<i8")
                totals[k] = totals[k] + got if k in totals else got
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], ["chunk", "counts"])

    chunks = (1 << SKETCH_BITS) // CHUNK
    parts = docs.select("text").mapInArrow(count, "chunk int, counts binary").repartition(16, "chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros((chunks, CHUNK), dtype=np.int64)
    with small_batches(docs.sparkSession):
        for r in parts.collect():  # 256 rows of 128 KB
            out[r["chunk"]] += np.frombuffer(r["counts"], dtype="<i8")
    return out.ravel()


def overlap(n: int, m: int, num: int, den: int) -> int:
    """The least intersection of sets of n and m with Jaccard >= num / den."""
    return -(-num * (n + m) // (num + den))


def signatures(docs: DataFrame, counts: np.ndarray, num: int, den: int, width: int = 5) -> DataFrame:
    """doc_id, n, key (of the set), its class hash, prefix: the first n - ceil(t n) + 1 shingles in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))

    def make():
        known = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(1), width)
            keys, prefixes = [], []
            for s in sets:
                keys.append(set_key(s))
                if len(s):
                    order = np.lexsort((s, known[_bucket(s)]))
                    prefixes.append(s[order[: len(s) - -(-num * len(s) // den) + 1]].view(np.int64))
                else:
                    prefixes.append(np.zeros(0, dtype=np.int64))
            ends = np.cumsum([0, *map(len, prefixes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes), pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            classes = pa.array(np.frombuffer(b"".join(k[:8] for k in keys), dtype="<i8"))
            return pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(keys, pa.binary()), classes, lists], ["doc_id", "n", "key", "class", "prefix"])

        return step

    return map_batches(docs, make, "doc_id long, n long, key binary, class long, prefix array<long>")


class Lists:
    """Inverted lists over a group's sets, searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        who = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.who = tokens[order], who[order]
        self.tokens, first = np.unique(tokens, return_index=True)
        self.first = np.append(first, len(tokens))

    def search(self, x: int, num: int, den: int) -> dict[int, int]:
        """{set: overlap with x} of all sets whose Jaccard with set x is num / den or more, x included.

        T is the least overlap any such set needs. The longest lists are set aside, the short ones are
        merged by a heap, and ids found T - L times are probed in the long lists by binary search.
        """
        n = int(self.sizes[x])
        least = max(1, -(-num * n // den))
        at = np.searchsorted(self.tokens, self.sets[x])
        length = self.first[at + 1] - self.first[at]
        at = at[np.argsort(length, kind="stable")]
        aside = min(least - 1, int(least / (0.0085 * math.log2(int(length.max()) + 1) + 1)))
        lists = [self.who[self.first[k] : self.first[k + 1]] for k in at.tolist()]
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        if len(self.sets) > 48:
            return self._search_arrays(x, num, den, least - aside, short, long)
        found: dict[int, int] = {}
        last, seen = -1, 0
        long = [one.tolist() for one in long]
        for i in [*heapq.merge(*(one.tolist() for one in short)), -1]:
            if i == last:
                seen += 1
                continue
            if last >= 0 and seen >= least - aside:
                need = overlap(n, int(self.sizes[last]), num, den)
                total = seen
                for k, one in enumerate(long):
                    if total + len(long) - k < need:
                        break
                    p = bisect_left(one, last)
                    total += p < len(one) and one[p] == last
                if total >= need:
                    found[last] = total
            last, seen = i, 1
        return found

    def _search_arrays(self, x: int, num: int, den: int, least: int, short: list[np.ndarray], long: list[np.ndarray]) -> dict[int, int]:
        """The same search with arrays: a stable sort merges the short lists' runs, all candidates are
        probed in a long list at once, and those that can't reach their overlap any more are let go."""
        merged = np.sort(np.concatenate(short), kind="stable")
        start = np.flatnonzero(np.append([True], merged[1:] != merged[:-1]))
        seen = np.diff(np.append(start, len(merged)))
        some = seen >= least
        ids, total = merged[start[some]], seen[some]
        need = -(-num * (self.sizes[ids] + self.sizes[x]) // (num + den))
        for k, one in enumerate(long):
            if k % 16 == 0:
                able = total + len(long) - k >= need
                ids, total, need = ids[able], total[able], need[able]
                if not len(ids):
                    return {}
            p = np.searchsorted(one, ids)
            total = total + (one[np.minimum(p, len(one) - 1)] == ids)
        enough = total >= need
        return dict(zip(ids[enough].tolist(), total[enough].tolist(), strict=True))


def linked(sets: list[np.ndarray], num: int, den: int, apart: np.ndarray | None = None, queries: np.ndarray | None = None) -> list[int]:
    """The component of each set, as the least position in it, by T-occurrence searches.

    apart: positions known to share a component already carry equal values (or -1). queries: the positions
    whose links are wanted, instead of all.
    """
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(a: int, b: int) -> None:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    if apart is not None:
        first: dict[int, int] = {}
        for i, a in enumerate(apart.tolist()):
            if a >= 0:
                join(i, first.setdefault(a, i))
    lists = Lists(sets)
    reach = den - num  # distance of a link, in parts of den
    ring = (max(0, den - 2 * reach), den) if 2 * reach < den else (1, 10**9)
    done: set[int] = set()  # sets whose links all lie in their component already
    idle = 0  # wider searches in a row that settled few other sets
    for x in range(len(sets)) if queries is None else queries.tolist():
        if x in done:
            continue
        wide = idle < 3
        near: list[tuple[int, int, int]] = []
        far_least: tuple[int, int] | None = None  # the least distance of an open set in the ring, as a fraction
        for y, both in lists.search(x, *(ring if wide else (num, den))).items():
            union = int(lists.sizes[x] + lists.sizes[y]) - both
            if den * both >= num * union:
                near.append((y, union - both, union))
                if y != x:
                    join(x, y)
            elif y not in done and (far_least is None or (union - both) * far_least[1] < far_least[0] * union):
                far_least = (union - both, union)
        done.add(x)
        if wide:
            before = len(done)
            for y, differ, union in near:
                # d(y, z) >= d(x, z) - d(x, y): z of the ring can link to y only if that is within reach
                if far_least is None or far_least[0] * union * den - differ * far_least[1] * den > reach * far_least[1] * union:
                    done.add(y)
            idle = idle + 1 if len(near) > 2 and 2 * (len(done) - before) < len(near) - 1 else 0
    return [root(i) for i in range(len(sets))]


def _list_links(token: np.ndarray, cls: np.ndarray, meta: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (u, v, of a star) of postings by ascending token. meta: size << 32 | position in the prefix, or HOT.

    A list of at most SHORT postings gives its pairs whose sizes and positions allow enough overlap; a
    longer one, or one that holds a HOT posting, is linked as a star to its first member.
    """
    first = np.ones(len(token), dtype=bool)
    first[1:] = token[1:] != token[:-1]
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(token)))
    long = (length > SHORT) | (np.minimum.reduceat(meta, start) < 0) if len(start) else np.zeros(0, dtype=bool)
    which = np.repeat(np.arange(len(start)), length)
    star = long[which]
    us, vs, kinds = [cls[star]], [cls[start[which[star]]]], [np.ones(int(star.sum()), dtype=np.int64)]
    rest = ~star & (length > 1)[which]
    cls, which, n, at = cls[rest], which[rest], meta[rest] >> 32, meta[rest] & 0xFFFFFFFF
    for k in range(1, min(SHORT, len(cls))):
        same = np.flatnonzero(which[k:] == which[:-k])
        if not len(same):
            break
        a, b = same, same + k
        least = -(-num * (n[a] + n[b]) // (num + den))
        ok = (np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num) & (1 + np.minimum(n[a] - at[a], n[b] - at[b]) - 1 >= least)
        us.append(np.minimum(cls[a[ok]], cls[b[ok]]))
        vs.append(np.maximum(cls[a[ok]], cls[b[ok]]))
        kinds.append(np.zeros(int(ok.sum()), dtype=np.int64))
    u, v, of_star = np.concatenate(us), np.concatenate(vs), np.concatenate(kinds)
    return u[u != v], v[u != v], of_star[u != v]


def candidate_links(signed: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v, star) of class hashes. Any two classes that can reach num / den are a link with star 0,
    or are joined by links with star 1."""
    kind = "token long, u long, v long, meta long"

    def rows(names, *columns):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, dtype=np.int64)) for c in columns], names)

    def spread(batches):
        for batch in slices(batches):
            n = batch.column(1).to_numpy()
            ends = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            token = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), ends)
            at = np.arange(len(token)) - np.repeat(np.cumsum(ends) - ends, ends)
            order = np.argsort(token, kind="stable")
            token, cls, meta = token[order], batch.column(0).to_numpy()[row][order], (n[row] << 32 | at)[order]
            start = np.flatnonzero(np.append([True], token[1:] != token[:-1])) if len(token) else np.zeros(0, dtype=np.int64)
            length = np.diff(np.append(start, len(token)))
            hot = length > SHORT
            mine = np.repeat(hot, length)
            u, v = cls[mine], np.repeat(cls[start[hot]], length[hot])
            if len(u):
                u, v = np.unique(np.stack([u, v])[:, u != v], axis=1)
            lead = start[hot]
            yield rows(
                ["token", "u", "v", "meta"], np.concatenate([token[~mine], token[lead], u]), np.concatenate([cls[~mine], cls[lead], u]),
                np.concatenate([np.zeros((~mine).sum() + len(lead), dtype=np.int64), v]), np.concatenate([meta[~mine], np.full(len(lead), HOT), np.full(len(u), LINK)]),
            )

    names = ["u", "v", "star"]

    def gather(batches):
        held = [np.zeros(0, dtype=np.int64)] * 3  # the last token's postings, whose list may go on
        for batch in batches:
            token, u, v, meta = (c.to_numpy() for c in batch.columns)
            link = meta == LINK
            yield rows(names, u[link], v[link], np.ones(int(link.sum())))
            token, cls, meta = (np.concatenate([h, x[~link]]) for h, x in zip(held, (token, u, meta), strict=True))
            if len(token):
                cut = np.searchsorted(token, token[-1])
                yield rows(names, *_list_links(token[:cut], cls[:cut], meta[:cut], num, den))
                held = [token[cut:], cls[cut:], meta[cut:]]
                if len(held[0]) > 4 * SHORT:
                    yield rows(names, *_list_links(*held, num, den))
                    held = [held[0][:1], held[1][:1], np.array([HOT])]
        yield rows(names, *_list_links(*held, num, den))

    sent = signed.filter("n > 0 AND doc_id IS NOT NULL").select("class", "n", "prefix").mapInArrow(spread, kind)
    return sent.repartition("token").sortWithinPartitions("token", "meta", "u").mapInArrow(gather, "u long, v long, star long").distinct()


def _link_table(reps: list[int], found: list[int]) -> pa.Table:
    pairs = [(reps[i], reps[r]) for i, r in enumerate(found) if i != r]
    return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})


def _search_texts(members: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """Links (u, v) as stars, from rows (grp, rep, key, text)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        sets = shingle_sets(table.column("text").combine_chunks(), width)
        mine = [i for i, k in enumerate(table.column("key").to_pylist()) if set_key(sets[i]) == k]
        reps = table.column("rep").to_pylist()
        return _link_table([reps[i] for i in mine], linked([sets[i] for i in mine], num, den))

    return members.select("grp", "rep", "key", "text").groupBy("grp").applyInArrow(run, "u long, v long")


def _search_sets(members: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """Links (u, v) as stars, from rows (keys..., rep, tokens binary, held long: a known component or null).
    Of two blocks a and b of a group, the sets of block a (`own`) are searched for."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        sets = [np.frombuffer(b, dtype="<u8") for b in table.column("tokens").to_pylist()]
        held = np.array([-1 if h is None else h for h in table.column("held").to_pylist()], dtype=np.int64)
        asked = np.flatnonzero(table.column("own").to_numpy() == table.column("a").to_numpy()) if "own" in table.column_names else None
        return _link_table(table.column("rep").to_pylist(), linked(sets, num, den, held, asked))

    # dealt by all keys: a join on the first of them would leave the parts of a group in one task
    return members.repartition(*keys).groupBy(*keys).applyInArrow(run, "u long, v long")


def _sets_of(members: DataFrame, width: int) -> DataFrame:
    """(class, rep, n, tokens) from (class, rep, key, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(3), width)
            mine = [i for i, k in enumerate(batch.column(2).to_pylist()) if set_key(sets[i]) == k]
            kept = batch.take(pa.array(mine, pa.int64()))
            tokens = [sets[i] for i in mine]
            columns = [*kept.columns[:2], pa.array([len(t) for t in tokens], pa.int64()), pa.array([t.astype("<u8").tobytes() for t in tokens], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["class", "rep", "n", "tokens"])

        return step

    return map_batches(members.select("class", "rep", "key", "text"), make, "class long, rep long, n long, tokens binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The links (u, v) among candidate pairs (u, v) of classes: each u with its candidates is one search.

    A query's set comes first in its run of rows, its candidates after it, a slice at a time; they are at
    most SHORT for each shingle of its prefix.
    """
    whole = sets.select(F.col("class").alias("q"), F.lit(0).alias("side"), "rep", "tokens")
    asked = whole.join(pairs.select(F.col("u").alias("q")).distinct(), "q", "left_semi")
    offered = pairs.select(F.col("u").alias("q"), F.col("v").alias("class")).join(sets, "class").select("q", F.lit(1).alias("side"), "rep", "tokens")

    def run(batches):
        query, mine = None, []  # class, and its (rep, set): more than one where hashes collide
        for batch in slices(batches):
            q, side, rep = (batch.column(i).to_numpy() for i in range(3))
            tokens = batch.column(3).to_pylist()
            start = np.flatnonzero(np.append([True], (q[1:] != q[:-1]) | (side[1:] != side[:-1])))
            us, vs = [], []
            for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(q)], strict=True):
                if query != q[lo]:
                    query, mine = q[lo], []
                sets_ = [np.frombuffer(b, dtype="<u8") for b in tokens[lo:hi]]
                if side[lo] == 0:
                    mine += zip(rep[lo:hi].tolist(), sets_, strict=True)
                    continue
                for own, x in mine:
                    for i in Lists([x, *sets_]).search(0, num, den):
                        if i and rep[lo + i - 1] != own:
                            us.append(own)
                            vs.append(int(rep[lo + i - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return asked.unionByName(offered).repartition("q").sortWithinPartitions("q", "side", "rep").mapInArrow(run, "u long, v long")


def _meet_leaders(members: DataFrame, num: int, den: int, part_shingles: int) -> tuple[DataFrame, DataFrame]:
    """One round for large groups: (links found, members still open).

    The leader of a group is its least set not yet in a component. All sets of the group meet it in one
    join, dealt in parts of about part_shingles. Groups where every set is within reach of the leader are
    settled in one round. Groups without such a set are left as they are: sets held by different leaders
    may still link.
    """
    reach = (den - num) / den
    least = F.min(F.when(F.col("held").isNull(), F.col("rep"))).alias("rep")
    loose = members.groupBy("grp").agg(least, F.ceil(F.sum("n") / part_shingles).cast("int").alias("parts")).filter("rep IS NOT NULL")
    leader = members.join(loose, ["grp", "rep"]).select("grp", F.col("rep").alias("lead"), F.col("tokens").alias("lead_tokens"), "parts")
    leader = leader.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for a, b in zip(batch.column(4).to_pylist(), batch.column(6).to_pylist(), strict=True):
                a, b = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append((both, len(a) + len(b) - both))
            return pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["grp", "rep", "n", "held", "tokens", "lead", "both", "union"])

        return step

    dealt = members.join(loose.select("grp", "parts"), "grp").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    met = dealt.join(leader, ["grp", "part"]).select("grp", "rep", "n", "held", "tokens", "lead", "lead_tokens")
    met = written(map_batches(met, make, "grp long, rep long, n long, held long, tokens binary, lead long, both long, union long"), "met")
    near = F.col("both") * den >= F.col("union") * num
    away = 1 - F.col("both") / F.col("union")
    links = met.filter(near & (F.col("rep") != F.col("lead"))).select(F.col("rep").alias("u"), F.col("lead").alias("v"))
    ring = met.filter(~near & (F.col("rep") != F.col("lead"))).groupBy("grp").agg(F.min(away).alias("least"))
    left = met.filter(F.col("rep") != F.col("lead")).join(ring, "grp")
    left = left.filter(~near | (away >= F.col("least") - reach - 1e-9))
    held = F.when(near, F.coalesce(F.col("held"), F.col("lead"))).otherwise(F.col("held"))
    left = left.select("grp", "rep", "n", held.alias("held"), "tokens")
    return links, written(left.unionByName(members.join(loose, "grp", "left_anti").select(*left.columns)), "left")


def links_in_dense(members: DataFrame, num: int, den: int, group_shingles: int, rounds: int = 3) -> DataFrame:
    """Links (u, v) of members (grp, rep, n, held, tokens): leaders first, then pairs of blocks."""
    large, links = written(members, "members"), []
    for _ in range(rounds):
        more, large = _meet_leaders(large, num, den, max(1, group_shingles // 8))
        links.append(more)
        if large.isEmpty():
            break
    sizes = large.groupBy("grp").agg(F.sum("n").alias("total"))
    # SPLIT small blocks for a middling group, blocks of half the bound for a large one
    blocks = F.greatest(F.ceil(2 * F.col("total") / group_shingles), F.least(F.lit(SPLIT), F.ceil(8 * F.col("total") / group_shingles))).cast("int")
    dealt = large.join(sizes, "grp").withColumn("blocks", blocks)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other"))
    out = _search_sets(dealt.drop("total", "blocks", "other"), ["grp", "a", "b"], num, den)
    for more in links:
        out = out.unionByName(more)
    return out


def links_in_large(sets: DataFrame, candidates: DataFrame, num: int, den: int, group_shingles: int) -> DataFrame:
    """Links (u, v) of the sets (class, rep, n, tokens) of large groups, along candidates (u, v, star) of
    classes: pairs query by query, and searches in what stars join."""
    sets = written(sets, "sets")
    known = sets.select("class").distinct()
    inside = written(candidates.join(known, candidates["u"] == known["class"], "left_semi"), "inside")
    dense = written(components(inside.filter("star = 1").select("u", "v")), "dense")
    one, two = dense.select(F.col("node").alias("u"), F.col("component").alias("_gu")), dense.select(F.col("node").alias("v"), F.col("component").alias("_gv"))
    pairs = inside.filter("star = 0").join(one, "u", "left").join(two, "v", "left").filter("_gu IS NULL OR _gv IS NULL OR _gu <> _gv").select("u", "v")
    members = sets.join(dense.select(F.col("node").alias("class"), F.col("component").alias("grp")), "class").select("grp", "rep", "n", F.lit(None).cast("long").alias("held"), "tokens")
    totals = written(members.groupBy("grp").agg(F.sum("n").alias("total")), "totals")
    members = members.join(totals, "grp")
    links = _verified(written(pairs, "pairs"), sets, num, den)
    links = links.unionByName(_search_sets(members.filter(F.col("total") <= group_shingles).drop("total"), ["grp"], num, den))
    if not totals.filter(F.col("total") > group_shingles).isEmpty():
        links = links.unionByName(links_in_dense(members.filter(F.col("total") > group_shingles).drop("total"), num, den, group_shingles))
    return links


def keyed_components(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, n, key (of the set), component (the least doc_id reachable by links of Jaccard >= num / den)."""
    docs = docs_of(docs)
    signed = written(signatures(docs, sketch(docs, width), num, den, width), "signed")
    classes = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("class").alias("class"), F.first("n").alias("n"))
    candidates = written(candidate_links(signed, num, den), "candidates")
    groups = components(candidates.select("u", "v")).select(F.col("node").alias("class"), F.col("component").alias("grp"))
    members = written(classes.join(groups, "class").select("key", "class", "rep", "n", "grp"), "groups")
    totals = members.groupBy("grp").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    totals = written(totals.select("grp", "total"), "totals")
    wanted = members.join(totals, "grp").select("key", "class", "rep", "grp", "total").hint("merge")
    # written, as small and large groups are read from it
    texts = written(docs.join(wanted, docs["doc_id"] == wanted["rep"]).select("grp", "class", "rep", "key", "text", "total"), "texts")
    links = _search_texts(texts.filter(F.col("total") <= group_shingles), num, den, width)
    if not totals.filter(F.col("total") > group_shingles).isEmpty():
        links = links.unionByName(links_in_large(_sets_of(texts.filter(F.col("total") > group_shingles), width), candidates, num, den, group_shingles))
    # merged at every size: a broadcast would leave `named` dealt by key below an aggregation, and a key with many rows could not be split in the last join
    found = components(links).withColumnRenamed("node", "rep").hint("merge")
    named = classes.join(found, "rep", "left").select("key", F.coalesce("component", "rep").alias("_c"))
    out = signed.select("doc_id", "n", "key").join(named, "key", "left")
    return out.select("doc_id", "n", "key", F.when(F.col("n") > 0, F.col("_c")).otherwise(F.col("doc_id")).alias("component"))


def near_components(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id, for every row of docs; how: as for keyed_components()."""
    return keyed_components(docs, **how).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def drop_near(docs: DataFrame, width: int = 5, **how) -> DataFrame:
    """docs with one document of each component, all columns as they came: the one with the least doc_id
    and, where this id has several texts in the component, the least set key; of repeated rows one. Rows
    without words stay, and so do rows with a null doc_id whose set no document has."""
    found = written(keyed_components(docs, width=width, **how), "near")
    first = found.filter("n > 0 AND doc_id = component").groupBy("component").agg(F.min("key").alias("key"))
    stay = first.select(F.col("component").alias("kept_id"), F.col("key").alias("kept_key"), F.lit(True).alias("one"))
    bare = found.filter("n = 0 OR (doc_id IS NULL AND component IS NULL)").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"), F.lit(False).alias("one"))
    return pick_rows(docs, found, stay.unionByName(bare.distinct()), lambda texts: [set_key(s) for s in shingle_sets(texts, width)])
