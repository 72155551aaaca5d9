"""Approximate membership and the access paths composed with it."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 10
MOST_BITS = 1 << 28  # a filter is one row that every task gets; beyond 32 MB use the exact semi-join


def bits_for(fpr: float) -> int:
    """Bits a key for a false-positive rate."""
    return math.ceil(-math.log(fpr) / 0.693**2)


def hashes_for(bits_per_key: int) -> int:
    return max(1, math.ceil(0.693 * bits_per_key))


def expected_fpr(n: Column, bits: Column, hashes: Column) -> Column:
    """(1 - exp(-k n / m)) ** k, and 0 for an empty filter."""
    return F.when(n == 0, F.lit(0.0)).otherwise(F.pow(1 - F.exp(-hashes * n / bits), hashes.cast("double")))


@dataclass
class Bloom:
    """A Bloom filter as a one-row table of bit words, built by an aggregation and probed by expressions.

    It may say maybe for a key it does not hold, and never no for one it does. Null keys are not held.
    """

    words: DataFrame  # (word, bits): only words with a bit set
    items: int
    bits: int
    hashes: int
    taken_back: DataFrame | None = None  # (key): keys of transactions that were rolled back after they were inserted

    @staticmethod
    def build(df: DataFrame, key: str, items: int, bits_per_key: int = BITS_PER_KEY, hashes: int | None = None) -> Bloom:
        bits = max(64, -(-items * bits_per_key // 64) * 64)
        if bits > MOST_BITS:
            raise ValueError(f"{bits} bits are more than one task should hold; use an exact semi-join")
        k = hashes or hashes_for(bits_per_key)
        at = df.filter(F.col(key).isNotNull()).select(F.explode(_positions(F.col(key), bits, k)).alias("_p"))
        return Bloom(_words(at), items, bits, k)

    def merge(self, other: Bloom) -> Bloom:
        if (self.bits, self.hashes) != (other.bits, other.hashes):
            raise ValueError("filters of different shape")
        both = self.words.unionByName(other.words).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        gone = [b.taken_back for b in (self, other) if b.taken_back is not None]
        return Bloom(both, self.items, self.bits, self.hashes, gone[0].unionByName(gone[1]).distinct() if len(gone) == 2 else gone[0] if gone else None)

    def insert(self, df: DataFrame, key: str) -> Bloom:
        """The filter with more keys, which are held from now on even if they had been taken back."""
        k = _positions(F.col(key), self.bits, self.hashes)
        out = self.merge(Bloom(_words(df.filter(F.col(key).isNotNull()).select(F.explode(k).alias("_p"))), self.items, self.bits, self.hashes))
        return out.confirm(df, key)

    def roll_back(self, df: DataFrame, key: str) -> Bloom:
        """The filter after the insertion of keys was rolled back: bits can't be unset, so the keys are remembered."""
        gone = df.select(F.col(key).alias("key")).filter("key IS NOT NULL")
        return replace(self, taken_back=(gone if self.taken_back is None else self.taken_back.unionByName(gone)).distinct())

    def confirm(self, df: DataFrame, key: str) -> Bloom:
        """Keys that were taken back count as held again."""
        if self.taken_back is None:
            return self
        return replace(self, taken_back=self.taken_back.join(df.select(F.col(key).alias("key")), "key", "left_anti"))

    def taken_back_count(self) -> int:
        return 0 if self.taken_back is None else self.taken_back.count()

    def vacuum(self, members: DataFrame, key: str) -> Bloom:
        """The filter built again from its members, without those taken back."""
        kept = members if self.taken_back is None else members.join(self.taken_back, members[key] == self.taken_back["key"], "left_anti")
        return Bloom(_words(kept.filter(F.col(key).isNotNull()).select(F.explode(_positions(F.col(key), self.bits, self.hashes)).alias("_p"))), self.items, self.bits, self.hashes)

    def clear(self) -> Bloom:
        """A filter of the same shape that holds nothing."""
        return Bloom(self.words.limit(0), self.items, self.bits, self.hashes)

    def verify(self) -> DataFrame:
        """(problem, n): words outside the filter, words said twice, and words without a bit."""
        outside = F.count_if(~F.col("word").between(0, self.bits // 64 - 1)).alias("outside")
        n = self.words.agg(outside, (F.count(F.lit(1)) - F.countDistinct("word")).alias("repeated"), F.count_if(F.col("bits") == 0).alias("bare"))
        return n.unpivot([], ["outside", "repeated", "bare"], "problem", "n")

    def _dense(self) -> Column:
        """All words in one array, as a scalar subquery that runs once."""
        spark = self.words.sparkSession
        every = spark.range(self.bits // 64).withColumnRenamed("id", "word").join(self.words, "word", "left")
        row = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("a"))
        return row.select(F.transform("a", lambda x: x["bits"]).alias("a")).scalar()

    def probe(self, df: DataFrame, key: str, out: str = "maybe") -> DataFrame:
        """df with whether the filter may hold the key."""
        rows = df.withColumn("_words", self._dense())
        hit = F.forall(_positions(F.col(key), self.bits, self.hashes), lambda p: F.get(F.col("_words"), F.floor(p / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int"))) != 0)
        rows = rows.withColumn(out, F.coalesce(hit, F.lit(False))).drop("_words")
        if self.taken_back is None:
            return rows
        gone = self.taken_back.select(F.col("key").alias("_gone")).distinct()
        return rows.join(gone, rows[key] == gone["_gone"], "left").withColumn(out, F.col(out) & F.col("_gone").isNull()).drop("_gone")

    def stats(self) -> DataFrame:
        """items, bits, hashes, set bits and the share of bits set."""
        ones = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))
        return self.words.agg(F.lit(self.items).alias("items"), F.lit(self.bits).alias("bits"), F.lit(self.hashes).alias("hashes"), ones.alias("ones"), F.round(ones / self.bits, 6).alias("fill"))


def _words(at: DataFrame) -> DataFrame:
    """(word, bits) of bit positions (_p)."""
    word = at.select(F.expr("_p div 64").alias("word"), F.expr("shiftleft(1L, cast(_p % 64 as int))").alias("b"))
    return word.groupBy("word").agg(F.bit_or("b").alias("bits"))


def _positions(key: Column, bits: int, hashes: int) -> Column:
    return F.when(key.isNotNull(), F.array(*(F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(hashes))))


@dataclass
class Member:
    """Keys that a composite asks for. A Bloom filter over them answers first, before anything is shuffled;
    `keys`, where given, settle what it lets through, so that the answer is exact."""

    bloom: Bloom | None = None
    keys: DataFrame | None = None

    @staticmethod
    def of(keys: DataFrame, items: int, key: str = "key") -> Member:
        return Member(Bloom.build(keys, key, items), keys)

    def only(self, df: DataFrame, key: str) -> DataFrame:
        if self.bloom is not None:
            df = self.bloom.probe(df, key, "_maybe").filter("_maybe").drop("_maybe")
        return df if self.keys is None else df.join(self.keys.select(key), key, "left_semi")


@dataclass
class Composite:
    """A primary table (key, value) with members that are asked before or after it."""

    primary: DataFrame
    before: list[Member] = field(default_factory=list)
    after: list[Member] = field(default_factory=list)
    alternatives: list[Member] = field(default_factory=list)
    key: str = "key"

    def bloom_first(self, keys: DataFrame) -> DataFrame:
        """(key, value): every member in front says maybe, then the primary is read."""
        return self._all(keys, self.before).join(self.primary, self.key)

    def primary_first(self, keys: DataFrame) -> DataFrame:
        """(key, value): the primary is read, then members behind it may veto."""
        return self._all(keys.join(self.primary, self.key), self.after)

    def parallel(self, keys: DataFrame) -> DataFrame:
        """(key, value, tables_consulted): a value only where all agree."""
        tables = [*self.before, *self.after]
        return self._all(keys.join(self.primary, self.key), tables).withColumn("tables_consulted", F.lit(1 + len(tables)))

    def sequential(self, keys: DataFrame) -> DataFrame:
        """(key, value): the primary's value for each key, null where it has none; alternatives hold no values."""
        return keys.join(self.primary, self.key, "left")

    def might_contain(self, keys: DataFrame) -> DataFrame:
        """(key, maybe): true where all members in front say so, or there are none."""
        if not self.before:
            return keys.withColumn("maybe", F.lit(True))
        hit = self._all(keys, self.before).select(self.key).distinct().withColumn("maybe", F.lit(True))
        return keys.join(hit, self.key, "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))

    def trace(self, keys: DataFrame) -> DataFrame:
        """(key, found, pre_filtered, tables_consulted) of bloom_first."""
        maybe = self.might_contain(keys)
        have = self.primary.select(self.key).distinct().withColumn("_have", F.lit(True))
        out = maybe.join(have, self.key, "left")
        n = F.lit(len(self.before)) + F.when(F.col("maybe"), 1).otherwise(0)
        return out.select(self.key, (F.col("maybe") & F.coalesce("_have", F.lit(False))).alias("found"), (~F.col("maybe")).alias("pre_filtered"), n.alias("tables_consulted"))

    def _all(self, df: DataFrame, members: list[Member]) -> DataFrame:
        for m in members:
            df = m.only(df, self.key)
        return df
