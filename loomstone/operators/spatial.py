"""Bounding-box geometry: intersections, nearest, grid joins, tiles and well-known binary."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomstone.functions.boxes import Box, intersects
from loomstone.operators import bands, mvcc
from loomstone.sources.shared import checkpointed

COLUMNS = ("min_x", "min_y", "max_x", "max_y")
#: Of a box join: left and right rows of a block, cuts of a cell into blocks at most, and partitions at most (beyond, blocks share them).
BLOCKS, MARKS, MOST_PARTITIONS = (1 << 14, 1 << 12), 1024, 10_000


def hits(df: DataFrame, box: tuple[float, float, float, float], limit: int | None = None) -> DataFrame:
    """Rows whose box meets the query box; the comparisons are pushed into the scan."""
    out = df.filter(intersects(Box.of(), Box.lit(*box)))
    return out if limit is None else out.limit(limit)


def nearest(df: DataFrame, x: float, y: float, k: int, key: str = "id") -> DataFrame:
    """(key, distance) of the k boxes nearest to a point, ties by key."""
    return df.select(key, Box.of().distance(F.lit(float(x)), F.lit(float(y))).alias("distance")).orderBy("distance", key).limit(k)


def box_join(left: DataFrame, right: DataFrame, cell: float, lid: str = "id", rid: str = "id", ordered: bool = False, blocks: tuple[int, int] = BLOCKS) -> DataFrame:
    """(left_id, right_id) of boxes that meet, by an equi-join on grid cells; of ordered ids, which are
    numbers then, pairs with left_id < right_id only.

    A box is dealt to the cells it covers; a pair is reported only from the cell that holds the lower
    left corner of the common box, so no distinct is needed. Cells should be about as large as boxes.

    Where a cell holds more than a block of either side, both sides are cut into blocks (by a hash, or by id
    if ordered, so that most pairs of blocks hold no pair or are in order throughout), and any two blocks meet
    in a task of their own. A task so holds one block of right rows, however many boxes a cell has. Its rows
    come out by left row and in an order of sizes and places, so columns of ids take few bytes.
    """
    order = lambda p: F.col(f"{p}id") if ordered else F.xxhash64(*(f"{p}{c}" for c in ("id", *COLUMNS)))

    def dealt(df: DataFrame, key: str, p: str) -> DataFrame:
        b = [F.col(c).cast("double") for c in COLUMNS]
        span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
        out = df.filter(F.col("min_x") <= F.col("max_x")).filter(F.col("min_y") <= F.col("max_y"))
        out = out.select(F.col(key).alias(f"{p}id"), *(c.alias(f"{p}{n}") for c, n in zip(b, COLUMNS, strict=True)), span(b[0], b[2]).alias("cx"))
        return out.withColumn("cy", span(F.col(f"{p}min_y"), F.col(f"{p}max_y")))

    def cells(df: DataFrame, p: str, most: int) -> DataFrame:
        """For each cell, what each of its blocks lies above; null for the first."""
        each = df.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / most).alias("_n"), F.percentile_approx(order(p), [i / MARKS for i in range(1, MARKS)]).alias("_m"))
        n = F.least("_n", F.lit(MARKS))
        above = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("_m", (F.floor(i * MARKS / n) - 1).cast("int")))
        return each.select("cx", "cy", above.alias(f"{p}above"))

    a, b, keys = dealt(left, lid, "l_"), dealt(right, rid, "r_"), ["cx", "cy"]
    n = F.array_size("l_above").cast("long") * F.array_size("r_above")
    crowded = cells(a, "l_", blocks[0]).join(cells(b, "r_", blocks[1]), keys).filter(n > 1)
    crowded = checkpointed(crowded.withColumn("_end", F.sum(n).over(Window.orderBy("cx", "cy"))).withColumn("_from", F.col("_end") - n))
    if pairs := crowded.agg(F.max("_end")).first()[0]:
        rest = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # for cells of one block
        partitions = min(pairs + rest, MOST_PARTITIONS)

        def cut(df: DataFrame, p: str, other: str, sort: str) -> DataFrame:
            out = df.join(F.broadcast(crowded), keys, "left").withColumn("_o", order(p))
            out = out.withColumn(f"{p}b", F.coalesce(F.array_size(F.filter(f"{p}above", lambda v: v < F.col("_o"))), F.lit(0)))
            some = F.sequence(F.lit(0), F.coalesce(F.array_size(f"{other}above"), F.lit(1)) - 1)
            if ordered:  # the left block's ids begin below the end of the right block's
                begins, ends = (lambda i: F.get("l_above", i)), (lambda i: F.get("r_above", i + 1))
                some = F.filter(some, lambda i: F.coalesce(begins(F.col("l_b")) < ends(i) if p == "l_" else begins(i) < ends(F.col("r_b")), F.lit(True)))
            out = out.withColumn(f"{other}b", F.explode(some))
            place = F.coalesce(F.col("_from") + F.col("l_b") * F.array_size("r_above") + F.col("r_b"), pairs + F.pmod(F.xxhash64(*keys), F.lit(rest)))
            out = out.withColumn("part", F.pmod(place, F.lit(partitions)).cast("int")).select("part", *keys, "l_b", "r_b", *df.columns[:5])
            size = [F.floor((F.col(f"{p}max_{c}") - F.col(f"{p}min_{c}")) / cell * 16) for c in "xy"]
            out = out.repartitionById(partitions, F.col("part")).sortWithinPartitions("part", *keys, "l_b", "r_b", *size, f"{p}{sort}")
            return out.withColumn("_row", F.monotonically_increasing_id()).filter("_row >= 0").drop("_row")  # else the optimizer drops an order below a join

        a, b, keys = cut(a, "l_", "r_", "min_y"), cut(b, "r_", "l_", "min_x").hint("merge"), ["part", *keys, "l_b", "r_b"]
    met = a.join(b, keys)
    common = Box.of(*(f"l_{c}" for c in COLUMNS)).overlap(Box.of(*(f"r_{c}" for c in COLUMNS)))
    own = (F.floor(common.x1 / cell) == F.col("cx")) & (F.floor(common.y1 / cell) == F.col("cy"))
    if ordered:
        own &= F.col("l_id") < F.col("r_id")
    return met.filter(common.valid() & own).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))


def _ntile(rank: Column, total: Column, tiles: int) -> Column:
    """The tile, from 1, of a rank, from 0, when `total` rows are dealt to tiles whose sizes differ by one at most."""
    small, over = F.call_function("div", total, F.lit(tiles)), F.pmod(total, F.lit(tiles))
    edge = over * (small + 1)
    return F.when(rank < edge, F.call_function("div", rank, small + 1)).otherwise(over + F.call_function("div", rank - edge, small)) + 1


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with its place in an order (`rank`, from 0) and the number of rows (`total`), in many tasks."""
    return bands.running(df, F.lit(1), *order).withColumn("rank", F.col("running") - 1).drop("running")


def str_tiles(df: DataFrame, slices: int, per_slice: int, key: str = "id") -> DataFrame:
    """Sort-tile-recursive tiles by centre: (key, slice, tile). Slices are cut by rank in x, found range by
    range; a slice is tiled by rank in y, slice by slice."""
    cx, cy = Box.of().center()
    rows = ranked(df.select(key, cx.alias("_x"), cy.alias("_y")), "_x", "_y", key)
    rows = rows.withColumn("slice", _ntile(F.col("rank"), F.col("total"), slices)).drop("rank", "total")
    rows = rows.withColumn("tile", F.ntile(per_slice).over(Window.partitionBy("slice").orderBy("_y", "_x", key)))
    return rows.select(key, F.col("slice").cast("long").alias("slice"), F.col("tile").cast("long").alias("tile"))


def visible(log: DataFrame, lsn: int, key: str = "id") -> DataFrame:
    """The boxes of a change log (id, four box columns, is_deleted, txn_id, commit_lsn, seq) as of lsn."""
    return mvcc.visible(log, lsn, keys=(key,))


def insert(df: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """df with new boxes, which take the place of boxes of the same key."""
    return remove(df, new, key).unionByName(new.select(*df.columns))


def insert_wkb(df: DataFrame, new: DataFrame, key: str = "id", wkb: str = "wkb") -> DataFrame:
    """df with the boxes of geometries (key, wkb); those that can't be read are left out."""
    made = new.select(key, wkb_boxes(F.col(wkb)).alias("_m")).filter("_m.min_x IS NOT NULL AND NOT isnan(_m.min_x)")
    return insert(df, made.select(key, *(F.col(f"_m.{c}").alias(c) for c in COLUMNS)), key)


def remove(df: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """df without the keys of `gone`; keys that it does not hold change nothing."""
    return df.join(gone.select(key), key, "left_anti")


def verify(df: DataFrame, key: str = "id") -> DataFrame:
    """(problem, n): boxes whose corners are the wrong way round or no numbers, and keys said twice."""
    bad = F.lit(False)
    for c in COLUMNS:
        bad |= F.col(c).isNull() | F.isnan(c)
    n = df.agg(F.count_if(~bad & ~Box.of().valid()).alias("inverted"), F.count_if(bad).alias("no number"), (F.count(key) - F.countDistinct(key)).alias("repeated key"))
    return n.unpivot([], ["inverted", "no number", "repeated key"], "problem", "n")


def clustered(df: DataFrame, partitions: int) -> DataFrame:
    """df laid out for pruning: range-partitioned by x, sorted by y inside (the bulk load at scale)."""
    cx, cy = Box.of().center()
    return df.withColumn("_x", cx).withColumn("_y", cy).repartitionByRange(partitions, "_x").sortWithinPartitions("_y").drop("_x", "_y")


def bounds(df: DataFrame, *by: str) -> DataFrame:
    """The box of all boxes of a group."""
    return df.groupBy(*by).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def _wkb_points(raw: bytes, at: int) -> tuple[list[tuple[float, float]], int]:
    order = "<" if raw[at] == 1 else ">"
    kind = struct.unpack_from(order + "I", raw, at + 1)[0]
    base, dims = kind & 0xFFFF, 2
    if kind & 0x80000000 or 1000 <= base < 2000:
        dims += 1
    if kind & 0x40000000 or 2000 <= base < 3000:
        dims += 1
    base, at = base % 1000, at + 5
    if kind & 0x20000000:
        at += 4

    def run(n: int) -> list[tuple[float, float]]:
        nonlocal at
        flat = struct.unpack_from(f"{order}{n * dims}d", raw, at)
        at += 8 * n * dims
        return [(flat[i * dims], flat[i * dims + 1]) for i in range(n)]

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", raw, at - 4)[0]

    out: list[tuple[float, float]] = []
    if base == 1:
        out = run(1)
    elif base == 2:
        out = run(count())
    elif base == 3:
        for _ in range(count()):
            out += run(count())
    elif 4 <= base <= 7:
        for _ in range(count()):
            some, at = _wkb_points(raw, at)
            out += some
    else:
        raise ValueError(f"unknown geometry {base}")
    return out, at


def wkb_box(raw: bytes | None) -> tuple[float, float, float, float] | None:
    """The box of a well-known-binary geometry (points to collections, either byte order); null if malformed or empty."""
    if raw is None:
        return None
    try:
        points, _ = _wkb_points(bytes(raw), 0)
    except (struct.error, ValueError, IndexError):
        return None
    points = [p for p in points if p[0] == p[0] and p[1] == p[1]]
    if not points:
        return None
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def _plain_boxes(raw: list[bytes | None], out: np.ndarray) -> np.ndarray:
    """Fills the boxes of plain two-dimensional points and line strings, those of one form all at once; gives
    the positions of all other values."""
    forms: dict[tuple, list[int]] = {}
    rest = []
    for i, b in enumerate(raw):
        size = len(b) if b is not None else 0
        if size >= 21 and b[0] in (0, 1) and bytes(b[1:5]) in ((b"\x01\0\0\0", b"\x02\0\0\0") if b[0] else (b"\0\0\0\x01", b"\0\0\0\x02")):
            forms.setdefault((b[0], bytes(b[1:5]), size), []).append(i)
        else:
            rest.append(i)
    for (order, kind, size), who in forms.items():
        one, end = "<" if order else ">", 5 if 1 in kind else 9
        table = np.frombuffer(b"".join(raw[i] for i in who), dtype=np.uint8).reshape(len(who), size)
        points = 1 if end == 5 else np.ascontiguousarray(table[:, 5:9]).view(f"{one}u4").ravel()
        fits = np.full(len(who), size >= 21) if end == 5 else 9 + 16 * points.astype(np.int64) <= size
        n = 1 if end == 5 else (size - 9) // 16
        whole = fits & (points == n) if end == 9 else fits
        xy = np.ascontiguousarray(table[:, end : end + 16 * n]).view(f"{one}f8").reshape(len(who), n, 2).astype(np.float64)
        whole &= ~np.isnan(xy).any(axis=(1, 2))
        at = np.array(who)
        out[at[whole], :2], out[at[whole], 2:] = xy[whole].min(axis=1), xy[whole].max(axis=1)
        rest += at[~whole].tolist()
    return np.array(sorted(rest), dtype=np.int64)


def wkb_boxes(column: Column) -> Column:
    """A struct of the four box columns; Arrow batches, as no built-in reads the format. Points and line
    strings are read form by form, nested geometries one by one."""

    @pandas_udf("min_x double, min_y double, max_x double, max_y double")
    def parse(raw: pd.Series) -> pd.DataFrame:
        values, out = raw.tolist(), np.full((len(raw), 4), np.nan)
        for i in _plain_boxes(values, out).tolist():
            out[i] = wkb_box(values[i]) or (np.nan,) * 4
        return pd.DataFrame(out, columns=list(COLUMNS))

    return parse(column)
