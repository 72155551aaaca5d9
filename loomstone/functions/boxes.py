"""Minimum bounding rectangles as four double columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(x1: str = "min_x", y1: str = "min_y", x2: str = "max_x", y2: str = "max_y") -> Box:
        return Box(F.col(x1), F.col(y1), F.col(x2), F.col(y2))

    @staticmethod
    def lit(x1: float, y1: float, x2: float, y2: float) -> Box:
        """Two corners in any order."""
        return Box(F.lit(float(min(x1, x2))), F.lit(float(min(y1, y2))), F.lit(float(max(x1, x2))), F.lit(float(max(y1, y2))))

    @staticmethod
    def empty() -> Box:
        """The box of nothing: not valid(), and the other box in every union()."""
        inf = F.lit(float("inf"))
        return Box(inf, inf, -inf, -inf)

    @staticmethod
    def point(x: Column, y: Column) -> Box:
        return Box(x, y, x, y)

    def valid(self) -> Column:
        return (self.x1 <= self.x2) & (self.y1 <= self.y2)

    def area(self) -> Column:
        return (self.x2 - self.x1) * (self.y2 - self.y1)

    def margin(self) -> Column:
        return (self.x2 - self.x1) + (self.y2 - self.y1)

    def perimeter(self) -> Column:
        return 2 * self.margin()

    def center(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2

    def union(self, o: Box) -> Box:
        return Box(F.least(self.x1, o.x1), F.least(self.y1, o.y1), F.greatest(self.x2, o.x2), F.greatest(self.y2, o.y2))

    def expand(self, by: float) -> Box:
        return Box(self.x1 - by, self.y1 - by, self.x2 + by, self.y2 + by)

    def overlap(self, o: Box) -> Box:
        """The common box; not valid() where there is none."""
        return Box(F.greatest(self.x1, o.x1), F.greatest(self.y1, o.y1), F.least(self.x2, o.x2), F.least(self.y2, o.y2))

    def overlap_area(self, o: Box) -> Column:
        c = self.overlap(o)
        return F.when(intersects(self, o), c.area()).otherwise(F.lit(0.0))

    def area_increase(self, o: Box) -> Column:
        return self.union(o).area() - self.area()

    def contains(self, o: Box) -> Column:
        return (self.x1 <= o.x1) & (self.y1 <= o.y1) & (self.x2 >= o.x2) & (self.y2 >= o.y2)

    def distance(self, x: Column, y: Column) -> Column:
        """Planar distance of a point to the box, 0 inside."""
        dx, dy = F.greatest(self.x1 - x, F.lit(0.0), x - self.x2), F.greatest(self.y1 - y, F.lit(0.0), y - self.y2)
        return F.sqrt(dx * dx + dy * dy)

    def max_distance(self, x: Column, y: Column) -> Column:
        """Distance of a point to the farthest corner."""
        dx, dy = F.greatest(F.abs(x - self.x1), F.abs(x - self.x2)), F.greatest(F.abs(y - self.y1), F.abs(y - self.y2))
        return F.sqrt(dx * dx + dy * dy)

    def center_distance(self, o: Box) -> Column:
        (a, b), (c, d) = self.center(), o.center()
        return F.sqrt((a - c) * (a - c) + (b - d) * (b - d))


@dataclass(frozen=True)
class Box3:
    """Boxes in three dimensions: a flat box and a range of z."""

    flat: Box
    z1: Column
    z2: Column

    def valid(self) -> Column:
        return self.flat.valid() & (self.z1 <= self.z2)

    def volume(self) -> Column:
        return self.flat.area() * (self.z2 - self.z1)

    def union(self, o: Box3) -> Box3:
        return Box3(self.flat.union(o.flat), F.least(self.z1, o.z1), F.greatest(self.z2, o.z2))

    def contains(self, o: Box3) -> Column:
        return self.flat.contains(o.flat) & (self.z1 <= o.z1) & (self.z2 >= o.z2)

    def meets(self, o: Box3) -> Column:
        return intersects(self.flat, o.flat) & (self.z1 <= o.z2) & (self.z2 >= o.z1)


def intersects(a: Box, b: Box) -> Column:
    """Closed boxes: touching counts."""
    return (a.x1 <= b.x2) & (a.x2 >= b.x1) & (a.y1 <= b.y2) & (a.y2 >= b.y1)


def hilbert(x: Column, y: Column, low: float, high: float, order: int = 16) -> Column:
    """Place on a Hilbert curve of a point's cell in a grid of 2**order over [low, high] squared."""
    top = float(2**order - 1)

    def cell(v: Column) -> Column:
        return F.least(F.lit(top), F.greatest(F.lit(0.0), F.floor((v - low) / (high - low) * top).cast("double"))).cast("long")

    # The curve has four states: its base cell as it is (0), with x and y swapped (1), with both swapped and
    # reflected (2), and reflected (3). The first quadrant of a cell swaps the curve inside it, the last
    # swaps and reflects it, so states follow each other by exclusive or.
    bits = F.array(*(F.lit(k) for k in range(order - 1, -1, -1)))
    start = F.struct(F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("d"))
    cx, cy, one = cell(x), cell(y), F.lit(1).cast("long")

    def step(s: Column, k: Column) -> Column:
        bx, by = (F.call_function("shiftright", c, k).bitwiseAND(one) for c in (cx, cy))
        swapped, reflected = s["state"].isin(1, 2), s["state"].isin(2, 3).cast("long")
        u = F.when(swapped, by).otherwise(bx).bitwiseXOR(reflected)
        v = F.when(swapped, bx).otherwise(by).bitwiseXOR(reflected)
        quadrant = (3 * u).bitwiseXOR(v)
        turn = F.when(quadrant == 0, 1).when(quadrant == 3, 2).otherwise(0).cast("long")
        return F.struct(s["state"].bitwiseXOR(turn).alias("state"), (4 * s["d"] + quadrant).alias("d"))

    return F.aggregate(bits, start, step)["d"]
