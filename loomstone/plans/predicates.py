"""A small predicate language, compiled to one column expression that Catalyst pushes into scans."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class P:
    """op and operands: ("eq", field, value), ("and", p, q, ...), ("not", p) and so on; see compile_predicate."""

    op: str
    args: tuple[Any, ...]


def p(op: str, *args: Any) -> P:
    return P(op, args)


def compile_predicate(x: P) -> Column:
    a = x.args
    match x.op:
        case "eq":
            return F.col(a[0]) == a[1]
        case "range":  # field, low, high, low inclusive, high inclusive; None is unbounded
            c, (low, high, low_in, high_in) = F.col(a[0]), a[1:]
            out = F.lit(True)
            if low is not None:
                out &= c >= low if low_in else c > low
            if high is not None:
                out &= c <= high if high_in else c < high
            return out
        case "prefix":
            return F.startswith(F.col(a[0]), F.lit(a[1]))
        case "text":  # field, word: the word occurs among the field's tokens
            from loomstone.functions.tokens import simple

            return F.array_contains(simple(F.col(a[0])), a[1].lower())
        case "knn":  # field, query vector, metric, distance bound
            from loomstone.functions.distance import distance

            return distance(F.col(a[0]), a[1], a[2]) <= a[3]
        case "intersects":  # box columns, query box
            from loomstone.functions.boxes import Box, intersects

            return intersects(Box.of(*a[0]), Box.lit(*a[1]))
        case "is_null":
            return F.col(a[0]).isNull()
        case "is_not_null":
            return F.col(a[0]).isNotNull()
        case "in":
            return F.col(a[0]).isin(*a[1])
        case "between":
            return F.col(a[0]).between(a[1], a[2])
        case "and":
            return reduce(lambda m, n: m & n, map(compile_predicate, a), F.lit(True))
        case "or":
            return reduce(lambda m, n: m | n, map(compile_predicate, a), F.lit(False))
        case "not":
            return ~compile_predicate(a[0])
    raise ValueError(f"unknown predicate {x.op}")
