"""Array expressions whose work grows with the array: folds that append, runs of equal keys, places in sorted arrays.

``concat`` copies all that it appends to, and ``exists`` looks at all there is; a fold that does either for each
element is quadratic. Here elements are appended to short pieces that are joined at the end, equal
keys meet by sorting, and places in sorted arrays are found by halving.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements a piece.
PIECE = 64


def empty(kind: str) -> Column:
    """A typed empty array."""
    return F.array().cast(f"array<{kind}>")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """What ``body`` makes of a value that is evaluated once, however often it stands in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def appended(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], finish: Callable[[Column, Column], Column] | None = None) -> Column:
    """All elements that ``step`` gives from left to right: it takes a state and an item, and returns the next state, of the
    same type, and an array of new elements. ``finish`` makes the result of the last state and all elements."""

    def one(a: Column, x: Column) -> Column:
        after, new = step(a["state"], x)
        return F.struct(after.alias("state"), F.concat(a["out"], new).alias("out"))

    def whole(xs: Column) -> Column:
        def one_piece(acc: Column, piece: Column) -> Column:
            zero = F.struct(acc["state"].alias("state"), empty(kind).alias("out"))
            return F.aggregate(piece, zero, one, lambda a: F.struct(a["state"].alias("state"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

        last = F.floor((F.size(xs) - 1) / PIECE).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * PIECE + 1, F.lit(PIECE)))
        zero = F.struct(state.alias("state"), empty(f"array<{kind}>").alias("out"))
        several = F.aggregate(pieces, zero, one_piece, lambda acc: end(acc["state"], F.flatten(acc["out"])))
        single = F.aggregate(xs, F.struct(state.alias("state"), empty(kind).alias("out")), one, lambda a: end(a["state"], a["out"]))
        return F.when(F.size(xs) > PIECE, several).otherwise(single)

    end = finish or (lambda _, out: out)
    return bound(items, whole)


def with_previous(items: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of each element and the one before it, null for the first."""
    return bound(items, lambda xs: F.transform(xs, lambda x, i: body(x, F.get(xs, i - 1))))


def first_of_runs(ordered: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The elements of a sorted array that are not the same as the one before."""
    marked = with_previous(ordered, lambda x, p: F.struct(x.alias("x"), F.coalesce(same(x, p), F.lit(False)).alias("again")))
    return F.transform(F.filter(marked, lambda m: ~m["again"]), lambda m: m["x"])


def place(ordered: Column, below: Callable[[Column], Column]) -> Column:
    """How many elements of a sorted array ``below`` holds for, given that they are its first ones."""
    zero = F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        up, down = F.struct((mid + 1).alias("lo"), a["hi"].alias("hi")), F.struct(a["lo"].alias("lo"), mid.alias("hi"))
        return F.when(a["lo"] >= a["hi"], a).when(below(F.get(ordered, mid)), up).otherwise(down)

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(ordered)))), zero, halve, lambda a: a["lo"])
