"""Running values over an array, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], out: str) -> Column:
    """Array of what each step gives out, for steps that depend on all items before.

    ``step(state, item)`` is a struct of the next ``state`` and of ``out``,
    whose type is named by ``out``. Appending copies an array; working in
    chunks keeps what is copied far below the square of the length.
    """
    nothing = F.array().cast(f"array<{out}>")

    def one(acc: Column, item: Column) -> Column:
        return bound(
            step(acc["state"], item), lambda s: F.struct(s["state"].alias("state"), F.concat(acc["out"], F.array(s["out"])).alias("out"))
        )

    def many(acc: Column, number: Column) -> Column:
        part = F.slice(items, number * CHUNK + 1, CHUNK)
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), nothing.alias("out")), one)
        return bound(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(acc["done"], F.array(i["out"])).alias("done")))

    some = F.size(items) > 0
    numbers = F.when(some, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    first = F.struct(start.alias("state"), F.array().cast(f"array<array<{out}>>").alias("done"))
    return F.aggregate(numbers, first, many, lambda acc: F.flatten(acc["done"]))
