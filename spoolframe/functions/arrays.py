"""Array helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that are summed up at a time; an append copies what is there, so runs are kept short.
RUN = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(numbers: Column, kind: str = "int") -> Column:
    """Running totals of an array of numbers.

    Totals are summed in runs of ``RUN``, and each run starts from the totals of
    those before; so an array of 100,000 costs some millions of steps, not the
    square of its length. Null for a null array; an empty one stays empty.
    """
    none, zero = F.array().cast(f"array<{kind}>"), F.lit(0).cast(kind)

    def run_totals(xs: Column) -> Column:
        return F.aggregate(xs, none, lambda done, x: F.array_append(done, (F.coalesce(F.try_element_at(done, F.lit(-1)), zero) + x).cast(kind)))

    def spread(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int"))
        runs = F.transform(starts, lambda i: run_totals(F.slice(xs, i * RUN + 1, F.lit(RUN))))

        def raised(rs: Column) -> Column:
            begin = F.aggregate(rs, F.struct(none.alias("done"), zero.alias("at")), lambda s, r: F.struct(F.array_append(s["done"], s["at"]).alias("done"), (s["at"] + F.element_at(r, -1)).cast(kind).alias("at")), lambda s: s["done"])
            return F.flatten(F.zip_with(rs, begin, lambda r, b: F.transform(r, lambda v: (v + b).cast(kind))))

        return let(runs, raised)

    return F.when(F.size(numbers) == 0, none).otherwise(let(numbers, lambda xs: F.when(F.size(xs) <= RUN, run_totals(xs)).otherwise(spread(xs))))
