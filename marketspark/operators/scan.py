"""Running values along lines of any length: a long line is cut into slices of time that are worked on in different tasks.

Each slice is summarised (its sum, its greatest or its last value), the summaries of a line, a few rows, are scanned in
order, and what comes before a slice is added to what its own rows give. Rows are shuffled once, by key and slice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegralType, NumericType, StructType, TimestampNTZType, TimestampType

#: Rows from which a line is cut, and into how many slices.
LONG, SLICES = 1 << 20, 64


@dataclass(frozen=True)
class Run:
    """A running value: how is sum, max or last (the last value that is not null). reverse: from the end of the line.
    inclusive: with the row itself."""

    how: str
    value: Column
    reverse: bool = False
    inclusive: bool = True


def number(column: Column, kind: DataType) -> Column:
    """A column of dates, times, numbers or of structs that begin with one as a number in the same order; null for others."""
    if isinstance(kind, StructType) and len(kind):
        return number(column[kind[0].name], kind[0].dataType)
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    return column.cast("double") if isinstance(kind, NumericType) else F.lit(None).cast("double")


def whole(column: Column, kind: DataType) -> Column:
    """A column of dates, times or whole numbers as a long in the same order."""
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(kind, IntegralType):
        return column.cast("long")
    raise TypeError(f"dates, times or whole numbers, not {kind.simpleString()}")


def lengthy(rows: DataFrame, by: list[str], long: int | None) -> int | None:
    """`long` if any line has more rows, else None: for several scans of the same lines, which then need not count again."""
    return long if long is not None and not rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > long).isEmpty() else None


def sliced(rows: DataFrame, by: list[str], order: str, long: int | None = LONG) -> DataFrame | None:
    """rows with _slice, which grows with `order` within a key; None if no key has over `long` rows, or for no `long`.

    Slices lie between quantiles of the order, told by mergeable sketches of the long lines alone, so nothing gathers a
    line; rows of one moment stay in one slice. Other keys, and rows without a moment, are in slice 0."""
    if lengthy(rows, by, long) is None:
        return None
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > long)
    time = number(F.col(order), rows.schema[order].dataType)
    shares = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    # a line in `sizes` stands for over `long` rows, so there are few: as broadcasts they leave the rows where they are
    bounds = rows.join(F.broadcast(sizes.select(*by)), by, "left_semi").groupBy(*by).agg(F.percentile_approx(time, shares, 1000).alias("_bounds"))
    at = F.coalesce(F.size(F.filter("_bounds", lambda b: b < time)), F.lit(0))
    return rows.join(F.broadcast(bounds), by, "left").withColumn("_slice", F.when(F.col("_bounds").isNotNull() & time.isNotNull(), at).otherwise(0)).drop("_bounds")


def _over(run: Run, w: Window, name: str) -> Column:
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if run.inclusive else -1)
    return {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[run.how](F.col(name)).over(frame)


def _both(how: str, before: Column, own: Column) -> Column:
    if how == "sum":
        return F.coalesce(before + own, before, own)
    return F.greatest(before, own) if how == "max" else F.coalesce(own, before)


def scanned(rows: DataFrame, by: list[str], order: list[str], runs: dict[str, Run], long: int | None = LONG, narrow: bool = False) -> DataFrame:
    """rows with one more column for each run along the lines of `by` in the order of `order` (ascending, nulls first).
    narrow: rows are dealt out before the values of the runs are added, for runs of what the rows hold already."""
    cut_up = sliced(rows, by, order[0], long)
    keys = by if cut_up is None else [*by, "_slice"]
    values = {f"_v_{n}": r.value for n, r in runs.items()}
    wide = (rows if cut_up is None else cut_up).withColumns(values)
    ahead = Window.partitionBy(*keys).orderBy(*order)
    behind = Window.partitionBy(*keys).orderBy(*map(F.desc, order))
    dealt = (rows if cut_up is None else cut_up).repartition(*keys).withColumns(values) if narrow else wide
    out = dealt.withColumns({n: _over(r, behind if r.reverse else ahead, f"_v_{n}") for n, r in runs.items()})
    if cut_up is not None:
        ends = []
        for n, r in runs.items():
            v = F.col(f"_v_{n}")
            place = F.when(v.isNotNull(), F.struct(*order))
            ends.append({"sum": F.sum(v), "max": F.max(v), "last": (F.min_by if r.reverse else F.max_by)(v, place)}[r.how].alias(f"_v_{n}"))
        parts = wide.groupBy(*keys).agg(*ends)
        lines = {reverse: Window.partitionBy(*by).orderBy(F.desc("_slice") if reverse else F.col("_slice")) for reverse in (False, True)}
        carry = parts.select(*keys, *[_over(Run(r.how, r.value, inclusive=False), lines[r.reverse], f"_v_{n}").alias(f"_c_{n}") for n, r in runs.items()])
        carry = carry.where(" or ".join(f"_c_{n} is not null" for n in runs))  # lines of one slice have nothing before it
        out = out.join(carry, keys, "left").withColumns({n: _both(r.how, F.col(f"_c_{n}"), F.col(n)) for n, r in runs.items()})
    return out.select(*rows.columns, *runs)
