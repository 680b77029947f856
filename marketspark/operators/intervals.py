"""Joins of moments with the spans that hold them, and totals of what spans hold, as equal joins on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.operators.scan import number, whole


def held_by(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, keys: list[str] | None = None) -> DataFrame:
    """points with the columns of every span (of the same keys) that holds them: start <= at <= end; dates, times or numbers.

    A span of 2**(l - 1) to 2**l units lies in two bins of width 2**l at most, so it is listed there, and a point looks in
    one bin for each level that spans have, some tens at most; then both ends are tested. No row meets a span of another
    bin, and neither side is broadcast unless Spark finds it small. Points and spans that lack an end or a key meet
    nothing; a span that ends before it starts holds nothing. Repeated rows meet repeatedly. Names must differ but for
    the keys."""
    keys = keys or []

    def place(df: DataFrame, c: str) -> Column:
        return number(F.col(c), df.schema[c].dataType)

    sized = spans.withColumns({"_s": place(spans, start), "_e": place(spans, end)}).where("_e >= _s")
    sized = sized.withColumn("_level", F.ceil(F.log2(F.col("_e") - F.col("_s") + 1)).cast("int"))
    levels = [x._level for x in sized.select("_level").distinct().collect()]  # under 64 numbers
    if not levels:
        return points.join(spans.limit(0), keys) if keys else points.limit(0).join(spans.limit(0), F.lit(True))

    def bin_of(c: str) -> Column:
        return F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level")))

    listed = sized.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of("_s"), bin_of("_e"))))).drop("_s", "_e")
    asked = points.withColumn("_p", place(points, at)).where("_p is not null").withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_bin", bin_of("_p")).drop("_p")
    met = asked.join(listed, [*keys, "_level", "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    return met.drop("_level", "_bin")


def held_totals(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, keys: list[str] | None = None, sums: list[str] | None = None) -> DataFrame:
    """spans with the number `n` and the sums of columns of the points (of the same keys) that they hold, in pieces: a span
    has a row for each of its pieces that holds any points, to be added up by what names it. start <= at <= end; dates,
    times or whole numbers.

    No point meets a span. Points are added up by moment and then by bins of 2**l units, for each l up to the length of
    the longest span; a span is cut into two such bins a level at most, which is what it is joined with. Work and rows
    grow with the spans and with the distinct moments, times the logarithm of the longest span, whatever the overlaps.
    Nulls and spans that end before they start are as in held_by. Names must differ but for the keys."""
    keys, sums = keys or [], sums or []
    s, e = (whole(F.col(c), spans.schema[c].dataType) for c in (start, end))
    sized = spans.withColumns({"_s": s, "_e": e + 1}).where("_e > _s")
    longest = sized.agg(F.max(F.col("_e") - F.col("_s"))).first()[0] or 1
    levels = range(int(longest).bit_length())
    pieces = []
    for level in levels:
        lo, hi = -F.shiftright(-F.col("_s"), level), F.shiftright("_e", level)  # bins from lo to hi - 1 lie in the span, an odd one at either end is no half of a larger one
        pieces += [F.when((lo < hi) & (odd.bitwiseAND(F.lit(1)) == 1), F.struct(F.lit(level).alias("_level"), bin_.alias("_bin"))) for odd, bin_ in ((lo, lo), (hi, hi - 1))]
    cut_up = sized.select(*spans.columns, F.inline(F.array_compact(F.array(*pieces))))
    moments = points.select(*keys, *sums, whole(F.col(at), points.schema[at].dataType).alias("_p")).where("_p is not null")
    moments = moments.groupBy(*keys, "_p").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    binned = moments.withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_bin", F.expr("shiftright(_p, _level)"))
    totals = binned.groupBy(*keys, "_level", "_bin").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])
    return cut_up.join(totals, [*keys, "_level", "_bin"]).drop("_level", "_bin")
