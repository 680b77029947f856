"""Feature matrices of other tools: nested or flat names, several files, labels that must not come along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Names under which a matrix may bring its two keys.
DATE_KEYS = ("date", "datetime", "time")
INSTRUMENT_KEYS = ("instrument", "instruments", "asset", "symbol")


def _leaves(schema: StructType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = []
    for f in schema:
        out += _leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, StructType) else [(*path, f.name)]
    return out


def _named(path: tuple[str, ...]) -> Column:
    return F.col(".".join(f"`{p}`" for p in path))


def flat(matrix: DataFrame) -> DataFrame:
    """date, instrument and one double for each feature, by name. Of nested names the last part counts; what lies under a
    `label` or has a name that begins with LABEL (any case) is dropped; what is no number becomes null.

    The keys go by any of the known names. A missing key, or two features of one name, is an error."""
    paths = _leaves(matrix.schema)

    def key(names: tuple[str, ...]) -> tuple[str, ...]:
        found = [p for n in names for p in paths if p[-1].lower() == n]
        if not found:
            raise ValueError(f"a matrix needs one of {names}: {['.'.join(p) for p in paths]}")
        return found[0]

    date, instrument = key(DATE_KEYS), key(INSTRUMENT_KEYS)
    rest = [p for p in paths if p not in (date, instrument) and "label" not in {x.lower() for x in p[:-1]} and not p[-1].upper().startswith("LABEL")]
    names = [p[-1] for p in rest]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"features of one name: {twice}")
    values = [_named(p).try_cast("double").alias(p[-1]) for p in sorted(rest, key=lambda p: p[-1])]
    return matrix.select(_named(date).try_cast("date").alias("date"), _named(instrument).cast("string").alias("instrument"), *values)


def key_faults(matrix: DataFrame) -> DataFrame:
    """date, instrument, n, fault: keys that are missing or come more than once."""
    keys = matrix.groupBy("date", "instrument").agg(F.count("*").alias("n"))
    fault = F.when(F.col("date").isNull() | F.col("instrument").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return keys.withColumn("fault", fault).where("fault is not null")


def read_matrix(spark: SparkSession, path: str, panel: DataFrame) -> DataFrame:
    """The matrix of all Parquet files under a path, their columns together (a file without a column has nulls there), for
    the dates and instruments of the panel, with labels left out. Rows with a missing or repeated key are an error."""
    rows = flat(spark.read.option("mergeSchema", True).parquet(path))
    inside = rows.join(panel.select("instrument").distinct(), "instrument", "left_semi").join(panel.select("date").distinct(), "date", "left_semi")
    faults = key_faults(rows).limit(5).collect()
    if faults:
        raise ValueError(f"keys of the matrix: {[tuple(f) for f in faults]}")
    return inside.select(*[_named((c,)) for c in rows.columns])
