"""Order-preserving keys of several whole-number columns in few numbers, so that wide orders are cheap to shuffle."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, TimestampNTZType, TimestampType

from marketspark.operators.scan import whole

_DAY, _MOST = 86_400_000_000, 1 << 62


class Keys:
    """Columns of dates, times, whole numbers or booleans, counted from their least values and joined into as few longs as
    their ranges allow (times in days where all are midnights). The longs order rows as the columns do, nulls last. A
    column whose range fills a long stays one of its own, as it is. One pass over the rows finds the ranges."""

    def __init__(self, rows: DataFrame, columns: list[str]):
        kinds = {c: rows.schema[c].dataType for c in columns}
        self._whole = {c: F.col(c).cast("long") if isinstance(k, BooleanType) else whole(F.col(c), k) for c, k in kinds.items()}
        asked = [F.count("*").alias("n")]
        for i, (c, w) in enumerate(self._whole.items()):
            asked += [F.min(w).alias(f"least{i}"), F.max(w).alias(f"most{i}")] + [F.max(w % _DAY != 0).alias(f"uneven{i}")] * isinstance(kinds[c], (TimestampType, TimestampNTZType))
        found = rows.agg(*asked).first().asDict()
        self.rows, self._low, self._step, self._size, self._groups = found["n"], {}, {}, {}, [[]]
        for i, c in enumerate(columns):
            low, high = found[f"least{i}"] or 0, found[f"most{i}"] or 0
            step = _DAY if found.get(f"uneven{i}", True) is False else 1
            self._low[c], self._step[c], self._size[c] = low, step, (high - low) // step + 2  # the last code is null
            if self._groups[-1] and prod(self._size[x] for x in [*self._groups[-1], c]) > _MOST:
                self._groups.append([])
            self._groups[-1].append(c)

    @property
    def names(self) -> list[str]:
        return [f"_k{i}" for i in range(len(self._groups))]

    def _alone(self, group: list[str]) -> bool:
        return prod(self._size[c] for c in group) > _MOST

    def packed(self) -> list[Column]:
        """The longs, named as in `names`."""
        out = []
        for name, group in zip(self.names, self._groups):
            key = F.lit(0).cast("long")
            for c in group:
                code = F.coalesce(F.floor((self._whole[c] - self._low[c]) / self._step[c]).cast("long") if self._step[c] > 1 else self._whole[c] - self._low[c], F.lit(self._size[c] - 1)) if not self._alone(group) else None
                key = self._whole[c] if code is None else key * self._size[c] + code
            out.append(key.alias(name))
        return out

    def order(self) -> list[Column]:
        return [F.asc_nulls_last(n) for n in self.names]

    def field(self, column: str) -> Column:
        """A column again, of times and dates their whole numbers."""
        name, group = next((n, g) for n, g in zip(self.names, self._groups) if column in g)
        if self._alone(group):
            return F.col(name)
        code = F.expr(f"{name} div {prod(self._size[c] for c in group[group.index(column) + 1 :])}L") % self._size[column]
        return F.when(code < self._size[column] - 1, code * self._step[column] + self._low[column])
