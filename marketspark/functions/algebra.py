"""Factor expressions: small trees over panel columns, evaluated in layers with one shuffle each.

A tree mixes three kinds of steps: row-wise ones, rolling ones along an instrument's sessions and cross-sectional ones
within a date. `evaluate` computes all rolling steps that are ready in one layer (they share a partitioning), then all
cross-sectional ones, so many factors cost as many shuffles as the deepest of them. `rolling` and `cross` are the same
steps as Spark columns, for single uses."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marketspark.functions.kernels import layer

#: Sessions of a stretch of one line.
CHUNK = 4096
ROWWISE, ROLLING, CROSS = "rowwise", "rolling", "cross"


def sessions(d: float) -> int:
    """Window lengths are rounded half to even and at least one session."""
    return max(1, round(float(d)))


@dataclass(frozen=True, eq=False)
class Expr:
    kind: str
    op: str
    args: tuple = ()
    value: object = None
    key: str = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "key", f"{self.op}[{self.value}]({','.join(a.key for a in self.args)})")

    @property
    def name(self) -> str:
        """The column that holds this step's result."""
        return self.value if self.op == "column" else "x" + hashlib.md5(self.key.encode()).hexdigest()[:12]

    def _two(self, op: str, other, turned: bool = False) -> Expr:
        pair = (self, lift(other))
        return Expr(ROWWISE, op, pair[::-1] if turned else pair)

    def __add__(self, x):
        return self._two("+", x)

    def __radd__(self, x):
        return self._two("+", x, True)

    def __sub__(self, x):
        return self._two("-", x)

    def __rsub__(self, x):
        return self._two("-", x, True)

    def __mul__(self, x):
        return self._two("*", x)

    def __rmul__(self, x):
        return self._two("*", x, True)

    def __truediv__(self, x):
        return self._two("/", x)

    def __rtruediv__(self, x):
        return self._two("/", x, True)

    def __pow__(self, x):
        return self._two("pow", x)

    def __neg__(self):
        return Expr(ROWWISE, "neg", (self,))

    def __lt__(self, x):
        return self._two("<", x)

    def __gt__(self, x):
        return self._two(">", x)

    def __le__(self, x):
        return self._two("<=", x)

    def __ge__(self, x):
        return self._two(">=", x)


def lift(x) -> Expr:
    return x if isinstance(x, Expr) else Expr(ROWWISE, "number", value=float(x))


def column(name: str) -> Expr:
    return Expr(ROWWISE, "column", value=name)


def _rolling(op: str):
    return lambda *a: Expr(ROLLING, op, tuple(lift(x) for x in a[:-1]), sessions(a[-1]))


def _cross(op: str):
    return lambda *a: Expr(CROSS, op, tuple(lift(x) for x in a))


def _rowwise(op: str):
    return lambda *a: Expr(ROWWISE, op, tuple(lift(x) for x in a))


#: Names that formulas may use.
VOCABULARY = {
    **{n: _rolling(n) for n in ("delay", "delta", "tsum", "mean", "tmin", "tmax", "std", "product", "argmax", "argmin", "trank", "decay", "corr", "cov")},
    **{n: _cross(n) for n in ("rank", "scale", "neutral", "zscore")},
    **{n: _rowwise(n) for n in ("sign", "log", "where", "flag", "larger", "smaller", "spow")},
    "abs": _rowwise("abs"),
    "adv": lambda d: _rolling("mean")(column("volume"), d),
    "winsor": lambda x, lo, hi: Expr(CROSS, "winsor", (lift(x),), (float(lo), float(hi))),
}
FIELDS = ("open", "high", "low", "close", "volume", "vwap", "returns", "industry", "cap")


def parse(text: str) -> Expr:
    """A formula in Python notation over FIELDS and VOCABULARY."""
    return lift(eval(text, {"__builtins__": {}}, VOCABULARY | {n: column(n) for n in FIELDS}))  # noqa: S307


def fine(x: Column) -> Column:
    """Missing is null: neither NaN nor an infinity stays."""
    return F.when(F.abs(x) < float("inf"), x)


def cell(e: Expr) -> Column:
    """A step as a Column; rolling and cross-sectional steps stand for the column that holds them."""
    if e.kind != ROWWISE or e.op == "column":
        return F.col(e.name)
    if e.op == "number":
        return F.lit(e.value)
    a = [cell(x) for x in e.args]
    match e.op:
        case "+" | "-" | "*":
            return {"+": a[0].__add__, "-": a[0].__sub__, "*": a[0].__mul__}[e.op](a[1])
        case "/":
            return F.try_divide(*a)
        case "pow":
            return fine(F.pow(*a))
        case "neg":
            return -a[0]
        case "<" | ">" | "<=" | ">=":  # a comparison with something missing does not hold
            return F.coalesce({"<": a[0] < a[1], ">": a[0] > a[1], "<=": a[0] <= a[1], ">=": a[0] >= a[1]}[e.op], F.lit(False))
        case "sign":
            return F.signum(a[0])
        case "abs":
            return F.abs(a[0])
        case "log":
            return F.ln(F.when(a[0] > 0, a[0]))
        case "flag":
            return a[0].cast("double")
        case "where":
            return F.when(F.coalesce(a[0], F.lit(False)), a[1]).otherwise(a[2])
        case "larger" | "smaller":
            both = a[0].isNotNull() & a[1].isNotNull()
            return F.when(both, (F.greatest if e.op == "larger" else F.least)(*a))
        case "spow":
            return F.signum(a[0]) * fine(F.pow(F.abs(a[0]), a[1]))
    raise ValueError(e.op)


def rolling(op: str, n: int, x: Column, y: Column | None = None, by: str = "instrument", order: str = "date") -> Column:
    """One rolling step over the last n sessions; null unless all n values are there."""
    line = Window.partitionBy(by).orderBy(order)
    if op == "delay":
        return F.lag(x, n).over(line)
    if op == "delta":
        return x - F.lag(x, n).over(line)
    w = line.rowsBetween(1 - n, 0)
    if op in ("corr", "cov"):
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        if op == "cov":
            return F.when(F.count(x).over(w) == n, F.covar_samp(x, y).over(w)) if n > 1 else F.lit(None).cast("double")
        spread = [F.when(F.var_pop(v).over(w) > 1e-14 * (1 + F.pow(F.avg(v).over(w), 2)), F.var_pop(v).over(w)) for v in (x, y)]
        return F.when(F.count(x).over(w) == n, F.covar_pop(x, y).over(w) / F.sqrt(spread[0] * spread[1]))
    if op == "std" and n == 1:
        return F.lit(None).cast("double")
    even = F.round(x, 9)
    values = F.collect_list(even).over(w)
    made = {
        "tsum": lambda: F.sum(x).over(w),
        "mean": lambda: F.avg(x).over(w),
        "tmin": lambda: F.min(x).over(w),
        "tmax": lambda: F.max(x).over(w),
        "std": lambda: F.stddev_samp(x).over(w),
        "product": lambda: F.product(x).over(w),
        "argmax": lambda: (F.array_position(values, F.array_max(values)) - 1).cast("double"),
        "argmin": lambda: (F.array_position(values, F.array_min(values)) - 1).cast("double"),
        "trank": lambda: F.size(F.filter(values, lambda v: v <= even)) / F.lit(float(n)),
        "decay": lambda: F.aggregate(F.transform(F.collect_list(x).over(w), lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v) / F.lit(n * (n + 1) / 2),
    }[op]()
    return F.when(F.count(x).over(w) == n, made)


def cross(op: str, x: Column, y: Column | None = None, value=None, by: str | list[str] = "date") -> Column:
    """One cross-sectional step within a date (or other keys)."""
    keys = [by] if isinstance(by, str) else list(by)
    day = Window.partitionBy(*keys)
    if op == "rank":  # average rank over the number of values; equal to nine digits is a tie
        even = F.round(x, 9)
        up, down = F.rank().over(day.orderBy(even.asc_nulls_last())), F.rank().over(day.orderBy(even.desc_nulls_last()))
        n = F.count(even).over(day)
        return F.when(even.isNotNull(), (up + n - down + 1) / 2 / n)
    if op == "scale":
        return F.try_divide(x, F.sum(F.abs(x)).over(day))
    if op == "zscore":
        return F.try_divide(x - F.avg(x).over(day), F.nullif(F.round(F.stddev_pop(x).over(day), 12), F.lit(0.0)))
    if op == "neutral":
        return x - F.avg(x).over(Window.partitionBy(*keys, y))
    if op == "winsor":
        lo, hi = (F.percentile(x, F.lit(p)).over(day) for p in value)
        return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))
    raise ValueError(op)


def _windows(e: Expr, found: dict[str, Expr]) -> None:
    for a in e.args:
        _windows(a, found)
    if e.kind != ROWWISE:
        found.setdefault(e.key, e)


def _needs(e: Expr) -> set[str]:
    """Windowed steps right below a step's row-wise part."""
    return reduce(set.union, ({a.key} if a.kind != ROWWISE else _needs(a) for a in e.args), set())


def layers(exprs: list[Expr]) -> list[tuple[str, list[Expr]]]:
    """Windowed steps in the order of their evaluation: (kind, steps of one select)."""
    left: dict[str, Expr] = {}
    for e in exprs:
        _windows(e, left)
    done: set[str] = set()
    out, kind = [], ROLLING
    while left:
        ready = [e for e in left.values() if e.kind == kind and _needs(e) <= done]
        if not ready:
            kind = CROSS if kind == ROLLING else ROLLING
            continue
        out.append((kind, ready))
        done |= {e.key for e in ready}
        left = {k: e for k, e in left.items() if k not in done}
    return out


def _read(e: Expr) -> set[str]:
    """Columns that a step's row-wise part reads."""
    if e.kind != ROWWISE or e.op == "column":
        return {e.name}
    return reduce(set.union, map(_read, e.args), set())


def reach(e: Expr) -> int:
    """Sessions before its own that a rolling step looks at."""
    return e.value if e.op in ("delay", "delta") else e.value - 1


def evaluate(panel: DataFrame, wanted: dict[str, Expr], keep: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """panel(date, instrument, fields) with one more double column for each wanted expression; the panel is dense (P.dense).

    One shuffle for each change between lines and dates, however many expressions there are: equal steps are computed once,
    layers of one kind in one pass, and columns that nothing later reads are left behind. A line of over `chunk` sessions
    is worked on in stretches, each with as many sessions before it as the pass's windows reach back."""
    keep = list(keep or panel.columns)
    passes = [(kind, [part for _, part in group]) for kind, group in groupby(layers(list(wanted.values())), key=lambda x: x[0])]
    final = reduce(set.union, map(_read, wanted.values()), set())
    out, fixed = panel, [*dict.fromkeys(["date", "instrument", *keep])]
    if any(kind == ROLLING for kind, _ in passes):
        days = panel.select("date").distinct().withColumn("_o", F.row_number().over(Window.orderBy("date")).cast("long") - 1)
        out, fixed = panel.join(F.broadcast(days), "date"), [*fixed, "_o"]  # one row a session
    for i, (kind, parts) in enumerate(passes):
        steps = [e for part in parts for e in part]
        own, reads = {e.name for e in steps}, [reduce(set.union, (_read(a) for part in p for e in part for a in e.args), set()) for _, p in passes[i:]]
        after = reduce(set.union, reads[1:], final)
        there = set(out.columns)
        carried = [*fixed, *sorted((after & there) - set(fixed))]
        made = [e.name for e in steps if e.name in after]
        rows = out.select(*carried, *sorted((reads[0] & there) - own - set(carried)))
        schema = StructType([out.schema[c] for c in carried] + [StructField(n, DoubleType()) for n in made])
        if kind == ROLLING:
            back = sum(max(map(reach, part)) for part in parts)
            long = max(chunk, 4 * back)
            at = F.floor(F.col("_o") / long)
            copies = F.when(F.col("_o") % long >= long - back, F.array(at, at + 1)).otherwise(F.array(at))
            dealt = rows.select("*", at.alias("_at"), F.explode(copies).alias("_c")).withColumn("_own", F.col("_at") == F.col("_c"))
            dealt = dealt.repartition("instrument", "_c").sortWithinPartitions("instrument", "_c", "date")
            out = dealt.mapInArrow(layer(parts, ["instrument", "_c"], carried, made, True, "_own"), schema)
        else:
            out = rows.repartition("date").sortWithinPartitions("date").mapInArrow(layer(parts, ["date"], carried, made, False), schema)
    return out.select(*keep, *[fine(cell(e).cast("double")).alias(n) for n, e in wanted.items()])
