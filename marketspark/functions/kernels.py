"""Rolling and cross-sectional steps over Arrow batches: all steps of one layer in one pass of one sorted partition.

A layer's rows come sorted by group (a stretch of one instrument's sessions, or one date). Steps are computed over whole
batches of groups at once, by views of windows and by sorts within groups; what a task holds is a batch and one group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Window elements of one temporary.
CELLS = 1 << 21


def aligned(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches cut at the edges of groups of equal keys, with the first row of each group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        starts = edges(table, keys)
        if starts[-1]:
            yield table.slice(0, int(starts[-1])), starts[:-1]
        held = table.slice(int(starts[-1])).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, edges(table, keys)


def edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(table.num_rows, dtype=bool)
    changed[0] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        before, after = column.slice(0, len(column) - 1), column.slice(1)
        unlike = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
        changed[1:] |= unlike | (pc.is_null(before).to_numpy(zero_copy_only=False) != pc.is_null(after).to_numpy(zero_copy_only=False))
    return np.flatnonzero(changed)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


def nulls(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values))


def _windowed(f: Callable[..., np.ndarray], n: int, *arrays: np.ndarray) -> np.ndarray:
    """f of the windows of n values that end at each place, in blocks of bounded size; NaN before the first whole one."""
    size = len(arrays[0])
    out = np.full(size, np.nan)
    if size >= n:
        views = [np.lib.stride_tricks.sliding_window_view(a, n) for a in arrays]
        step = max(1, CELLS // n)
        for i in range(0, size - n + 1, step):
            part = f(*(v[i : i + step] for v in views))
            out[n - 1 + i : n - 1 + i + len(part)] = part
    return out


def _spread(v: np.ndarray) -> np.ndarray:
    """Variance of each window, NaN where it is nothing beside the level."""
    var = v.var(axis=1)
    return np.where(var > 1e-14 * (1 + v.mean(axis=1) ** 2), var, np.nan)


def _co(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - x.mean(axis=1, keepdims=True)) * (y - y.mean(axis=1, keepdims=True))).mean(axis=1)


def rolling(op: str, n: int, place: np.ndarray, x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """One step over the last n sessions; place: of each row in its line. NaN unless all n values are there."""
    if op in ("delay", "delta"):
        before = np.full(len(x), np.nan)
        before[n:] = x[:-n]
        before[place < n] = np.nan
        return before if op == "delay" else x - before
    if op in ("corr", "cov"):
        both = np.isnan(x) | np.isnan(y)
        x, y = np.where(both, np.nan, x), np.where(both, np.nan, y)
    if n == 1 and op in ("std", "cov"):
        return np.full(len(x), np.nan)
    weights = np.arange(1, n + 1, dtype=np.float64)
    made: dict[str, tuple[Callable[..., np.ndarray], tuple[np.ndarray, ...]]] = {
        "tsum": (lambda v: v.sum(axis=1), (x,)),
        "mean": (lambda v: v.mean(axis=1), (x,)),
        "tmin": (lambda v: v.min(axis=1), (x,)),
        "tmax": (lambda v: v.max(axis=1), (x,)),
        "std": (lambda v: v.std(axis=1, ddof=1), (x,)),
        "product": (lambda v: v.prod(axis=1), (x,)),
        "argmax": (lambda v: v.argmax(axis=1).astype(np.float64), (np.round(x, 9),)),
        "argmin": (lambda v: v.argmin(axis=1).astype(np.float64), (np.round(x, 9),)),
        "trank": (lambda v: (v <= v[:, -1:]).sum(axis=1) / n, (np.round(x, 9),)),
        "decay": (lambda v: v @ weights / (n * (n + 1) / 2), (x,)),
        "cov": (lambda v, w: _co(v, w) * n / (n - 1), (x, y)),
        "corr": (lambda v, w: _co(v, w) / np.sqrt(_spread(v) * _spread(w)), (x, y)),
    }
    f, arrays = made[op]
    out = _windowed(f, n, *arrays)
    known = np.cumsum(~np.isnan(x))
    known = known - np.r_[np.zeros(n), known[:-n]][: len(x)]
    return np.where((place >= n - 1) & (known == n), out, np.nan)


def cross(op: str, value: tuple | None, group: np.ndarray, x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """One step within each group (numbers from 0, ascending)."""
    size = int(group[-1]) + 1 if len(group) else 0
    there = ~np.isnan(x)
    g, v = group[there], x[there]
    out = np.full(len(x), np.nan)
    n = np.bincount(g, minlength=size)

    def mean(w: np.ndarray, at: np.ndarray = g, count: np.ndarray = n, among: int = size) -> np.ndarray:
        return np.bincount(at, w, among) / np.maximum(count, 1)

    with np.errstate(divide="ignore", invalid="ignore"):
        if op == "rank":  # average rank over the number of values; equal to nine digits is a tie
            even = np.round(v, 9)
            order = np.lexsort((even, g))
            first = np.flatnonzero(np.r_[True, (even[order][1:] != even[order][:-1]) | (g[order][1:] != g[order][:-1])]) if len(v) else np.zeros(0, np.int64)
            ends = np.r_[first[1:], len(v)]
            start = np.r_[0, np.cumsum(n)[:-1]][g[order[first]]] if len(v) else first
            ranks = np.empty(len(v))
            ranks[order] = np.repeat((first + ends - 1) / 2 - start + 1, ends - first)
            out[there] = ranks / n[g]
        elif op == "scale":
            total = np.bincount(g, np.abs(v), size)[g]
            out[there] = np.where(total == 0, np.nan, v / total)
        elif op == "zscore":
            centre = mean(v)[g]
            std = np.sqrt(mean((v - centre) ** 2))[g]
            out[there] = np.where(np.round(std, 12) == 0, np.nan, (v - centre) / std)
        elif op == "neutral":  # a missing second key is a key
            key = np.unique(np.stack([group.astype(np.float64), np.where(np.isnan(y), np.inf, y)]), axis=1, return_inverse=True)[1].ravel()
            own = key[there]
            out[there] = v - mean(v, own, np.bincount(own, minlength=len(x)), len(x))[own]
        elif op == "winsor":
            ordered = v[np.lexsort((v, g))]
            start = np.r_[0, np.cumsum(n)[:-1]]
            limits = []
            for share in value:
                at = share * np.maximum(n - 1, 0)
                low = np.floor(at).astype(np.int64)
                high = np.ceil(at).astype(np.int64)
                has = n > 0
                edge = np.full(size, np.nan)
                a, b = ordered[(start + low)[has]], ordered[(start + high)[has]]
                edge[has] = np.where(low[has] == high[has], a, (high - at)[has] * a + (at - low)[has] * b)
                limits.append(edge)
            out[there] = np.minimum(np.maximum(v, limits[0][g]), limits[1][g])
        else:
            raise ValueError(op)
    return out


def rowwise(e, known: Callable[[object], np.ndarray]) -> np.ndarray:
    """A row-wise step over arrays; missing is NaN, conditions are booleans that do not hold where something is missing.
    known: the array of a column or of a windowed step."""
    if e.kind != "rowwise" or e.op == "column":
        return known(e)
    if e.op == "number":
        return np.float64(e.value)
    a = [rowwise(x, known) for x in e.args]

    def power(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        made = np.power(np.asarray(x, np.float64), y)
        return np.where(np.isfinite(made) & ~np.isnan(x) & ~np.isnan(y), made, np.nan)  # one to a missing power is missing

    match e.op:
        case "+":
            return a[0] + a[1]
        case "-":
            return a[0] - a[1]
        case "*":
            return a[0] * a[1]
        case "/":
            return np.where(a[1] == 0, np.nan, np.asarray(a[0]) / a[1])
        case "pow":
            return power(*a)
        case "neg":
            return -a[0]
        case "<":
            return np.less(*a)
        case ">":
            return np.greater(*a)
        case "<=":
            return np.less_equal(*a)
        case ">=":
            return np.greater_equal(*a)
        case "sign":
            return np.sign(a[0])
        case "abs":
            return np.abs(a[0])
        case "log":
            return np.log(np.where(np.asarray(a[0]) > 0, a[0], np.nan))
        case "flag":
            return np.asarray(a[0], np.float64)
        case "where":
            return np.where(a[0], a[1], a[2])
        case "larger":
            return np.maximum(*a)
        case "smaller":
            return np.minimum(*a)
        case "spow":
            return np.sign(a[0]) * power(np.abs(a[0]), a[1])
    raise ValueError(e.op)


def layer(parts: list[list], keys: list[str], carried: list[str], made: list[str], along: bool, own: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: `parts`, lists of windowed steps of one kind each of which may read those before it, with the row-wise
    steps between them; gives the carried columns and those of the `made` steps. along: the steps are rolling ones, else
    cross-sectional; own: a column that is false for rows that are only there for windows to reach back to."""
    named = [[(e.name, e) for e in part] for part in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in aligned(batches, keys):
            sizes = np.diff(np.append(starts, table.num_rows))
            group = np.repeat(np.arange(len(starts)), sizes)
            place = np.arange(table.num_rows) - np.repeat(starts, sizes)
            values: dict[str, np.ndarray] = {}

            def known(e) -> np.ndarray:
                name = e.name
                if name not in values:  # noqa: B023
                    values[name] = numbers(table, name)  # noqa: B023
                return values[name]  # noqa: B023

            with np.errstate(all="ignore"):
                for part in named:
                    args: dict[str, np.ndarray] = {}
                    for _, e in part:
                        for x in e.args:
                            if x.key not in args:
                                args[x.key] = np.broadcast_to(np.asarray(rowwise(x, known), np.float64), (table.num_rows,))
                    for name, e in part:
                        a = [args[x.key] for x in e.args]
                        values[name] = rolling(e.op, e.value, place, *a) if along else cross(e.op, e.value, group, *a)
            out = pa.table([*(table.column(c) for c in carried), *(nulls(values[n]) for n in made)], names=[*carried, *made])
            if own:
                out = out.filter(table.column(own))
            yield from out.combine_chunks().to_batches()

    return run
