"""Factor expressions as DuckDB SQL: the other side of each comparison, written for that engine's functions."""

from __future__ import annotations

from marketspark.functions.algebra import ROLLING, ROWWISE, Expr, layers


def cell(e: Expr) -> str:
    if e.kind != ROWWISE or e.op == "column":
        return f'"{e.name}"'
    if e.op == "number":
        return f"CAST({e.value!r} AS DOUBLE)"
    a = [cell(x) for x in e.args]
    match e.op:
        case "+" | "-" | "*":
            return f"({a[0]} {e.op} {a[1]})"
        case "/":
            return f"({a[0]} / nullif({a[1]}, 0))"
        case "pow":
            return fine(power(a[0], a[1]))
        case "neg":
            return f"(-{a[0]})"
        case "<" | ">" | "<=" | ">=":
            return f"coalesce({a[0]} {e.op} {a[1]}, false)"
        case "sign":
            return f"CAST(sign({a[0]}) AS DOUBLE)"
        case "abs":
            return f"abs({a[0]})"
        case "log":
            return f"ln(CASE WHEN {a[0]} > 0 THEN {a[0]} END)"
        case "flag":
            return f"CAST({a[0]} AS DOUBLE)"
        case "where":
            return f"(CASE WHEN coalesce({a[0]}, false) THEN {a[1]} ELSE {a[2]} END)"
        case "larger" | "smaller":
            f = "greatest" if e.op == "larger" else "least"
            return f"(CASE WHEN {a[0]} IS NOT NULL AND {a[1]} IS NOT NULL THEN {f}({a[0]}, {a[1]}) END)"
        case "spow":
            return f"(sign({a[0]}) * {fine(power(f'abs({a[0]})', a[1]))})"
    raise ValueError(e.op)


def power(x: str, y: str) -> str:
    """Without the cases that this engine refuses: a root of a negative number, zero to a negative power."""
    return f"(CASE WHEN ({x} < 0 AND {y} <> floor({y})) OR ({x} = 0 AND {y} < 0) THEN NULL ELSE pow({x}, {y}) END)"


def fine(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} END)"


def rolling(op: str, n: int, x: str, y: str = "") -> str:
    line = "PARTITION BY instrument ORDER BY date"
    if op == "delay":
        return f"lag({x}, {n}) OVER ({line})"
    if op == "delta":
        return f"{x} - lag({x}, {n}) OVER ({line})"
    w = f"OVER ({line} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    if op in ("corr", "cov"):
        x, y = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
        if op == "cov":
            return f"CASE WHEN count({x}) {w} = {n} THEN covar_samp({x}, {y}) {w} END"
        s = [f"(CASE WHEN var_pop({v}) {w} > 1e-14 * (1 + pow(avg({v}) {w}, 2)) THEN var_pop({v}) {w} END)" for v in (x, y)]
        return f"CASE WHEN count({x}) {w} = {n} THEN covar_pop({x}, {y}) {w} / sqrt({s[0]} * {s[1]}) END"
    if op == "std" and n == 1:
        return "CAST(NULL AS DOUBLE)"
    even = f"round({x}, 9)"
    values = f"(list({even}) {w})"
    made = {
        "tsum": f"sum({x}) {w}",
        "mean": f"avg({x}) {w}",
        "tmin": f"min({x}) {w}",
        "tmax": f"max({x}) {w}",
        "std": f"stddev_samp({x}) {w}",
        "product": f"product({x}) {w}",
        "argmax": f"CAST(list_position({values}, list_max({values})) - 1 AS DOUBLE)",
        "argmin": f"CAST(list_position({values}, list_min({values})) - 1 AS DOUBLE)",
        "trank": f"len(list_filter({values}, lambda v: v <= {even})) / CAST({n} AS DOUBLE)",
        "decay": f"list_sum(list_transform(list({x}) {w}, lambda v, i: v * i)) / {n * (n + 1) / 2}",
    }[op]
    return f"CASE WHEN count({x}) {w} = {n} THEN {made} END"


def cross(op: str, x: str, y: str = "", value=None, keys: str = "date") -> str:
    day = f"PARTITION BY {keys}"
    if op == "rank":
        e = f"round({x}, 9)"
        return f"CASE WHEN {e} IS NOT NULL THEN (rank() OVER ({day} ORDER BY {e} ASC NULLS LAST) + count({e}) OVER ({day}) - rank() OVER ({day} ORDER BY {e} DESC NULLS LAST) + 1) / 2.0 / count({e}) OVER ({day}) END"
    if op == "scale":
        return f"{x} / nullif(sum(abs({x})) OVER ({day}), 0)"
    if op == "zscore":
        return f"({x} - avg({x}) OVER ({day})) / nullif(round(stddev_pop({x}) OVER ({day}), 12), 0)"
    if op == "neutral":
        return f"{x} - avg({x}) OVER ({day}, {y})"
    if op == "winsor":
        return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, quantile_cont({x}, {value[0]}) OVER ({day})), quantile_cont({x}, {value[1]}) OVER ({day})) END"
    raise ValueError(op)


def steps(wanted: dict[str, Expr], source: str = "panel") -> tuple[str, str]:
    """Common table expressions for all windowed steps, and the name of the last."""
    out, at = [], source
    for i, (kind, ready) in enumerate(layers(list(wanted.values()))):
        made = [f"{rolling(e.op, e.value, *map(cell, e.args)) if kind == ROLLING else cross(e.op, *map(cell, e.args), value=e.value)} AS {e.name}" for e in ready]
        out.append(f"{source}_{i} AS (SELECT *, {', '.join(made)} FROM {at})")
        at = f"{source}_{i}"
    return ",\n".join(out), at


def evaluated(wanted: dict[str, Expr], source: str = "panel") -> tuple[str, dict[str, str]]:
    """The steps as CTEs ending in `evaluated`, which has all columns of source and the wanted ones."""
    ctes, at = steps(wanted, source)
    last = f"evaluated AS (SELECT *, {', '.join(f'{fine(cell(e))} AS {n}' for n, e in wanted.items())} FROM {at})"
    return (f"{ctes},\n{last}" if ctes else last), {n: n for n in wanted}
