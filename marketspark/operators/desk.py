"""Desk work: rebalancing, exposure limits, order audits, valuations and daily ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.lineage import cut
from marketspark.operators.panel import asof
from marketspark.operators.scan import LONG, Run, lengthy, scanned, sliced


def rebalance(targets: DataFrame, holdings: DataFrame, equity: float, band: float = 0.05) -> DataFrame:
    """targets(instrument, weight, price), holdings(instrument, quantity): whole-unit orders; changes within the band of
    what is held are skipped; names without a target are sold."""
    both = targets.join(holdings, "instrument", "full")
    wanted = F.coalesce(F.floor(F.try_divide(equity * F.col("weight"), "price")), F.lit(0)).cast("long")
    rows = both.select("instrument", wanted.alias("wanted"), F.coalesce("quantity", F.lit(0)).cast("long").alias("held")).withColumn("delta", F.col("wanted") - F.col("held"))
    return rows.where((F.col("delta") != 0) & ((F.col("held") == 0) | (F.abs("delta") / F.abs("held") > band) | (F.col("wanted") == 0)))


def exposure(weights: DataFrame) -> DataFrame:
    """Per date: gross, largest weight, names held."""
    return weights.groupBy("date").agg(F.sum(F.abs("weight")).alias("gross"), F.max(F.abs("weight")).alias("largest"), F.sum((F.col("weight") != 0).cast("long")).alias("names"))


def exposure_gates(daily: DataFrame, gross: float = 1.0, p95: float = 1.0, least: int = 40) -> DataFrame:
    """Per year: sessions, median and 95th percentile of gross, and the rules that fail."""
    years = daily.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("sessions"), F.percentile("gross", F.lit(0.5)).alias("median"), F.percentile("gross", F.lit(0.95)).alias("p95"))
    tests = {"sessions": F.col("sessions") >= least, "median": F.col("median") <= gross, "p95": F.col("p95") <= p95}
    return years.withColumn("failed", F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()])), ","))


def dual_momentum(rows: DataFrame, keys: list[str], mom: str, vol: str, share: float = 0.9) -> DataFrame:
    """weight: winners (momentum over 0) by half magnitude, half inverse volatility; without winners all by the latter."""
    day = Window.partitionBy(*keys)
    inverse = 1 / F.greatest(F.coalesce(vol, F.percentile(vol, F.lit(0.5)).over(day)), F.lit(0.05))
    rows = rows.withColumns({"_m": F.when(F.col(mom) > 0, F.col(mom)), "_v": inverse})
    winners = F.when(F.col("_m").isNotNull(), F.col("_v"))
    half = 0.5 * F.col("_m") / F.sum("_m").over(day) + 0.5 * F.try_divide(winners, F.sum(winners).over(day))
    weight = F.when(F.count("_m").over(day) == 0, F.try_divide("_v", F.sum("_v").over(day))).otherwise(F.coalesce(half, F.lit(0.0)))
    return rows.withColumn("weight", share * weight).drop("_m", "_v")


def correlations(returns: DataFrame) -> DataFrame:
    """returns(book, date, ret): Pearson of each pair of books over their common dates; books are few, dates the key."""
    a, b = returns.select("date", F.col("book").alias("a"), F.col("ret").alias("x")), returns.select("date", F.col("book").alias("b"), F.col("ret").alias("y"))
    spread = F.nullif(F.sqrt(F.var_pop("x")) * F.sqrt(F.var_pop("y")), F.lit(0.0))
    return a.join(b, "date").where("a < b").groupBy("a", "b").agg((F.covar_pop("x", "y") / spread).alias("corr"), F.count("*").alias("n"))


def order_reasons(orders: DataFrame, bars: DataFrame, lot: int = 5, limit: float = 0.195, share: float = 0.1) -> DataFrame:
    """orders(symbol, date, at, quantity) audited against bars(symbol, date, close, volume): first reason against a fill.

    Lots are whole multiples; a missing quote or a limit move blocks; a day's fills may not pass a share of the volume of
    the bar before."""
    w = Window.partitionBy("symbol").orderBy("date")
    quotes = bars.select("symbol", "date", "close", F.lag("close", 1).over(w).alias("before"), F.lag("volume", 1).over(w).alias("prior"))
    used = F.sum("quantity").over(Window.partitionBy("symbol", "date").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = orders.withColumn("used", used).join(quotes, ["symbol", "date"], "left")
    reason = (
        F.when(F.col("quantity") % lot != 0, "board lot").when(F.col("before").isNull(), "no quote")
        .when(F.abs(F.try_divide("close", "before") - 1) >= limit, "limit move").when(F.col("used") > share * F.col("prior"), "volume cap").otherwise("ok")
    )
    return rows.withColumn("reason", reason)


def average_cost(trades: DataFrame, long: int = LONG) -> DataFrame:
    """book, symbol, holding, cost: average cost of the open holding, which starts anew when the holding returns to zero or
    changes sign; selling part of it changes nothing.

    A buy of a share of what is held afterwards moves the cost by that share: cost = kept * cost + added, with kept = 1 -
    share and added = price * share; an opening trade keeps nothing. Such steps compose to steps of the same kind, so each
    slice of a line (scan) gives one step, from running sums of ln(kept) after its last opening, and a line's few steps
    are composed in order."""
    signed = F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity"))
    long = lengthy(trades, ["book", "symbol"], long)
    rows = scanned(trades.withColumn("signed", signed), ["book", "symbol"], ["seq"], {"sum": Run("sum", F.col("signed"))}, long)
    rows = rows.withColumns({"after": F.round("sum", 6), "before": F.round(F.col("sum") - F.col("signed"), 6)})
    opens = (F.col("before") == 0) | (F.col("before") * F.col("after") < 0)
    share = F.when(opens, 1.0).when(F.col("before") * F.col("signed") > 0, F.col("signed") / F.col("after")).otherwise(0.0)
    rows = rows.withColumns({"opens": opens, "share": share})
    cut_up = sliced(rows, ["book", "symbol"], "seq", long)
    rows = rows.withColumn("_slice", F.lit(0)) if cut_up is None else cut_up
    line = Window.partitionBy("book", "symbol", "_slice").orderBy(F.desc("seq"))
    later = line.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "kept": F.exp(F.coalesce(F.sum(F.when(~F.col("opens"), F.ln(1 - F.col("share")))).over(later), F.lit(0.0))),
        "closed": F.coalesce(F.max(F.col("opens").cast("int")).over(later), F.lit(0)),  # a later trade of the slice opens anew
    })
    live = rows.where("closed = 0")
    steps = live.groupBy("book", "symbol", "_slice").agg(
        F.max_by("after", "seq").alias("after"), F.when(F.max(F.col("opens").cast("int")) == 1, 0.0).otherwise(F.exp(F.sum(F.ln(1 - F.col("share"))))).alias("kept"),
        F.sum(F.col("price") * F.col("share") * F.col("kept")).alias("added"),
    )
    # a line has one step a slice
    whole = steps.groupBy("book", "symbol").agg(F.array_sort(F.collect_list(F.struct("_slice", "kept", "added", "after"))).alias("steps"))
    cost = F.aggregate("steps", F.lit(0.0), lambda c, s: s["kept"] * c + s["added"])
    holding = F.element_at("steps", -1)["after"]
    return whole.select("book", "symbol", holding.alias("holding"), F.when(holding != 0, cost).otherwise(0.0).alias("cost"))


def holdings_at(trades: DataFrame, time: Column) -> DataFrame:
    """Holdings and cash of each book and symbol by the trades up to a time."""
    signed = F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity"))
    known = F.col("date") <= time
    return trades.groupBy("book", "symbol").agg(F.sum(F.when(known, signed).otherwise(0.0)).alias("holding"), F.sum(F.when(known, -signed * F.col("price") - F.col("fee")).otherwise(0.0)).alias("cash"))


def daily_ledger(trades: DataFrame) -> DataFrame:
    """Per book and day: fills, fees, cash flow, running cash, its running peak and the distance from it."""
    signed = F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity"))
    days = trades.groupBy("book", "date").agg(F.count("*").alias("fills"), F.sum("fee").alias("fees"), F.sum(-signed * F.col("price") - F.col("fee")).alias("flow"))
    w = Window.partitionBy("book").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("cash", F.sum("flow").over(w)).withColumn("below", F.col("cash") - F.greatest(F.lit(0.0), F.max("cash").over(w)))


def idle_days(sessions: DataFrame, trades: DataFrame) -> DataFrame:
    """Sessions on which a book has no trade."""
    return sessions.crossJoin(trades.select("book").distinct()).join(trades.select("book", "date").distinct(), ["book", "date"], "left_anti")


def source_differences(a: DataFrame, b: DataFrame, fields: list[str], tolerance: float = 0.0051) -> DataFrame:
    """instrument, date, field, a, b where two sources differ by more than the tolerance."""
    long = lambda d, n: d.unpivot(["instrument", "date"], fields, "field", n)
    return long(a, "a").join(long(b, "b"), ["instrument", "date", "field"]).where(F.abs(F.col("a") - F.col("b")) > tolerance)


def coverage(panel: DataFrame, usable: float = 0.95) -> DataFrame:
    """Per instrument: bars, last bar, share of sessions with a positive price, and whether that is enough."""
    good = (F.coalesce(F.col("close") > 0, F.lit(False))).cast("double")
    return panel.groupBy("instrument").agg(F.count("close").alias("bars"), F.max(F.when(F.col("close").isNotNull(), F.col("date"))).alias("last"), F.avg(good).alias("share")).withColumn("enough", F.col("share") >= usable)


def asset_class(symbol: Column) -> Column:
    """By the form of a code: option (letters, date, C or P, strike), warrant (five digits), fund (51, 15 or 58 and four
    more digits), else equity."""
    return F.when(symbol.rlike("^[A-Z]+[0-9]{6}[CP][0-9]{8}$"), "option").when(symbol.rlike("^[0-9]{5}$"), "warrant").when(symbol.rlike("^(?:51|15|58)[0-9]{4}$"), "fund").otherwise("equity")


def multiplier(kind: Column) -> Column:
    return F.when(kind == "option", 100).otherwise(1)


def entitlements(lots: DataFrame, actions: DataFrame) -> DataFrame:
    """lots(book, symbol, date, quantity) held before an action's day: book, symbol, day, whole shares after a split, the
    fraction paid in cash at the opening price, and the dividend due. actions(symbol, day, split, dividend, open)."""
    held = lots.join(actions, "symbol").where("date < day").groupBy("book", "symbol", "day", "split", "dividend", "open").agg(F.sum("quantity").alias("quantity"))
    after = F.col("quantity") * F.col("split")
    return held.select("book", "symbol", "day", F.floor(after).cast("long").alias("shares"), ((after - F.floor(after)) * F.col("open")).alias("in_lieu"), (F.col("quantity") * F.col("dividend")).alias("dividend_due"))


def overview(trades: DataFrame, marks: DataFrame) -> DataFrame:
    """Per book and symbol: holding, cash, mark, value and result; without a mark, value and result are null."""
    signed = F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity"))
    rows = trades.groupBy("book", "symbol").agg(F.sum(signed).alias("holding"), F.sum(-signed * F.col("price") - F.col("fee")).alias("cash")).join(marks, "symbol", "left")
    return rows.withColumn("value", F.col("holding") * F.col("mark")).withColumn("result", F.col("value") + F.col("cash"))


def experiment_reasons(s: dict[str, Column]) -> Column:
    """Names of the rules that an experiment breaks, comma-joined: at least 126 sessions, Sharpe of 0.5 or more, a drawdown
    of at most 20 % and a positive return."""
    tests = {"sessions": s["sessions"] >= 126, "sharpe": s["sharpe"] >= 0.5, "drawdown": s["max_drawdown"] >= -0.2, "return": s["net_return"] > 0}
    return failed_rules(tests)


def failed_rules(tests: dict[str, Column]) -> Column:
    """Names of the tests that do not hold, comma-joined; a test of something missing does not hold."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()])), ",")


def marked_positions(holdings: DataFrame, bars: DataFrame, day: Column) -> DataFrame:
    """holdings(book, symbol, quantity) at the last close up to a day: book, symbol, quantity, close, price_date, value,
    stale (the bar is not of the day or had no volume). Without any bar the price is null and the mark is stale."""
    last = bars.where(F.col("date") <= day).where("close is not null").groupBy("symbol").agg(F.max_by(F.struct("close", "date", "volume"), "date").alias("m"))
    stale = ~F.coalesce((F.col("m.date") == day) & (F.col("m.volume") > 0), F.lit(False))
    return holdings.join(last, "symbol", "left").select("book", "symbol", "quantity", F.col("m.close").alias("close"), F.col("m.date").alias("price_date"), (F.col("quantity") * F.col("m.close")).alias("value"), stale.alias("stale"))


def close_before(bars: DataFrame, when: Column) -> DataFrame:
    """instrument, close: the last close before a day, else the first on or after it."""
    known = bars.where("close is not null")
    before = F.max_by("close", F.when(F.col("date") < when, F.col("date")))
    after = F.min_by("close", F.when(F.col("date") >= when, F.col("date")))
    return known.groupBy("instrument").agg(F.coalesce(before, after).alias("close"))


def closed_sessions(bars: DataFrame, now: Column, zone: str, close_hour: int) -> DataFrame:
    """bars without a session that is not over: a day counts from five minutes after its close. now: a moment in UTC
    (timestamp_ntz); zone: of the exchange."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), now)
    over = F.hour(local) * 60 + F.minute(local) >= close_hour * 60 + 5
    return bars.where(F.col("date") <= F.date_sub(F.to_date(local), F.when(over, 0).otherwise(1)))


def daily_moves(trades: DataFrame) -> DataFrame:
    """trades(book, day, symbol, side, quantity, price, fee) added up: book, symbol, day, moved, flow, fees, fills."""
    signed = F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity"))
    return trades.groupBy("book", "symbol", "day").agg(F.sum(signed).alias("moved"), F.sum(-signed * F.col("price") - F.col("fee")).alias("flow"), F.sum("fee").alias("fees"), F.count("*").alias("fills"))


def reconciled(days: DataFrame, trades: DataFrame, initial: Column, tolerance: float = 1e-6) -> DataFrame:
    """Differences between a stored ledger and its trades: book, day, field, stored, computed; none if all is right.

    days(book, day, cash, fees, fills, positions map<symbol, quantity>, closes map<symbol, close>, equity, drawdown),
    trades(book, day, symbol, side, quantity, price, fee). Cash, holdings, fees, fills, equity and drawdown from the running
    peak are computed anew; a day that one side lacks differs in `fills`. Trades are added up once, to what a book moved of
    a symbol on a day; these rows are stored, for several steps read them."""
    return reconciled_moves(days, cut(daily_moves(trades)), initial, tolerance)


def reconciled_moves(days: DataFrame, moves: DataFrame, initial: Column, tolerance: float = 1e-6) -> DataFrame:
    """reconciled() for trades that daily_moves() has added up."""
    flows = moves.groupBy("book", "day").agg(F.sum("flow").alias("flow"), F.sum("fees").alias("c_fees"), F.sum("fills").alias("c_fills"))
    w = Window.partitionBy("book").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    both = days.join(flows, ["book", "day"], "full").withColumn("c_cash", initial + F.sum(F.coalesce("flow", F.lit(0.0))).over(w))
    held = Window.partitionBy("book", "symbol").orderBy("day")
    since = moves.withColumn("holding", F.sum("moved").over(held.rowsBetween(Window.unboundedPreceding, 0)))
    # what is stored of each day's symbols beside the latest holding up to that day
    stored = days.select("book", "day", F.explode("positions").alias("symbol", "quantity"), "closes")
    line = stored.select("book", "symbol", "day", "quantity", F.col("closes")[F.col("symbol")].alias("close"), F.lit(None).cast("double").alias("holding"), F.lit(1).alias("asked"))
    line = line.unionByName(since.select("book", "symbol", "day", F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("double").alias("close"), "holding", F.lit(0).alias("asked")))
    upto = Window.partitionBy("book", "symbol").orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("computed", F.coalesce(F.last("holding", ignorenulls=True).over(upto), F.lit(0.0))).where("asked = 1")
    value = line.groupBy("book", "day").agg(F.sum(F.col("computed") * F.col("close")).alias("c_value"))
    both = both.join(value, ["book", "day"], "left").withColumn("c_equity", F.col("c_cash") + F.coalesce("c_value", F.lit(0.0)))
    both = both.withColumn("c_drawdown", F.col("c_equity") / F.greatest(initial, F.max("c_equity").over(w)) - 1)
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("stored"), F.coalesce(F.col(f"c_{f}"), F.lit(0)).cast("double").alias("computed")) for f in ("cash", "fees", "fills", "equity", "drawdown")]
    fields = both.select("book", "day", F.inline(F.array(*pairs)))
    holdings = line.select("book", "day", F.concat(F.lit("position "), "symbol").alias("field"), F.col("quantity").cast("double").alias("stored"), "computed")
    apart = F.coalesce(F.abs(F.col("stored") - F.col("computed")) > tolerance, F.lit(True))
    return fields.union(holdings).where(apart)


def strategy_summary(days: DataFrame) -> DataFrame:
    """Per book of days(book, day, equity, total_return, drawdown, fees, fills, stale): last day and its equity and return,
    worst drawdown, fees, fills, days with stale marks, sessions."""
    last = F.max_by(F.struct("equity", "total_return"), "day")
    return days.groupBy("book").agg(
        F.max("day").alias("last_day"), last.alias("l"), F.least(F.lit(0.0), F.min("drawdown")).alias("max_drawdown"), F.sum("fees").alias("fees"), F.sum("fills").alias("fills"),
        F.sum(F.col("stale").cast("long")).alias("stale_days"), F.count("*").alias("sessions"),
    ).select("book", "last_day", "l.equity", "l.total_return", "max_drawdown", "fees", "fills", "stale_days", "sessions")


def listing(rows: DataFrame, book: str, newest: str, held: str | None = None, n: int = 100) -> DataFrame:
    """A book's rows, newest first, of positions only those that are held; one page."""
    mine = rows.where(F.col("book") == book)
    return (mine.where(F.col(held) > 0) if held else mine).orderBy(F.desc(newest)).limit(n)


def model_orders(targets: DataFrame, holdings: DataFrame, equity: float, k: int, turnover: float, lot: int = 100, invested: float = 0.98) -> DataFrame:
    """targets(instrument, price) of the k chosen names, holdings(instrument, quantity, price): orders towards `invested` / k
    of the equity each. Amounts are scaled down together so that they turn over at most `turnover` of the equity, then
    rounded to lots; a name that is no target is sold whole if nothing was scaled."""
    both = targets.select("instrument", "price", F.lit(equity * invested / k).alias("wanted")).join(holdings.select("instrument", "quantity", F.col("price").alias("mark")), "instrument", "full")
    price = F.coalesce("price", "mark")
    rows = both.select("instrument", price.alias("price"), F.coalesce("quantity", F.lit(0)).alias("held"), F.col("wanted").isNull().alias("leaves"), (F.coalesce("wanted", F.lit(0.0)) - F.coalesce("quantity", F.lit(0)) * price).alias("amount"))
    whole = Window.partitionBy(F.lit(1))  # the names of one book
    scale = F.least(F.lit(1.0), F.try_divide(F.lit(turnover * equity), F.sum(F.abs("amount")).over(whole)))
    rows = rows.withColumn("scale", scale)
    size = F.floor(F.abs("amount") * F.col("scale") / F.col("price") / lot) * lot
    size = F.when(F.col("leaves") & (F.col("scale") == 1), F.col("held")).otherwise(size)
    return rows.select("instrument", F.when(F.col("amount") < 0, "sell").otherwise("buy").alias("side"), size.cast("long").alias("quantity")).where("quantity > 0")


def share_deltas(weights: DataFrame, holdings: DataFrame, quotes: DataFrame, equity: float, cash: float, lot: int = 100, cost: float = 0.001) -> DataFrame:
    """weights(instrument, weight), holdings(instrument, quantity, sellable), quotes(instrument, price, volume, fresh) as
    orders of whole lots: names that are no members are sold as far as they are sellable, quotes without volume or that are
    stale are skipped, buys go in order of weight while the cash lasts."""
    rows = weights.join(holdings, "instrument", "full").join(quotes, "instrument").where("volume > 0 and fresh and price > 0")
    unit = F.col("price") * (1 + cost)
    wanted = F.coalesce(F.floor(F.lit(equity) * F.col("weight") / unit / lot) * lot, F.lit(0))
    delta = wanted - F.coalesce("quantity", F.lit(0))
    rows = rows.select("instrument", "weight", unit.alias("unit"), F.greatest(delta, -F.coalesce("sellable", F.lit(0))).cast("long").alias("delta")).where("delta <> 0")
    line = Window.partitionBy(F.lit(1)).orderBy(F.desc("weight"), "instrument").rowsBetween(Window.unboundedPreceding, 0)  # the names of one book
    spent = F.sum(F.when(F.col("delta") > 0, F.col("delta") * F.col("unit")).otherwise(0.0)).over(line)
    return rows.withColumn("spent", spent).where((F.col("delta") < 0) | (F.col("spent") <= cash)).select("instrument", "delta")


def searched(instruments: DataFrame, text: str, n: int = 20) -> DataFrame:
    """instruments(symbol, name) whose symbol or name holds the text, letter case ignored; the first n by symbol."""
    q = text.strip().upper()
    return instruments.where(F.contains(F.upper("symbol"), F.lit(q)) | F.contains(F.upper("name"), F.lit(q))).orderBy("symbol").limit(n)


def filled(orders: DataFrame, profiles: DataFrame) -> DataFrame:
    """orders(venue, side, kind, quantity, price) with fill_price and fee by profiles(venue, slippage, commission, stamp,
    all_in, minimum): buys pay and sells lose the slippage; a venue with all_in charges it on both sides, others their
    commission, and stamp duty on sold equities; the commission is `minimum` at least; options count a hundredfold."""
    rows = orders.join(F.broadcast(profiles), "venue")  # one row a venue
    fill = F.col("price") * (1 + F.when(F.col("side") == "buy", F.col("slippage")).otherwise(-F.col("slippage")))
    amount = fill * F.col("quantity") * multiplier(F.col("kind"))
    stamp = F.when((F.col("side") == "sell") & (F.col("kind") == "equity"), F.col("stamp")).otherwise(0.0)
    rate = F.coalesce(F.col("all_in"), F.col("commission") + stamp)
    short = F.greatest(F.lit(0.0), F.col("minimum") - amount * F.col("commission"))
    return rows.select(*orders.columns, fill.alias("fill_price"), (amount * rate + short).alias("fee"))


def period_results(trades: DataFrame, bars: DataFrame, day: Column) -> DataFrame:
    """book, period (day, week, month), result: what holdings and cash are worth on a day less what they were worth at the
    start of the period, at the last close before it; null if a held symbol has no price then or now."""
    signed = F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity"))
    parts = []
    for period in ("day", "week", "month"):
        start = F.to_date(F.date_trunc(period, day.cast("timestamp")))
        held = trades.where(F.col("date") <= day).groupBy("book", "symbol").agg(
            F.sum(F.when(F.col("date") < start, signed).otherwise(0.0)).alias("q0"), F.sum(signed).alias("q1"),
            F.sum(F.when(F.col("date") >= start, -signed * F.col("price") - F.col("fee")).otherwise(0.0)).alias("flow"),
        )
        marks = bars.where("close is not null").groupBy("symbol").agg(
            F.max_by("close", F.when(F.col("date") < start, F.col("date"))).alias("p0"), F.max_by("close", F.when(F.col("date") <= day, F.col("date"))).alias("p1")
        )
        value = lambda q, p: F.when(F.col(q) == 0, 0.0).otherwise(F.col(q) * F.col(p))
        one = held.join(marks, "symbol", "left").withColumn("r", value("q1", "p1") - value("q0", "p0") + F.col("flow"))
        parts.append(one.groupBy("book").agg(F.lit(period).alias("period"), F.when(F.count("r") == F.count("*"), F.sum("r")).alias("result")))
    return parts[0].union(parts[1]).union(parts[2])


def equity_ledger(trades: DataFrame, bars: DataFrame, initial: float, long: int = LONG) -> DataFrame:
    """book, date, cash, value, equity, pnl, drawdown of each of a book's trading days: holdings at the last close so far."""
    signed = F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity"))
    days = trades.groupBy("book", "date").agg(F.sum(-signed * F.col("price") - F.col("fee")).alias("flow"))
    moves = trades.groupBy("book", "symbol", "date").agg(F.sum(signed).alias("moved"))
    # holdings and closes of a symbol on each of the book's days, both carried forward on one line
    names = moves.select("book", "symbol").distinct()
    asked = days.select("book", "date").join(names, "book").select("book", "symbol", "date", F.lit(0.0).alias("moved"), F.lit(None).cast("double").alias("close"), F.lit(1).alias("asked"))
    line = asked.unionByName(moves.select("book", "symbol", "date", "moved", F.lit(None).cast("double").alias("close"), F.lit(0).alias("asked")))
    line = line.unionByName(names.join(bars.select("symbol", "date", "close"), "symbol").select("book", "symbol", "date", F.lit(0.0).alias("moved"), "close", F.lit(0).alias("asked")))
    line = scanned(line, ["book", "symbol"], ["date", "asked"], {"held": Run("sum", F.col("moved")), "mark": Run("last", F.col("close"))}, long).where("asked = 1")
    value = line.groupBy("book", "date").agg(F.sum(F.col("held") * F.coalesce("mark", F.lit(0.0))).alias("value"))
    all_ = Window.partitionBy("book").orderBy("date")
    upto = all_.rowsBetween(Window.unboundedPreceding, 0)
    rows = days.join(value, ["book", "date"]).withColumn("cash", initial + F.sum("flow").over(upto)).withColumn("equity", F.col("cash") + F.col("value"))
    pnl = F.col("equity") - F.coalesce(F.lag("equity", 1).over(all_), F.lit(initial))
    return rows.select("book", "date", "cash", "value", "equity", pnl.alias("pnl"), (F.col("equity") / F.greatest(F.lit(initial), F.max("equity").over(upto)) - 1).alias("drawdown"))


def order_checks(orders: DataFrame, bars: DataFrame, rules: DataFrame, age: int = 7, share: float = 0.01, long: int = LONG) -> DataFrame:
    """orders(venue, symbol, kind, date, at, side, quantity, held) with reason (ok or the first against it) and filled.

    rules(venue, kind, lot, limit): the classes that a venue trades, with their lot and, if any, their daily limit; other
    classes are "class". A quantity off the lot is "board lot" unless it sells all that is held. The quote is the symbol's
    last bar(symbol, date, close, volume) up to the day: none is "no quote", one over `age` days old is "stale quote". A
    close that moved by the limit or more since the bar before is "limit move", either way. What is left are fills, in
    the order of `at`: all of a symbol's fills of a day stay within `share` of the volume of the last bar before that day,
    in whole lots; orders that find nothing left are "volume cap", others may be filled in part."""
    w = Window.partitionBy("symbol").orderBy("date")
    quotes = bars.select("symbol", "date", F.struct(F.col("date").alias("day"), "close", F.lag("close", 1).over(w).alias("before"), "volume", F.lag("volume", 1).over(w).alias("prior")).alias("q"))
    rows = asof(orders, quotes, "symbol", "date", "q", long).join(rules, ["venue", "kind"], "left")  # rules: a few rows a venue
    lot, q = F.coalesce("lot", F.lit(1)), F.col("q")
    all_of_it = (F.col("side") == "sell") & (F.col("held") > 0) & (F.col("quantity") == F.col("held"))
    reason = (
        F.when(F.col("lot").isNull(), "class").when((F.col("quantity") % lot != 0) & ~F.coalesce(all_of_it, F.lit(False)), "board lot").when(q.isNull(), "no quote")
        .when(F.datediff("date", q["day"]) > age, "stale quote").when(F.abs(F.try_divide(q["close"], q["before"]) - 1) >= F.col("limit"), "limit move")
    )
    # the bar before the day: the quote's own if that is older than the day
    prior = F.coalesce(F.when(q["day"] < F.col("date"), q["volume"]).otherwise(q["prior"]), F.lit(0.0))
    rows = rows.withColumns({"reason": reason, "_cap": (F.floor(F.floor(prior * share) / lot) * lot).cast("double")}).drop("q")
    asked = F.when(F.col("reason").isNull(), F.col("quantity").cast("double")).otherwise(0.0)
    # fills are taken in order until the cap is used up
    rows = scanned(rows.withColumn("_asked", asked), ["symbol", "date"], ["at"], {"_upto": Run("sum", F.col("_asked"))}, long)
    filled = F.least("_upto", "_cap") - F.least(F.col("_upto") - F.col("_asked"), F.col("_cap"))
    rows = rows.withColumn("filled", F.when(F.col("reason").isNull(), filled).otherwise(0.0))
    last = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("filled") <= 0, "volume cap").otherwise("ok")
    return rows.select(*orders.columns, last.alias("reason"), "filled")
