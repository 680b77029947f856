"""Statistical series, text records, ledgers, corporate actions and data quality."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.intervals import held_by
from marketspark.operators.lineage import cut, stored
from marketspark.operators.scan import LONG, Run, lengthy, scanned


# --- series -------------------------------------------------------------------------------------------------------------
def monthly(values: DataFrame) -> DataFrame:
    """values(series_id, date, value): one value a month end, months without any filled with null, infinities dropped."""
    known = values.where("date is not null and value is not null and abs(value) < double('infinity')")
    rows = known.groupBy("series_id", F.last_day("date").alias("period_end")).agg(F.max_by("value", "date").alias("value"))
    spans = rows.groupBy("series_id").agg(F.min("period_end").alias("a"), F.max("period_end").alias("b"))
    grid = spans.select("series_id", F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")).select("series_id", F.last_day("m").alias("period_end"))
    return grid.join(rows, ["series_id", "period_end"], "left")


def changed(series: DataFrame) -> DataFrame:
    """diff against the month before and percent against the same month a year before; a gap stays a gap."""
    w = Window.partitionBy("series_id").orderBy("period_end")
    return series.withColumns({"diff": F.col("value") - F.lag("value", 1).over(w), "yoy": (F.try_divide("value", F.lag("value", 12).over(w)) - 1) * 100})


def series_summary(series: DataFrame) -> DataFrame:
    """Per series: first and last period, latest value, the adjacent one before it, observations and gaps."""
    w = Window.partitionBy("series_id").orderBy("period_end")
    rows = series.withColumn("before", F.lag("value", 1).over(w))
    known = F.col("value").isNotNull()
    latest = F.max_by(F.struct("value", "before"), F.when(known, F.col("period_end")))
    return rows.groupBy("series_id").agg(F.min("period_end").alias("first"), F.max(F.when(known, F.col("period_end"))).alias("last"), latest.alias("l"), F.count("value").alias("n"), F.sum((~known).cast("long")).alias("missing")).select(
        "series_id", "first", "last", F.col("l.value").alias("latest"), F.col("l.before").alias("previous"), (F.col("l.value") - F.col("l.before")).alias("change"), "n", "missing"
    )


def shrunk(old: DataFrame, new: DataFrame) -> DataFrame:
    """Series whose new delivery starts later or ends earlier than what is stored."""
    span = lambda d, p: d.groupBy("series_id").agg(F.min("period_end").alias(f"{p}_first"), F.max("period_end").alias(f"{p}_last"))
    return span(old, "old").join(span(new, "new"), "series_id").where("new_last < old_last or new_first > old_first").select("series_id")


# --- text ---------------------------------------------------------------------------------------------------------------
def plain(html: str | Column, size: int | None = None) -> Column:
    """Text of a fragment: tags to blanks, the common entities read, white space joined; whole, or its first `size` characters."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    # The entities that are read.
    for name, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(letter))
    text = F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))
    return text if size is None else F.substring(text, 1, size)


def title(html: str, size: int = 400) -> Column:
    """Plain text of the first <title>, cut to `size` characters; null without one."""
    found = F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(F.col(html).rlike("(?is)<title[^>]*>.*?</title>"), plain(found, size))


def safe_url(url: str) -> Column:
    """http or https with a host and no user part, without its fragment; else null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    return F.when(bare.rlike("^(?i:https?)://[^/@?#\\s]+(?:[/?][^\\s]*)?$"), bare)


def article_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 20)


def tagged(text: str, tags: dict[str, str], default: str) -> Column:
    """Names of all patterns that a text matches, in order; the default if none does."""
    hits = F.array_compact(F.array(*[F.when(F.lower(F.col(text)).rlike(p), F.lit(n)) for n, p in tags.items()]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))


def first_seen(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by id: the earliest first_seen, the latest content."""
    both = old.unionByName(new)
    content = [c for c in both.columns if c not in ("id", "first_seen")]
    return both.groupBy("id").agg(F.min("first_seen").alias("first_seen"), F.max_by(F.struct(*content), "first_seen").alias("c")).select("id", "first_seen", "c.*")


def policy_scores(dates: DataFrame, regimes: DataFrame) -> DataFrame:
    """date, theme, score: scores of all regimes(start, end, scores map) that hold on a day, added and clipped to two. Any
    number of regimes: they meet their days in bins (held_by)."""
    open_ = held_by(dates.select("date"), regimes.select("start", "end", "scores"), "date", "start", "end")
    return open_.select("date", F.explode("scores").alias("theme", "s")).groupBy("date", "theme").agg(F.greatest(F.least(F.sum("s"), F.lit(2)), F.lit(-2)).alias("score"))


# --- ledgers ------------------------------------------------------------------------------------------------------------
def positions(trades: DataFrame) -> DataFrame:
    """trades(book, symbol, at, quantity > 0, price, side, fee) with running signed quantity and running cash of the book's symbol."""
    w = Window.partitionBy("book", "symbol").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity"))
    return trades.withColumns({"holding": F.sum(signed).over(w), "cash": F.sum(-signed * F.col("price") - F.col("fee")).over(w)})


def fifo_matches(trades: DataFrame, long: int = LONG) -> DataFrame:
    """Slices of sells matched with the oldest buys: book, symbol, bought_at, sold_at, quantity, buy_price, sell_price.

    Each buy and each sell ends at a cumulative quantity of its side. All ends of a book's symbol in one order cut the
    quantities into slices; a slice belongs to the buy and to the sell that end next, found from behind. No join of trades
    with trades: the work is linear in the trades, and lines of over `long` trades are worked on in slices (scan)."""
    long = lengthy(trades, ["book", "symbol"], long)
    ends = scanned(trades.where("quantity > 0"), ["book", "symbol", "side"], ["at"], {"end": Run("sum", F.col("quantity"))}, long)
    trade = F.struct("at", "price")
    rows = scanned(ends, ["book", "symbol"], ["end", "side", "at"], {
        "before": Run("max", F.col("end"), inclusive=False),
        "b": Run("last", F.when(F.col("side") == "buy", trade), reverse=True), "s": Run("last", F.when(F.col("side") == "sell", trade), reverse=True),
    }, long)
    met = rows.withColumn("quantity", F.col("end") - F.coalesce("before", F.lit(0.0))).where("quantity > 0 and b is not null and s is not null")
    return met.select("book", "symbol", F.col("b.at").alias("bought_at"), F.col("s.at").alias("sold_at"), "quantity", F.col("b.price").alias("buy_price"), F.col("s.price").alias("sell_price"))


#: Rows up to which a table of slices is broadcast.
_SMALL = 1 << 18


def fifo_numbered(trades: DataFrame, keys: list[str], bounds: list[float], long: int = LONG) -> DataFrame:
    """fifo_matches(book, symbol, bought_at, sold_at, quantity) for trades(book, symbol, sell, quantity) whose moments are
    their numbers from 1 among all trades, in the order of `keys` (nulls last; the trades of one line have distinct ones).

    Trades are dealt out by slices of the first key between `bounds`. There each gets its number and its running quantity
    within the slice, which is what is stored; what comes before a slice, of all trades and of each line, is added from a
    table of one row a slice and line. So each trade is shuffled once for its number and once to be matched."""
    splits = [-float("inf"), *(sorted(set(bounds)) or [0.0]), float("inf")]
    place = Bucketizer(splits=splits, inputCol="_first", outputCol="_slice", handleInvalid="keep")
    rows = place.transform(trades.withColumn("_first", F.col(keys[0]).cast("double"))).drop("_first").withColumn("_slice", F.coalesce(F.col("_slice").cast("int"), F.lit(len(splits) - 1)))
    counts = F.coalesce(F.col("quantity") > 0, F.lit(False))
    rows = rows.repartition("_slice").withColumn("_n", F.row_number().over(Window.partitionBy("_slice").orderBy(*map(F.asc_nulls_last, keys))))
    line = Window.partitionBy("_slice", "book", "symbol", "sell").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = stored(rows.select("_slice", "book", "symbol", "sell", "_n", F.sum(F.when(counts, F.col("quantity"))).over(line).alias("_own"), counts.alias("_counts")))
    ahead = lambda *by: Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("_slice").agg(F.max("_n").alias("_size")).select("_slice", F.coalesce(F.sum("_size").over(ahead()), F.lit(0)).alias("_numbers"))  # one row a slice
    lines = rows.groupBy("_slice", "book", "symbol", "sell").agg(F.max("_own").alias("_moved"))
    before = lines.withColumn("_before", F.coalesce(F.sum("_moved").over(ahead("book", "symbol", "sell")), F.lit(0.0))).drop("_moved")
    before = cut(before.join(F.broadcast(slices), "_slice"))
    long = lengthy(rows.where("_counts"), ["book", "symbol"], long)
    met = rows.where("_counts").join(F.broadcast(before) if before.count() <= _SMALL else before, ["_slice", "book", "symbol", "sell"])
    ends = met.select("book", "symbol", "sell", (F.col("_numbers") + F.col("_n")).alias("at"), (F.col("_before") + F.col("_own")).alias("end"))
    found = scanned(ends, ["book", "symbol"], ["end", "sell", "at"], {
        "before": Run("max", F.col("end"), inclusive=False), "b": Run("last", F.when(~F.col("sell"), F.col("at")), reverse=True), "s": Run("last", F.when(F.col("sell"), F.col("at")), reverse=True),
    }, long, narrow=True)
    found = found.withColumn("quantity", F.col("end") - F.coalesce("before", F.lit(0.0))).where("quantity > 0 and b is not null and s is not null")
    return found.select("book", "symbol", F.col("b").alias("bought_at"), F.col("s").alias("sold_at"), "quantity")


def lots(trades: DataFrame, long: int = LONG) -> DataFrame:
    """Every buy with what is left of it after the sells, oldest first: book, symbol, at, quantity, price, remaining. It may
    be nothing; sells beyond all buys leave no lots. Lines of over `long` buys are worked on in slices (scan)."""
    sold = trades.where("side = 'sell'").groupBy("book", "symbol").agg(F.sum("quantity").alias("sold"))
    buys = scanned(trades.where("side = 'buy'"), ["book", "symbol"], ["at"], {"end": Run("sum", F.coalesce("quantity", F.lit(0.0)))}, long)
    rows = buys.join(sold, ["book", "symbol"], "left")
    left = F.greatest(F.least(F.col("quantity"), F.col("end") - F.coalesce("sold", F.lit(0.0))), F.lit(0.0))
    return rows.withColumn("remaining", left).drop("end", "sold", "side")


def sellable(lots: DataFrame, today: Column, days: int, date: str = "date") -> DataFrame:
    """Per book and symbol: what is held and what of it is at least `days` days old (all of it for none)."""
    old = F.datediff(today, F.col(date)) >= days if days > 0 else F.lit(True)
    return lots.groupBy("book", "symbol").agg(F.sum("remaining").alias("held"), F.sum(F.when(old, F.col("remaining")).otherwise(0.0)).alias("sellable"))


def win_rate(matches: DataFrame) -> DataFrame:
    return matches.groupBy("book").agg(F.count("*").alias("slices"), F.avg((F.col("sell_price") > F.col("buy_price")).cast("double")).alias("win_rate"), F.sum(F.col("quantity") * (F.col("sell_price") - F.col("buy_price"))).alias("profit"))


def fees(side: Column, amount: Column, rate: float = 0.0003, least: float = 1.0, stamp: float = 0.0005) -> Column:
    """Commission with a minimum, and stamp duty on sells."""
    return F.greatest(amount * rate, F.lit(least)) + F.when(side == "sell", amount * stamp).otherwise(0.0)


# --- corporate actions and quality --------------------------------------------------------------------------------------
def nominal_prices(bars: DataFrame) -> DataFrame:
    """Prices times the product of all later splits, volume by its inverse; split is 1 or null where there is none."""
    w = Window.partitionBy("instrument").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    factor = F.coalesce(F.product(F.coalesce("split", F.lit(1.0))).over(w), F.lit(1.0))
    return bars.withColumn("factor", factor).withColumns({c: F.col(c) * F.col("factor") for c in ("open", "high", "low", "close")} | {"volume": F.col("volume") / F.col("factor")})


def quality_issues(bars: DataFrame, gap: float = 0.35) -> DataFrame:
    """instrument, date, reason, severity: repeated sessions, prices that are not positive, an envelope that does not hold
    the close or the open, and moves of over `gap` since the bar before, close against close: splits are not told apart. contract_issues() does."""
    w = Window.partitionBy("instrument").orderBy("date")
    move = F.abs(F.try_divide("close", F.lag("close", 1).over(w)) - 1)
    rows = bars.withColumns({"move": move, "same": F.count("*").over(Window.partitionBy("instrument", "date"))})
    tests = [
        ("duplicate", "error", F.col("same") > 1),
        ("not positive", "error", ~F.coalesce(F.least("open", "high", "low", "close") > 0, F.lit(False))),
        ("envelope", "warning", (F.col("high") + 1e-6 < F.greatest("open", "close")) | (F.col("low") - 1e-6 > F.least("open", "close"))),
        ("gap", "warning", F.col("move") > gap),
    ]
    return _issues(rows, tests)


def _issues(rows: DataFrame, tests: list[tuple[str, str, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(r).alias("reason"), F.lit(s).alias("severity"))) for r, s, t in tests]))
    return rows.select("instrument", "date", F.inline(found))


def contract_issues(bars: DataFrame, gaps: bool = True, gap: float = 0.35) -> DataFrame:
    """The data contract of bars(instrument, date, prices, split, dividend): instrument, date, reason, severity.

    Repeated sessions and prices that are missing, infinite or not positive are errors; an open or close outside the day's
    range is a warning, on sound bars only. gaps (for the venue that limits moves): an open that differs by over `gap` from
    the close before, net of the day's split and dividend, all in nominal units."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    sound = F.coalesce(*[F.lit(None).cast("boolean"), F.forall(F.array(*prices), lambda p: p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf")) & (p > 0))])
    nominal = nominal_prices(bars).withColumn("dividend", F.coalesce("dividend", F.lit(0.0)) * F.col("factor"))
    w = Window.partitionBy("instrument").orderBy("date")
    reference = F.try_divide(F.lag("close", 1).over(w), F.coalesce(F.nullif("split", F.lit(0.0)), F.lit(1.0))) - F.col("dividend")
    rows = nominal.withColumns({"jump": F.abs(F.try_divide("open", reference) - 1), "same": F.count("*").over(Window.partitionBy("instrument", "date")), "sound": sound})
    outside = (F.col("high") + 1e-6 < F.greatest("open", "close")) | (F.col("low") - 1e-6 > F.least("open", "close"))
    tests = [
        ("duplicate", "error", F.col("same") > 1),
        ("invalid", "error", ~F.col("sound")),
        ("envelope", "warning", outside & F.col("sound")),
        ("opening gap", "error", (F.col("jump") > gap) & F.lit(gaps)),
    ]
    return _issues(rows, tests)


def from_nominal(bars: DataFrame, events: DataFrame) -> DataFrame:
    """The inverse of nominal_prices(): nominal bars(instrument, date, prices, volume) and events(instrument, date, ratio)
    as bars adjusted for all later splits; adj_close is the close. Events on days without a bar have no effect."""
    rows = bars.join(events.select("instrument", "date", F.col("ratio").alias("split")), ["instrument", "date"], "left")
    w = Window.partitionBy("instrument").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    factor = F.coalesce(F.product(F.coalesce(F.nullif("split", F.lit(0.0)), F.lit(1.0))).over(w), F.lit(1.0))
    rows = rows.withColumn("factor", factor).withColumns({c: F.col(c) / F.col("factor") for c in ("open", "high", "low", "close")} | {"volume": F.col("volume") * F.col("factor")})
    return rows.withColumn("adj_close", F.col("close"))


def adjusted(bars: DataFrame) -> DataFrame:
    """Prices times adj_close over close; bars without an adj_close stay as they are."""
    ratio = F.coalesce(F.try_divide("adj_close", "close"), F.lit(1.0))
    return bars.withColumn("_r", ratio).withColumns({c: F.col(c) * F.col("_r") for c in ("open", "high", "low", "close")}).drop("_r") if "adj_close" in bars.columns else bars


def anchored(signals: DataFrame, raw: DataFrame, days: DataFrame, most: int = 260) -> DataFrame:
    """Adjusted bars as they looked on each day: day, instrument, date, prices, in the units of the actual close of the
    session before the day, so that later splits and dividends change nothing.

    signals, raw(instrument, date, close); days(instrument, day): each sees its last `most` bars before it."""
    both = signals.join(raw.select("instrument", "date", F.col("close").alias("actual")), ["instrument", "date"], "left")
    place = both.withColumn("place", F.row_number().over(Window.partitionBy("instrument").orderBy("date")))
    # the anchor: the last bar before the day
    line = place.select("instrument", "date", "place", F.try_divide("actual", "close").alias("ratio"), F.lit(None).cast("date").alias("day"), F.lit(1).alias("kind"))
    asked = days.select("instrument", F.col("day").alias("date"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("double").alias("ratio"), "day", F.lit(0).alias("kind"))
    w = Window.partitionBy("instrument").orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, 0)
    anchors = line.union(asked).withColumn("a", F.last(F.when(F.col("kind") == 1, F.struct("place", "ratio")), ignorenulls=True).over(w)).where("kind = 0 and a is not null")
    # a day's bars are the `most` places up to its anchor: an equi-join on exploded places
    wanted = anchors.select("instrument", "day", F.col("a.ratio").alias("ratio"), F.explode(F.sequence(F.greatest(F.col("a.place") - most + 1, F.lit(1)), F.col("a.place"))).alias("place"))
    rows = wanted.join(place, ["instrument", "place"])
    return rows.select("day", "instrument", "date", *[(F.col(c) * F.col("ratio")).alias(c) for c in ("open", "high", "low", "close") if c in signals.columns])


# --- feeds --------------------------------------------------------------------------------------------------------------
def klines(lines: DataFrame, text: str = "line") -> DataFrame:
    """date,open,close,high,low,volume lines as bars; lines with fewer parts are dropped, other columns kept."""
    rest = [c for c in lines.columns if c != text]
    parts = F.split(text, ",")
    cast = [F.expr(f"try_cast(get(parts, {i}) as double)").alias(n) for i, n in enumerate(("open", "close", "high", "low", "volume"), 1)]
    return lines.select(*rest, parts.alias("parts")).where(F.size("parts") >= 6).select(*rest, F.expr("try_cast(get(parts, 0) as date)").alias("date"), *cast)


def symbol_code(raw: str) -> Column:
    """Suffix cut, padded with zeros to six letters; longer codes stay."""
    code = F.element_at(F.split(F.upper(F.trim(raw)), r"\."), 1)
    return F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)


def manifest(bars: DataFrame) -> DataFrame:
    """Per instrument: rows, first, last and an order-free digest of its rows."""
    return bars.groupBy("instrument").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.bit_xor(F.xxhash64("date", "open", "high", "low", "close", "volume")).alias("digest"))
