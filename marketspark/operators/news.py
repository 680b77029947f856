"""Articles and proposals: feed items, filters, policy events, checked JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.operators.records import article_id, plain, safe_url

# Terms that make an article a policy event, terms that take it back, and terms that nothing takes back.
KEEP_TERMS = (
    "bis", "export control", "entity list", "tariff", "tariffs", "pboc", "csrc", "nsc", "ofac", "antitrust", "platform economy",
    "gaming license", "semiconductor control", "出口管制", "实体清单", "关税", "平台经济", "反垄断", "证监会", "央行",
)
DROP_TERMS = ("earnings beat", "earnings miss", "price target", "analyst", "stocks rally", "stocks plunge", "overbought", "oversold", "sentiment")
FIRM_TERMS = ("bis", "export control", "entity list", "出口管制", "实体清单")
#: Fixed value: the form of a feed's dates; the zone must be there, as an offset or GMT.
DATE_FORM = r"(?:[A-Za-z]{3},\s*)?(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}:\d{2})(?::(\d{2}))?\s+([+-]\d{4}|GMT|UT|UTC)"


def published(text: Column) -> Column:
    """Moment in UTC (timestamp_ntz) of a feed's date; null without a zone or if it is none."""
    part = lambda i: F.regexp_extract(text, DATE_FORM, i)
    zone = F.when(part(6).rlike("^[+-]"), part(6)).otherwise("+0000")
    local = F.concat(F.lpad(part(1), 2, "0"), F.lit(" "), F.initcap(part(2)), F.lit(" "), part(3), F.lit(" "), part(4), F.lit(":"), F.when(part(5) == "", "00").otherwise(part(5)))
    # the pattern is read without a locale: months by their English names
    month = F.array_position(F.array(*[F.lit(m) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")]), F.substring(local, 4, 3))
    stamp = F.concat(F.substring(local, 8, 4), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.substring(local, 1, 2), F.lit(" "), F.substring(local, 13, 8)).try_cast("timestamp_ntz")
    minutes = (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    return F.when(text.rlike(DATE_FORM), stamp - F.make_dt_interval(F.lit(0), F.lit(0), minutes))


def articles(items: DataFrame, now: Column, title: int = 400) -> DataFrame:
    """items(title, link, published text, other columns) as id, title, url, published_at and the other columns.

    Tags and entities go from the title, which is cut; items without a title or a safe url are dropped, and those that are
    dated after now (timestamp_ntz); a date without a zone is unknown."""
    rest = [c for c in items.columns if c not in ("title", "link", "published")]
    rows = items.select(*rest, plain("title", title).alias("title"), safe_url("link").alias("url"), published(F.col("published")).alias("published_at"))
    rows = rows.where((F.col("title") != "") & F.col("url").isNotNull() & ~F.coalesce(F.col("published_at") > now, F.lit(False)))
    return rows.select(article_id(F.col("url")).alias("id"), "title", "url", "published_at", *rest)


def newest(merged: DataFrame, by: str, n: int = 5000) -> DataFrame:
    """The n newest, undated ones last."""
    return merged.orderBy(F.desc_nulls_last(by), "id").limit(n)


def filtered(rows: DataFrame, region: str | None = None, tag: str | None = None, text: str | None = None, since: Column | None = None, order: str = "published_at", n: int = 300) -> DataFrame:
    """One page of rows(region, tags array, title, published_at) that match, newest first, each with matched_count: how many
    match altogether."""
    if region:
        rows = rows.where(F.col("region") == region)
    if tag:
        rows = rows.where(F.array_contains("tags", tag))
    if text:
        rows = rows.where(F.contains(F.lower("title"), F.lit(text.lower())))
    if since is not None:
        rows = rows.where(F.col("published_at") >= since)
    count = rows.agg(F.count("*").alias("matched_count"))
    return rows.orderBy(F.desc_nulls_last(order)).limit(n).crossJoin(F.broadcast(count))  # one row


def policy_event(text: Column, keep: tuple[str, ...] = KEEP_TERMS, drop: tuple[str, ...] = DROP_TERMS, firm: tuple[str, ...] = FIRM_TERMS) -> Column:
    """Whether a text holds a term to keep, and either none to drop or a firm one; letter case is ignored."""
    low = F.lower(text)
    holds = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))
    return F.coalesce(holds(keep) & (~holds(drop) | holds(firm)), F.lit(False))


def proposals(rows: DataFrame, column: str = "raw") -> DataFrame:
    """rows with decision (apply or no_change), name, scores (map of whole numbers) and error of a proposal's JSON.

    A code fence is taken off. What is no JSON object, speaks of sentiment or polarity, or has no scores that are whole
    numbers is an error."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.col(column)), r"^```(?:json|yaml)?\s*", ""), r"\s*```$", "")
    rows = rows.withColumn("_t", text).withColumn("_j", F.from_json("_t", "map<string,string>"))
    rows = rows.withColumn("_s", F.from_json(F.col("_j")["scores"], "map<string,string>"))
    none = (F.contains(F.lower("_t"), F.lit("no_change")) & ~F.contains(F.lower("_t"), F.lit("scores"))) | F.coalesce(F.col("_j")["decision"] == "no_change", F.lit(False))
    whole = F.transform_values("_s", lambda _, v: v.try_cast("decimal(30,10)").cast("long"))
    mood = F.exists(F.map_keys("_j"), lambda k: F.lower(k).isin("sentiment", "polarity"))
    error = (
        F.when(none & F.col("_j").isNull(), None).when(F.col("_j").isNull() | ~F.coalesce(F.col("_t").startswith("{"), F.lit(False)), "not json").when(mood, "sentiment").when(none, None)
        .when(F.col("_s").isNull(), "no scores").when(F.exists(F.map_values(whole), lambda v: v.isNull()), "not whole numbers")
    )
    decision = F.when(error.isNull(), F.when(none, "no_change").otherwise("apply"))
    rows = rows.withColumns({"decision": decision, "name": F.when(decision == "apply", F.coalesce(F.col("_j")["name"], F.lit("untitled_regime"))), "scores": F.when(decision == "apply", whole), "error": error})
    return rows.drop("_t", "_j", "_s")
