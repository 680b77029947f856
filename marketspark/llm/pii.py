"""Personal data: patterns propose spans, checksums confirm them, words before a span move its score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import table

# Fixed patterns. They are written with possessive steps and with starts fixed to the first place of a run (or the end of
# the last match, \G), which finds the same matches without trying every place of a long run again.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"  # runs with fewer digits never pass
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
#: Words near a span that raise its score by 0.3, and words that lower it by 0.3. Near is what stands between a match and
#: its neighbours of the same pattern, 40 code points on either side at most.
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|adresse",
    "card": r"(?i)card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel|mobile|fax|telefon",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
    "ssn": r"(?i)ssn|social|security|tax",
}
DOUBT = r"(?i)version|isbn|order no|serial|example"
NEAR = 40
#: Score of a confirmed span before its context: checksums are strong evidence, bare shapes are not.
PRIOR = {"email": 0.8, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.7, "ssn": 0.4}
ACCEPTED = 0.5


def _luhn(match: Column) -> Column:
    """The digits from the right, every second one doubled, digit sums added: a multiple of ten."""
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.length(digits).between(16, 19) & (F.aggregate(places, F.lit(0), add) % 10 == 0)


def _mod97(match: Column) -> Column:
    """First four letters moved to the end, letters as 10 to 35: one, modulo 97."""
    plain = F.regexp_replace(match, "\x20", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(left: Column, i: Column) -> Column:
        c = F.substring(moved, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (left * 10 + F.ascii(c) - 48) % 97).otherwise((left * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _small_parts(match: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(match, r"\."), small)


def _digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


# kind: pattern, a cheap test that every text with a match passes, what confirms a match
_RULES = {
    "email": (_EMAIL, lambda t: F.instr(t, "@") > 0, None),
    "ip": (_IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), _small_parts),
    "card": (_CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), _luhn),
    "phone": (_PHONE, lambda t: t.rlike(r"\+[0-9]"), lambda m: _digits(m).between(8, 15)),
    "iban": (_IBAN, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"), _mod97),
    "ssn": (_SSN, lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda m: ~m.rlike(r"^(?:000|666|9)|-00-|0000$")),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once, however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_runs(items: Column, fold: Callable[[Column, Column], Column], reach: Callable[[Column, Column], Column]) -> Column:
    """fold(run, where it begins) of runs of about sqrt(n) items, as an array; reach(at, run) is where a run that begins at
    `at` ends. An array is never built element by element over its whole size, which would be quadratic."""

    def by_runs(items: Column) -> Column:
        size = F.size(items)
        step = F.greatest(F.ceil(F.sqrt(size)).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), step), lambda i: F.slice(items, i + 1, step))

    def folded(runs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(runs, start, lambda acc, run: F.struct(reach(acc["at"], run).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.zip_with(runs, begins, fold)

    return _let(items, lambda x: _let(by_runs(x), folded))


def _spans(text: Column, kind: str) -> Column:
    """Confirmed matches of one kind: array of (kind, start, end, score), code points, end exclusive.

    The text is split at the pattern; the lengths of what lies between and of the matches give the places, and what lies
    between is all that is looked at for context."""
    pattern, likely, confirm = _RULES[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")

    def pieces(between: Column) -> Column:
        beside = F.zip_with(found, F.slice(between, F.lit(2), F.size(between)), lambda m, a: F.struct(m.alias("match"), a.alias("after")))
        return F.zip_with(between, beside, piece)

    def piece(gap: Column, x: Column) -> Column:
        near = F.concat_ws("\n", F.right(gap, F.lit(NEAR)), F.left(x["after"], F.lit(NEAR)))
        fine = x["match"].isNotNull() & (confirm(x["match"]) if confirm else F.lit(True))
        score = F.when(fine, _score(near, kind))  # null: no match, or one that its check rejects
        return F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(x["match"]), F.lit(0)).alias("size"), score.alias("score"))

    def fold(run: Column, begin: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["size"]
            span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["score"].alias("score")))
            kept = x["score"] >= (ACCEPTED if kind in ADDED else 0.0)
            return F.struct(end.alias("at"), F.when(kept, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(run, F.struct(begin.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def reach(at: Column, run: Column) -> Column:
        return at + F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + x["size"])

    return F.when(likely(text), F.flatten(_in_runs(_let(F.split(text, pattern, -1), pieces), fold, reach))).otherwise(none)


def _score(near: Column, kind: str) -> Column:
    moved = F.lit(PRIOR[kind]) + F.when(near.rlike(CONTEXT[kind]), 0.3).otherwise(0.0) - F.when(near.rlike(DOUBT), 0.3).otherwise(0.0)
    return F.round(F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0)), 2)


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one more column, pii: an array of (kind, start, end, score) by kind (email, ip, card, phone, iban, ssn),
    then start.

    Matches are leftmost and do not overlap within a kind; a match that its check rejects is dropped without another try.
    email, ip, card and phone are kept whatever their score, which callers can filter by; iban and ssn need a score of 0.5
    or more: a bare ssn shape counts only beside a word such as "social", an iban not beside a word such as "example". A null or empty text has no spans. Rows, other columns and repeated rows
    stay as they are; a column named pii is replaced. JVM expressions only, no shuffle."""
    clean = F.coalesce(F.col(text), F.lit(""))
    # by kind in separate columns, so that no expression is evaluated twice
    return docs.withColumn("pii", F.concat(*[_spans(clean, kind) for kind in BASE + ADDED]))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of its text replaced by its kind in angle brackets, e.g. <EMAIL>; of overlapping spans the first
    (then the longer) one names the gap, which covers all of them. n_chars, if there, is counted anew; a null text stays
    null and clean texts stay as they are. Column order is kept."""
    spans = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def reach(at: Column, run: Column) -> Column:
        return F.greatest(at, -F.array_min(F.transform(run, lambda s: s["back"])))

    # each run's part of the text is cut out once, its pieces from that part
    def fold(run: Column, begin: Column) -> Column:
        last = F.greatest(F.array_max(F.transform(run, lambda s: s["start"])), begin)
        return F.struct(reach(begin, run).alias("end"), _let(F.substring(F.col("text"), begin + 1, last - begin), lambda part: shown(run, begin, part)).alias("shown"))

    def shown(run: Column, begin: Column, part: Column) -> Column:
        def one(acc: Column, s: Column) -> Column:
            gap = F.substring(part, acc["at"] - begin + 1, s["start"] - acc["at"])
            out = F.concat(acc["out"], F.array(gap, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
            return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), F.when(s["start"] >= acc["at"], out).otherwise(acc["out"]).alias("out"))

        first = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(run, first, one, lambda acc: F.array_join(acc["out"], ""))

    def joined(runs: Column) -> Column:
        rest = F.substring(F.col("text"), F.element_at(runs, -1)["end"] + 1, F.length("text"))
        return F.concat(F.array_join(F.transform(runs, lambda r: r["shown"]), ""), rest)

    whole = _let(_in_runs(spans, fold, reach), joined)
    out = found(docs).withColumn("text", F.when(F.size("pii") > 0, whole).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (kind:start:end) and their scores in the same order, one row per
    row of docs; texts without spans have zeros and empty strings, an empty table gives no rows."""

    def joined(kinds: tuple[str, ...]) -> Column:
        return F.array_join(F.transform(F.filter("pii", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", *map(number, BASE), F.sha2(joined(BASE), 256).alias("base_sha256"), joined(BASE + ADDED).alias("spans"), F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
