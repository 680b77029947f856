"""Periodic runs of words: an online suffix automaton whose suffix-link tree is a link-cut tree.

Appending a word accesses the new state: the path to the root is recoloured with the present position. Before that it lies in
segments of one colour each, and a segment's colour c is the last place where its strings ended before. Strings of a segment
up to length l end at c and at the present i, so a distance i - c of l or less is a square, which is then extended to a run.
For the smallest period q of a run the last occurrence before the present one is exactly q words back (a primitive string
does not occur inside its own square), so no run is missed."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import _SPACE, mixed, slices, table

#: The shortest run, in words. Half of it is the size of the repeated word sequence that every run holds (see `stretches`).
LEAST = 12
#: Above so many words the automaton's arrays hold machine integers: slower, but a tenth of the memory.
LISTED = 50_000


class Automaton:
    """Suffix automaton over word numbers, one word at a time. Its suffix links are kept as a link-cut tree of splay trees:
    one splay tree per preferred path, and every node of a path has the colour of the path, which its splay root holds."""

    def __init__(self, most: int):
        size = 2 * most + 2
        full: Callable[[int], list | array] = (lambda x: [x] * size) if most < LISTED else (lambda x: array("i", [x]) * size)
        self.length, self.link, self.word, self.goes = full(0), full(-1), full(-1), full(-1)
        self.more: dict[int, dict[int, int]] = {}  # transitions beyond a state's first
        self.up, self.left, self.right, self.colour = full(-1), full(-1), full(-1), full(-1)
        self.states, self.last, self.now = 1, 0, -1

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = x
        p = up[x]
        while p >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            top = g if inner else p
            if inner and (left[g] == p) == (left[p] == x):  # parent over grandparent first
                self._rotate(p, g)
                self._rotate(x, p)
            else:
                self._rotate(x, p)
                if inner:
                    self._rotate(x, g)
            p = up[x]
        self.colour[x] = self.colour[top]

    def _rotate(self, x: int, p: int) -> None:
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b >= 0:
            up[b] = p
        up[p] = x
        up[x] = g
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def _step(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.goes[state]
        others = self.more.get(state)
        return others.get(word, -1) if others else -1

    def _lead(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.goes[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def append(self, word: int) -> list[tuple[int, int]]:
        """Squares that end with this word: (their period, how long the two copies agree), one for each last occurrence."""
        length, link = self.length, self.link
        new, p = self.states, self.last
        self.states, self.last = new + 1, new
        length[new] = length[p] + 1
        while p >= 0 and (q := self._step(p, word)) < 0:
            self._lead(p, word, new)
            p = link[p]
        if p < 0:
            link[new] = 0
        elif length[q] == length[p] + 1:
            link[new] = q
        else:
            link[new] = self._split(p, q, word)
        self.up[new] = link[new]
        return self._access(new)

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of state q for its strings that also end here; it stands between q and q's link, on q's path."""
        copy, link = self.states, self.link
        self.states = copy + 1
        self.length[copy], link[copy] = self.length[p] + 1, link[q]
        self.word[copy], self.goes[copy] = self.word[q], self.goes[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        link[q] = copy
        while p >= 0 and self._step(p, word) == q:
            self._lead(p, word, copy)
            p = link[p]
        self._splay(q)
        above = self.left[copy] = self.left[q]
        if above >= 0:
            self.up[above] = copy
        self.left[q], self.up[copy] = copy, q
        return copy

    def _access(self, state: int) -> list[tuple[int, int]]:
        up, right, colour, length = self.up, self.right, self.colour, self.length
        self.now = now = self.now + 1
        found, below, x = [], -1, state
        while x >= 0:
            self._splay(x)
            c, r = colour[x], right[x]
            if r >= 0:
                colour[r] = c
            right[x] = below
            if c >= 0 and now - c <= length[x]:
                found.append((now - c, length[x]))
            below, x = x, up[x]
        colour[below] = now
        self._splay(state)
        return found


def runs_of(words: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` words, by start, then period."""
    automaton, size = Automaton(len(words)), len(words)
    reach: dict[int, int] = {}  # by period, the end of the last region that was extended
    found: dict[tuple[int, int], int] = {}
    for i, word in enumerate(words):
        for period, agreed in automaton.append(word):
            if reach.get(period, -1) >= i:
                continue
            start, end = i - agreed - period + 1, i + 1
            while end < size and words[end] == words[end - period]:
                end += 1
            reach[period] = end - 1
            if end - start >= max(least, 2 * period):  # the same stretch may also have multiples of its period
                found[start, end] = min(period, found.get((start, end), period))
    return sorted((start, end - start, period) for (start, end), period in found.items())


def _split_words(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts as one array, and the first word of each text (n + 1)."""
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    begins[edges] = solid[edges]
    starts = np.flatnonzero(begins)
    places = np.append(np.cumsum(solid)[starts] - 1, int(solid.sum())) if len(starts) else np.zeros(1, np.int64)
    array = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data[solid]))
    return array, np.searchsorted(starts, at)


def stretches(number: np.ndarray, part: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words in which all runs lie; part: text of each word.

    Within a run of length l and period q the first l - q words come again q words later; that is half of `least` or more,
    and together both copies cover the run. So each word of a run lies in a repeated sequence of half of `least` words, and
    only what is covered by such sequences of one stretch can hold runs. Told by hashes: a collision only keeps more."""
    k = least // 2
    where = np.arange(len(number))
    for _ in range(4):
        if len(where) < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        v = mixed(number[where].astype(np.uint64) + np.uint64(1))
        h = mixed(part[where[: len(where) - k + 1]].astype(np.uint64) + np.uint64(0x51ED27))
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + v[j : len(v) - k + 1 + j]
        h = mixed(h)
        inside = (where[k - 1 :] - where[: len(where) - k + 1] == k - 1) & (part[where[k - 1 :]] == part[where[: len(where) - k + 1]])
        own = np.sort(h[inside])
        twice = np.unique(own[1:][own[1:] == own[:-1]])
        near = np.zeros(1 << 16, dtype=bool)
        near[twice >> np.uint64(48)] = True
        again = np.flatnonzero(inside & near[h >> np.uint64(48)])
        again = again[np.isin(h[again], twice)]
        step = np.zeros(len(number) + 1, dtype=np.int64)
        np.add.at(step, where[again], 1)
        np.add.at(step, where[again] + k, -1)
        covered = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        if not len(covered):
            return covered, covered
        breaks = np.flatnonzero((np.diff(covered) > 1) | (part[covered[1:]] != part[covered[:-1]]))
        first, last = covered[np.r_[0, breaks + 1]], covered[np.r_[breaks, len(covered) - 1]] + 1
        long = last - first >= least
        first, last = first[long], last[long]
        total = int((last - first).sum())
        if total == len(where):
            break
        # once more, each stretch on its own
        where = np.repeat(first - np.r_[0, np.cumsum(last - first)[:-1]], last - first) + np.arange(total)
        part = part.copy()
        part[where] = np.repeat(np.arange(len(first)), last - first) + len(number)
    return first, last


def found(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with three more columns: n_words, runs (array of (start, length, period) in words, by start, then period) and
    collapsed (the words that are left when each run keeps its first period, joined by one space).

    Words are [^\\x20\\x09-\\x0D]+, compared as they are. A run has the smallest period q, `least` words or more and 2 q or
    more, and its neighbours do not continue it. Null, empty and wordless texts have no words, no runs and an empty collapsed
    text; texts of any length are read whole, one at a time in a task's memory. Repeated rows stay, columns of these three
    names are replaced, an empty table gives no rows. No shuffle."""
    kept = docs.drop("n_words", "runs", "collapsed")
    run_type = "array<struct<start:long,length:long,period:long>>"
    schema = kept.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.array().cast(run_type), "collapsed": F.lit("")}).schema
    shape = pa.struct([pa.field(x, pa.int64()) for x in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, text):
                words, first = _split_words(data, at)
                number = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                starts, ends = stretches(number, row, least)
                runs = [(r, i - first[r] + s, n, q) for i, j in zip(starts.tolist(), ends.tolist(), strict=True) for r in (int(row[i]),) for s, n, q in runs_of(number[i:j].tolist(), least)]
                r, s, n, q = np.array(runs, dtype=np.int64).reshape(-1, 4).T
                gone = np.zeros(len(number) + 1, dtype=np.int64)
                np.add.at(gone, first[r] + s + q, 1)
                np.add.at(gone, first[r] + s + n, -1)
                keep = np.cumsum(gone[:-1]) == 0
                left = np.r_[0, np.cumsum(keep)][first]
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(keep))), " ")
                spans = pa.StructArray.from_arrays([pa.array(x) for x in (s, n, q)], fields=list(shape))
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(part.num_rows + 1)).astype(np.int32)), spans)
                yield pa.record_batch([*part.columns, pa.array(np.diff(first)), listed, collapsed], names=[*part.schema.names, "n_words", "runs", "collapsed"])

    return kept.mapInArrow(run, schema)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of every tenth document (by h = crc32 of its id) repeat from one place on: with
    g = floor(h / 10), words i >= a = g % n become the words a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Other
    texts, and those without words or id, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")

        def from_place(x: Column) -> Column:  # (a, p)
            tail = F.transform(F.sequence(F.lit(0), n - x["a"] - 1), lambda i: F.get(words, x["a"] + F.pmod(i, x["p"])))
            return F.array_join(F.concat(F.slice(words, F.lit(1), x["a"]), tail), " ")

        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("int")
        return F.when(n > 0, _let(F.struct(a.alias("a"), p.alias("p")), from_place)).otherwise(F.lit(""))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    return docs.select(F.col("doc_id").cast("long"), F.when((h % 10 == 0) & F.col("text").isNotNull(), _let(words, again)).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; four nulls without one), its exponent in
    thousandths, and digests of all runs and of the collapsed text, one row per row of docs."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("back"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    of_runs = found(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    best = {"start": F.col("best.start"), "length": -F.col("best.back"), "period": F.col("best.period"), "exponent_milli": F.floor(-1000 * F.col("best.back") / F.col("best.period"))}
    return of_runs.select("doc_id", "n_runs", *[x.cast("long").alias(name) for name, x in best.items()], "runs_sha256", "collapsed_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repeating(table(spark, sf_dir, "documents")))


# The planted repeats, then all equal words of a text at each distance; stretches of neighbours are the regions of a period.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, 8 * length(doc_id::VARCHAR)), lambda b: ((ascii(substr(doc_id::VARCHAR, CAST(b // 8 + 1 AS INTEGER), 1)) >> CAST(b % 8 AS INTEGER)) & 1)::BIGINT)),
                     lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)) AS c
  FROM documents
), e AS (
  SELECT doc_id, w, len(w) AS n, xor(c, 4294967295::BIGINT) AS h FROM d
), f AS (
  SELECT *, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM e
), g AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM f
), words AS (
  SELECT doc_id, i, w[CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word
  FROM (SELECT doc_id, w, h, a, p, unnest(range(0, n)) AS i FROM g)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs
), regions AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM regions GROUP BY doc_id, start, length
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
), told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1
)
SELECT documents.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
