"""Secrets: patterns give labelled credentials, grammars inferred from them find others of the same format.

A grammar is a probabilistic automaton. It begins as the prefix tree of a kind's labelled credentials, whose states are merged
where the frequencies of their ends and next letters agree within Hoeffding bounds, all the way down. Every long token of
every text is then scored: bits that its best grammar saves over a model of ordinary text."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import cut, slices, table

# Fixed patterns.
_KEY = rb"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = re.compile(_KEY + rb"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
BASE = ("assign", "access", "hex")
ADDED = ("like_assign", "like_access", "like_hex")
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_CODE = np.zeros(256, dtype=np.int64)  # 0: not in a token
_CODE[list(LETTERS)] = np.arange(1, len(LETTERS) + 1)
_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_WIDE = len(LETTERS) + 1
_APART = 255  # between texts; no byte of UTF-8


@dataclass(frozen=True)
class Settings:
    """sample: distinct credentials of a kind that a grammar is inferred from, at most (the documented bound), taken by a hash
    of the credential; longest: longer ones are not learned from. doubt: the chance at which a Hoeffding bound calls equal
    frequencies unequal; meagre: states seen less often are not compared. shortest: tokens under this length are no
    candidates; a candidate is a secret if it saves `bits` in all and `rate` on each letter, and if its grammar needs no more
    than `slack` bits a letter beyond what it needs on its own credentials."""

    sample: int = 1000
    longest: int = 256
    doubt: float = 1e-4
    meagre: int = 8
    shortest: int = 16
    bits: float = 24.0
    rate: float = 1.0
    slack: float = 1.0


@dataclass
class Grammar:
    """goes[state, letter code]: next state, -1 for none. seen[state, code]: how often; code 0 is the end."""

    goes: np.ndarray
    seen: np.ndarray
    log: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cost: float = 0.0

    def weigh(self, ordinary: np.ndarray) -> None:
        """log2 chances, smoothed by one more observation with the frequencies of ordinary letters, and mean bits a letter."""
        share = ordinary.sum(axis=0) / ordinary.sum()
        self.log = np.log2((self.seen + share) / (self.seen.sum(axis=1, keepdims=True) + 1))
        self.cost = float(-(self.seen * self.log).sum() / max(self.seen[:, 1:].sum(), 1))


def infer(words: list[bytes], s: Settings = Settings()) -> Grammar:
    """The grammar of words of LETTERS; words that repeat count as often. No words: one state that has seen nothing."""
    children: list[dict[int, int]] = [{}]
    count, ends = [0], [0]
    for word in sorted(words):
        at = 0
        count[0] += 1
        for c in _CODE[np.frombuffer(word, np.uint8)].tolist():
            to = children[at].get(c)
            if to is None:
                to = children[at][c] = len(children)
                children.append({})
                count.append(0)
                ends.append(0)
            at = to
            count[at] += 1
        ends[at] += 1
    # arrivals[state]: how often each letter was taken there
    taken = [{c: count[to] for c, to in kids.items()} for kids in children]
    bound = math.sqrt(0.5 * math.log(2 / s.doubt))

    def distance(a: int, b: int) -> float:
        """The largest difference of two states in units of its bound; over 1 is too much."""
        most = 0.0
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = count[a], count[b]
            if min(n, m) < s.meagre:
                continue
            unit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for c in {*taken[a], *taken[b]}:
                most = max(most, abs(taken[a].get(c, 0) / n - taken[b].get(c, 0) / m) / unit)
            most = max(most, abs(ends[a] / n - ends[b] / m) / unit)
            if most > 1:
                return most
            stack += [(children[a][c], to) for c, to in children[b].items() if c in children[a]]
        return most

    def fold(a: int, b: int) -> None:
        """Adds the tree below b to state a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            count[a] += count[b]
            ends[a] += ends[b]
            for c, n in taken[b].items():
                taken[a][c] = taken[a].get(c, 0) + n
            for c, to in children[b].items():
                if c in children[a]:
                    stack.append((children[a][c], to))
                else:
                    children[a][c] = to

    kept, open_ = [0], []

    def border(state: int) -> None:
        for c, to in children[state].items():
            if to not in settled:
                heapq.heappush(open_, (-count[to], to, state, c))

    settled = {0}
    border(0)
    while open_:  # the most frequent state next
        _, state, parent, c = heapq.heappop(open_)
        if state in settled or children[parent].get(c) != state:
            continue
        # of equally fit states, as all are for one that is hardly ever seen, its own predecessor
        far, _, best = min((distance(k, state), k != parent, i) for i, k in enumerate(kept))
        if far <= 1:
            children[parent][c] = kept[best]
            fold(kept[best], state)
            for k in kept:
                border(k)
        else:
            settled.add(state)
            kept.append(state)
            border(state)
    name = {k: i for i, k in enumerate(kept)}
    goes, seen = np.full((len(kept), _WIDE), -1, dtype=np.int64), np.zeros((len(kept), _WIDE))
    for k, i in name.items():
        seen[i, 0] = ends[k]
        for c, to in children[k].items():
            goes[i, c], seen[i, c] = name[to], taken[k][c]
    return Grammar(goes, seen)


def saved(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, grammar: Grammar, ordinary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token code[start:end] the bits that the grammar saves over ordinary text (log2 chances of letter pairs), and
    the bits that it needs. A letter that a state has never seen leaves it in that state."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    first, left = starts[order], size[order]
    state, total, before = np.zeros(len(order), np.int64), np.zeros((2, len(order))), np.zeros(len(order), np.int64)
    log, goes = grammar.log, grammar.goes
    step, n = 0, len(order)
    while n := int(np.searchsorted(-left[:n], -step, "left")):
        if n < 4 and left[0] - step > 512:  # few and long: one at a time
            for k in range(n):
                at, last, own, other = int(state[k]), int(before[k]), 0.0, 0.0
                for c in code[first[k] + step : first[k] + left[k]].tolist():
                    own += log[at, c]
                    other += ordinary[last, c]
                    at, last = int(goes[at, c]) if goes[at, c] >= 0 else at, c
                state[k], before[k] = at, last
                total[:, k] += own, other
            break
        c = code[first[:n] + step]
        total[:, :n] += log[state[:n], c], ordinary[before[:n], c]
        to = goes[state[:n], c]
        state[:n] = np.where(to >= 0, to, state[:n])
        before[:n] = c
        step += 1
    total += log[state, 0], ordinary[before, 0]
    out = np.empty((2, len(order)))
    out[:, order] = total[0] - total[1], -total[0]
    return out[0], out[1]


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def _apart(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a slice with one byte between any two, and where each begins."""
    return np.insert(data, at[1:-1], _APART), at[:-1] + np.arange(len(at) - 1)


def _base(joined: np.ndarray) -> dict[str, np.ndarray]:
    """Spans of each base kind: columns start, end, and start of the credential in it (it ends with the span)."""
    text = joined.tobytes()
    none = np.zeros((0, 3), dtype=np.int64)
    assign = [(m.start(), m.end(), m.start(1)) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    access = [(m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    starts, ends = _runs(_HEX[joined], 24)
    return {"assign": np.array(assign or none, dtype=np.int64), "access": np.array(access or none, dtype=np.int64), "hex": np.stack([starts, ends, starts], axis=1)}


def _covered(size: int, spans: np.ndarray) -> np.ndarray:
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, spans[:, 0], 1)
    np.add.at(step, spans[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def learned(docs: DataFrame, text: str = "text", s: Settings = Settings()) -> tuple[dict[str, Grammar], np.ndarray]:
    """A grammar for each base kind, and log2 chances of a letter after a letter in ordinary tokens, those outside of base
    spans and shorter than s.shortest (code 0: before the first, after the last).

    The letter pairs are counted over all texts; pairs never seen have a chance by their second letter. Credentials are told apart first (equal ones count once), so a hot one
    weighs no more than any other; of each kind those with the highest hash levels are taken, as many levels as fit
    s.sample. Both are sums and do not depend on partitions."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, found = np.zeros(_WIDE * _WIDE, dtype=np.int64), set()
        names = ["kind", "value", "pair", "n"]
        for batch in batches:
            for _, data, at in slices(batch, text):
                joined, _ = _apart(data, at)
                base = _base(joined)
                for kind, spans in base.items():
                    short = spans[spans[:, 1] - spans[:, 2] <= s.longest]
                    found |= {(kind, joined[i:j].tobytes()) for _, j, i in short.tolist()}
                code = _CODE[joined]
                for spans in (*base.values(), np.stack(_runs(code > 0, s.shortest), axis=1)):
                    code[_covered(len(code), spans)] = 0
                code = np.r_[0, code, 0]
                pairs += np.bincount(code[:-1] * _WIDE + code[1:], minlength=len(pairs))
                if len(found) >= 10_000:
                    yield pa.record_batch([pa.array([k for k, _ in found]), pa.array([v for _, v in found], pa.binary()), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64())], names=names)
                    found = set()
        held = np.flatnonzero(pairs)
        rows = [[k for k, _ in found] + [None] * len(held), [v for _, v in found] + [None] * len(held), [None] * len(found) + held.tolist(), [None] * len(found) + pairs[held].tolist()]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=names)

    gathered = cut(docs.select(text).mapInArrow(gather, "kind string, value binary, pair long, n long").groupBy("kind", "value", "pair").agg(F.sum("n").alias("n")))
    ordinary = np.zeros(_WIDE * _WIDE)
    for x in gathered.where("pair is not null").select("pair", "n").collect():  # 69 x 69 rows at most
        ordinary[x.pair] += x.n
    ordinary[0] = 0  # what lies between tokens
    ordinary = ordinary.reshape(_WIDE, _WIDE)
    letter = ordinary.sum(axis=0) + 0.5
    ordinary += letter / letter.sum()
    # level l holds one credential in 2 ** (l + 1)
    level = F.floor(-F.log2((F.pmod(F.xxhash64("kind", "value"), F.lit(1 << 40)) + 0.5) / (1 << 40)))
    values = gathered.where("kind is not null").select("kind", "value", level.alias("level"))
    floors = {kind: 64 for kind in BASE}
    sizes: dict[str, int] = dict.fromkeys(BASE, 0)
    for x in values.groupBy("kind", "level").count().orderBy("kind", F.desc("level")).collect():  # 41 levels a kind
        if floors[x.kind] >= 0 and sizes[x.kind] + x["count"] <= s.sample:
            sizes[x.kind], floors[x.kind] = sizes[x.kind] + x["count"], x.level
        else:
            sizes[x.kind] = s.sample + 1
    chosen = values.where(F.expr(" or ".join(f"(kind = '{kind}' and level >= {least})" for kind, least in floors.items())))

    def grown(part: pa.Table) -> pa.Table:
        grammar = infer(part.column("value").to_pylist(), s)
        state, code = np.nonzero(grammar.seen)
        got = [pa.array(part.column("kind").to_pylist()[:1] * len(state), pa.string()), pa.array(state), pa.array(code), pa.array(grammar.goes[state, code]), pa.array(grammar.seen[state, code])]
        return pa.table(got, names=["kind", "state", "code", "goes", "seen"])

    rows = chosen.groupBy("kind").applyInArrow(grown, "kind string, state long, code long, goes long, seen double").toPandas()
    grammars = {}
    for kind in BASE:
        own = rows[rows.kind == kind]
        size = int(own.state.max()) + 1 if len(own) else 1
        grammar = Grammar(np.full((size, _WIDE), -1, dtype=np.int64), np.zeros((size, _WIDE)))
        grammar.goes[own.state, own.code], grammar.seen[own.state, own.code] = own.goes, own.seen
        grammar.weigh(ordinary)
        grammars[kind] = grammar
    return grammars, np.log2(ordinary / ordinary.sum(axis=1, keepdims=True))


def found(docs: DataFrame, text: str = "text", s: Settings = Settings()) -> DataFrame:
    """docs with one more column, secrets: an array of (kind, start, end, score) by start, then kind (assign, access, hex and
    like_ each of them); code points, end exclusive; score: bits saved by the kind's grammar on the credential.

    Base matches are leftmost and do not overlap within a kind; one that is too short is dropped without another try, and
    base matches stay whatever their score. Tokens of [A-Za-z0-9+/_.=-] that touch no base match are secrets if the
    grammar of a kind with labelled credentials finds them likely (see Settings). Null and empty texts have none;
    tokens of any length are scored whole. Without labelled credentials nothing is added. Rows, repeated ones too, and
    other columns stay; a column named secrets is replaced. Two passes over docs and no shuffle of texts."""
    grammars, ordinary = learned(docs, text, s)
    kept = docs.drop("secrets")
    kind_of = [*BASE, *ADDED]
    schema = kept.withColumn("secrets", F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")).schema
    shape = [pa.field("kind", pa.string()), pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("score", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, text):
                joined, begin = _apart(data, at)
                base, code = _base(joined), _CODE[joined]
                spans = [np.r_[base[kind].T, [saved(code, base[kind][:, 2], base[kind][:, 1], grammars[kind], ordinary)[0]], [np.full(len(base[kind]), k)]] for k, kind in enumerate(BASE)]
                starts, ends = _runs(code > 0, s.shortest)
                touched = np.r_[0, np.cumsum(_covered(len(joined), np.concatenate([*base.values()])))]
                free = touched[ends] == touched[starts]
                starts, ends = starts[free], ends[free]
                scores = np.full((len(BASE), len(starts)), -np.inf)
                for k, kind in enumerate(BASE):
                    bits, needed = saved(code, starts, ends, grammars[kind], ordinary)
                    of_format = needed <= (grammars[kind].cost + s.slack) * (ends - starts)
                    scores[k] = np.where(of_format & grammars[kind].seen.any(), bits, -np.inf)
                best = scores.argmax(axis=0)
                top = scores[best, np.arange(len(starts))]
                good = (top >= s.bits) & (top >= s.rate * (ends - starts))
                spans.append(np.array([starts[good], ends[good], starts[good], top[good], best[good] + len(BASE)]))
                start, end, _, score, kind = np.concatenate(spans, axis=1)
                start, end, kind = start.astype(np.int64), end.astype(np.int64), kind.astype(np.int64)
                order = np.lexsort((kind, start))
                start, end, score, kind = start[order], end[order], score[order], kind[order]
                row = np.searchsorted(begin, start, "right") - 1
                points = np.r_[0, np.cumsum((joined & 0xC0) != 0x80)]
                origin = points[begin[row]]
                columns = [pa.array([kind_of[k] for k in kind.tolist()], pa.string()), pa.array((points[start] - origin).astype(np.int32)), pa.array((points[end] - origin).astype(np.int32)), pa.array(np.round(score, 2))]
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)), pa.StructArray.from_arrays(columns, fields=shape))
                yield pa.record_batch([*part.columns, listed], names=[*part.schema.names, "secrets"])

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (kind:start:end) and their scores in the same order, one row per
    row of docs."""

    def joined(spans: Column | str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("secrets", lambda s: s["score"].cast("string")), ",")
    return found(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", *map(number, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined("secrets").alias("spans"), scores.alias("scores"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
