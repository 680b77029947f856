"""Language-model scores from a sharded Elias-Fano trie of words and the contexts before them."""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import cut, mixed, parts, slices, table, words

#: A word is named by 63 bits of its hash; the highest bit is set, so END and START are no word's name.
WORD = 63
END, START = np.uint64(1), np.uint64(2)
#: The number that stands for a context that goes by its name.
NAMED = (1 << 24) - 1
INDEXED = 4 << 20


@dataclass(frozen=True)
class Settings:
    """discount: taken from each word's count for the unknown word; mix: share of the bigram in the mixture. Every word is a
    context of its own with its exact count; exact: as many most frequent ones go by a number and have their counts broadcast
    (12 bytes each), which only saves bytes: the rest go by name and their counts are joined. classes: if over 0, the rest
    share as many contexts, by their hash, a coarser model; exact and classes together under 2**24 - 1. heavy: words
    with over 1 / heavy of all tokens are dealt by word and context; tokens: about as many tokens make one shard; step:
    the width of a quantised log10 probability."""

    discount: float = 0.5
    mix: float = 0.5
    exact: int = 1 << 20
    classes: int = 0
    heavy: int = 2000
    tokens: int = 2_000_000
    step: float = 1 / 4096


def _mapped(data: np.ndarray) -> np.ndarray:
    """A copy in its own memory map, outside Python's heap; it goes back to the system with the trie."""
    out = np.frombuffer(mmap.mmap(-1, max(1, data.nbytes)), dtype=data.dtype, count=len(data))
    out[:] = data
    return out


class EliasFano:
    """A sorted list of unsigned integers: low bits as they are, high bits in unary. Elements and buckets are found through
    counts of the set bits before each 64; nothing is unpacked."""

    def __init__(self, values: np.ndarray, universe: int):
        self.n = len(values)
        self.low = max(0, (universe // max(1, self.n)).bit_length() - 1)
        width = np.uint16 if self.low <= 16 else np.uint32 if self.low <= 32 else np.uint64
        self.lows = _mapped((values & np.uint64((1 << self.low) - 1)).astype(width))
        high = (values >> np.uint64(self.low)).astype(np.int64)
        self.buckets = (universe >> self.low) + 1
        bits = np.zeros(-(-(self.n + self.buckets) // 64) * 64, dtype=np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.highs = _mapped(np.packbits(bits, bitorder="little").view("<u8"))
        ones = np.r_[0, np.cumsum(np.bitwise_count(self.highs).astype(np.int64))]
        self.ones, self.zeros = _mapped(ones), _mapped(np.arange(len(ones)) * 64 - ones)

    def _select(self, before: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place of the at-th set bit of words; before: set bits before each word."""
        block = np.searchsorted(before, at, "right") - 1
        word, left, place = words[block], (at - before[block]).astype(np.uint64), block * 64
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.uint64)
            on = left >= count
            left = np.where(on, left - count, left)
            word = np.where(on, word >> np.uint64(half), word)
            place = np.where(on, place + half, place)
        return place

    def start(self, bucket: np.ndarray) -> np.ndarray:
        """First element of a bucket of equal high bits, or of the next ones."""
        inner = np.maximum(bucket - 1, 0)
        return np.where(bucket > 0, self._select(self.zeros, ~self.highs, inner) - inner, 0)

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (self._select(self.ones, self.highs, at) - at).astype(np.uint64)
        return high << np.uint64(self.low) | self.lows[at].astype(np.uint64)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Place of the least element that is not under x, within [first, last); `last` if there is none."""
        high = (x >> np.uint64(self.low)).astype(np.int64)
        lo, hi = self.start(high), self.start(high + 1)
        if first is not None:
            lo, hi = np.maximum(lo, first), np.maximum(np.minimum(hi, last), first)
        want = x & np.uint64((1 << self.low) - 1)
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) // 2
            less = (lo < hi) & (self.lows[np.minimum(mid, max(self.n - 1, 0))] < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
        return lo


class Trie:
    """Level one: known words, their quantised log10 probability and a monotone pointer to their contexts. Level two:
    the contexts of each word and the quantised smoothed log10 probability of the word after them."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, word: np.ndarray, context: np.ndarray, pairs: np.ndarray, after: np.ndarray, total: int, vocabulary: int, s: Settings):
        """names, counts: sorted known words; word (place in names), context, pairs: sorted bigrams and their counts; after:
        counts of the contexts by their numbers."""
        self.s, self.after, self.bits = s, after, _bits(after)
        self.unknown = np.log10(s.discount * vocabulary / total) if total else 0.0
        one = (counts - s.discount) / max(total, 1)
        two = s.mix * pairs / after[context] + (1 - s.mix) * one[word]
        self.names = EliasFano(names, 1 << 64)
        self.pointers = EliasFano(np.searchsorted(word, np.arange(len(names) + 1)).astype(np.uint64), len(word) + 1)
        self.contexts = EliasFano(word.astype(np.uint64) << np.uint64(self.bits) | context.astype(np.uint64), max(1, len(names)) << self.bits)
        self.ones, self.twos = (_mapped(np.round(-np.log10(x) / s.step).astype(np.uint16)) for x in (one, two))

    def score(self, names: np.ndarray, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log10 probability of names[word] after each context."""
        out, heard = np.full(len(word), self.unknown), self.after[context] > 0
        known = np.zeros(len(names), dtype=bool)
        if self.names.n:
            place = np.minimum(self.names.successor(names), self.names.n - 1)
            known = self.names.get(place) == names
            pointers = self.pointers.get(np.where(known, place, 0)).astype(np.int64)
            ends = self.pointers.get(np.where(known, place, 0) + 1).astype(np.int64)
        asked = np.flatnonzero(known[word])
        if len(asked):
            out[asked] = -self.s.step * self.ones[place[word[asked]]]
        out[heard] += np.log10(1 - self.s.mix)
        if len(asked) and self.contexts.n:
            at = word[asked]
            key = place[at].astype(np.uint64) << np.uint64(self.bits) | context[asked].astype(np.uint64)
            found = self.contexts.successor(key, pointers[at], ends[at])
            there = (found < ends[at]) & (self.contexts.get(np.minimum(found, self.contexts.n - 1)) == key)
            out[asked[there]] = -self.s.step * self.twos[found[there]]
        return out


def _bits(after: np.ndarray) -> int:
    return max(1, len(after) - 1).bit_length()


class Contexts:
    """Keys of contexts: words in the sorted array `exact` have their place there; the others have their name with the
    highest bit set or, if classes is over 0, share as many numbers more."""

    def __init__(self, exact: np.ndarray, classes: int):
        self.exact, self.classes = exact, classes

    def of(self, names: np.ndarray) -> np.ndarray:
        if self.classes:
            rest = np.uint64(len(self.exact)) + (mixed(names) >> np.uint64(32)) % np.uint64(self.classes)
        else:
            rest = names | np.uint64(1 << WORD)
        if not len(self.exact):
            return rest
        place = np.minimum(np.searchsorted(self.exact, names), len(self.exact) - 1)
        return np.where(self.exact[place] == names, place.astype(np.uint64), rest)


def _named(keys: np.ndarray) -> np.ndarray:
    return keys >= np.uint64(1 << WORD)


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all words and ends, the row of each, and the name of what stands before each."""
    h, row, first = words(data, at)
    n = len(at) - 1
    ends = first[1:] + np.arange(n)
    names = np.empty(len(h) + n, dtype=np.uint64)
    inner = np.ones(len(names), dtype=bool)
    inner[ends] = False
    names[inner], names[ends] = h | np.uint64(1 << WORD), END
    rows = np.repeat(np.arange(n), np.diff(first) + 1)
    before = np.r_[START, names[:-1]][: len(names)]
    before[first[:-1] + np.arange(n)] = START
    return names, rows, before


def _shard(names: np.ndarray, context: np.ndarray, heavy: np.ndarray, shards: int) -> np.ndarray:
    spread = np.where(np.isin(names, heavy), mixed(names * np.uint64(3) + context * np.uint64(0x9E3779B97F4A7C15)), mixed(names ^ np.uint64(0x5555)))
    return (spread >> np.uint64(40)).astype(np.int64) % shards


def training() -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 7, is not 2; a null id is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))


def unigrams(docs: DataFrame) -> DataFrame:
    """word (hash), n: counts over all training tokens, ends included; counted per task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text", INDEXED):
                names, rows, _ = _tokens(data, at)
                learned = part.column("learned").to_numpy(zero_copy_only=False)
                word, n = np.unique(names[learned[rows]], return_counts=True)
                yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select("text", training().alias("learned")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _floor(counted: DataFrame, total: int, most: int) -> int:
    """The least count that at most `most` words reach, from how many words have each count (those over a bound are told
    by the total: fewer than `most` words can have over total / most tokens)."""
    bound = 1 << 16
    got = counted.groupBy(F.least("n", F.lit(bound)).alias("n")).count().toArrow()  # `bound` rows at most
    n, words_ = got.column("n").to_numpy(), got.column("count").to_numpy()
    order = np.argsort(-n)
    fits = np.flatnonzero(np.cumsum(words_[order]) <= most)
    return int(n[order][fits[-1]]) if len(fits) else total // max(1, most) + 1


def scores(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is a mixture of a bigram and a discounted unigram over all training words and one unknown word:
    mix * c(k, w) / c(k) + (1 - mix) * (c(w) - discount) / N, where k is the word before, whatever its frequency; it sums
    to one over the known words and the unknown one. Null and empty texts are their end alone. Repeated rows stay,
    other columns are ignored, an empty table gives no rows. If nothing is learned from, all scores are zero.

    Every token goes once to the shard that counts its word, together with all texts that hold it; the shard builds its
    part of the trie and answers for its tokens; a text's answers are added up. Very frequent words are dealt by word and
    context, with their exact counts known beforehand, so no shard grows with one word's share. A shard also gets the counts
    of those contexts that stand before its words and are not broadcast."""
    if s.exact + s.classes >= NAMED:
        raise ValueError("exact and classes together must be under 2**24 - 1")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    counted = cut(unigrams(docs))
    total, vocabulary = (int(x or 0) for x in counted.agg(F.sum("n"), F.count("*")).first())
    heavy = counted.where(F.col("n") > total / s.heavy).toArrow()  # under s.heavy rows
    # as many starts as ends; the most frequent contexts, s.exact of them at most, then the sums of the classes, if any
    before = cut(counted.withColumn("word", F.when(F.col("word") == int(END), F.lit(int(START))).otherwise(F.col("word"))))
    often = before.where(F.col("n") >= _floor(before, total, s.exact)).toArrow()
    exact = often.column("word").to_numpy().view(np.uint64)
    order = np.argsort(exact)
    contexts = Contexts(exact[order], s.classes)
    after = np.zeros(len(exact) + s.classes, dtype=np.int32 if total < 1 << 31 else np.int64)
    after[: len(exact)] = often.column("n").to_numpy()[order]
    held = spark.sparkContext.broadcast(contexts)

    def rarer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = held.value
        for batch in batches:
            number, n = contexts.of(batch.column(0).to_numpy().view(np.uint64)).view(np.int64), batch.column(1).to_numpy()
            shared = number >= len(contexts.exact)
            at, which = np.unique(number[shared], return_inverse=True)
            yield pa.record_batch([pa.array(at), pa.array(np.bincount(which, n[shared], len(at)).astype(np.int64))], names=["context", "n"])

    if s.classes:
        got = before.mapInArrow(rarer, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")).toArrow()  # s.classes rows at most
        after[got.column("context").to_numpy()] = got.column("n").to_numpy()
    heavy_names, heavy_counts = heavy.column("word").to_numpy().view(np.uint64), heavy.column("n").to_numpy()
    order = np.argsort(heavy_names)
    shared = spark.sparkContext.broadcast((contexts, after, heavy_names[order], heavy_counts[order]))
    shards = max(parts(spark), -(-total // s.tokens))

    names_of = ["shard", "slice", "rows", "learned", "body"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which shards need the count of which context that goes by its name."""
        contexts, _, frequent, _ = shared.value
        for batch in batches:
            for _, data, at in slices(batch, "text", INDEXED):
                names, _, before = _tokens(data, at)
                keys = contexts.of(before)
                rest = _named(keys)
                keys, shard = keys[rest], _shard(names[rest], keys[rest], frequent, shards)
                order = np.lexsort((shard, keys))
                keys, shard = keys[order], shard[order]
                new = np.r_[True, (keys[1:] != keys[:-1]) | (shard[1:] != shard[:-1])][: len(keys)]
                yield pa.record_batch([pa.array(keys[new].view(np.int64)), pa.array(shard[new].astype(np.int32))], names=["word", "shard"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counted contexts that go by name, under their keys."""
        contexts = held.value
        for batch in batches:
            keys = contexts.of(batch.column(0).to_numpy().view(np.uint64))
            yield pa.record_batch([pa.array(keys.view(np.int64)), batch.column(1)], names=["word", "n"]).filter(pa.array(_named(keys)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts for each shard, as rows that stand beside the slices'."""
        waiting, size = [], 0

        def done() -> pa.RecordBatch:
            shard, word, n = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.argsort(shard, kind="stable")
            shard, word, n = shard[order], word[order], n[order]
            begins = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            bodies = [[word[i:j].tobytes(), n[i:j].tobytes()] for i, j in zip(begins, np.r_[begins[1:], len(shard)], strict=True)]
            none = [0] * len(begins)
            return pa.record_batch([pa.array(shard[begins].astype(np.int64)), pa.array(none), pa.array(none), pa.array([b""] * len(begins)), pa.array(bodies, pa.list_(pa.binary()))], names=names_of)

        for batch in batches:
            if batch.num_rows:
                waiting.append(tuple(batch.column(c).to_numpy() for c in range(3)))
                size += batch.num_rows
            if size >= 1 << 19:
                yield done()
                waiting, size = [], 0
        if waiting:
            yield done()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, _, frequent, _ = shared.value
        for batch in batches:
            for part, data, at in slices(batch, "text", INDEXED):
                names, rows, before = _tokens(data, at)
                context = contexts.of(before)
                tokens = np.bincount(rows, minlength=part.num_rows)
                learned = np.packbits(part.column("learned").to_numpy(zero_copy_only=False)).tobytes()
                shard = _shard(names, context, frequent, shards)
                order = np.lexsort((rows, context, names, shard))
                names, rows, context, shard = names[order], rows[order], context[order], shard[order]
                begins = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (rows[1:] != rows[:-1]) | (context[1:] != context[:-1])])
                n = np.diff(np.r_[begins, len(names)])
                names, rows, context, shard = names[begins], rows[begins], context[begins], shard[begins]
                number = part.column("id")[0].as_py()
                bounds = np.searchsorted(shard, np.arange(shards + 1))
                short = np.uint16 if part.num_rows <= 1 << 16 else np.uint32
                out = []
                for k in np.flatnonzero(np.diff(bounds)):
                    i, j = bounds[k], bounds[k + 1]
                    word, uses = np.unique(names[i:j], return_counts=True)
                    times = n[i:j].astype(np.uint32 if n[i:j].max() > 255 else np.uint8)
                    keys = context[i:j]
                    rest = _named(keys)
                    numbers = np.where(rest, np.uint64(NAMED), keys).astype(np.uint32)
                    out.append((int(k), [word.tobytes(), uses.astype(np.uint32).tobytes(), numbers.view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), rows[i:j].astype(short).tobytes(), times.tobytes(), keys[rest].tobytes()]))
                ids = part.column("doc_id")
                # the texts' own row: it goes to any shard, which passes it on
                out.append((int(number % shards), [tokens.astype(np.int64).tobytes(), ids.fill_null(0).to_numpy().tobytes(), np.packbits(ids.is_valid().to_numpy(zero_copy_only=False)).tobytes()]))
                yield pa.record_batch([pa.array([k for k, _ in out]), pa.array([number] * len(out)), pa.array([part.num_rows] * len(out)), pa.array([learned] * len(out)), pa.array([b for _, b in out], pa.list_(pa.binary()))], names=names_of)

    summed = ["slice", "rows", "body"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, after, frequent, frequent_counts = shared.value
        names, context, named, rows, n, learned, heads, counted, at = [], [], [], [], [], [], [], [], 0
        for batch in batches:
            for x in batch.to_pylist():
                size, body = x["rows"], x["body"]
                if len(body) == 2:
                    counted.append((np.frombuffer(body[0], np.uint64), np.frombuffer(body[1], np.int64)))
                    continue
                if len(body) == 3:
                    yield pa.record_batch([pa.array([x["slice"]]), pa.array([size]), pa.array([[*body, x["learned"]]], pa.list_(pa.binary()))], names=summed)
                    continue
                word = np.frombuffer(body[0], np.uint64)
                uses = np.frombuffer(body[1], np.uint32)
                count = int(uses.sum())
                low = np.zeros((count, 4), dtype=np.uint8)
                low[:, :3] = np.frombuffer(body[2], np.uint8).reshape(-1, 3)
                names.append(np.repeat(word, uses))
                context.append(low.view(np.uint32).ravel())
                named.append(np.frombuffer(body[5], np.uint64))
                row = np.frombuffer(body[3], np.uint16 if size <= 1 << 16 else np.uint32)
                rows.append(row.astype(np.uint32) + np.uint32(at))
                n.append(np.frombuffer(body[4], np.uint8 if len(body[4]) == count else np.uint32).astype(np.uint32))
                learned.append(np.unpackbits(np.frombuffer(x["learned"], np.uint8), count=size).astype(bool))
                heads.append((x["slice"], size, at))
                at += size
        if not heads:
            return
        names, context, named, rows, n, learned = (np.concatenate(x) for x in (names, context, named, rows, n, learned))
        # contexts that go by name get numbers of this shard, after the others
        own, number = np.unique(named, return_inverse=True)
        context[context == NAMED] = len(after) + number
        mine = np.zeros(len(own), dtype=np.int64)
        if counted:
            keys, sums = (np.concatenate(x) for x in zip(*counted, strict=True))
            place = np.searchsorted(own, keys)
            mine[place] = sums
        after = np.r_[after, mine.astype(after.dtype)]
        bits = _bits(after)
        word, inverse = np.unique(names, return_inverse=True)
        del names, named, number, counted
        pair, which = np.unique(inverse.astype(np.uint64) << np.uint64(bits) | context, return_inverse=True)
        taught = np.where(learned[rows], n, 0)
        pairs = np.bincount(which, taught, len(pair)).astype(np.int64)
        counts = np.bincount(inverse, taught, len(word)).astype(np.int64)
        if len(frequent):
            place = np.minimum(np.searchsorted(frequent, word), len(frequent) - 1)
            counts = np.where(frequent[place] == word, frequent_counts[place], counts)
        of, k = (pair >> np.uint64(bits)).astype(np.int64), (pair & np.uint64((1 << bits) - 1)).astype(np.int64)
        known, seen = counts > 0, pairs > 0
        renamed = np.cumsum(known) - 1
        trie = Trie(word[known], counts[known], renamed[of[seen]], k[seen], pairs[seen], after, total, vocabulary, s)
        value = trie.score(word, of, k)
        base = np.bincount(rows, n * np.log10(counts + 1.0)[inverse], at)
        heard = np.bincount(rows, n * known[inverse], at).astype(np.int64)
        score = np.bincount(rows, n * value[which], at)
        for number, size, i in heads:
            cells = [base[i : i + size].tobytes(), heard[i : i + size].astype(np.uint32).tobytes(), score[i : i + size].tobytes()]
            yield pa.record_batch([pa.array([number]), pa.array([size]), pa.array([cells], pa.list_(pa.binary()))], names=summed)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a slice stand together."""
        now, head, sums = None, None, None

        def done() -> pa.RecordBatch:
            size, (base, known, score) = len(sums[0]), sums
            tokens, ids, valid, learned = head
            bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=size).astype(bool) for b in (valid, learned)]
            columns = [pa.array(np.frombuffer(ids, np.int64), mask=~bits[0]), pa.array(~bits[1]), pa.array(np.frombuffer(tokens, np.int64)), pa.array(known), pa.array(base), pa.array(score)]
            return pa.record_batch(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                number, size, body = (batch.column(c)[i].as_py() for c in range(3))
                if number != now:
                    if sums:
                        yield done()
                    now, sums = number, [np.zeros(size), np.zeros(size, np.int64), np.zeros(size)]
                if len(body) == 4:
                    head = body
                else:
                    for total, cell, kind in zip(sums, body, (np.float64, np.uint32, np.float64), strict=True):
                        total += np.frombuffer(cell, kind)
        if sums:
            yield done()

    numbered = docs.select("doc_id", "text", training().alias("learned"), F.monotonically_increasing_id().alias("id"))
    form = "shard long, slice long, rows long, learned binary, body array<binary>"
    wanted = docs.select("text").mapInArrow(ask, "word long, shard int")
    needed = wanted.join(before.mapInArrow(rare, "word long, n long"), "word").select("shard", "word", "n").mapInArrow(packed, form)
    dealt = numbered.mapInArrow(deal, form).union(needed).repartitionById(shards, F.col("shard").cast("int"))
    partial = dealt.mapInArrow(answer, "slice long, rows long, body array<binary>").repartition(shards, "slice").sortWithinPartitions("slice")
    added = partial.mapInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    base = F.col("base") - F.col("n_tokens") * float(np.log10(total + vocabulary + 1.0))
    return added.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
