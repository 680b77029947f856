"""Benchmark decontamination: passages of every document query a BM25 index of the test items by block-max WAND."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import cut, mixed, slices, table, words

#: Cells of the table of bounds by term and range of items, at most.
CELLS = 1 << 23
NAMES = ("item_id", "score", "question_overlap", "answer_overlap")
LEAKS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


@dataclass(frozen=True)
class Settings:
    """k1, b: of BM25. least: retrieved items reach this share of their own full score. shingle: words of a shingle;
    question: share of an item's shingles, answer: share of its answer's words, that a passage must hold. block: postings
    under one bound; groups: as many ranges of items have a bound of their own at most. items_kb: KB of item text in one
    broadcast index, about; more items are looked up in further blocks."""

    k1: float = 1.2
    b: float = 0.75
    least: float = 0.5
    shingle: int = 5
    question: float = 0.8
    answer: float = 0.5
    block: int = 32
    groups: int = 64
    items_kb: int = 4096


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the distinct word sequences of this size; of a shorter text, of the whole."""
    size = min(size, len(h))
    if not size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


@dataclass(frozen=True)
class Statistics:
    """Of all items with words, whatever block they are in: their number, mean and greatest length in words."""

    items: int
    mean: float
    longest: int


def _item_words(text: str | None) -> tuple[str, np.ndarray]:
    """The text in lower case and the hashes of its words."""
    low = pc.utf8_lower(pa.scalar(text or "")).as_py()
    raw = low.encode()
    return low, words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


class Index:
    """Postings of a block of items: per term the items, their BM25 shares of the item's full score, and block maxima."""

    def __init__(self, items: list[tuple[int, str]], s: Settings, known: Statistics | None = None, frequency: dict[int, int] | None = None):
        """known, frequency: statistics of all items and how many of them hold each term; those of this block if left out."""
        self.s, self.ids, self.shingles, self.answers = s, [], [], []
        texts, sizes = [], []
        for item, text in sorted((i, t or "") for i, t in items):
            low, h = _item_words(text)
            if len(h):
                self.ids.append(item)
                texts.append(h)
                sizes.append(len(h))
                self.shingles.append(_shingles(h, s.shingle))
                self.answers.append(np.unique(h[-_answer_words(low) :]))
        known = known or Statistics(len(sizes), float(np.mean(sizes or [1])), max(sizes, default=1))
        self.sizes, self.longest = sizes, known.longest
        lists: dict[int, list[tuple[int, float]]] = {}
        for i, h in enumerate(texts):
            for term, tf in zip(*np.unique(h, return_counts=True), strict=True):
                lists.setdefault(int(term), []).append((i, tf / (tf + s.k1 * (1 - s.b + s.b * sizes[i] / known.mean))))
        whole = np.zeros(len(texts))
        for term, posting in lists.items():
            df = frequency[term] if frequency else len(posting)
            idf = np.log(1 + (known.items - df + 0.5) / (df + 0.5))
            lists[term] = [(i, idf * x) for i, x in posting]
            for i, x in lists[term]:
                whole[i] += x
        self.terms = np.array(sorted(lists), dtype=np.uint64)
        self.docs = [[i for i, _ in lists[t]] for t in self.terms.tolist()]
        self.share = [[x / whole[i] for i, x in lists[t]] for t in self.terms.tolist()]
        self.most = np.array([max(x) for x in self.share])
        width = max(4, -(-len(texts) // max(1, min(s.groups, CELLS // max(1, len(self.terms))))))
        self.group_most = np.zeros((len(self.terms), -(-len(texts) // width)), dtype=np.float32)
        for t, (docs, share) in enumerate(zip(self.docs, self.share, strict=True)):
            np.maximum.at(self.group_most[t], np.array(docs) // width, share)
        self.peaks = [[max(x[i : i + s.block]) for i in range(0, len(x), s.block)] for x in self.share]

    def above(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items whose score for these distinct terms reaches the threshold, by block-max WAND."""
        least, out, end = self.s.least - 1e-9, [], len(self.ids)
        cursors = [[self.docs[t][0], 0, t] for t in terms]
        while cursors:
            # the pivot: the first item that the bounds of the lists up to it can lift to the threshold
            cursors.sort()
            reach, pivot = 0.0, None
            for n, (item, _, t) in enumerate(cursors):
                reach += self.most[t]
                if reach >= least:
                    pivot = item
                    break
            if pivot is None:
                break
            while n + 1 < len(cursors) and cursors[n + 1][0] == pivot:
                n += 1
            # the bounds of the blocks that would hold the pivot
            peaks, upto = 0.0, end
            for c in cursors[: n + 1]:
                docs, at = self.docs[c[2]], c[1]
                block = at // self.s.block
                while (block + 1) * self.s.block < len(docs) and docs[(block + 1) * self.s.block] <= pivot:
                    block += 1
                peaks += self.peaks[c[2]][block]
                upto = min(upto, docs[(block + 1) * self.s.block] if (block + 1) * self.s.block < len(docs) else end)
            if peaks < least:  # no item before the next block or the next list can reach it
                target = max(pivot + 1, min(upto, cursors[n + 1][0] if n + 1 < len(cursors) else end))
            else:
                target = pivot
            if target == pivot and cursors[0][0] == pivot:
                score = sum(self.share[c[2]][c[1]] for c in cursors[: n + 1])
                if score >= least:
                    out.append((pivot, score))
                target = pivot + 1
            moved = []
            for c in cursors:
                if c[0] < target:
                    docs, at = self.docs[c[2]], c[1]
                    while at < len(docs) and docs[at] < target:
                        at += 1
                    if at < len(docs):
                        moved.append([docs[at], at, c[2]])
                else:
                    moved.append(c)
            cursors = moved
        return out

    def leaks(self, data: np.ndarray, at: np.ndarray) -> list[list[tuple]]:
        """Of each text the items that a passage of it holds, with the best passage's score and overlaps.

        Passages are twice as long as the longest item and start every such length, so each stretch of an item's length
        lies within one."""
        h, row, first = words(data, at)
        out: list[dict[int, tuple]] = [{} for _ in range(len(at) - 1)]
        if not len(h) or not len(self.terms):
            return [[] for _ in out]
        place = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        used = np.flatnonzero(self.terms[place] == h)
        step = self.longest
        base = np.r_[0, np.cumsum(np.diff(first) // step + 1)]
        window = base[row[used]] + (used - first[row[used]]) // step
        early = window > base[row[used]]
        key = np.unique(np.r_[window, window[early] - 1] * len(self.terms) + np.r_[place[used], place[used][early]])
        window, term = key // len(self.terms), key % len(self.terms)
        bound = np.bincount(window, self.most[term], base[-1])
        starts = np.searchsorted(window, np.arange(base[-1] + 1))
        # passages that some term bounds lift to the threshold, then those that the bounds of one range of items do
        likely = np.flatnonzero((bound >= self.s.least) & (starts[1:] > starts[:-1]))
        if len(likely):
            inside = np.zeros(base[-1], dtype=bool)
            inside[likely] = True
            kept = term[inside[window]]
            sums = np.add.reduceat(self.group_most[kept], np.r_[0, np.cumsum(np.diff(starts)[likely])[:-1]], axis=0)
            likely = likely[sums.max(axis=1) >= self.s.least - 1e-4]
        for w in likely:
            hits = self.above(term[starts[w] : starts[w + 1]].tolist())
            if not hits:
                continue
            r = int(np.searchsorted(base, w, "right")) - 1
            begin = first[r] + (w - base[r]) * step
            passage = h[begin : min(begin + 2 * step, first[r + 1])]
            # an item shorter than a shingle is one shingle of its own length
            made: dict[int, np.ndarray] = {}
            present = np.unique(passage)
            for i, score in hits:
                size = min(self.s.shingle, self.sizes[i])
                if size not in made:
                    made[size] = _shingles(passage, size)
                q = float(np.isin(self.shingles[i], made[size]).mean())
                a = float(np.isin(self.answers[i], present).mean())
                if q >= self.s.question and a >= self.s.answer and (i not in out[r] or out[r][i][1] < score):
                    out[r][i] = (self.ids[i], float(score), q, a)
        return [[dict(zip(NAMES, x, strict=True)) for x in sorted(o.values())] for o in out]


def _answer_words(text: str) -> int:
    """Words of the answer: of the last sentence, if there are several and it has four words; else of the last quarter."""
    sentences = [x for x in text.replace("?", ".").replace("!", ".").split(".") if x.split()]
    n, last = len(text.split()), len(sentences[-1].split()) if sentences else 0
    return last if len(sentences) > 1 and last >= 4 else max(min(4, n), n // 4)


KIND = pa.list_(pa.struct([("item_id", pa.int64()), *((n, pa.float64()) for n in NAMES[1:])]))
#: The index that this worker last built, and the key of its block.
_BUILT: dict[str, Index] = {}


def _built(key: str, block, s: Settings) -> Index:
    """A worker keeps the index of the block it looked at last, so that not every task builds it again."""
    if key not in _BUILT:
        _BUILT.clear()
        items, known, terms, counts = block.value
        _BUILT[key] = Index(items, s, known, dict(zip(terms.tolist(), counts.tolist(), strict=True)))
    return _BUILT[key]


def _blocks(items: DataFrame, s: Settings) -> Iterator[tuple[str, object]]:
    """Broadcast blocks of about s.items_kb of item text, each with the statistics of all items and its own terms' counts."""
    spark = items.sparkSession
    items = items.where("item_id is not null").select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (s.items_kb << 10)))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_item_words(t)[1] for t in batch.column("text").to_pylist()]
            distinct = pa.array([np.unique(h).view(np.int64) for h in hashes], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("block"), pa.array([len(h) for h in hashes]), distinct], names=["block", "size", "terms"])

    read = cut(items.select("text", block).mapInArrow(terms, "block long, size long, terms array<long>").where("size > 0"))
    count, mean, longest = read.agg(F.count("*"), F.avg("size"), F.max("size")).first()
    known = Statistics(count, mean or 1.0, longest or 1)
    each = read.select("block", F.explode("terms").alias("term"))
    frequency = cut(each.distinct().join(each.groupBy("term").agg(F.count("*").alias("n")), "term")) if blocks > 1 else each.groupBy("block", "term").agg(F.count("*").alias("n"))
    for k in range(blocks):
        # about items_kb of text and its terms, whatever the number of items
        part = [tuple(x) for x in items.select("item_id", "text", block).where(F.col("block") == k).select("item_id", "text").collect()]
        counts = frequency.where(F.col("block") == k).select("term", "n").toArrow()
        yield uuid.uuid4().hex, spark.sparkContext.broadcast((part, known, counts.column("term").to_numpy().view(np.uint64), counts.column("n").to_numpy()))


def _leaks(batch: pa.RecordBatch, index: Index) -> Iterator[tuple[pa.RecordBatch, list]]:
    low = batch.set_column(batch.schema.get_field_index("text"), "text", pc.utf8_lower(batch.column("text")))
    done = 0
    for part, data, at in slices(low, "text"):
        yield batch.slice(done, part.num_rows), index.leaks(data, at)
        done += part.num_rows


def marked(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with one more column, leaks: an array of (item_id, score, question_overlap, answer_overlap) of the items that a
    passage of the text holds, by item_id.

    items(item_id, text): the last sentence is taken as the answer. Case is ignored. Null and wordless texts and
    items match nothing; an item_id that repeats is reported once for each of its texts that is found; rows, other columns
    and repeated rows of docs stay; a column named leaks is replaced. Document frequencies, lengths and passages are those
    of all items, so a score does not depend on the blocks. One block of items needs no shuffle; of several, each is met by
    all texts in tasks of its own, and what they find is joined to docs by the text's digest."""
    docs = docs.drop("leaks")
    return _looked_up(docs, items, s, docs.columns)


def _looked_up(docs: DataFrame, items: DataFrame, s: Settings, keep: list[str]) -> DataFrame:
    blocks = list(_blocks(items, s))
    kept = docs.select(*keep)
    if len(blocks) == 1:
        key, block = blocks[0]

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, leaks in _leaks(batch, _built(key, block, s)):
                    yield pa.record_batch([*(part.column(c) for c in keep), pa.array(leaks, KIND)], names=[*keep, "leaks"])

        schema = kept.withColumn("leaks", F.array().cast(LEAKS)).schema
        return docs.mapInArrow(mark, schema)

    def finder(key: str, block):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, leaks in _leaks(batch, _built(key, block, s)):
                    hit = [i for i, x in enumerate(leaks) if x]
                    digests = [hashlib.sha256(part.column("text")[i].as_py().encode()).digest() for i in hit]
                    yield pa.record_batch([pa.array(digests, pa.binary()), pa.array([leaks[i] for i in hit], KIND)], names=["digest", "leaks"])

        return find

    found = [docs.select("text").mapInArrow(finder(*b), f"digest binary, leaks {LEAKS}").dropDuplicates(["digest"]) for b in blocks]
    digest = "_digest"
    while digest in docs.columns:
        digest += "_"
    all_found = reduce(DataFrame.union, found).groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    each = docs.select(*keep, F.unhex(F.sha2("text", 256)).alias(digest))
    joined = each.join(all_found.withColumnRenamed("digest", digest), digest, "left")
    return joined.select(*keep, F.coalesce("leaks", F.array().cast(LEAKS)).alias("leaks"))


def matches(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per text and item found in it: doc_id, item_id, score, question_overlap, answer_overlap."""
    return _looked_up(docs.select(F.col("doc_id").cast("long"), "text"), items, s, ["doc_id"]).select("doc_id", F.inline("leaks"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
