"""SimHash near-duplicates through an inverted index over the byte positions of the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import cut, parts, table
from marketspark.llm.graph import components

#: Postings are keyed by the values at four of the eight positions. Each five positions hold exactly one of these
#: fourteen sets (planes of the affine space over three bits), so a pair that shares five bytes meets in one posting.
PLANES = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
_CHUNK = 1 << 15


def fingerprint(text: bytes, size: int = 3) -> int:
    """Unsigned 64-bit SimHash over the XXH64 (seed 42) of word shingles, repeats included; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    count, set_bits = len(words) - size + 1, np.zeros(64, dtype=np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype=np.uint64, count=count)
    for i in range(0, count, _CHUNK):
        part = hashes[i : i + _CHUNK]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and digest (XXH64 of the text) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", size) for t in texts), dtype=np.uint64, count=batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "digest"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("digest")).mapInArrow(run, "doc_id long, fp long, digest long")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def postings(fps: DataFrame, hot: int = 20_000) -> DataFrame:
    """Rows (key, fp): fourteen postings of each distinct fp. A posting of over `hot` members is divided by each of its
    four other bytes; pairs that share five bytes still meet, and no posting can hold over 2**24 fingerprints."""
    fp = F.col("fp")
    planes = [
        F.struct(F.lit(k).alias("plane"), sum((F.shiftleft(_byte(fp, p), 8 * i) for i, p in enumerate(plane)), F.lit(0).cast("long")).alias("bytes"),
                 F.array(*[F.shiftleft(F.lit(p).cast("long"), 48).bitwiseOR(F.shiftleft(_byte(fp, p), 40)) for p in range(8) if p not in plane]).alias("rest"))
        for k, plane in enumerate(PLANES)
    ]
    index = fps.select("fp", F.explode(F.array(*planes)).alias("p")).select("fp", F.shiftleft(F.col("p.plane").cast("long"), 56).bitwiseOR(F.col("p.bytes")).alias("key"), "p.rest")
    crowded = index.groupBy("key").count().where(F.col("count") > hot).select("key", F.lit(True).alias("crowded"))
    split = F.when(F.col("crowded"), F.transform("rest", lambda r: r.bitwiseOR(F.col("key")))).otherwise(F.array("key"))
    return index.join(crowded, "key", "left").select(F.explode(split).alias("key"), "fp")


def _spanned(members: np.ndarray, bits: int) -> tuple[list, list]:
    """Links that span what `bits` or fewer differing bits connect among the members."""
    left, to = [], []
    waiting = members
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = np.bitwise_count(waiting ^ at) <= bits
            if near.any():
                found = waiting[near]
                left += [at] * len(found)
                to += list(found)
                front += list(found)
                waiting = waiting[~near]
    return left, to


def _tallied(members: np.ndarray, bits: int) -> tuple[list, list]:
    """Links that span the members of one posting, which share the four (or five) bytes of its key.

    A pair needs 8 - bits matching positions. Where the key alone does not give as many, each other position has an
    inverted list for each of its bytes: members that meet there reach the tally, and only they are compared bit by bit."""
    cells = members.view(np.uint8).reshape(-1, 8)
    open_ = np.flatnonzero((cells != cells[0]).any(axis=0))
    if len(members) < 16 or len(open_) <= bits:
        return _spanned(members, bits)
    left, to = [], []
    for position in open_:
        order = np.argsort(cells[:, position], kind="stable")
        value = cells[order, position]
        starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        for i, j in zip(starts, np.r_[starts[1:], len(value)], strict=True):
            if j - i > 1:
                a, b = _spanned(members[order[i:j]], bits)
                left += a
                to += b
    return left, to


def links(fps: DataFrame, bits: int = 3, hot: int = 20_000) -> DataFrame:
    """Rows (a, b) that connect all distinct fp at `bits` or fewer differing bits: per posting a spanning forest of its
    verified pairs, never the pairs themselves. bits is at most 3: more could leave under five bytes in common."""
    if not 0 <= bits <= 3:
        raise ValueError("bits must be from 0 to 3")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def closed(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes, left, to = np.diff(np.r_[starts, len(keys)]), [], []
            for i in np.flatnonzero(sizes > 1):
                a, b = _tallied(fps[starts[i] : starts[i] + sizes[i]], bits)
                left += a
                to += b
            return pa.record_batch([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (left, to)], names=["a", "b"])

        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy()]
            fps = np.r_[fps, batch.column(1).to_numpy().view(np.uint64)]
            if len(keys) and keys[0] != keys[-1]:
                last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
                yield closed(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield closed(keys, fps)

    index = postings(fps.select("fp").distinct(), hot)
    return index.repartition(parts(fps.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _components(docs: DataFrame, size: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp, digest of each row; and fp, root (a fingerprint) of each distinct fingerprint."""
    each = cut(fingerprints(docs, size))
    nodes = each.select("fp").distinct()
    roots = components(links(nodes, bits))
    return each, nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = 3) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint (16 hex digits), component_id (the least doc_id that
    links of `bits` or fewer differing bits reach, itself included).

    Null and wordless texts have the fingerprint zero and link like any other. Equal fingerprints are one node, so copies
    cost nothing more; rows that repeat stay; a null doc_id keeps its row and never names a component. An empty table
    gives no rows. Other columns are ignored."""
    each, rooted = _components(docs, size, bits)
    least = each.groupBy("fp").agg(F.min("doc_id").alias("least")).join(rooted, "fp")
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def chosen(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id and digest (XXH64 of the text) are in kept(doc_id, digest), repeated rows once, and those
    with a null doc_id. Columns and their order stay."""
    digest = "_digest"
    while digest in docs.columns:
        digest += "_"
    known = docs.where("doc_id is not null").withColumn(digest, F.xxhash64("text"))
    found = known.join(kept.withColumnRenamed("digest", digest), ["doc_id", digest], "left_semi").dropDuplicates(["doc_id", digest])
    return found.select(*docs.columns).union(docs.where("doc_id is null"))


def representatives(docs: DataFrame, size: int = 3, bits: int = 3) -> DataFrame:
    """docs with one row of each component of near_duplicates(): the one with the least doc_id. Rows that repeat a doc_id
    with unlike texts are documents of their own; rows with a null doc_id stay. Columns and their order are kept; an empty
    table stays empty."""
    each, rooted = _components(docs.where("doc_id is not null"), size, bits)
    least = each.join(rooted, "fp").groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("least"))
    return chosen(docs, least.select("least.doc_id", "least.digest"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
