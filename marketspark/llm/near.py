"""Near copies by wide SimHash fingerprints: an inverted index over byte positions finds pairs, whole shingle sets verify.

Documents of a shingle similarity of 0.8 differ in too many bits for a guarantee of 64-bit fingerprints. These have 512
bits; the index is keyed by two of the 64 byte positions together. Within a posting each of 32 other positions has an
inverted list for each of its bytes: members that meet in one reach the tally of three positional bytes, and only they are
compared bit by bit. At a similarity of exactly 0.8 a byte is shared with probability 0.27, and a pair is missed by all 96
postings about four times in a thousand, by all lists of one about four times in a hundred thousand; over 0.82 hardly ever."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import cut, mixed, parts, slices, words
from marketspark.llm.graph import components
from marketspark.llm.simhash import chosen

#: Shingles of so many words; two sets are near if their Jaccard similarity is SHARE[0] / SHARE[1] or more.
SIZE, SHARE = 5, (4, 5)
#: 64-bit words of a fingerprint, and of its head, which postings carry.
WORDS, HEAD = 8, 4
#: Two heads of sets that are near differ in no more bits (four standard deviations over the mean at similarity 0.8).
BITS = 64
#: Keys of the index: each byte position with the next one and with the opposite one.
PAIRS = [(i, (i + 1) % 64) for i in range(64)] + [(i, i + 32) for i in range(32)]
#: The byte positions that are the head in each posting: those that follow its own two.
HEADS = [[p % 64 for p in range(y + 1, y + 65) if p % 64 not in (x, y)][: HEAD * 8] for x, y in PAIRS]
LONGS = [f"h{k}" for k in range(HEAD)]
#: Clusters of so many members give all their pairs at once. Of so few members the tally is taken without lists.
SMALL, FEW = 8, 256
#: Members that one lead's text is sent along with, members of a chunk of a family; bits of the filter of wanted sets,
#: which only saves work.
CHUNK, GRID, FILTER = 256, 1024, 24


def shingles(data: np.ndarray, at: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of the distinct shingles of each text, in order; a text of fewer words is one shingle, and so
    is a wordless one."""
    h, row, first = words(data, at)
    n = len(at) - 1
    many = np.diff(first)
    out_row, out = [np.flatnonzero(many == 0)], [np.zeros(int((many == 0).sum()), np.uint64)]
    for length in range(1, size + 1):  # of `length` words: whole texts, or for the last the shingles
        starts = np.flatnonzero((np.arange(len(h)) + length <= first[1:][row]) if length == size else (many[row] == length) & (np.arange(len(h)) == first[:-1][row]))
        value = np.full(len(starts), length, np.uint64)
        for k in range(length):
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + h[starts + k])
        out_row.append(row[starts])
        out.append(value)
    rows, hashes = np.concatenate(out_row), np.concatenate(out)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])][: len(rows)]
    assert n == 0 or new[0]
    return rows[new], hashes[new]


def _nodes(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Name of each row's set, and the places of the rows' first shingles (n + 1)."""
    at = np.searchsorted(rows, np.arange(n + 1))
    return mixed(np.add.reduceat(mixed(hashes ^ np.uint64(0xA5A5)), at[:-1]) if n else np.zeros(0, np.uint64)).view(np.int64), at


def _bucket(nodes: np.ndarray) -> np.ndarray:
    return (mixed(nodes.view(np.uint64)) >> np.uint64(64 - FILTER)).astype(np.int64)


def _wide(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints (n x WORDS) of sets of shingles: a bit is set if it is in over half of the shingles' hashes."""
    out = np.zeros((len(at) - 1, WORDS * 64), dtype=bool)
    spread = np.stack([mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) for k in range(WORDS)], axis=1).view(np.uint8)
    for i, (begin, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        count = np.zeros(WORDS * 64, dtype=np.int64)
        for k in range(begin, end, 255):  # sums that fit a byte
            count += np.unpackbits(spread[k : min(k + 255, end)], axis=1).sum(axis=0, dtype=np.uint8)
        out[i] = count * 2 > end - begin
    return np.packbits(out, axis=1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest (XXH64 of the text), node (name of the text's shingle set), fp (its fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                rows, hashes = shingles(data, at)
                node, first = _nodes(rows, hashes, part.num_rows)
                fp = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WORDS * 8), part.num_rows, [None, pa.py_buffer(_wide(hashes, first).tobytes())])
                yield pa.record_batch([part.column("doc_id"), part.column("digest"), pa.array(node), fp.cast(pa.binary())], names=["doc_id", "digest", "node", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("digest")).mapInArrow(run, "doc_id long, digest long, node long, fp binary")


def postings(nodes: DataFrame) -> DataFrame:
    """key, node, LONGS: for each of PAIRS the two bytes there, with the bytes at 32 other positions, the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                fp = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint8).reshape(-1, WORDS * 8)
                keys = [np.full(len(fp), k << 16) | fp[:, x].astype(np.int64) << 8 | fp[:, y] for k, (x, y) in enumerate(PAIRS)]
                head = np.concatenate([np.ascontiguousarray(fp[:, other]).view(np.int64) for other in HEADS])
                columns = [np.concatenate(keys).astype(np.int32), np.tile(part.column("node").to_numpy(), len(PAIRS)), *head.T]
                yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], names=["key", "node", *LONGS])

    return nodes.select("node", "fp").mapInArrow(run, "key int, node long, " + ", ".join(f"{c} long" for c in LONGS))


def _cells(head: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(head).view(np.uint8).reshape(len(head), -1)


class Lists:
    """Inverted lists of heads: for each byte position the members that have each byte there."""

    def __init__(self, head: np.ndarray):
        self.head, self.cells = head, _cells(head)
        self._list(np.arange(len(head)))

    def _list(self, members: np.ndarray) -> None:
        self.members, self.lists = members, None
        if len(members) > FEW:
            cells = self.cells[members]
            self.lists = [members[np.argsort(column, kind="stable")] for column in cells.T]
            self.begins = [np.r_[0, np.cumsum(np.bincount(column, minlength=256))].tolist() for column in cells.T]

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of others share a byte with member i and have a near head."""
        out = (self.cells[others] == self.cells[i]).any(axis=1)
        out[out] = np.bitwise_count(self.head[others[out]] ^ self.head[i]).sum(axis=1) <= BITS
        return out

    def found(self, i: int, left: np.ndarray) -> np.ndarray:
        """Members left (a mask) that meet member i in a list and have a near head, in order. Once half of those listed are
        gone, the lists are made anew."""
        if self.lists is None:
            others = self.members[left[self.members]]
            return others[self.near(i, others)]
        met = [(order, begins[c], begins[c + 1]) for order, begins, c in zip(self.lists, self.begins, self.cells[i].tolist(), strict=True)]
        if sum(end - begin for _, begin, end in met) > 8 * len(self.members):  # most share a byte with it
            others = self.members[left[self.members]]
            others = others[self.near(i, others)]
        else:
            others = np.concatenate([order[begin:end] for order, begin, end in met])
            others = others[left[others]]
            others = np.unique(others[np.bitwise_count(self.head[others] ^ self.head[i]).sum(axis=1) <= BITS])
        return others

    def trim(self, left: np.ndarray, many: int) -> None:
        if self.lists is not None and 2 * many < len(self.members):
            self._list(self.members[left[self.members]])


def _apart(keys: np.ndarray, head: np.ndarray) -> np.ndarray:
    """First and last rows of the postings that need a look: those with more than 64 members or any two that reach the
    tally and have near heads."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    wanted, cells = sizes > 64, _cells(head)
    of = np.repeat(np.arange(len(starts)), sizes)
    at, far = np.flatnonzero(~wanted[of]), 1
    while len(at):
        at = at[at + far < len(keys)]
        at = at[keys[at] == keys[at + far]]
        met = at[(cells[at] == cells[at + far]).any(axis=1)]
        near = np.bitwise_count(head[met] ^ head[met + far]).sum(axis=1) <= BITS
        wanted[of[met[near]]] = True
        far += 1
    return np.stack([starts, starts + sizes], axis=1)[wanted]


def _clustered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clusters of each posting: the rows of a key stand together."""
    held = None

    def found(key: np.ndarray, node: np.ndarray, *longs: np.ndarray) -> Iterator[pa.RecordBatch]:
        head = np.stack(longs, axis=1).view(np.uint64)
        for i, j in _apart(key, head).tolist():
            yield from _clusters(node[i:j], head[i:j])

    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        held = [np.r_[x, y] for x, y in zip(held, columns, strict=True)] if held else columns
        if len(held[0]) and held[0][0] != held[0][-1]:
            last = int(np.searchsorted(held[0], held[0][-1]))
            yield from found(*(c[:last] for c in held))
            held = [c[last:] for c in held]
    if held and len(held[0]) > 1:
        yield from found(*held)


def _met(lead: np.ndarray, node: np.ndarray, large: bool) -> pa.RecordBatch:
    return pa.record_batch([pa.array(lead), pa.array(node), pa.array(np.full(len(node), large))], names=["lead", "node", "large"])


def _clusters(node: np.ndarray, head: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Members of one posting that reach the tally and have near heads, directly or through others, are a cluster. Of up to
    SMALL members all near pairs are given; of more (large) a star and the links that hold it together.

    The member nearest to a cluster's majority bits leads: the likeliest original of copies that differ from each other."""
    lists, left, many_left = Lists(head), np.ones(len(node), dtype=bool), len(node)
    for first in range(len(node)):
        if not left[first]:
            continue
        left[first], many_left = False, many_left - 1
        cluster, front, tree = [first], [first], [first]
        while front and many_left:
            at = front.pop()
            found = lists.found(at, left)
            left[found], many_left = False, many_left - len(found)
            cluster += found.tolist()
            front += found.tolist()
            tree += [at] * len(found)
            lists.trim(left, many_left)
        many = np.array(cluster)
        if 1 < len(many) <= SMALL:
            for i in range(len(many) - 1):
                others = many[i + 1 :][lists.near(many[i], many[i + 1 :])]
                yield _met(np.minimum(node[others], node[many[i]]), np.maximum(node[others], node[many[i]]), False)
        elif len(many) > SMALL:
            bits = np.unpackbits(lists.cells[many], axis=1)
            middle = np.packbits(bits.sum(axis=0) * 2 > len(many)).view(np.uint64)
            lead = many[int(np.bitwise_count(head[many] ^ middle).sum(axis=1).argmin())]
            one = np.where(lists.near(lead, many), lead, np.array(tree))
            yield _met(node[one], node[many], True)


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """node, text: one text of each set in needed(node) and of a few others; most texts are sieved out before the shuffle."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(np.unique(_bucket(batch.column(0).to_numpy())))], names=["bucket"])

    bits = np.zeros(1 << FILTER, dtype=bool)  # of fixed size
    bits[needed.distinct().mapInArrow(buckets, "bucket long").distinct().toArrow().column("bucket").to_numpy()] = True
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                node, _ = _nodes(*shingles(data, at), part.num_rows)
                _, once = np.unique(node, return_index=True)
                kept = np.sort(once[bits[_bucket(node[once])]])
                yield pa.record_batch([pa.array(node[kept]), part.column("text").take(pa.array(kept))], names=["node", "text"])

    return docs.select("text").mapInArrow(take, "node long, text string").groupBy("node").agg(F.first("text").alias("text"))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs(lead, node) whose sets have the similarity, as (a, b). A lead's text meets its nodes' in chunks of
    about CHUNK, so no task holds a large group."""
    spark, (up, down) = docs.sparkSession, SHARE
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    texts = _texts(docs, pairs.select("node").union(sizes.select("lead")))
    chunk = F.pmod(F.xxhash64("node", "lead"), F.col("chunks")).cast("int")
    members = texts.join(pairs.join(sizes, "lead").withColumn("chunk", chunk), "node").select("lead", "chunk", "node", "text")
    leads = texts.withColumnRenamed("node", "lead").join(sizes, "lead").select("lead", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("chunk"), F.lit(None).cast("long").alias("node"), "text")
    dealt = members.union(leads).repartition(parts(spark), "lead", "chunk").sortWithinPartitions("lead", "chunk", F.col("node").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                rows, hashes = shingles(data, at)
                first = np.searchsorted(rows, np.arange(part.num_rows + 1)).tolist()
                lead, node = part.column("lead").to_numpy(), part.column("node")
                is_lead, fine = node.is_null().to_numpy(zero_copy_only=False), np.zeros(part.num_rows, dtype=bool)
                for i in range(part.num_rows):
                    mine = hashes[first[i] : first[i + 1]]
                    if is_lead[i]:
                        own = mine
                    else:
                        both = int((own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine).sum())
                        fine[i] = both * (up + down) >= up * (len(own) + len(mine))
                yield pa.record_batch([pa.array(lead[fine]), node.filter(pa.array(fine))], names=["a", "b"])

    return dealt.mapInArrow(check, "a long, b long")


def compared(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is near among members(node, family, root, LONGS: a head) of the same family and of
    different roots: every two sets that meet in a list of their cell and whose heads are near are compared as a whole.

    A family's members are dealt to chunks of about GRID, and each two chunks meet in one task: no task holds a family, and
    only links leave it, at most one for each two roots there."""
    up, down = SHARE
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / GRID).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    each = _texts(docs, members.select("node")).join(members.join(sizes, "family"), "node").withColumn("own", own)
    cells = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("side"), "node", "root", *LONGS, "text"
    )
    dealt = cells.repartition(parts(docs.sparkSession), "family", "x", "y").sortWithinPartitions("family", "x", "y", "side", "node")

    def links(node: np.ndarray, root: np.ndarray, head: np.ndarray, side: np.ndarray, sets: list[np.ndarray], same: bool) -> Iterator[pa.RecordBatch]:
        group = {r: r for r in np.unique(root).tolist()}

        def top(r: int) -> int:
            while group[r] != r:
                group[r] = group[group[r]]
                r = group[r]
            return r

        lists, there = Lists(head), np.ones(len(node), dtype=bool) if same else side.copy()
        out: list[tuple[int, int]] = []
        for i in range(len(node)) if same else np.flatnonzero(~side).tolist():
            if same:
                there[i] = False  # each two once
            others = lists.found(i, there)
            others = others[root[others] != root[i]]
            mine = sets[i]
            for j in others.tolist():
                n, m = len(mine), len(sets[j])
                if (up + down) * min(n, m) < up * (n + m) or top(int(root[i])) == top(int(root[j])):
                    continue
                both = int((mine[np.minimum(np.searchsorted(mine, sets[j]), n - 1)] == sets[j]).sum())
                if both * (up + down) >= up * (n + m):
                    group[top(int(root[i]))] = top(int(root[j]))
                    out.append((int(node[i]), int(node[j])))
        if out:
            yield pa.record_batch([pa.array([min(p) for p in out]), pa.array([max(p) for p in out])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, sets = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            node, root, side, *longs = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield from links(node, root, np.stack(longs, axis=1).view(np.uint64), side, sets, now[1] == now[2])

        for batch in batches:
            for part, data, at in slices(batch, "text"):
                r, hashes = shingles(data, at)
                first = np.searchsorted(r, np.arange(part.num_rows + 1))
                cell = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("family", "x", "y")])
                starts = np.flatnonzero(np.r_[True, (cell[:, 1:] != cell[:, :-1]).any(axis=0)])
                for i, j in zip(starts, np.r_[starts[1:], part.num_rows], strict=True):
                    if tuple(cell[:, i].tolist()) != now:
                        if rows:
                            yield from done()
                        now, rows, sets = tuple(cell[:, i].tolist()), [], []
                    rows.append(tuple(part.column(c).slice(i, j - i).to_numpy(zero_copy_only=False) for c in ("node", "root", "side", *LONGS)))
                    sets += [hashes[first[k] : first[k + 1]] for k in range(i, j)]
        if rows:
            yield from done()

    return dealt.mapInArrow(run, "a long, b long")


def roots(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root of all sets that near pairs connect to a lesser one.

    All candidates come from the index: postings, then the lists within each. A posting gives stars of its large clusters, so a large group of near copies never gives its pairs; what the stars
    connect needs no more comparing. Where that leaves a large cluster apart, the family of sets around it is compared
    chunk by chunk."""
    spark = docs.sparkSession
    dealt = postings(nodes).repartition(parts(spark), "key").sortWithinPartitions("key", "node")
    met = cut(dealt.mapInArrow(_clustered, "lead long, node long, large boolean").where("lead <> node").groupBy("lead", "node").agg(F.max("large").alias("large")))
    stars = cut(verified(docs, met.select("lead", "node")))
    linked = cut(components(stars))
    # families: what unverified links of large clusters connect
    family = cut(components(met.where("large").select(F.col("lead").alias("a"), F.col("node").alias("b"))))
    inside = family.union(family.select("root", "root").distinct()).toDF("node", "family")
    known = inside.join(linked, "node", "left").select("node", "family", F.coalesce("root", "node").alias("root"))
    apart = known.groupBy("family").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("family")
    heads = nodes.select("node", *[F.conv(F.hex(F.substring("fp", 8 * k + 1, 8)), 16, -10).cast("long").alias(c) for k, c in enumerate(LONGS)])
    members = cut(known.join(apart, "family").join(heads, "node").select("node", "family", "root", *LONGS))
    return components(stars.union(compared(docs, members)))


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each group that near pairs connect: the one with the least doc_id.

    Null and wordless texts are near each other. Of rows that repeat a doc_id within a group one stays; in different groups
    each is a document of its own. Rows with a null doc_id stay. Columns and their order are kept; an empty table stays
    empty."""
    known = docs.where("doc_id is not null")
    each = cut(fingerprints(known))
    found = roots(known, each.groupBy("node").agg(F.first("fp").alias("fp")))
    least = each.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("doc_id", "digest")).alias("least"))
    return chosen(docs, least.select("least.doc_id", "least.digest"))
