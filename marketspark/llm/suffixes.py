"""Removal of repeated byte strings: content anchors find candidates, a hash-compared suffix sort settles them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import cut, mixed, slices, table

LENGTH, GRAM = 200, 50
#: Distinct fragments of one anchor that one task sorts; beyond, its windows are counted by hash and verified by bytes.
CROWDED = 4096
#: Bytes of fragments that are sorted at once (and the whole of one anchor's).
SORTED = 1 << 18
#: Bits of the sieve that keeps most texts without candidates out of the joins; wrong hits only cost time.
SIEVE = 1 << 23
_BASE = np.uint64(0xB5AD4ECEDA1CE2A9)
_INVERSE = np.uint64(pow(0xB5AD4ECEDA1CE2A9, -1, 1 << 64))
#: Bits of a place within a block of windows.
_PLACE = 24
BLOCK = 1 << 22


class Prefixes:
    """Prefix polynomial hashes of a byte array, modulo 2 ** 64: the hash of any substring in constant time."""

    powers = inverses = np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Prefixes.powers) <= len(data):
            size = max(len(data) + 1, 1 << 20)
            for name, step in (("powers", _BASE), ("inverses", _INVERSE)):
                steps = np.full(size, step, dtype=np.uint64)
                steps[0] = 1
                setattr(Prefixes, name, np.multiply.accumulate(steps))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Prefixes.powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * Prefixes.inverses[start]


def fragments(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK):
    """Runs of windows (strings of `length` bytes) that share their anchor, the gram of least hash: row, first window's
    place in its text, number of windows, anchor's hash, fragment's hash. Equal windows have equal anchors. Windows are
    looked at in blocks, so the working memory does not grow with a text; a run that goes on in the next block is two."""
    found = []
    for start in range(0, max(len(data), 1), block):
        part = data[start : start + block + length - 1]
        found.append(_fragments(part, np.clip(at - start, 0, len(part)), length, gram))
        found[-1][0][:] += start
    first, number, ah, fh = (np.concatenate(x) for x in zip(*found, strict=True))
    row = np.searchsorted(at, first, "right") - 1
    return row, first - at[row], number, ah, fh


def _fragments(data: np.ndarray, at: np.ndarray, length: int, gram: int):
    n, reach = len(data), length - gram + 1
    inside = np.zeros(n + 1, dtype=np.int8)
    long = np.flatnonzero(np.diff(at) >= length)
    inside[at[long]] += 1
    inside[at[long + 1] - length + 1] -= 1
    windows = np.flatnonzero(np.cumsum(inside))
    if not len(windows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    prefixes, places = Prefixes(data), np.arange(n - gram + 1)
    hashes = mixed(prefixes.of(places, places + gram))
    mask = np.uint64((1 << _PLACE) - 1)
    least, width = (hashes & ~mask) | places.astype(np.uint64), 1
    while width * 2 <= reach:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    anchor = (least[windows] & mask).astype(np.int64)
    # a run ends where the anchor changes, where windows stop, and where another text begins
    begins = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(windows) != 1)])
    first, number, anchor = windows[begins], np.diff(np.r_[begins, len(windows)]), anchor[begins]
    whole = prefixes.of(first, first + number - 1 + length)
    form = (number.astype(np.uint64) << np.uint64(32)) | (anchor - first).astype(np.uint64)
    return first, number, hashes[anchor], mixed(whole + mixed(form))


def suffix_order(data: np.ndarray, suffixes: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (places in data, each with `length` bytes) sorted by group, then by their first `length` bytes, and
    whether each has an equal neighbour in its group. A mergesort by whole levels: every element finds its rank in the sibling run by binary search; two
    suffixes are compared by their first eight bytes, then at the end of their common extension, which a binary search
    over prefix hashes finds. Equality is verified byte by byte."""
    prefixes, n = Prefixes(data), len(suffixes)
    heads = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        heads = heads << np.uint64(8) | data[suffixes + i].astype(np.uint64)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), length)
        for _ in range(length.bit_length()):
            mid = (low + high + 1) // 2
            same = prefixes.of(a, a + mid) == prefixes.of(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def under(x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix number x comes before y; equal ones do if `ties`."""
        out = heads[x] < heads[y]
        even = np.flatnonzero(heads[x] == heads[y])
        if len(even):
            a, b = suffixes[x[even]], suffixes[y[even]]
            size = common(a, b)
            end = np.minimum(size, length - 1)
            out[even] = np.where(size >= length, ties, data[a + end] < data[b + end])
        return out

    order, width, place = np.argsort(groups, kind="stable"), 1, np.arange(n)
    begins = np.flatnonzero(np.r_[True, np.diff(groups[order]) != 0]) if n else place
    sizes = np.diff(np.r_[begins, n])
    begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    while width < sizes.max(initial=0):
        run = (place - begin) // width
        sibling = run ^ 1
        low, high = begin + np.minimum(sibling * width, size), begin + np.minimum((sibling + 1) * width, size)
        start = low.copy()
        right = (run & 1).astype(bool)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            x, y = order[mid], order[open_]
            # an element of the right run goes after its equals in the left one
            before = np.where(right[open_], under(x, y, True), under(x, y, False))
            low[open_], high[open_] = np.where(before, mid + 1, low[open_]), np.where(before, high[open_], mid)
        merged = np.empty(n, dtype=np.int64)
        merged[begin + (run // 2) * 2 * width + (place - begin - run * width) + (low - start)] = order
        order, width = merged, width * 2
    equal = np.zeros(n, dtype=bool)
    left, right = order[:-1], order[1:]
    close = np.flatnonzero((heads[left] == heads[right]) & (begin[1:] == begin[:-1]))
    for i in range(0, len(close), 4096):
        part = close[i : i + 4096]
        a, b = suffixes[left[part]], suffixes[right[part]]
        found = part[common(a, b) >= length]
        a, b = suffixes[left[found]], suffixes[right[found]]
        span = np.arange(length)
        found = found[(data[a[:, None] + span] == data[b[:, None] + span]).all(axis=1)]
        equal[left[found]] = equal[right[found]] = True
    return order, equal


def anchors(docs: DataFrame) -> DataFrame:
    """ah, fh, vh, rid, pos, number of every fragment of docs(rid, text): hashes of its anchor and of its bytes (one
    polynomial, one XXH3, which have nothing in common), text, place and number of windows. Texts under LENGTH bytes have
    none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in slices(batch, "text", 1 << 20):
                row, pos, number, ah, fh = fragments(data, at)
                rid = part.column("rid").to_numpy()[row]
                begin, view = at[row] + pos, memoryview(np.ascontiguousarray(data))
                ends = begin + number - 1 + LENGTH
                vh = np.fromiter((xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(begin.tolist(), ends.tolist(), strict=True)), np.uint64, len(row))
                columns = [ah.view(np.int64), fh.view(np.int64), vh.view(np.int64), rid, pos, number.astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["ah", "fh", "vh", "rid", "pos", "number"])

    return docs.select("rid", "text").mapInArrow(run, "ah long, fh long, vh long, rid long, pos long, number int")


def _sieved(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """docs(rid, text) without most of the texts whose rid is not in rids."""
    slot = F.pmod(F.xxhash64("rid"), F.lit(SIEVE))
    cells = rids.select(slot.alias("slot")).groupBy(F.expr("slot div 63").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(SIEVE // 63 + 1, dtype=np.int64)  # of fixed size
    bits[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            kept = held.value[slot // 63] >> (slot % 63) & 1
            yield batch.filter(pa.array(kept.astype(bool))).select(["rid", "text"])

    return docs.select("rid", "text", slot.alias("slot")).mapInArrow(run, "rid long, text string")


def _cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the wanted(rid, pos, number, ...) fragments, taken from the texts."""
    others = [c for c in wanted.columns if c not in ("rid", "pos", "number")]
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("pos", "number", *others)).alias("wanted"))
    joined = _sieved(docs, wanted).join(lists, "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, rid in enumerate(batch.column("rid").to_pylist()):
                text = memoryview(texts[i].as_buffer())
                rows = batch.column("wanted")[i].values.flatten()
                pos, number = rows[0].to_numpy(), rows[1].to_numpy()
                cells = [bytes(text[p : p + m - 1 + LENGTH]) for p, m in zip(pos.tolist(), number.tolist(), strict=True)]
                yield pa.record_batch([pa.array([rid] * len(pos), pa.int64()), *rows, pa.array(cells, pa.binary())], names=["rid", "pos", "number", *others, "bytes"])

    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema}
    return joined.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("rid", "pos", "number", *others)) + ", bytes binary")


def _sorted_out(pieces: DataFrame) -> DataFrame:
    """Runs of repeated windows, as rid, s, e (bytes), of the fragments that occur once, by a suffix sort by anchor."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(x[-1] for x in rows), dtype=np.uint8)
        sizes = np.array([len(x[-1]) for x in rows])
        number = sizes - LENGTH + 1
        begins = np.r_[0, np.cumsum(sizes)[:-1]]
        inside = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        of = np.repeat(np.arange(len(rows)), number)
        # windows can only be equal if they have the same anchor at the same distance: its first place in the fragment
        ah, grams = np.array([x[3] for x in rows]).view(np.uint64), np.arange(len(data) - GRAM + 1)
        here = np.flatnonzero(mixed(Prefixes(data).of(grams, grams + GRAM)) == np.repeat(ah, sizes)[grams])
        anchor = here[np.searchsorted(here, begins)] - begins
        _, equal = suffix_order(data, np.repeat(begins, number) + inside, mixed(ah[of] + (anchor[of] - inside + LENGTH).astype(np.uint64)).view(np.int64))
        single = np.array([x[2] == 1 for x in rows])[of]
        hit = np.flatnonzero(equal & single)
        first = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (of[hit[1:]] != of[hit[:-1]])]) if len(hit) else hit
        last = np.r_[first[1:], len(hit)] - 1 if len(hit) else hit
        rid, pos = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])
        a, b = hit[first], hit[last]
        return pa.record_batch([pa.array(rid[of[a]]), pa.array(pos[of[a]] + inside[a]), pa.array(pos[of[b]] + inside[b] + LENGTH)], names=["rid", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, now = [], 0, None
        for batch in batches:
            for ah, *x in zip(*(batch.column(c).to_pylist() for c in ("ah", "rid", "pos", "copies", "bytes")), strict=True):
                if ah != now and held >= SORTED:
                    yield settle(rows)
                    rows, held = [], 0
                now = ah
                rows.append((*x[:-1], ah, x[-1]))
                held += len(x[-1])
        if rows:
            yield settle(rows)

    return pieces.select("ah", "rid", "pos", "copies", "bytes").repartition("ah").sortWithinPartitions("ah").mapInArrow(run, "rid long, s long, e long")


def _windows(pieces: DataFrame) -> DataFrame:
    """one (hash), rid, s, copies, window (its bytes) of every window of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, pos, copies, data in zip(*(batch.column(c).to_pylist() for c in ("rid", "pos", "copies", "bytes")), strict=True):
                data = np.frombuffer(data, dtype=np.uint8)
                start = np.arange(len(data) - LENGTH + 1)
                size = len(start)
                cells = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH))
                window = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), size, [None, pa.py_buffer(cells)]).cast(pa.binary())
                columns = [mixed(Prefixes(data).of(start, start + LENGTH)).view(np.int64), np.full(size, rid), pos + start, np.full(size, copies)]
                yield pa.record_batch([*map(pa.array, columns), window], names=["one", "rid", "s", "copies", "window"])

    return pieces.mapInArrow(run, "one long, rid long, s long, copies long, window binary")


def _counted_out(pieces: DataFrame) -> DataFrame:
    """The same for crowded anchors, which no task could sort: windows are counted by their hash with partial sums, and
    what repeats is verified by its bytes. Least and greatest bytes of a hash are partial aggregates too, so no task holds
    the windows of a hash; only where they differ (a collision) are windows counted by their bytes."""
    windows = _windows(cut(pieces))
    repeated = cut(windows.groupBy("one").agg(F.count("*").alias("n")).where("n > 1").select("one"))
    again = windows.join(repeated, "one", "left_semi")
    told = cut(again.groupBy("one").agg((F.min("window") == F.max("window")).alias("alike")))
    single = windows.where("copies = 1").select("one", "rid", "s").join(told.where("alike"), "one").select("rid", "s")
    clash = windows.join(told.where("not alike"), "one", "left_semi")
    apart = clash.groupBy("window").agg(F.count("*").alias("n")).where("n > 1")
    return single.union(clash.where("copies = 1").join(apart, "window").select("rid", "s")).select("rid", "s", (F.col("s") + LENGTH).alias("e"))


def _clashing(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """ah, fh, vh of copies(ah, fh, vh, rid, pos, number) whose bytes are not all the same, although their hashes are.

    The bytes are read from the texts again and told by a cryptographic digest (BLAKE2b, 128 bits); its least and greatest
    value for each group are sums that tasks make apart, so a group may have any number of copies."""
    lists = copies.groupBy("rid").agg(F.collect_list(F.struct("pos", "number", "ah", "fh", "vh")).alias("wanted"))
    joined = _sieved(docs, copies).join(lists, "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column("text").cast(pa.binary()), batch.column("wanted")
            rows = wanted.flatten().flatten()
            starts, ends = rows[0].to_numpy(), rows[0].to_numpy() + rows[1].to_numpy() - 1 + LENGTH
            told, edges = [], np.r_[0, np.cumsum(wanted.value_lengths().to_numpy())].tolist()
            for i, (first, last) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                text = memoryview(texts[i].as_buffer())
                told += [hashlib.blake2b(text[p:q], digest_size=16).digest() for p, q in zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True)]
            halves = np.frombuffer(b"".join(told), dtype=np.int64).reshape(-1, 2)
            yield pa.record_batch([*rows[2:], *map(pa.array, halves.T.copy())], names=["ah", "fh", "vh", "d0", "d1"])

    told = joined.mapInArrow(run, "ah long, fh long, vh long, d0 long, d1 long")
    ends = told.groupBy("ah", "fh", "vh").agg(*[f(d).alias(f"{d}_{n}") for d in ("d0", "d1") for n, f in (("a", F.min), ("b", F.max))])
    return ends.where("d0_a <> d0_b or d1_a <> d1_b").select("ah", "fh", "vh")


def repeats(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """rid, s, e: byte ranges of docs(rid, text) that together are all bytes within a repeated string of LENGTH bytes. found:
    the fragments, of anchors(docs) unless given; whatever their hashes fh and vh are, the result is the same."""
    found = anchors(docs) if found is None else found
    same = [f(c).alias(f"{c}{k}") for c in ("fh", "vh") for k, f in enumerate((F.min, F.max))]
    groups = found.groupBy("ah").agg(F.count("*").alias("n"), *same).where("n > 1")
    groups = cut(groups)  # else the join would share the count's partitions, and one anchor's rows could not be spread
    differ = (F.col("fh0") != F.col("fh1")) | (F.col("vh0") != F.col("vh1"))
    shared = cut(found.join(groups, "ah").select("ah", "fh", "vh", "rid", "pos", "number", differ.alias("mixed")))
    mixed_ = shared.where("mixed")
    # one fragment stands for its copies, which are repeated throughout
    kinds = cut(mixed_.groupBy("ah", "fh", "vh").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "pos", "number")).alias("one")))
    copied = kinds.where("copies > 1").select("ah", "fh", "vh")
    copies = shared.where("not mixed").drop("mixed").union(mixed_.drop("mixed").join(copied, ["ah", "fh", "vh"]).select("ah", "fh", "vh", "rid", "pos", "number"))
    clash = cut(_clashing(docs, copies))  # none, as a rule
    if clash.isEmpty():
        whole, alone = copies, None
    else:  # copies by hash alone are fragments of their own, to be sorted by their bytes
        whole = copies.join(clash, ["ah", "fh", "vh"], "left_anti")
        alone = copies.join(clash, ["ah", "fh", "vh"], "left_semi").select("ah", F.lit(1).cast("long").alias("copies"), F.struct("rid", "pos", "number").alias("one"))
        kinds = kinds.join(clash, ["ah", "fh", "vh"], "left_anti")
    single = kinds.select("ah", "copies", "one")
    single = cut(single.union(alone)) if alone is not None else single
    crowds = single.groupBy("ah").agg(F.count("*").alias("kinds")).where(F.col("kinds") > CROWDED).select("ah", F.lit(True).alias("crowded"))
    whole = whole.select("rid", F.col("pos").alias("s"), (F.col("pos") + F.col("number") - 1 + LENGTH).alias("e"))
    wanted = single.join(crowds, "ah", "left").select("one.rid", "one.pos", "one.number", "ah", "copies", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    pieces = _cut_out(docs, wanted)
    return whole.union(_sorted_out(pieces.where("not crowded"))).union(_counted_out(pieces.where("crowded")))


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def _changed(rows: DataFrame) -> DataFrame:
    """rid, n_removed, n_spans, kept bytes of the texts that lose any."""
    spans = cut(repeats(rows.where(F.octet_length("text") >= LENGTH)))
    lists = spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            removed, runs, kept = [], [], []
            for i in range(batch.num_rows):
                data = np.frombuffer(texts[i].as_buffer(), dtype=np.uint8)
                s, e = (x.to_numpy() for x in batch.column("spans")[i].values.flatten())
                depth = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(depth, s, 1)
                np.add.at(depth, e, -1)
                gone = np.cumsum(depth[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(data[~gone].tobytes())
            yield pa.record_batch([batch.column("rid"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["rid", "n_removed", "n_spans", "kept"])

    return _sieved(rows, spans).join(lists, "rid").mapInArrow(run, "rid long, n_removed long, n_spans long, kept binary")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the other
    bytes, joined; they may end inside a character).

    A byte goes if a string of LENGTH bytes around it also starts anywhere else, in the same text or another; strings are
    judged on the input. Null texts count as empty; shorter texts stay whole; repeated rows are texts of their own; other
    columns are ignored; an empty table gives no rows. docs must give the same rows in the same order when it is read
    again, as a stored table does. Fragments that are equal as a whole by two hashes are read again and told by a
    cryptographic digest of their bytes; windows of differing fragments are verified byte by byte."""
    rows = _numbered(docs)
    return rows.join(_changed(rows), "rid", "left").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), *_counts(), F.coalesce("kept", F.col("text").cast("binary")).alias("kept"))


def _counts() -> list:
    return [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of deduplicated(); texts that stay whole are not shuffled for it."""
    rows = _numbered(table(spark, sf_dir, "documents"))
    small = _changed(rows).select("rid", "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha256"))
    each = rows.select("rid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256"))
    return each.join(small, "rid", "left").select("doc_id", "n_bytes", *_counts(), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))
