"""BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import slices, table

# Fixed values of the vocabulary file's own pre-tokenizer; \s is spelled out as Unicode White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Words whose ids a task remembers; the memory is emptied beyond that, with no effect on the result.
REMEMBERED = 150_000
#: Bytes of text that share one pair index.
INDEXED = 3 << 20


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if visible Latin-1, else 256 and up."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    letters = dict(zip(visible, map(chr, visible), strict=True)) | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Bpe:
    """Encoder and decoder of a vocabulary with word ends, from the bytes of its tokenizers file."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        vocab, end, letters = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"], byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.final = np.array([vocab[x + end] for x in letters], dtype=np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.left, self.right = keys >> 20, keys & (1 << 20) - 1
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cuts = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.known: dict[str, bytes] = {x: np.uint32(i).tobytes() for x, i in self.special.items()}
        self.fixed = len(self.known)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 for those never merged."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, as little-endian unsigned 32-bit integers. All words lie in one symbol array; the index
        maps each rank to its positions; the least active rank is merged everywhere, then its neighbours are listed."""
        coded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        data = np.frombuffer(b"".join(coded), dtype=np.uint8)
        ends = np.cumsum(sizes) - 1
        symbol = self.inner[data]
        symbol[ends] = self.final[data[ends]]
        after = np.arange(1, len(symbol) + 1)
        after[ends] = -1
        before = np.arange(-1, len(symbol) - 1)
        before[ends[:-1] + 1] = -1

        index: dict[int, list] = {}

        def listed(at: np.ndarray) -> None:
            at = at[at >= 0]
            at = at[after[at] >= 0]
            rank = self.rank(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else []
            for r, group in zip(rank[starts].tolist(), np.split(at, starts[1:]) if len(rank) else [], strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(group)

        active: list[int] = []
        listed(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            at, a, b, new = np.unique(np.concatenate(index.pop(r))), self.left[r], self.right[r], self.made[r]
            if a != b:
                at = at[(symbol[at] == a) & (after[at] >= 0)]
                at = at[symbol[after[at]] == b]
            else:
                kept = []
                for p in at.tolist():
                    if symbol[p] == a and after[p] >= 0 and symbol[after[p]] == b and not (kept and after[kept[-1]] == p):
                        kept.append(p)
                at = np.array(kept, dtype=np.int64)
            if not len(at):
                continue
            gone = after[at]
            symbol[at], symbol[gone] = new, -1
            follows = after[gone]
            after[at] = follows
            before[follows[follows >= 0]] = at[follows >= 0]
            listed(np.unique(np.r_[before[at], at]))
        alive = symbol >= 0
        ids = symbol[alive].astype("<u4").tobytes()
        stops = (np.cumsum(alive)[ends] * 4).tolist()
        return [ids[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]

    def pieces(self, text: str) -> list[str]:
        """Words to merge, and special tokens as they stand in the raw text."""
        out: list[str] = []
        at = 0
        for m in [*self.cuts.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            if part.isascii():
                out += ASCII_PIECES.findall(part.lower())
            else:
                # one letter at a time: the final form of sigma is not chosen
                out += PIECES.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
            if m:
                out.append(m[0])
                at = m.end()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        wanted = set().union(*split)
        if len(self.known) + len(wanted) > REMEMBERED:
            for word in [*self.known][self.fixed :]:
                del self.known[word]
        if new := [w for w in wanted if w not in self.known]:
            self.known.update(zip(new, self.merge(new), strict=True))
        find = self.known.__getitem__
        return [b"".join(map(find, x)) for x in split]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens and decoded text of every row of docs(doc_id, text),
    as the tokenizers library encodes with add_special_tokens=False and decodes with skip_special_tokens=False.

    Null and empty texts have no ids and decode to the empty text. Special tokens inside a text become their id. Repeated
    rows stay; other columns are ignored; an empty table gives no rows. The file (about 2 MB, of fixed size) is read once
    on the driver and broadcast."""
    with open(path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(file.value)
        for batch in batches:
            for part, _, _ in slices(batch, "text", INDEXED):
                ids = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(bpe.decode, ids), pa.string())],
                    names=["doc_id", "ids", "n_tokens", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    return encoded(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())
