"""op12 against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np

from marketspark.llm import periods
from pyspark.sql import functions as F


def plain(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def puzzles(number, seed):
    r = random.Random(seed)
    for _ in range(number):
        w = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            if len(w) > 4:
                a, p = r.randrange(len(w)), r.randint(1, 9)
                for i in range(a + p, min(len(w), a + r.randint(1, 40))):
                    w[i] = w[i - p]
        yield w


def test_runs_of_any_length_equal_plain_ones():
    for w in puzzles(600, 1):
        for least in (2, 12):
            assert periods.runs_of(w, least) == plain(w, least), w


def test_stretches_hold_all_runs():
    texts = list(puzzles(300, 2))
    number = np.array([x for w in texts for x in w], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
    first = np.r_[0, np.cumsum([len(w) for w in texts])]
    got = {}
    for i, j in zip(*map(np.ndarray.tolist, periods.stretches(number, row)), strict=True):
        assert row[i] == row[j - 1]
        got.setdefault(int(row[i]), []).extend((i - int(first[row[i]]) + s, n, q) for s, n, q in periods.runs_of(number[i:j].tolist()))
    for k, w in enumerate(texts):
        assert sorted(got.get(k, [])) == plain(w)


def test_long_periodic_texts_with_machine_integers():
    w = [i % 700 for i in range(60_000)]
    assert len(w) > periods.LISTED and periods.runs_of(w) == [(0, 60_000, 700)]
    w = [0] * 30_000 + [1] + [0] * 30_000
    assert periods.runs_of(w) == [(0, 30_000, 1), (30_001, 30_000, 1)]


def test_operator_on_texts(spark):
    texts = [" ".join(map(str, w)) for w in puzzles(150, 3)] + ["a\tb\x0bc\n" * 9, "x " * 20_000, "é ü " * 8, None, "", " \n"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, runs long").repartition(4)
    got = periods.found(df).collect()
    assert len(got) == len(texts)
    for r in got:
        w = words_of(texts[r.doc_id])
        want = [(0, len(w), 1)] if len(w) == 20_000 else plain(w)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), want, collapsed(w, want))


def test_planted_repeats_and_digests(spark):
    r = random.Random(4)
    texts = {i: " ".join(str(r.randrange(50)) for _ in range(r.randint(0, 90))) for i in range(400)}
    texts[11], texts[12] = None, ""
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    changed = 0
    for x in periods.digests(periods.repeating(df)).collect():
        w = words_of(texts[x.doc_id])
        h = zlib.crc32(str(x.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + i % p] for i in range(n - a)]
            changed += 1
        runs = plain(w)
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        want = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli) == (len(runs), *want)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert changed > 10


def test_odd_tables(spark, odd, empty):
    assert periods.digests(periods.repeating(empty)).count() == 0
    got = periods.digests(periods.repeating(odd)).collect()
    assert len(got) == odd.count() and all(len(x.runs_sha256) == 64 for x in got)
    assert periods.found(odd).select(F.sum(F.size("runs"))).first()[0] > 0
