"""Scores, index, spans and links of the operators against plain versions, across the sizes at which they divide work."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.llm import decontaminate, graph, lm, near, pii, simhash, suffixes, toxicity


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + [None]


def test_lm_equals_a_plain_model(spark):
    r = random.Random(1)
    words = [f"w{int(r.expovariate(0.05))}" for _ in range(6000)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 60))) for _ in range(200)] + [None, "", "unheard words only here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    taught = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))}
    ones, pairs, after = Counter(), Counter(), Counter()
    for i, t in enumerate(texts):
        if taught[i]:
            k = "<start>"
            for w in _tokens(t):
                ones[w] += 1
                pairs[k, w] += 1
                after[k] += 1
                k = w
    total = sum(ones.values())
    for s in (lm.Settings(), lm.Settings(mix=0.2, discount=0.7, heavy=20, tokens=500)):  # heavy words dealt by context, many shards
        got = {x.doc_id: x.score for x in lm.scores(docs, s).collect()}
        for i, t in enumerate(texts):
            want, k = 0.0, "<start>"
            for w in _tokens(t):
                mix = s.mix if after[k] else 0.0
                one = (ones[w] - s.discount) / total if ones[w] else s.discount * len(ones) / total
                want += math.log10(mix * (pairs[k, w] / after[k] if after[k] else 0) + (1 - mix) * one)
                k = w
            assert abs(got[i] - want) <= s.step * (len(_tokens(t)) + 1), i


def test_lm_with_fewer_exact_contexts_than_words(spark):
    r = random.Random(2)
    texts = [" ".join(f"w{int(r.expovariate(0.02))}" for _ in range(50)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {x.doc_id: x.score for x in lm.scores(docs).collect()}
    few = {x.doc_id: x.score for x in lm.scores(docs, lm.Settings(exact=20, classes=16)).collect()}
    assert set(few) == set(whole) and all(x < 0 for x in few.values())
    # pooled contexts say less about the training texts
    assert sum(few.values()) < sum(whole.values())


def test_lm_contexts_that_are_not_broadcast_are_exact(spark):
    """Whatever number of contexts is broadcast, the scores are those of every word as a context of its own."""
    r = random.Random(12)
    texts = [" ".join(f"w{int(r.expovariate(0.01))}" for _ in range(r.randint(0, 60))) for _ in range(150)] + [None, "", "unheard words only here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    whole = {x.doc_id: x.score for x in lm.scores(docs, lm.Settings(tokens=500)).collect()}
    for s in (lm.Settings(exact=20, tokens=500), lm.Settings(exact=0, heavy=20, tokens=500)):
        got = {x.doc_id: x.score for x in lm.scores(docs, s).collect()}
        assert set(got) == set(whole) and all(abs(got[i] - whole[i]) < 1e-9 for i in whole)


def test_elias_fano_over_the_whole_range():
    r = np.random.default_rng(5)
    for values in (np.unique(r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)), np.arange(300, dtype=np.uint64), np.array([0, 0, 5, 5, 9], np.uint64)):
        coded = lm.EliasFano(values, 1 << 64 if values.max() > 1 << 40 else 10_000)
        assert (coded.get(np.arange(len(values))) == values).all()
        asked = np.r_[values[:200], values[:200] + np.uint64(1), np.uint64(0)]
        assert (coded.successor(asked) == np.searchsorted(values, asked)).all()


def _bm25(items, s):
    sizes = [len(w) for w in items]
    mean, df = sum(sizes) / len(sizes), Counter(t for w in items for t in set(w))
    idf = {t: math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    parts = [{t: idf[t] * tf / (tf + s.k1 * (1 - s.b + s.b * len(w) / mean)) for t, tf in Counter(w).items()} for w in items]
    return [{t: x / sum(p.values()) for t, x in p.items()} for p in parts]


def _shingles(w, n=5):
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


@pytest.mark.parametrize("kb", [4096, 1])
def test_decontamination_equals_brute_force(spark, kb):
    r, s = random.Random(3), decontaminate.Settings(items_kb=kb)
    words = [f"v{i}" for i in range(400)]
    items = [" ".join(r.choices(words, k=r.randint(3, 25))) + ". " + " ".join(r.choices(words, k=r.randint(4, 8))) + "." for _ in range(60)]
    rows = [(i % 50, t) for i, t in enumerate(items)]  # ids repeat with other texts
    docs = []
    for _ in range(240):
        w = r.choices(words, k=r.randint(0, 150))
        for _ in range(r.randrange(3)):
            p = r.choice(items).upper().split()
            for _ in range(r.randrange(4)):
                p[r.randrange(len(p))] = r.choice(words)
            at = r.randint(0, len(w))
            w[at:at] = p[: r.randint(len(p) // 2, len(p))] if r.random() < 0.3 else p
        docs.append(" ".join(w))
    split = [t.lower().split() for t in items]
    share, longest = _bm25(split, s), max(map(len, split))
    want = set()
    for d, text in enumerate(docs):
        w = text.lower().split()
        best = {}
        for at in range(0, max(len(w), 1), longest):
            part = w[at : at + 2 * longest]
            for i, (own, scores) in enumerate(zip(split, share, strict=True)):
                score = sum(scores.get(t, 0) for t in set(part))
                n = decontaminate._answer_words(items[i].lower())
                q = len(_shingles(own) & _shingles(part, len(own) if len(own) < 5 else 5)) / len(_shingles(own))
                a = len(set(own[-n:]) & set(part)) / len(set(own[-n:]))
                if score >= s.least - 1e-9 and q >= s.question and a >= s.answer and score > best.get(i, (0,))[0]:
                    best[i] = (score,)
        want |= {(d, rows[i][0], round(x[0], 6)) for i, x in best.items()}
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = decontaminate.matches(table, spark.createDataFrame(rows, "item_id long, text string"), s)
    assert {(x.doc_id, x.item_id, round(x.score, 6)) for x in got.collect()} == want and len(want) > 30


def test_decontamination_reports_each_text_of_a_repeated_item(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta."), (1, "one two three four five six seven."), (1, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta. one two three four five six seven.")], "doc_id long, text string")
    for kb in (4096, 1):
        assert decontaminate.matches(docs, items, decontaminate.Settings(items_kb=kb)).count() == 2


def test_pii_context_and_scores(spark):
    texts = ["iban DE89370400440532013000", "DE89370400440532013000", "example DE89370400440532013000", "DE89370400440532013000 is an example", "social 123-45-6789", "123-45-6789 is my ssn", "123-45-6789", "123-45-6789 " + "x" * 41 + " ssn", "serial social 123-45-6789", "DE88370400440532013000"]
    got = [x.spans for x in pii.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [bool(x) for x in got] == [True, True, False, False, True, True, False, False, False, False]
    scored = pii.digests(spark.createDataFrame([(1, "write to a@b.cd or 1.2.3.4")], "doc_id long, text string")).first()
    assert scored.spans == "email:9:15,ip:19:26" and len(scored.scores.split(",")) == 2


def test_pii_of_many_matches_is_whole(spark):
    n = 3000
    text = "é a@b.cd 1.2.3.4, " * n
    row = pii.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_email, row.n_ip) == (n, n)
    want = [f"email:{18 * i + 2}:{18 * i + 8}" for i in range(n)] + [f"ip:{18 * i + 9}:{18 * i + 16}" for i in range(n)]
    assert row.spans == ",".join(want)
    assert pii.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == "é <EMAIL> <IP>, " * n


def test_simhash_links_in_a_large_posting(spark):
    """Hundreds of fingerprints that share four bytes: compared through the lists of a fifth one."""
    r, fps = random.Random(4), set()
    for _ in range(60):
        x = (r.getrandbits(32) << 32) | 0x01020304
        for _ in range(6):
            y = x
            for b in r.sample(range(32, 64), r.randint(0, 4)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    label = {x: x for x in fps}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                label[max(top(a), top(b))] = min(top(a), top(b))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {x.node: x.root for x in graph.components(simhash.links(table, 3)).collect()}
    groups = lambda f: {frozenset(y for y in fps if f(y) == f(x)) for x in fps}
    assert groups(top) == groups(lambda x: roots.get(signed(x), signed(x)))


def test_simhash_representatives_keep_other_texts_of_an_id(spark):
    rows = [(1, "one two three four"), (2, "one two three four"), (2, "quite other words here"), (2, "quite other words here"), (None, "one two three four")]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.text[:3]) for x in got) == [(0, "one"), (1, "one"), (2, "qui")]


def test_near_copies_of_one_text_by_the_hundreds(spark, monkeypatch):
    """A family larger than a posting's small clusters and than one chunk."""
    monkeypatch.setattr(near, "GRID", 40)
    monkeypatch.setattr(near, "CHUNK", 16)
    r = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    got = {x.doc_id for x in near.representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i for i in range(len(sets)) if top(i) == i}


def test_fragments_in_blocks_hold_the_same_windows():
    r = np.random.default_rng(6)
    data = r.integers(97, 100, 6000).astype(np.uint8)
    at = np.array([0, 2500, 2600, 6000])
    whole, parts = suffixes.fragments(data, at), suffixes.fragments(data, at, block=700)

    def windows(found):
        row, pos, number, ah, _ = found
        return {(int(a), int(p) + k): int(h) for a, p, n, h in zip(row, pos, number, ah, strict=True) for k in range(n)}

    assert windows(whole) == windows(parts) and len(windows(whole)) == 2301 + 3201


def test_toxicity_does_not_depend_on_the_order_of_rows(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choices([f"w{k}" for k in range(50)], k=20) + ["moron"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    kept = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    one = {x.doc_id: x.score for x in toxicity.scored(docs.select("doc_id", "text"), docs.select("doc_id", "toxic").where(kept)).collect()}
    same = {x.doc_id: x.score for x in toxicity.scored(docs.select("doc_id", "text").repartition(7), docs.select("doc_id", "toxic").where(kept)).collect()}
    assert one == same and np.mean([(one[i] >= 0.5) == t for i, _, t in rows]) > 0.95
