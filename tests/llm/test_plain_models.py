"""Learners and dealing against plain versions."""

import heapq
import math
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from marketspark.llm import common, sharding, toxicity


def features_of(text, bits):
    raw = text.encode()
    h, row, _ = common.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    f, _ = toxicity.features(h, row, bits)
    return sorted(set(f.tolist()))


def test_ftrl_equals_a_plain_loop(spark):
    """z and n by coordinate, as published: w = 0 inside the l1 ball, else by the coordinate's own rate."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choices(words, k=12) + ["bad"] * (i % 4 == 0)), int(i % 4 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    s = toxicity.Settings(bits=12, alpha=0.5, beta=1.0, l1=0.7, l2=0.1, epochs=2)
    at, w, bias = toxicity.fit(docs, docs, s)
    order = {x.doc_id: x.o for x in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("o")).collect()}
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if i == "bias":  # without penalties
            return -z[i] / ((s.beta + math.sqrt(n[i])) / s.alpha)
        return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for i, text, y in sorted(rows, key=lambda x: order[x[0]]):
            own = [*features_of(text, s.bits), "bias"]
            ws = {f: weight(f) for f in own}
            g = 1 / (1 + math.exp(-sum(ws.values()))) - y
            for f in own:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / s.alpha * ws[f]
                n[f] += g * g
    want = {f: weight(f) for f in z if f != "bias" and weight(f)}
    assert set(at.tolist()) == set(want) and np.allclose(w, [want[f] for f in at.tolist()]) and abs(bias - weight("bias")) < 1e-9


def differenced(sizes, k):
    """Karmarkar-Karp by a heap: the two partial partitions of largest spread are combined, one in the opposite order."""
    heap = [(-s, i, [s] + [0] * (k - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted((x + y for x, y in zip(sorted(a, reverse=True), sorted(b), strict=True)), reverse=True)
        count += 1
        heapq.heappush(heap, (-(both[0] - both[-1]), count, both))
    return heap[0][2]


def test_shards_are_as_even_as_plain_differencing(spark, tmp_path):
    r = random.Random(4)
    texts = ["x" * int(r.paretovariate(0.9) * 20) + str(i) for i in range(300)]
    texts += [texts[0]] * 5 + [None, "", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sharding.query(spark, str(tmp_path)).collect()
    groups = defaultdict(int)
    for t in texts:
        groups[t] += len((t or "").encode()) + 1
    assert len(rows) == len(texts)
    shards, held = defaultdict(int), defaultdict(set)
    for x in rows:
        assert x.size == len((texts[x.doc_id] or "").encode()) + 1 and x.text_crc32 == zlib.crc32((texts[x.doc_id] or "").encode())
        shards[x.shard] += x.size
        held[texts[x.doc_id]].add(x.shard)
    assert all(len(s) == 1 for s in held.values())
    plain = differenced(list(groups.values()), 16)
    spread = max(shards.values()) - min(shards[i] for i in range(16))
    assert spread <= max(max(plain) - min(plain), 2) + 2
