"""The pipeline's near copies against the similarity of all pairs."""

import random

import corpus_pipeline
import numpy as np
from marketspark.llm import near


def plain(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept(rows):
    """Least id of each group, by comparing all pairs."""
    sets = [(i, plain(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i for i in root if root[i] == i}


def edited(r, text, times):
    w = text.split()
    for _ in range(times):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_stage_drops_all_near_copies(spark):
    r = random.Random(3)
    texts = []
    line = " ".join(f"common{i}" for i in range(30))
    for _ in range(60):
        text = " ".join(f"w{r.randrange(3000)}" for _ in range(r.choice([3, 6, 40, 150, 400])))
        if r.random() < 0.3:
            text = f"{line} {text}"
        texts += [text] + [edited(r, text, r.randrange(1 + len(text.split()) // 25)) for _ in range(r.randrange(5))]
    texts += [edited(r, texts[0] + " " + line * 3, k) for k in range(8)] + [None, "", " \t", "a", "a b", "A B", "a b c d e", "a b c d e f"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == kept(rows)


def test_stage_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {x.doc_id for x in near.representatives(docs).collect()}
    assert got == kept([(x.doc_id, x.text) for x in docs.collect()])


def test_repeated_id_with_another_text_stays(spark):
    rows = [(1, "one two three four five six seven"), (2, "one two three four five six seven"), (2, "quite another text of more than five words"), (None, "one two three four five six seven")]
    got = near.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.text[:3]) for x in got) == [(0, "one"), (1, "one"), (2, "qui")]


def test_members_of_a_posting_meet_in_the_lists_of_other_positions():
    """Heads that share no byte stay under the tally, however few bits differ; one byte brings them together."""
    r = np.random.default_rng(7)
    one = r.integers(0, 256, near.HEAD * 8).astype(np.uint8)
    for others in (0, 400):  # without lists and with them
        cells = np.stack([one, one ^ np.uint8(1), one ^ np.uint8(1)])
        cells[2, 5] ^= np.uint8(1)
        cells[2, 6] ^= np.uint8(3)
        cells = np.concatenate([r.integers(0, 256, (others, near.HEAD * 8)).astype(np.uint8), cells])
        met = [(a, b) for x in near._clusters(np.arange(len(cells)), cells.view(np.uint64)) for a, b in zip(x["lead"].to_pylist(), x["node"].to_pylist(), strict=True)]
        assert (others, others + 2) in met and (others, others + 1) not in met


def test_lists_of_a_posting_connect_what_all_pairs_do():
    r = np.random.default_rng(8)
    cells = np.repeat(r.integers(0, 256, (90, near.HEAD * 8)).astype(np.uint8), r.integers(1, 20, 90), axis=0)
    cells ^= np.where(r.random(cells.shape) < 0.7, 1 << r.integers(0, 8, cells.shape), 0).astype(np.uint8)
    order = r.permutation(len(cells))
    cells = cells[order]
    head = cells.view(np.uint64)
    n = len(cells)
    assert n > 2 * near.FEW

    def roots(pairs):
        root = list(range(n))

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            x, y = sorted((top(a), top(b)))
            root[y] = x
        return [top(x) for x in range(n)]

    want = [(i, j) for i in range(n) for j in range(i) if (cells[i] == cells[j]).any() and np.bitwise_count(head[i] ^ head[j]).sum() <= near.BITS]
    got = [(a, b) for x in near._clusters(np.arange(n), head) for a, b in zip(x["lead"].to_pylist(), x["node"].to_pylist(), strict=True)]
    assert roots(got) == roots(want)
