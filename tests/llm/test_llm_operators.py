"""Each operator against a plain version, and on odd and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.llm import bpe, chat, common, decontaminate, graph, lm, pii, search, sharding, simhash, suffixes, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_words_match_plain_split():
    texts = ["Ab  cd\tAB", "", "é x", "\x0b\x0cq\x1cz"]
    raw = [t.encode() for t in texts]
    h, row, first = common.words(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    want = [r.lower().split() for r in raw]
    assert np.diff(first).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


def test_components_of_a_long_chain(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    assert graph.components(links).select("root").distinct().collect()[0][0] == 0
    assert graph.components(links.where("a < 0")).count() == 0


def _union(fps, bits=3):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_links_all_near_pairs(spark):
    r = random.Random(2)
    center = r.getrandbits(64)
    fps = [r.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    for _ in range(120):
        x = center
        for b in r.sample(range(64), r.randint(0, 5)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = _union(fps)
    for hot in (20_000, 3):  # also with divided postings
        roots = {x.node: x.root for x in graph.components(simhash.links(table, 3, hot)).collect()}
        got = [roots.get(x, x) for x in signed]
        assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_simhash_documents(docs):
    got = {x.doc_id: x for x in simhash.near_duplicates(docs).collect()}
    data = docs.select("doc_id", "text").collect()
    for x in data:
        assert int(got[x.doc_id].fingerprint, 16) == simhash.fingerprint((x.text or "").encode())
    ids = [x.doc_id for x in data]
    label = _union([int(got[i].fingerprint, 16) for i in ids])
    least = {}
    for i, g in zip(ids, label, strict=True):
        least[g] = min(least.get(g, i), i)
    assert all(got[i].component_id == least[g] for i, g in zip(ids, label, strict=True))


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicates(odd)
    assert got.count() == odd.count() == 13
    zero = got.where("fingerprint = '0000000000000000'").collect()
    assert len(zero) == 4 and {x.component_id for x in zero} == {2}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns and kept.where("text like 'same%'").count() == 1 and kept.where("doc_id is null").count() == 1
    assert simhash.representatives(empty).count() == 0


def _clean(x, default):
    return (x or default).replace("<|im_", "<| im_")


def _plain_preference(chosen, rejected):
    """Lists of (turn, role, text) as (n_prompt, prompt, chosen, rejected)."""
    a, b = (sorted((-1 if t is None else t, _clean(r, "user"), _clean(x, "")) for t, r, x in rows) for rows in (chosen, rejected))
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    show = lambda ts: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, x in ts)
    return n, show(a[:n]), show(a[n:]), show(b[n:])


def test_chat_prefix_and_masks(spark):
    r = random.Random(12)
    rows = []
    for p in range(30):
        both = [(r.choice([None, i]), r.choice(["user", "assistant", None]), r.choice(["x", "é y", None, "<|im_end|>"])) for i in range(r.randrange(12))]
        for side in (True, False):
            turns = both + [(r.randrange(12), "assistant", r.choice("ab")) for _ in range(r.randrange(4))]
            rows += [(p, side, *t) for t in turns + turns[: r.randrange(3)]]
    rows += [(40, s, t, "assistant" if t % 2 else "user", f"t{t}" if s or t != 401 else "other") for s in (True, False) for t in range(600)] + [(None, True, 0, "user", "x"), (41, None, 0, "user", "x")]
    table = spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    for piece in (256, 2):
        got = {x.pair_id: x for x in chat.preferences(table, piece).collect()}
        assert set(got) == {x[0] for x in rows if x[0] is not None and x[0] != 41}
        for p, x in got.items():
            assert (x.n_prompt, x.prompt, x.chosen, x.rejected) == _plain_preference(*([t[2:] for t in rows if t[0] == p and t[1] is s] for s in (True, False)))
            for text, mask in ((x.chosen, x.chosen_mask), (x.rejected, x.rejected_mask)):
                spans = [tuple(map(int, m.split(":"))) for m in mask.split(",") if m]
                assert [text[a:b] for a, b in spans] == re.findall(r"(?<=<\|im_start\|>assistant\n)[^<]*(?:<\| im_end\|>)?[^<]*<\|im_end\|>", text)
        assert got[40].n_prompt == 401 and got[40].chosen_mask.count(":") == 100
    assert chat.preferences(table.where("pair_id < 0")).count() == 0


def test_chat_query_has_prompts_and_stays_in_the_jvm(spark):
    got = chat.query(spark, SF)
    assert got.where("n_prompt = 0 or prompt = ''").count() == 0 and got.where("chosen = rejected").count() < got.count()
    assert "Python" not in spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.vocabulary()), bpe.Bpe(open(bpe.vocabulary(), "rb").read())
    r = random.Random(3)
    letters = "aaabA \n'sdΣσẞßİıǅéÉ́​\x1c\x85½²12٣ⅧabcXYZ\U0001d7d9<|>﻿中文字ﬁ"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["<|endoftext|>a<|startoftext|>", "aaaaaaaaaa", ""]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_query(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary())
    got = {x.doc_id: x for x in bpe.digests(docs, bpe.vocabulary()).collect()}
    for x in docs.collect():
        ids = library.encode(x.text or "", add_special_tokens=False).ids
        assert got[x.doc_id].n_tokens == len(ids) and got[x.doc_id].ids_sha256 == brute.sha(np.array(ids, "<u4").tobytes())
    assert bpe.encoded(odd, bpe.vocabulary()).where("n_tokens = 0").count() == 4
    assert bpe.encoded(empty, bpe.vocabulary()).count() == 0


def test_sharding(docs, odd, empty):
    for table in (docs, odd):
        got = sharding.shards(table).toPandas()
        assert len(got) == table.count()
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        assert got["size"].sum() == sum(len((x.text or "").encode()) + 1 for x in table.select("text").collect())
    sums = sharding.shards(docs).groupBy("shard").agg(F.sum("size").alias("b")).toPandas().b
    assert sums.max() - sums.min() < 0.01 * sums.mean()
    assert sharding.shards(docs).groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert sharding.shards(empty).count() == 0


def test_sharding_never_divides_a_group(spark):
    rows = [(i, "same text") for i in range(3000)] + [(5000 + i, f"text {i} " * (1 + i % 7)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for items in (4096, 50, 7):  # one, two and four steps of differencing
        got = sharding.shards(docs, items=items).toPandas()
        sums = sorted(got.groupby("shard")["size"].sum())
        assert len(got) == len(rows) and len(sums) == 16 and sums[-1] == 30_000
        assert sums[-2] - sums[0] < 0.1 * sums[0]
        assert got[got["size"] == 10].groupby("text_crc32").shard.nunique().max() == 1
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_differencing_by_hand():
    # 8, 7, 6, 5, 4 in two: 8-7=1, 6-5=1, 4-1=3, 3-1=2
    slot, sums = sharding.difference(sharding._alone(np.array([8, 7, 6, 5, 4]), 2))
    assert sorted(sums) == [14, 16]
    for shard in (0, 1):
        assert sum(x for x, s in zip([8, 7, 6, 5, 4], slot[:, 0], strict=True) if s == shard) == sums[shard]


def _plain_repeats(texts, length=200):
    seen = Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("crowded", [4096, 3])
def test_repeated_strings(spark, tmp_path, monkeypatch, crowded):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    r = random.Random(4)
    base = "".join(r.choice("ab") for _ in range(2000))
    texts = []
    for _ in range(40):
        x = list(base[r.randint(0, 800) : r.randint(900, 2000)])
        for _ in range(r.randint(0, 12)):
            x[r.randrange(len(x))] = r.choice("abcé")
        texts.append("".join(x))
    texts += ["a" * 1000, "a" * 199, "a" * 200, None, "", "xy" * 300, "é" * 150, "é" * 100]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixes.query(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == _plain_repeats(texts)


@pytest.mark.parametrize("forced", ["all", "some"])
def test_repeated_strings_whose_hashes_collide(spark, forced):
    """Fragments of one anchor that have equal hashes and other bytes: what goes is the same."""
    r = random.Random(14)
    base = "".join(r.choice("ab") for _ in range(900))
    texts = [base, base, base[:500] + "c" + base[501:], "z" + base[100:], base[:450] + base[:450], "q" * 100, "".join(r.choice("ab") for _ in range(900))]
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(2).cache()
    hashes = suffixes.anchors(rows)
    low = F.lit(0).cast("long") if forced == "all" else F.col("fh") % 2
    spans = suffixes.repeats(rows, hashes.withColumns({"fh": low, "vh": low})).collect()
    gone = {i: {b for x in spans if x.rid == i for b in range(x.s, x.e)} for i in range(len(texts))}
    plain = suffixes.repeats(rows).collect()
    assert gone == {i: {b for x in plain if x.rid == i for b in range(x.s, x.e)} for i in range(len(texts))}
    assert [len(gone[i]) for i in range(len(texts))] == [x[1] for x in _plain_repeats(texts)]


def test_repeated_strings_odd(spark, odd, empty):
    got = suffixes.deduplicated(odd)
    assert got.count() == 13 and got.where("n_removed > 0").count() >= 3
    assert suffixes.deduplicated(empty).count() == 0


def test_elias_fano_successor():
    r = np.random.default_rng(5)
    values = np.unique(r.integers(0, 1 << 40, 3000).astype(np.uint64))
    coded = lm.EliasFano(values, 1 << 40)
    asked = np.r_[values[:50], r.integers(0, 1 << 40, 500).astype(np.uint64), np.uint64(0)]
    assert (coded.get(np.arange(len(values))) == values).all()
    assert (coded.successor(asked) == np.searchsorted(values, asked)).all()
    assert lm.EliasFano(np.zeros(0, np.uint64), 1 << 40).n == 0


def test_lm_scores(docs):
    got = {x.doc_id: x for x in lm.scores(docs).collect()}
    split = {x.doc_id: re.findall(r"[^\x20\x09-\x0d]+", (x.text or "").translate({c: c + 32 for c in range(65, 91)})) + [None] for x in docs.collect()}
    taught = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in split}
    counts = Counter(w for i, ws in split.items() if taught[i] for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    for i, ws in split.items():
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), total, not taught[i])
        assert abs(x.base_score - sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws)) < 1e-6
    held = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def test_lm_odd(odd, empty):
    got = lm.scores(odd).collect()
    assert len(got) == 13 and min(x.n_tokens for x in got) == 1 and all(x.score <= 0 for x in got)
    assert lm.scores(empty).count() == 0
    alone = odd.where("doc_id = 0").withColumn("doc_id", F.lit(1).cast("long"))  # a held-out id: nothing is learned
    assert [(x.score, x.train_tokens) for x in lm.scores(alone).collect()] == [(0, 0)] * 2


def test_wand_finds_all_above():
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(vocabulary, k=30))) for i in range(120)]
    index = decontaminate.Index(items, decontaminate.Settings(least=0.2, block=4))
    for _ in range(100):
        terms = sorted(r.sample(range(len(index.terms)), 60))
        want = Counter()
        for t in terms:
            for i, x in zip(index.docs[t], index.share[t], strict=True):
                want[i] += x
        assert {i for i, _ in index.above(terms)} == {i for i, x in want.items() if x >= 0.2}


def test_decontamination(spark, odd, empty):
    items = spark.createDataFrame([(1, "Which river runs through the old town of Ulm? The blue Danube of course."), (2, None), (None, "x"), (3, "tiny item")], "item_id long, text string")
    leak = "some words before WHICH river runs through the old town of Ulm? The blue Danube of course. and after " + "filler words " * 200
    docs = spark.createDataFrame([(1, leak, "a"), (2, "which river is it", "b"), (3, None, "c"), (4, leak, "a")], "doc_id long, text string, leaks string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.matches(docs, items).collect()} == {(1, 1), (4, 1)}
    marked = decontaminate.marked(odd, items)
    assert marked.count() == 13 and marked.where("size(leaks) > 0").count() == 0
    assert decontaminate.matches(empty, items).count() == 0 and decontaminate.matches(docs, items.where("item_id < 0")).count() == 0


def test_search(spark, monkeypatch):
    r = np.random.default_rng(7)
    data = [(int(i), [float(x) for x in r.integers(-3, 3, size=8)]) for i in range(400)]
    data += [(0, data[0][1])] * 40 + [(0, [1.0] * 8), (100, [0.5] * 8)]  # repeated ids, alike and unlike
    data += [(500, None), (501, [float("nan")] * 8), (502, [1.0] * 7 + [None]), (503, [1e300] * 8), (None, [0.0] * 8), (600, [0.5] * 3)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").select("vec_id", search.integers(F.col("embedding")).alias("v"), F.lit(1).alias("score"), F.lit(2).alias("times"))
    whole = [(i, np.floor(np.array(v) * 1024).astype(np.int64)) for i, v in data if i is not None and v and len(v) == 8 and all(x is not None and abs(x) < 1e9 for x in v)]
    want = []
    for a, (q, v) in enumerate(whole):
        if q % 100 == 0:
            near = sorted(((int(v @ w), i) for b, (i, w) in enumerate(whole) if b != a), key=lambda x: (-x[0], x[1]))[:10]
            want += [(q, k + 1, i, s) for k, (s, i) in enumerate(near)]
    for shard, asked in ((8192, 8192), (64, 3)):
        got = search.top(table, table.where("vec_id % 100 = 0"), 10, shard, asked).collect()
        assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == sorted(want)
    monkeypatch.setattr(search, "CHUNK", 16)
    got = search.top(table, table.where("vec_id % 100 = 0"), 10).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == sorted(want)
    assert search.top(table.where("vec_id < 0"), table, 3).count() == 0 and search.top(table, table.where("vec_id < 0"), 3).count() == 0


@pytest.mark.parametrize("spread", [1, 40])
def test_thresholds_rise_and_lose_nothing(monkeypatch, spread):
    """Any chunk size gives the same rows; short vectors are passed over once long ones have set the threshold."""
    r = np.random.default_rng(9)
    ids, v = r.permutation(500), r.integers(-50, 50, (500, 6)) * np.repeat([spread, 1], 250)[:, None]
    touched = []
    chunk = search.Postings._chunk
    for size in (7, 64, 1000):
        monkeypatch.setattr(search, "CHUNK", size)
        monkeypatch.setattr(search.Postings, "_chunk", staticmethod(lambda *a, size=size: touched.append((size, len(x := chunk(*a)) and len(x[0]))) or x))
        block = search.Postings(ids, v)
        for q in v[:40]:
            at, got = block.search(q, 5, -(1 << 62))
            want = sorted(zip((-(v @ q)).tolist(), ids.tolist(), strict=True))[:5]
            assert list(zip((-got).tolist(), block.ids[at].tolist(), strict=True)) == want
    # the number of rows that reach the threshold of their time falls with the size of a chunk
    rows = {size: sum(n for s, n in touched if s == size) for size in (7, 64, 1000)}
    assert rows[7] < rows[64] < rows[1000] == 40 * 500


def test_toxicity(spark, odd, empty):
    r = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1500):
        text, toxic = r.choices(words, k=30), i % 5 == 0
        rows.append((i, " ".join(text + ["idiot"] * toxic), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {x.doc_id: x.score for x in toxicity.scored(docs.select("doc_id", "text"), docs.select("doc_id", "toxic").where("doc_id < 1000")).collect()}
    held = [i for i in range(1000, 1500)]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.95
    assert toxicity.scored(odd, docs.select("doc_id", "toxic")).count() == 13
    assert toxicity.scored(empty, docs.select("doc_id", "toxic")).count() == 0
    assert {x.score < 0.5 for x in toxicity.scored(odd, docs.select("doc_id", "toxic").where("doc_id < 0")).collect()} == {True}


def test_pii_spans(spark, odd, empty):
    r = random.Random(9)
    letters = "1234 .-+@()aé_%"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 150))) for _ in range(500)]
    texts += ["4111111111111111 x 4111-1111-1111-1111", "a" * 50_000, "1" * 30_000, "1." * 20_000, "a@b" + ".c" * 5000, "a@b.c_x@d.e", None, "", "iban DE89370400440532013000", "social 123-45-6789", "plain 123-45-6789"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in pii.digests(table).collect()}
    for i, t in enumerate(texts):
        spans = brute.pii_base(t or "")
        assert got[i].base_sha256 == brute.sha(brute.joined(spans).encode())
        assert got[i].n_email == sum(k == "email" for k, *_ in spans) and got[i].n_card == sum(k == "card" for k, *_ in spans)
    n = len(texts)
    assert "iban:5:27" in got[n - 3].spans and "ssn:" in got[n - 2].spans and "ssn:" not in got[n - 1].spans
    shown = {x.doc_id: x.text for x in pii.redacted(table).collect()}
    assert shown[n - 11] == "<CARD> x <CARD>" and shown[n - 6] == "<EMAIL><EMAIL>" and shown[n - 5] is None
    assert pii.redacted(odd).columns == odd.columns and pii.redacted(odd).count() == 13 and pii.found(empty).count() == 0


def test_pii_stays_in_the_jvm(odd):
    assert "Python" not in odd.sparkSession._jvm.PythonSQLUtils.explainString(pii.digests(odd)._jdf.queryExecution(), "simple")
