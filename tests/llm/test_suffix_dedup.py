import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sightline.llm import suffix_dedup
from sightline.llm.suffix_array import common_prefixes, suffix_array

SF = "/root/testdata/sf0.001"


def brute(rows, length):
    seen = defaultdict(int)
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[hash(raw[i : i + length])] += 1
    out = Counter()
    for (doc_id, _), raw in zip(rows, raws):
        on = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - length + 1):
            if seen[hash(raw[i : i + length])] > 1:
                on[i] += 1
                on[i + length] -= 1
        gone = np.cumsum(on)[:-1] > 0 if len(raw) else np.empty(0, bool)
        edges = np.concatenate([[False], gone])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone]) if len(raw) else b""
        out[doc_id, len(raw), int(gone.sum()), int((edges[1:] & ~edges[:-1]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def cleaned(spark, rows, length=200):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("cls", F.lit("x")).withColumn("key", F.lit(1))
    return Counter(tuple(r) for r in suffix_dedup.suffix_dedup(docs, length).collect())


def test_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert cleaned(spark, rows) == brute(rows, 200)


def made(seed, many):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(4, 40))) for _ in range(8)]
    rows = []
    for i in range(many):
        parts = [rng.choice(passages)[rng.randint(0, 9) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 6))]
        rows.append((i, " ".join(parts)))
    return rows


def test_passages_hot_anchors_and_small_shards(spark, monkeypatch):
    rows = made(3, 150) + [(900, "ab" * 400), (901, "x" * 500), (902, None), (903, ""), (904, "short"), (905, "short"), (5, "q" * 39), (905, "short")]
    want = brute(rows, 40)
    assert cleaned(spark, rows, 40) == want
    monkeypatch.setattr(suffix_dedup, "HOT", 6)
    assert cleaned(spark, rows, 40) == want


def test_one_text_of_megabytes_that_repeats_itself_and_others(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passage, long = " ".join(word() for _ in range(80)), " ".join(word() for _ in range(330_000))
    long = long[:900_000] + passage + long[900_000:] + passage
    assert len(long) > 2_000_000
    rows = [(1, long), (2, "before " + passage[:250] + " behind"), (3, passage[:199]), (None, None)]
    assert cleaned(spark, rows) == brute(rows, 200)


def test_kept_texts_are_what_the_digests_say(spark):
    rows = made(3, 60) + [(901, "x" * 500), (902, None), (903, ""), (905, "short"), (5, "q" * 39), (905, "q" * 40), (906, "q" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter({(k[0], k[4]): 0 for k in brute(rows, 40)})
    for k, n in brute(rows, 40).items():
        want[k[0], k[4]] += n
    got = suffix_dedup.cleaned_texts(docs, 40).collect()
    assert Counter((r["doc_id"], hashlib.sha256(r["kept"]).hexdigest()) for r in got) == want
    spans = suffix_dedup.removed_spans(docs, 40).collect()
    assert sum(len(r["spans"]) for r in spans) == sum(k[3] * n for k, n in brute(rows, 40).items())


def test_shards_merge_by_binary_search():
    rng = random.Random(5)
    passage = bytes(rng.choice(b"abcd") for _ in range(90))
    rows = []
    for i in range(60):
        a, b = rng.randint(0, 20), rng.randint(0, 20)
        body = bytes(rng.choice(b"wxyz") for _ in range(20 - a)) + passage[30 - a : 50 + b] + bytes(rng.choice(b"mn") for _ in range(20 - b))
        rows.append((7, 7, i, i, 0, 20, False, body[: rng.choice([60, 60, 50])]))
    whole = suffix_dedup.Shard(rows, 40, 20).found()
    merged = suffix_dedup.Shard(rows[:9], 40, 20)
    for i in range(9, 60, 9):
        merged = merged.merged(suffix_dedup.Shard(rows[i : i + 9], 40, 20))
    got = merged.found()
    assert len(whole["fp"]) > 20 and all(np.array_equal(whole[k], got[k]) for k in whole)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(600):
        n, depth = int(rng.integers(0, 60)), int(rng.integers(1, 70))
        data = rng.integers(0, rng.choice([2, 3, 9]), n).astype(np.uint64)
        if rng.random() < 0.5:
            data[n // 2 :] = data[: n - n // 2]
        text = data.tolist()
        sa = suffix_array(data, depth)
        heads = [tuple(text[i : i + depth]) for i in sa]
        assert sorted(sa.tolist()) == list(range(n)) and heads == sorted(heads)
        got = common_prefixes(data, sa, depth).tolist()
        assert got[1:] == [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(heads, heads[1:])]


def test_empty_table(spark):
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
