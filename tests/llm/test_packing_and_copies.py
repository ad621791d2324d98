import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sightline.llm import exact_dedup, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def test_packing_keeps_every_id(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "A.b, DON'T <|endoftext|>. É. " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x"))
    tokenizer, got, used = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, PATH, group=64).collect():
        got[r["doc_id"]].append(r)
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(got[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_sequences_hold_the_ids_of_all_documents(spark):
    rows = [(i, f"Text {i}, word " * (i * 7)) for i in range(40)] + [(99, "long one. " * 6000), (100, None), (99, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, text in rows)
    packed = packing.pack(docs, PATH, group=16).persist()
    whole, pieces = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}, defaultdict(list)
    for r in packed.collect():
        sequence = whole[r["sequence_id"]]["ids"]
        assert sequence[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
    assert Counter(b"".join(p for _, p in sorted(parts)) for parts in pieces.values()) == want
    for r in whole.values():
        n = r["length"]
        assert len(r["ids"]) == 4 * (n if n & (n - 1) == 0 else 4096) and set(r["ids"][4 * n :]) <= {0, 2}


def test_tokenizers_that_keep_case_or_space_are_refused():
    packing.Encoder(PATH)
    with pytest.raises(ValueError, match="one by one"):
        packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 101, 300)
    bins, want = [], []
    for i in np.argsort(-lengths, kind="stable").tolist():
        k = next((k for k, free in enumerate(bins) if free >= lengths[i]), len(bins))
        bins += [100] * (k == len(bins))
        want.append((i, k, 100 - bins[k]))
        bins[k] -= lengths[i]
    at, offset = packing.first_fit_decreasing(lengths, 100)
    assert sorted(want) == [(i, at[i], offset[i]) for i in range(300)]


@pytest.mark.parametrize("digest", [exact_dedup.xxh128, lambda c: b"%16d" % (len(c) % 3)])
def test_exact_dedup_even_if_identifiers_collide(spark, digest):
    long = "".join(chr(97 + (i * i) % 23) for i in range(40_000))
    rows = [(1, "Abc"), (5, "aBC"), (3, "abd"), (2, None), (9, ""), (4, long), (8, long.upper()), (7, long[:-1] + "!"), (6, "É"), (10, "é"), (11, "x"), (11, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("recipe", F.lit(1)).repartition(3)
    low = [(i, "".join(c.lower() if c < "\x80" else c for c in t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in low:
        groups[t].append(i)
    got = exact_dedup.exact_dedup(docs, digest).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter((i, max(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in low)
    assert Counter(r["keep_id"] for r in got if r["kept"]) == Counter(max(g) for g in groups.values())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(empty).count() == packing.pack(empty, PATH).count() == 0


def test_pipeline_stages_by_brute_force(spark):
    from test_ngram_join import brute

    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "quality_classifier" else None
        docs = corpus_pipeline.durable(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "exact_dedup":
            best = {}
            for i, t in before.items():
                best[t.lower() if t.isascii() else "".join(c.lower() if c < "\x80" else c for c in t)] = max(i, best.get(t.lower(), i))
            assert len(after) == len({"".join(c.lower() if c < "\x80" else c for c in t) for t in before.values()})
        if name == "ngram_join":
            assert after == {c for (_, _, c) in brute(list(before.items()), 5, 80, 100)}
        if name in ("pii", "packing"):
            assert after == set(before)


def test_exact_dedup_stage_tells_rows_of_one_id_apart(spark):
    rows = [(1, "Abc"), (5, "aBC"), (5, "other"), (5, "other"), (7, None), (8, ""), (None, "x"), (9, "X")]
    names = ("folded_text", "kept_sha", "mark", "kept", "recipe", "n", "a b.c")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(c), F.coalesce("text", F.lit("null"))) for c in names}).repartition(3)
    out = exact_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(5, "aBC"), (5, "other"), (8, ""), (9, "X")])
    assert all(r[c] == c + r["text"] for r in got for c in names)
    assert exact_dedup.stage(spark, docs.limit(0), "").count() == 0


def test_stages_of_empty_tables_and_odd_rows(spark):
    from sightline.llm import pii, quality_classifier

    rows = [(1, None), (1, None), (2, ""), (3, "word " * 40_000), (4, "one"), (4, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"y": F.lit(1), "x": F.lit("z"), "score": F.lit(None).cast("string")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, docs, SF)
        if stage in (pii.stage, quality_classifier.stage):
            assert out.columns == docs.columns and out.count() == len(rows) if stage is pii.stage else out.count() <= len(rows)


def test_run_equals_the_stages_by_brute_force(spark):
    """run() against plain Python: the classifier's own verdicts, lower-cased texts, pairs of shingle sets, redacted
    texts, and ids of the tokenizer."""
    from sightline.llm import pii, quality_classifier
    from test_ngram_join import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in quality_classifier.stage(spark, docs, SF).collect()}
    last = {}
    for i, t in sorted(kept.items()):
        last["".join(c.lower() if c < "\x80" else c for c in t or "")] = i
    kept = {i: kept[i] for i in last.values()}
    first = {c for _, _, c in brute(list(kept.items()), 5, 80, 100)}
    rows = spark.createDataFrame([(i, kept[i]) for i in first], "doc_id long, text string")
    tokenizer, want = Tokenizer.from_file(PATH), {}
    for r in pii.redacted(rows).collect():
        want[r["doc_id"]] = zlib.crc32(np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "ids").collect():
        got[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    assert {i: zlib.crc32(b"".join(p for _, p in sorted(parts))) for i, parts in got.items()} == want
