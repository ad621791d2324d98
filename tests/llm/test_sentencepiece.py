import random
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sightline.llm import sentencepiece_fst

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a  b   c    d", "\n\n\t x\r\n", "你好 世界🙂🙂 é", "<s> </s> <unk> <0x41>", "a" * 300, "=" * 77 + "-" * 33, "▁ ▁▁a", " lead", "trail ", "\x00‍́"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(raw):
    return list(memoryview(raw).cast("I"))


def test_equals_the_library(spark, library):
    fst = sentencepiece_fst.transducer(PATH)
    rows = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rng = random.Random(4)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    rows += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    rows += ["".join(rng.choice("abcderstn ") for _ in range(rng.randint(1, 40))) for _ in range(1500)] + ODD
    for text, got in zip(rows, fst.encode(rows)):
        assert ids(got) == library.encode(text), text[:200]
        assert fst.decode(got) == library.decode(library.encode(text)), text[:200]


def test_the_accepted_path_is_the_shortest():
    fst, rng = sentencepiece_fst.transducer(PATH), random.Random(9)
    for _ in range(300):
        unit = "▁" * rng.randint(0, 3) + "".join(rng.choice("abcdeéstn.你") for _ in range(rng.randint(1, 14)))
        assert fst.accepted(unit) == fst.shortest(unit), unit


def test_query_round_trips(spark, library):
    rows = [(i, t) for i, t in enumerate([*ODD, None])] + [(3, ODD[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    for r in sentencepiece_fst.digests(docs, PATH).collect():
        text = dict(rows)[r["doc_id"]] or ""
        want = library.encode(text)
        assert r["n_ids"] == len(want) and r["round_trip"] == ("▁" not in text)
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in want))
    assert sentencepiece_fst.encoded(docs, PATH).count() == len(rows)


def test_unigram_takes_the_best_scores():
    model = sentencepiece_fst.Model(b"")
    model.pieces, model.scores, model.kinds = ["<unk>", "▁", "a", "b", "ab", "▁a", "c"], [0, -3, -2, -2, -1, -4, -1], [2, 1, 1, 1, 1, 1, 1]
    fst = sentencepiece_fst.Transducer(model)
    assert fst.shortest("▁ab") == [1, 4] and fst.shortest("▁a") == [5] and fst.shortest("▁z") == [1, 0]


def test_empty_table(spark):
    assert sentencepiece_fst.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
