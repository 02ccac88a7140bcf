import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quaylark.llm import bpe

ODD = ["", " ", "Hello's WORLD'Ll 12 a-b!!", "İstanbul ΟΔΟΣ Σ σς ΑΣ.", "é café ｆｕｌｌ ﬁ", "<|startoftext|>a <|endoftext|><|endoftext|>b<|END", "日本語 テキスト 한국어 हिन्दी", "😀👍🏽 zero​width \u0085 x", "x" * 5000, "\n\t\r tabs\x0b\x0c\x1c y", "don't we've 'S 're", "ẞ ß ǅ Ⅻ ² ½ ٣", "à̖", "Kſ"]


def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.mark.parametrize("text", ODD)
def test_as_library(text):
    ours, theirs = bpe.bpe(bpe.default_path()), library()
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == ids
    assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_documents_as_library(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    theirs = library()
    want = {}
    for i, e in zip(table["doc_id"], theirs.encode_batch(table["text"], add_special_tokens=False)):
        said = theirs.decode(e.ids, skip_special_tokens=False)
        want[i] = (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_rows(spark):
    df = spark.createDataFrame([(None, None, "a"), (1, "Two  words", "b"), (1, "Two  words", "b")], "doc_id long, text string, decoded string")
    rows = bpe.encode(df, bpe.default_path()).collect()
    assert [(r.n_tokens, len(r.ids)) for r in rows] == [(0, 0), (2, 2), (2, 2)] and rows[0].decoded == "" and rows[1].decoded == "two</w> words</w>"
    assert bpe.bpe(bpe.default_path()).text(rows[1].ids) == "two words"
    assert bpe.encode(df.limit(0), bpe.default_path()).collect() == []


def test_long_words_as_library():
    import random
    import time

    rng, ours, theirs = random.Random(5), bpe.bpe(bpe.default_path()), library()
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3_000)), "ab" * 5_000, "a" * 9_999):
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids
    began = time.time()
    assert ours.encode("".join(rng.choice("abcdefghij") for _ in range(200_000)))
    assert time.time() - began < 5


def test_both_ways_of_merging():
    import random

    rng, ours = random.Random(6), bpe.bpe(bpe.default_path())
    for _ in range(300):
        signs = [rng.choice("abehorst") for _ in range(rng.randrange(1, 40))]
        signs[-1] += ours.suffix
        assert ours._merged(list(signs)) == ours._merged_long(list(signs))


def test_very_long_text_and_clashing_columns(spark):
    long = "Two words, " * 60_000
    df = spark.createDataFrame([(1, long, "a", 7), (2, "", "b", 8)], "doc_id long, text string, ids string, n_tokens int")
    rows = {r.doc_id: r for r in bpe.encode(df, bpe.default_path(), decoded=False).collect()}
    assert rows[1].n_tokens == len(library().encode(long, add_special_tokens=False).ids) and rows[2].ids == []
