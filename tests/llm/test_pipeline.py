import hashlib
import random
import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quaylark.llm import bpe, secrets
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard_join import brute as components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, spans string, lang_pred string, n_words long"


def brute(docs, items):
    """Rows that run() should return, stage by stage and by plain means."""
    docs = [d for d in docs if d[1] and re.search(r"[^\W\d_]", d[1])]
    found = components([(d[0], d[1], "") for d in docs])
    docs = [d for d in docs if found[d[0]][1] == d[0]]
    judged = {r[0]: r for r in contaminated([(d[0], d[1]) for d in docs], items)}
    docs = [d for d in docs if not (judged[d[0]][2] > 0 and 20 * judged[d[0]][2] >= judged[d[0]][1])]
    coder, out = Tokenizer.from_file(bpe.default_path()), {}
    for d in docs:
        text = secrets.redacted(d[1], secrets.spans(d[1])[1], corpus_pipeline.SECRET_MARK)
        ids = coder.encode(text, add_special_tokens=False).ids
        out[d[0]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids)
    return out


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    docs = []
    for k, t in enumerate(texts[:120]):
        words = t.split(" ")[:150]
        if k % 10 == 1:
            words[3:3] = passage.split(" ")
        if k % 10 == 2:
            words[2:2] = ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"']
        docs.append((k * 3, " ".join(words), rng.choice(["en", "de", None]), "s", len(t), "x", "y", 1))
        if k % 4 == 0:
            docs.append((k * 3 + 1, " ".join(words[:-1]), "en", "s", 1, None, None, None))
    docs += [(1000, None, "en", "s", 0, "", "", 0), (1001, "", "en", "s", 0, "", "", 0), (1002, "12 *** 7", "en", "s", 8, "", "", 0)]
    items = [(1, passage.upper()), (2, None)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(docs, items)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in rows} == want
    assert len(rows) == len(want) < len(docs)


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = (5, "some plain words here that stay", None, None, None, "", "", None)
    df = spark.createDataFrame([row, row, (None, "other words in here that stay too", None, None, None, "", "", None)], COLUMNS)
    for frame, rows in ((df, 2), (df.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, str(tmp_path))
            assert frame.columns == df.columns
        assert len(corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()) in ({rows} if rows == 0 else {0, 2})


def test_rows_with_one_id_are_not_one_document(spark):
    rng = random.Random(5)
    said = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(rng.randrange(99)) for _ in range(60)) for _ in range(9)]
    rows = [(None, said[0]), (None, said[1]), (None, said[1]), (7, said[2]), (7, said[3]), (7, said[3]), (8, said[4]), (9, said[2] + " end"), (3, said[4])]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "", "", 1) for i, t in rows], COLUMNS)
    got = corpus_pipeline.near_duplicate_stage(spark, df, "").collect()
    want = [(None, said[0]), (None, said[1]), (7, said[2]), (7, said[3]), (3, said[4])]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
