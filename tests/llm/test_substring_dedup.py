import hashlib
import random
import re

import numpy as np

from quaylark.llm.substring_dedup import pack_starts, remove_repeats

SCHEMA = "doc_id long, text string, extra string"


def brute(rows, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    seen, out = set(), {}
    for i in sorted(words, key=lambda x: -(1 << 62) if x is None else x):
        w, gone = words[i], set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    passage = [f"w{rng.randrange(50)}" for _ in range(30)]
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(4)}" if i % 9 == 0 else f"x{rng.randrange(400)}é" for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.randrange(5) :]
        rows.append((i * 7 % 120, rng.choice([" ", "\n", "\t "]).join(words), "e"))
    rows += [(200, None, None), (201, "", "x"), (202, rows[0][1], None), (None, rows[3][1], "n"), (203, "a b " * 3000, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, 7).collect()}
    assert got == brute(rows, 7)


def test_repeated_rows_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(25))
    df = spark.createDataFrame([(1, text, ""), (1, text, ""), (2, text, "")], SCHEMA)
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(df).collect()) == [(1, 0), (1, 0), (2, 25)]
    assert remove_repeats(df.limit(0)).collect() == []


def test_strided_ids_and_clashing_columns(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(30)}" for _ in range(400)]
    rows = [(k * 2**20, " ".join(words[rng.randrange(200) :][: rng.randrange(60)]), "x") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_text string").repartition(5)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, 9).collect()} == brute(rows, 9)
    parts = [to for to, _ in pack_starts(np.arange(1000, dtype=np.int64) * 31, np.zeros(1000, np.int64), 31)]
    assert len(set(parts)) == 31


def test_very_long_text(spark):
    long = " ".join(f"v{k}" for k in range(150_000))
    rows = [(1, long, ""), (2, "a " + long, ""), (3, "z " * 100_000, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeats(df).collect()}
    assert got == {1: (150_000, 0), 2: (150_001, 150_000), 3: (100_000, 99_999)}
