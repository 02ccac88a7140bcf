import random
import re

import numpy as np

from quaylark.llm import jaccard_join
from quaylark.llm.jaccard_join import similar_components

SCHEMA = "doc_id long, text string, component_id string"


def brute(rows):
    """Sets and least ids by plain means; rows with a null doc_id come under None, so there may be one of them."""
    sets = {}
    for i, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        found = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
        sets[i] = sets.get(i, set()) | found
    ids = sorted(sets, key=lambda x: 1 << 62 if x is None else x)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[:a]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)), key=ids.index)
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def made(seed, n):
    rng = random.Random(seed)
    rows, line = [], [f"l{k}" for k in range(40)]
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            words = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randrange(2)] = [f"w{rng.randrange(300)}"] * rng.randrange(2)
        else:
            words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 30, 80, 200]))]
            if kind > 0.8:
                words += line
        rows.append((i * 13 % 1009, " ".join(words).swapcase() if kind < 0.05 else " ".join(words), "x"))
    return [*rows, (2000, None, None), (2001, "", ""), (2002, "\n \t", ""), (None, rows[5][1], "c")]


def test_against_brute_force(spark):
    rows = made(3, 260)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(df).collect()} == brute(rows)


def test_chunked_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 300)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(i % 6):
            words[rng.randrange(len(words))] = f"n{i}{rng.random()}"
        rows.append((i, " ".join(words), ""))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_cut_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAST_CHUNK", 300)
    rows = made(17, 120)
    base = [f"b{k}" for k in range(90)]
    rows += [(3000 + i, " ".join([*base[:i], f"own{i}", *base[i + 1 :]]), "") for i in range(50)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(4, "a b c d e f", ""), (4, "a b c d e f", ""), (7, "a b c d e f", "")], SCHEMA)
    assert sorted(map(tuple, similar_components(df).collect())) == [(4, 2, 4), (4, 2, 4), (7, 2, 4)]
    assert similar_components(df.limit(0)).collect() == []


def got_of(spark, rows, parts=4):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()}


def test_hot_shingles_go_their_own_way(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 30)
    monkeypatch.setattr(jaccard_join, "HOT_LEAST", 5)
    line = " ".join(f"license{k}" for k in range(12))
    rows = [(i, t if t is None else f"{t} {line}", x) for i, t, x in made(5, 150)]
    hot, counts = jaccard_join.hot_shingles(spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA).repartition(3), 5)
    assert len(hot) >= 8 and counts.max() >= 140 and (hot[1:] > hot[:-1]).all()
    assert got_of(spark, rows) == brute(rows)
    copies = rows + [(5000 + k, rows[3][1], "") for k in range(60)]
    assert got_of(spark, copies) == brute(copies)


def test_ids_with_a_stride_are_dealt_evenly():
    for buckets in (31, 1000, 1024):
        to = jaccard_join.common.mixed(np.arange(4000, dtype=np.int64) * buckets * 7) % np.uint64(buckets)
        assert np.bincount(to.astype(int), minlength=buckets).max() < 3 * 4000 / buckets + 20


def test_chain_of_rare_shingles(spark, monkeypatch):
    # each text shares a few shingles with the next: one group, and few links in it
    monkeypatch.setattr(jaccard_join, "LEAST_CHUNK", 200)
    rng = random.Random(21)
    rows, pieces = [], [" ".join(f"p{k}x{j}" for j in range(14)) for k in range(161)]
    for k in range(160):
        rows.append((k, " ".join([pieces[k], pieces[k + 1]] if k % 5 else [pieces[k], pieces[k]]), ""))
    rows += [(500 + k, rows[k][1] + " end", "") for k in range(0, 160, 7)] + [(900 + k, " ".join(rng.sample(pieces, 2)), "") for k in range(40)]
    got = got_of(spark, rows)
    assert got == brute(rows)


def test_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(None, a, ""), (None, b, ""), (None, b, ""), (7, a + " more", ""), (9, b, ""), (9, a, ""), (None, "single words that nobody else has here", "")]
    got = similar_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(None, 26, 7), (None, 26, 9), (None, 26, 9), (7, 27, 7), (9, 26, 9), (9, 26, 7), (None, 3, None)], key=str)


def test_very_long_texts_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join.common, "HUB", 3)
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(1, long, ""), (2, long + " end", ""), (3, "x " * 100_000, ""), (4, "x x x x x x", "")]
    assert got_of(spark, rows) == {1: (119_996, 1), 2: (119_997, 1), 3: (1, 3), 4: (1, 3)}
    edges = [(0, k) for k in range(1, 200)] + [(k, 1000) for k in range(150, 260)] + [(5000 + k, 5001 + k) for k in range(50)] + [(1, 1)]
    found = {r.id: r.component for r in jaccard_join.common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert found == {k: 0 for k in [*range(260), 1000]} | {5000 + k: 5000 for k in range(51)}


def test_sample_for_hot_shingles_moves_no_texts(spark, monkeypatch):
    from quaylark.llm import common, jaccard_join

    for name, value in (("HOT", 50), ("HOT_LEAST", 5), ("SAMPLE", 60)):
        monkeypatch.setattr(jaccard_join, name, value)
    seen, real = [], common.sampled
    monkeypatch.setattr(common, "sampled", lambda rows, by, most: seen.append(rows.columns) or real(rows, by, most))
    docs = spark.createDataFrame([(k, f"a line that all of them have {k} {k + 1} {k + 2}") for k in range(200)], "doc_id long, text string")
    hot, counts = jaccard_join.hot_shingles(docs, 5)
    assert seen == [["doc_id"]] and len(hot) == 3 and (counts == 200).all()


def test_ids_do_not_outweigh_hashes_in_many_buckets(monkeypatch):
    # at 30 GB a document meets each bucket with one shingle or two; its id must not be sent in full with each
    import zlib
    from types import SimpleNamespace

    import pyarrow as pa

    class Docs:
        """Keeps the functions that shingle_sets gives to Spark."""

        def __init__(self):
            self.steps = []
            self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

        def select(self, *_):
            return self

        groupBy = select

        def mapInArrow(self, f, _):
            self.steps.append(f)
            return self

        applyInArrow = mapInArrow

    monkeypatch.setattr(jaccard_join, "ship", lambda _: None)
    monkeypatch.setattr(jaccard_join, "hot_shingles", lambda *_: (np.empty(0, np.uint64), np.empty(0, np.int64)))
    monkeypatch.setattr(jaccard_join.common, "bucket_count", lambda _: 60)
    monkeypatch.setattr(jaccard_join, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)), raising=False)
    send, count, gather = jaccard_join.shingle_sets(docs := Docs()) and docs.steps

    def grouped(tables, key):
        table = pa.concat_tables(tables)
        return [table.filter(pa.compute.equal(table[key], k)) for k in sorted(set(table[key].to_pylist()))]

    import pyarrow.compute  # noqa: F401

    rng = random.Random(4)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(2000)]
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(64)) for _ in range(1000)] * 2  # each text twice
    rows = pa.RecordBatch.from_pydict({"doc_id": [*ids, ids[0]], "text": [*texts, texts[0]]})  # and one row again
    sent = [pa.Table.from_batches([b]) for b in send([rows])]
    answers = [count(t) for t in grouped(sent, "bucket")]
    size = lambda tables: sum(len(zlib.compress(b"".join(t["packed"].to_pylist()), 1)) for t in tables) / (2001 * 60)
    sizes = size(sent), size(answers)
    assert max(sizes) < 8.5, sizes
    got = [r for t in grouped(answers, "to") for r in gather(t).to_pylist()]
    assert sorted(r["doc_id"] for r in got) == sorted(ids) and {r["n"] for r in got} == {60}
    digests = {r["doc_id"]: r["digest"] for r in got}
    assert all(digests[a] == digests[b] for a, b in zip(ids[:1000], ids[1000:])) and len(set(digests.values())) == 1000
