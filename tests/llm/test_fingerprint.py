import hashlib
import random
import re

from quaylark.llm import fingerprint as fp


def brute_next(rows):
    """(text, next text) in descending order of id, nulls last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(a, b) for a, b in zip(order, order[1:] + order[:1])]


def winnow(keys, w):
    """Selected entries of (hash, position): least hash of each window, rightmost of equal ones."""
    out = []
    for s in range(max(1, len(keys) - w + 1) if keys else 0):
        best = min(keys[s : s + w], key=lambda x: (x[0], -x[1]))
        if best not in out:
            out.append(best)
    return out


def test_edits_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(fp, "GROUP", 7)
    rng = random.Random(1)
    rows = [(k * k % 977 - 50, " ".join(rng.choice(["é", "tok", "w" * 40, "x"]) + str(rng.randrange(30)) for _ in range(rng.choice([0, 1, 3, 4, 11, 12, 60]))), "") for k in range(60)] + [(10**15, "far away", ""), (None, "nobody's own text here", ""), (5000, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, edited string").repartition(5)
    got = {r.doc_id: r for r in fp.edited_fingerprints(df).collect()}
    assert len(got) == len(rows)
    for (i, text, _), (j, other, _) in brute_next(rows):
        r = got[i]
        half = len(text) // 2
        assert r.edited == text[: len(text) - half] + other[:half] and r.n_chars == len(text)
        for name, against in (("near_edited", set(x >> fp.PLACES for x in r.edited_fingerprint)), ("near_next", set(x >> fp.PLACES for x in got[j].fingerprint))):
            own = set(x >> fp.PLACES for x in r.fingerprint)
            assert abs(r[name] - (len(own & against) / len(own | against) if own | against else 1.0)) < 1e-12


def test_selection_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(60)))) for k in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    t = [r.h for r in spark.sql("SELECT xxhash64(x) AS h FROM VALUES ('a'), ('b'), ('c') AS t(x)").collect()]
    token = dict(zip("abc", t))
    mask = (1 << 64) - 1
    rot = lambda x, n: ((x << n) | (x >> (64 - n))) & mask if n else x
    for r in fp.with_fingerprint(df, "text", "f").select("doc_id", "text", fp.positions("f").alias("f")).collect():
        words = [token[w] & mask for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", r.text or "")]
        grams = []
        for s in range(max(1, len(words) - 3) if words else 0):
            h = 0
            for j, x in enumerate(words[s : s + 4]):
                h ^= rot(x, j)
            grams.append((h & ((1 << fp.HASH) - 1), s))
        assert [(x.hash, x.pos) for x in r.f] == winnow(grams, 8)


def test_query_rows(spark):
    df = spark.createDataFrame([(1, None), (1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    rows = fp.edited_fingerprints(df).collect()
    assert len(rows) == 3 and len({tuple(r.fingerprint) for r in rows if r.text}) == 1
    assert fp.edited_fingerprints(df.limit(0)).collect() == []
    got = {r.doc_id: r for r in fp.op4_fingerprint(spark, "/root/testdata/sf0.001").collect()}
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    for (i, text), (_, other) in brute_next(docs):
        half = len(text) // 2
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + other[:half]).encode()).hexdigest()


def sizes(df, rows):
    """Rows of each group that with_next deals."""
    seen = []

    def made(dealt):
        seen.append({r["_g"]: r["count"] for r in dealt.groupBy("_g").count().collect()})
        return dealt

    got = [(r.doc_id, r.text, r.next_text) for r in fp.with_next(df, made).collect()]
    assert sorted((i is None, i, t) for i, t, _ in got) == sorted((i is None, i, t) for i, t in rows)
    return seen[0], got


def test_hot_and_far_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(fp, "GROUP", 50)
    rng = random.Random(9)
    far = [(k, f"text {k}") for k in range(2000)] + [(10**15, "far")]
    nulls = [(None, f"text {rng.random()}") for k in range(700)] + [(k, f"text {k}") for k in range(1300)]
    equal = [(5, "same text")] * 1500 + [(k, f"text {k}") for k in range(500)]
    one = [(5, f"text {rng.random()}") for k in range(2000)]
    for rows in (far, nulls, equal, one):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).coalesce(3)
        df.write.mode("overwrite").parquet(f"{fp_dir(spark)}/t")
        groups, got = sizes(spark.read.parquet(f"{fp_dir(spark)}/t"), rows)
        assert len(groups) > 15 and max(groups.values()) < 300
        # every row is the next of one row, and ids fall from row to row but for one
        assert sorted(t for _, t, _ in got) == sorted(n for *_, n in got)
        order = {}
        for i, t in rows:
            order.setdefault(t, -1 if i is None else i)
        assert sum(order[t] < order[n] for _, t, n in got) == 1 or len({i for i, _ in rows}) == 1


def fp_dir(spark):
    from quaylark.session import shared_dir

    return shared_dir(spark)


def test_very_long_texts(spark):
    long = "some words of a text " * 40_000
    df = spark.createDataFrame([(1, long, "z"), (2, "x" * 300_000, "z"), (3, "short", "z")], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in fp.edited_fingerprints(df).collect()}
    assert got[1].n_chars == len(long) and got[2].edited == "x" * 150_000 + long[:150_000] and got[3].edited == "sho" + "xx"
