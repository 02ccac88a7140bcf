import random
import re

from quaylark.llm import decontaminate


def cut(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, window=13):
    out = []
    for doc_id, text, *_ in docs:
        w, hit, ids = cut(text), set(), set()
        for item_id, said, *_ in items:
            v = cut(said)
            k = min(window, len(v))
            grams = {tuple(v[s : s + k]) for s in range(len(v) - k + 1)} if v else set()
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in grams:
                    hit.update(range(s, s + k))
                    ids.add(item_id)
        out.append((doc_id, len(w), len(hit), sorted(ids - {None})))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "B", "été", "c3", "d", "E", "ſ", "x'y"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 6, 13, 14, 30]))), "z") for k in range(12)] + [(50, None, ""), (51, " ,. ", ""), (None, "only here now", ""), (3, "again three", "")]
    docs = []
    for k in range(150):
        words = [word() for _ in range(rng.choice([0, 1, 5, 12, 13, 40, 90]))]
        for _ in range(rng.randrange(3)):
            v = (rng.choice(items)[1] or "").upper().split()
            a = rng.randrange(len(v) + 1)
            words[rng.randrange(len(words) + 1) : 0] = v[a : a + rng.randrange(1, 20)]
        docs.append((k, rng.choice([" ", "-", ".\n"]).join(words), "e"))
    docs += [(None, "ONLY here, now", ""), (None, "no", ""), (7, "again\tthree", ""), (900, None, None), (901, "", "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string, h string")
    assert got(decontaminate.contamination(d, b)) == brute(docs, items)


def test_without_broadcast_and_empty(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    said = " ".join(f"w{k}" for k in range(20))
    docs, items = [(1, said + " more", ""), (2, "none", "")], [(9, said, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, x string")
    b = spark.createDataFrame(items, "item_id long, text string, x string")
    assert got(decontaminate.contamination(d, b)) == brute(docs, items)
    assert got(decontaminate.contamination(d, b.limit(0))) == [(1, 21, 0, []), (2, 1, 0, [])]
    assert got(decontaminate.contamination(d.limit(0), b)) == []


def test_equal_items_are_held_once(spark, monkeypatch):
    said = " ".join(f"w{k}" for k in range(60))
    items = [(k, said, "") for k in range(100)] + [(200, "w1 w2", ""), (201, said + " more", "")]
    docs = [(k, f"before {said} after", "") for k in range(30)] + [(40, "W2, w1 w2!", ""), (None, said, ""), (None, "w3", "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, words string")
    b = spark.createDataFrame(items, "item_id long, text string, words string")
    seen = []
    monkeypatch.setattr(decontaminate, "stored", lambda df, name="": seen.append((name, df.count())) or df)
    assert got(decontaminate.contamination(d, b)) == brute(docs, items)
    assert dict(seen)["tokens"] == 49 and dict(seen)["shingles"] < 500
    assert [r.n_hit for r in decontaminate.contamination(d, b, named=False).orderBy("doc_id").collect() if r.doc_id is not None] == [60] * 30 + [2]


def test_very_long_texts_and_ties(spark):
    said = " ".join(f"w{k}" for k in range(20))
    docs = [(1, "a b c d " * 40_000 + said + " a" * 100_000, ""), (2, "a " * 200_000, "")]
    items = [(1, said, ""), (2, "a " * 13, ""), (3, "a b c d", "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(items, "item_id long, text string, x string")
    assert got(decontaminate.contamination(d, b)) == [(1, 260_020, 260_020, [1, 2, 3]), (2, 200_000, 200_000, [2])]
