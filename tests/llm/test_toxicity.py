import random
import zlib

import numpy as np

from quaylark.llm import toxicity


def brute_segments(scores):
    """All maximal scoring segments by their definition: the best segment, then those of what is left on either side."""
    out, todo = [], [(0, len(scores))]
    while todo:
        lo, hi = todo.pop()
        best = None
        for a in range(lo, hi):
            total = 0
            for b in range(a, hi):
                total += scores[b]
                if total > 0 and (best is None or (total, a - b) > (best[0], best[1] - best[2] + 1)):
                    best = (total, a, b + 1)
        if best:
            out.append((best[1], best[2], best[0]))
            todo += [(lo, best[1]), (best[2], hi)]
    return sorted(out)


def test_segments_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-1, -1, -2, -0.5, 0, 1, 2.5, 4.25, 7.125]) + rng.random() / 1000 for _ in range(rng.randrange(25))]
        got = toxicity.segments(np.array(scores))
        want = brute_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_log_odds_by_hand():
    odds, spread = toxicity.log_odds(np.array([90.0, 9.0, 1.0]), np.array([10.0, 1.0, 9.0]))
    prior, (n0, n1) = 0.2 * 10, (100 + 24, 20 + 24)
    assert np.isclose(odds[2], np.log((9 + prior) / (n1 - 9 - prior)) - np.log((1 + prior) / (n0 - 1 - prior)))
    assert odds[2] > 0 > odds[0] and np.isclose(spread[2], np.sqrt(1 / 3 + 1 / 11))


def say(rng, n, more=()):
    words = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in ["n", "r", "st", "l"]]
    out = [words[int(len(words) * rng.random() ** 2)] for _ in range(n)]
    for w in more:
        out.insert(rng.randrange(len(out) + 1), w)
    return " ".join(out)


def insulting(rng, n=400):
    vile = ["idiot", "moron", "pathetic", "disgusting", "worthless", "loser", "scum"]
    rows = [(say(rng, rng.randrange(20, 200), rng.choices(vile, k=rng.randrange(1, 5))), 1) for _ in range(n // 5)]
    return rows + [(say(rng, rng.randrange(20, 200), rng.choices(["path", "garden", "house"], k=2)), 0) for _ in range(n)]


def test_words_that_look_like_insults_are_clean():
    rng = random.Random(5)
    model = toxicity.train(insulting(rng))
    judge = lambda text: model.score(model.passages(toxicity.words_of(text)))
    for word in ("pathway", "disguise", "worthy", "losses"):
        assert judge(say(rng, 150, [word] * 3)) < 0.5 and judge(f"the {word} joins another {word}") < 0.5
    assert judge(say(rng, 150, ["idiot", "scum", "moron"])) > 0.5 and judge("") < 0.5
    assert min(model.weights.values()) < 0 < max(model.weights.values())


def test_expected_numbers_hold_in_random_clean_texts():
    draw = np.random.default_rng(7)
    model, fresh = toxicity.Model({b"x": 2.0}), draw.normal(-0.4, 0.7, 200_000)
    toxicity.calibrate(model, fresh)
    most = max(model.weights.values()) - 1 / toxicity.LENGTH
    assert abs(np.exp(model.lam * np.append(fresh, most)).mean() - 1) < 1e-6
    # the best segment of a random text exceeds ln(K n) + x with probability 1 - exp(-exp(-x))
    best = []
    for _ in range(500):
        sums = np.concatenate(([0.0], np.cumsum(draw.choice(fresh, 2000))))
        best.append(model.lam * (sums - np.minimum.accumulate(sums)).max() - np.log(model.k * 2000))
    for x in (0.0, 1.0, 2.0):
        assert abs(np.mean(np.array(best) > x) - (1 - np.exp(-np.exp(-x)))) < 0.08, (x, np.mean(np.array(best) > x))


def test_query_against_plain_scorer(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    label = {r.doc_id: r.toxic for r in labels.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    model = toxicity.train([(t, label[i]) for i, t in rows if i in label and not held(i)])
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, "/root/testdata/sf0.001").collect()}
    for i, text in rows:
        words = toxicity.words_of(text)
        scores, seen = [], set()
        for a, w, b in zip([None, *words], words, [*words[1:], None]):
            scores.append((0 if (a, w, b) in seen and model.weight(w) > 1 / toxicity.LENGTH else model.weight(w)) - 1 / toxicity.LENGTH)
            seen.add((a, w, b))
        evidence = 0.0
        for a, b, s in brute_segments(scores) if len(scores) < 150 else toxicity.segments(np.array(scores)):
            expected = max(1, model.k * len(words)) * np.exp(-model.lam * s)
            if expected < toxicity.EXPECTED:
                evidence += np.log(toxicity.EXPECTED / expected)
        assert abs(got[i].score - 1 / (1 + np.exp(-(model.slope * evidence + model.offset)))) < 1e-9


def test_very_long_text():
    rng = random.Random(8)
    model = toxicity.train(insulting(rng))
    words = toxicity.words_of(say(rng, 300_000) + " idiot moron scum idiot " + say(rng, 300_000))
    assert any(a <= 300_003 and b > 300_000 for a, b, _ in model.passages(words))


def test_held_out_accuracy(spark):
    rows = toxicity.op7_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    label = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "good words", 0.5), (1, "good words", 0.5), (None, None, None), (3, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 4
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), labels.limit(0))).collect() == []


def test_copies_teach_nothing():
    rng = random.Random(4)
    say = lambda: " ".join(f"w{rng.choice('abcdefghij')}{rng.choice('abcdefghij')}" for _ in range(60))
    copied = say() + " once onlyhere"
    rows = [(say() + " vile " + say() + " vile", 1) for _ in range(40)] + [(copied + " " * k, 1) for k in range(30)] + [(say(), 0) for _ in range(200)]
    model = toxicity.train(rows)
    assert b"vile" in model.weights and model.weights.get(b"onlyhere", 0) < 1 < model.weights[b"vile"]
