"""Toxicity by maximum-scoring segments of word log-odds.

Weights: log-odds of each token between toxic and clean texts, with an informative Dirichlet prior (PRIOR times the token's
count in both together), less Z standard deviations towards 0, so that rare tokens say little; words of clean texts have
negative weights. Tokens are the words, and their stems of some lengths as tokens of their own: a word counts once for each
pair of neighbours that it is seen between, so copies of a text add nothing, and a stem once for each different word that it
begins, so one frequent word lends its stem nothing. Tokens whose log-odds don't tell them from 0 have no weight. A word with a
negative weight of its own has that; another the greater of its own and that of its longest stem with a weight. Every word of a
passage costs 1 / LENGTH, the rate at which passages of LENGTH words end.

In a text, too, a word with a positive weight counts once for each pair of neighbours: lines that are said again and again
are no more toxic than said once.

Passages: one linear scan finds all maximal scoring segments of weights less cost (Ruzzo and Tompa). A segment is significant
when its expected number in a random clean text of this length, K n exp(-lambda S), is under EXPECTED (Karlin and Altschul);
texts of fewer than 1 / K words, where the formula would count less than one segment in all, are judged like such a text.
lambda solves mean(exp(lambda s)) = 1 over the words of clean texts that the weights were not learned from (the sample is
halved, each half is scored by the other's weights) and, as a word of caution, one more word with the greatest weight; K is
fitted to the best segments of random texts drawn from these words, which follow an extreme-value distribution. A text's
evidence is the sum of lambda S - ln(max(K n, 1) / EXPECTED) over its significant segments; a logistic curve, fitted to evidence
of texts that the weights were not learned from, turns it into a score.

Training reads a bounded sample of SAMPLE labelled documents, those with the least hash of doc_id (one text for each doc_id).
Null and empty texts and texts without words have no evidence and get the curve's lowest score. With no labelled row, or one
class only, every score is 0. Texts are read whole, at any length. Rows are independent: repeated rows and null ids keep their
own result. Other columns pass through unless their names clash with the result's, which win.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quaylark.llm.language import normal
from quaylark.session import ship

#: Labelled documents that the weights are learned from.
SAMPLE = 5_000
#: Prior count of a word as a share of its count in all texts.
PRIOR = 0.2
#: Standard deviations that are taken off log-odds. Z, LENGTH, EXPECTED: the least mean log loss on training rows
#: that the weights were not learned from (README).
Z = 2.5
#: Characters of the stems that are tokens beside the words.
STEMS = (4, 5, 6)
#: Words whose weight a worker keeps at hand.
KEPT_WORDS = 500_000
#: Words of a passage, on average: each costs the passage 1 / LENGTH.
LENGTH = 8
#: A passage is significant when fewer such passages are expected in a clean text.
EXPECTED = 0.1
#: Random clean texts that K is fitted to, and their words.
TEXTS, TEXT_WORDS, SEED = 200, 4_000, 5
_EULER = 0.5772156649015329


def words_of(text: str | None) -> list[bytes]:
    return normal(text).split() if text else []


def stems(word: bytes) -> list[bytes]:
    """The word's stems, shortest first; a stem is shorter than its word."""
    text = word.decode("utf-8", "surrogatepass")
    return [(text[:k] + "*").encode("utf-8", "surrogatepass") for k in STEMS if len(text) > k]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in order.

    Runs of positive scores are candidates; each keeps the sum before it, the sum after it and the nearest candidate on
    its left with a lesser sum before it, so that no candidate is looked at twice."""
    above = np.concatenate(([False], scores > 0, [False]))
    edges = np.flatnonzero(above[1:] != above[:-1])
    if not len(edges):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    begins, ends = edges[::2], edges[1::2]
    stack: list[list] = []
    for new in map(list, zip(sums[begins].tolist(), sums[ends].tolist(), begins.tolist(), ends.tolist())):
        new.append(-1)
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= new[0]:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= new[1]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            nxt = stack[j][4]
            del stack[j:]
            j = nxt
    return [(s[2], s[3], s[1] - s[0]) for s in stack]


class Model:
    """Token weights (stems end with a star), the extreme-value parameters and the curve."""

    def __init__(self, weights: dict[bytes, float], lam: float = 0.0, k: float = 1.0):
        self.weights, self.lam, self.k = weights, lam, k
        self.slope, self.offset, self.fitted = 0.0, 0.0, False
        self.table: dict[bytes, float] = {}

    def weight(self, word: bytes) -> float:
        found = self.weights.get(word, 0.0)
        if found >= 0:
            found = max(found, next((self.weights[t] for t in stems(word)[::-1] if t in self.weights), found))
        if len(self.table) >= KEPT_WORDS:
            self.table.clear()
        self.table[word] = found
        return found

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Weight less cost of each word; a word that speaks for toxicity does so once between the same neighbours."""
        get, weight = self.table.get, self.weight
        out = np.fromiter((x if (x := get(w)) is not None else weight(w) for w in words), np.float64, len(words)) - 1 / LENGTH
        seen, last = set(), len(words) - 1
        for i in np.flatnonzero(out > 0).tolist():
            said = (words[i - 1] if i else None, words[i], words[i + 1] if i < last else None)
            if said in seen:
                out[i] = -1 / LENGTH
            seen.add(said)
        return out

    def passages(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Significant segments with their evidence."""
        if not words or self.lam <= 0:
            return []
        bar = math.log(max(1.0, self.k * len(words)) / EXPECTED)
        return [(a, b, self.lam * s - bar) for a, b, s in segments(self.scores(words)) if self.lam * s > bar]

    def score(self, passages: list[tuple[int, int, float]]) -> float:
        if not self.fitted:
            return 0.0
        x = self.slope * sum(e for _, _, e in passages) + self.offset
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def learn(texts: list[list[bytes]], toxic: np.ndarray) -> Model:
    """Weights from texts (as words) and labels."""
    vocabulary: dict[bytes, int] = {}
    rows: dict[int, list] = {0: [], 1: []}
    for words, y in zip(texts, toxic.tolist()):
        if words:
            rows[y].append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words)))
    if not rows[0] or not rows[1]:
        return Model({})
    h = np.fromiter(map(xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
    counts = [_contexts(h, rows[label]) for label in (0, 1)]
    weights = dict(zip(vocabulary, _bounded(*counts)))
    kinds: dict[bytes, list[int]] = {}  # of each stem: different words in clean and in toxic texts
    for word, y0, y1 in zip(vocabulary, *(c.tolist() for c in counts)):
        for stem in stems(word):
            kind = kinds.setdefault(stem, [0, 0])
            kind[0] += y0 > 0
            kind[1] += y1 > 0
    for size in STEMS:
        some = [t for t in kinds if len(t.decode("utf-8", "surrogatepass")) == size + 1]
        if some:
            weights |= zip(some, _bounded(*np.array([kinds[t] for t in some], np.float64).T))
    return Model({t: x for t, x in weights.items() if x})


def _bounded(y0: np.ndarray, y1: np.ndarray) -> list[float]:
    """Log-odds less Z standard deviations towards 0."""
    odds, spread = log_odds(y0, y1)
    return (np.sign(odds) * np.maximum(0, np.abs(odds) - Z * spread)).tolist()


def calibrate(model: Model, clean: np.ndarray) -> None:
    """lambda and K from the scores of words of clean texts."""
    most = max(model.weights.values(), default=0.0) - 1 / LENGTH
    if most > 0:
        scores = np.append(clean, most)
        model.lam = _lambda(scores)
        model.k = _k(scores, model.lam)


def log_odds(y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each word between the classes and their standard deviations, under a Dirichlet prior of PRIOR times the
    counts of both."""
    prior = PRIOR * (y0 + y1)
    a0, a1, n0, n1 = y0 + prior, y1 + prior, y0.sum() + prior.sum(), y1.sum() + prior.sum()
    odds = np.log(a1) - np.log(np.maximum(n1 - a1, 1e-9)) - np.log(a0) + np.log(np.maximum(n0 - a0, 1e-9))
    return odds, np.sqrt(1 / a0 + 1 / a1)


def _contexts(h: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """For each word (a number; h: hashes of the words) the number of different pairs of neighbours it has in the texts."""
    around = []
    for ids in texts:
        before = np.concatenate(([np.uint64(1)], h[ids[:-1]])) * np.uint64(0x9E3779B97F4A7C15)
        around.append(before ^ np.concatenate((h[ids[1:]], [np.uint64(2)])) * np.uint64(0xC2B2AE3D27D4EB4F))
    word, pair = np.concatenate(texts), np.concatenate(around)
    order = np.lexsort((pair, word))
    word, pair = word[order], pair[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (pair[1:] != pair[:-1])
    return np.bincount(word[new], minlength=len(h)).astype(np.float64)


def _lambda(scores: np.ndarray) -> float:
    """The positive solution of mean(exp(lambda s)) = 1; 0 where there is none, as the mean score isn't negative."""
    values, n = np.unique(scores, return_counts=True)
    rate = n / n.sum()
    if rate @ values >= 0:
        return 0.0
    over = lambda x: float(rate @ np.exp(np.minimum(x * values, 700))) - 1
    low, high = 0.0, 1.0
    while over(high) < 0:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) < 0 else (low, mid)
    return high


def _k(scores: np.ndarray, lam: float) -> float:
    """K from the mean of the best segments of random texts: lambda S - ln(K n) is Gumbel-distributed."""
    draw = np.random.default_rng(SEED)
    best = []
    for _ in range(TEXTS):
        sums = np.concatenate(([0.0], np.cumsum(scores[draw.integers(0, len(scores), TEXT_WORDS)])))
        best.append(float((sums - np.minimum.accumulate(sums)).max()))
    return math.exp(lam * float(np.mean(best)) - math.log(TEXT_WORDS) - _EULER)


def train(rows: list[tuple[str | None, int]]) -> Model:
    """A model from (text, label) rows: the curve is fitted crosswise on halves, the weights on all."""
    rows = sorted(set((t or "", int(y)) for t, y in rows))
    one: dict[bytes, bytes] = {}  # each word is held once
    texts, toxic = [[one.setdefault(w, w) for w in words_of(t)] for t, _ in rows], np.array([y for _, y in rows], np.int64)
    half = np.array([xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) & 1 for t, _ in rows], np.int64)
    del rows, one
    evidence, clean = np.zeros(len(texts)), []
    for side in (0, 1):
        half_model = learn([w for w, h in zip(texts, half) if h != side], toxic[half != side])
        mine = np.flatnonzero(half == side)
        scores = [half_model.scores(texts[i]) for i in mine if not toxic[i]]
        if scores:
            calibrate(half_model, np.concatenate(scores))
            clean += scores
        for i in mine:
            evidence[i] = sum(e for _, _, e in half_model.passages(texts[i]))
    model = learn(texts, toxic)
    if clean:
        calibrate(model, np.concatenate(clean))
    if len(set(toxic.tolist())) == 2:
        model.slope, model.offset = _curve(evidence, toxic)
        model.fitted = True
    model.table = {}
    return model


def _curve(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method with a light ridge on the slope."""
    design, w = np.stack((x, np.ones(len(x))), axis=1), np.zeros(2)
    ridge = np.diag([0.05, 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge + 1e-9 * np.eye(2), design.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` of the documents that labels marks."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # of `sample` rows at most
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return train([(r.text, r.toxic) for r in rows.select("text", "toxic").collect()])


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score, predicted and passages (start, end in words, evidence)."""
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # the words of the sample at most
    kept = [c for c in df.columns if c not in ("score", "predicted", "passages")]
    df, at = df.select(*kept), kept.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))

    def run(batches):
        known = held.value
        for batch in batches:
            scores, passages = [], []
            for value in batch.column(at):
                found = known.passages(words_of(value.as_py()))
                scores.append(known.score(found))
                passages.append([{"start": a, "end": b, "evidence": e} for a, b, e in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, kind)], [*kept, "score", "predicted", "passages"])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "score double, predicted int, passages array<struct<start:long,end:long,evidence:double>>"]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0)) == 0
    model = fit(docs, labels.where(~held_out))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
