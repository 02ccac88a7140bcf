"""Models: TF-IDF, walk-forward learners, ensembles, importance, learning curves, on pyspark.ml."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylark.session import ship, stored


def tfidf(docs: DataFrame, least: int, most: float = 1.0, features: int | None = None) -> DataFrame:
    """id, term, weight: (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), of unit length. docs: id, terms (array).

    Terms in fewer than `least` documents or more than a share `most` are out; features: the most frequent terms kept."""
    counts = docs.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).join(F.broadcast(n)).where((F.col("df") >= least) & (F.col("df") <= most * F.col("n")))
    if features:
        df = df.orderBy(F.desc("all"), "term").limit(features)
    x = counts.join(df, "term").withColumn("x", (1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return x.select("id", "term", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))).alias("weight"))


def nearest_before(docs: DataFrame, least: int, band: int) -> DataFrame:
    """id, c: for each id the greatest cosine of its TF-IDF vector (as tfidf, terms of `least` documents or more) with one of an id
    less than it by `band` at most and of the same source; 0 without one. docs: id (long), source, words (joined by spaces).

    Pairs are never rows. Documents are dealt by blocks of five bands, those of a block's last band to the next one too. A block is
    packed as one row with the list of its terms; the terms' numbers of documents come to it by a join of these lists, and its
    vectors are then multiplied in place, by sources and bands."""
    spark, n, width = docs.sparkSession, docs.count(), 5 * band
    ship(spark)

    def pack(key, table):
        counts: dict = {}
        for i, source, words in zip(*(table.column(c).to_pylist() for c in ("id", "source", "words"))):
            counts.setdefault((i, source), Counter()).update(w for w in (words or "").split(" ") if w)
        keys = sorted(counts, key=lambda k: (k[0], k[1] is not None, k[1] or ""))
        terms: dict[str, int] = {}
        codes = np.array([terms.setdefault(w, len(terms)) for k in keys for w in counts[k]], "<i4")
        tfs = np.array([x for k in keys for x in counts[k].values()], "<i4")
        sizes = np.array([len(counts[k]) for k in keys], np.int64)
        own = np.repeat([k[0] // width == key[0].as_py() for k in keys], sizes)
        df = np.bincount(codes[own], minlength=len(terms))
        row = {"b": [key[0].as_py()], "ids": [[k[0] for k in keys]], "sources": [[k[1] for k in keys]], "sizes": [sizes.tolist()], "codes": [codes.tobytes()], "tfs": [tfs.tobytes()], "terms": [list(terms)], "dfs": [df.tolist()]}
        return pa.table(row, schema=kinds)

    def score(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, sizes, found = np.array(r["ids"], np.int64), np.array(r["sizes"], np.int64), r["found"] or []
                df = np.zeros(len(found and r["dfs"]), np.int64)
                df[[x["pos"] for x in found]] = [x["df"] for x in found]
                codes, tfs, doc = np.frombuffer(r["codes"], "<i4"), np.frombuffer(r["tfs"], "<i4"), np.repeat(np.arange(len(ids)), sizes)
                kept = df[codes] > 0 if len(df) else np.zeros(len(codes), bool)
                codes, tfs, doc = codes[kept], tfs[kept], doc[kept]
                x = (1 + np.log(tfs)) * (np.log((1 + n) / (1 + df[codes])) + 1)
                _, at = np.unique(ids, return_inverse=True)  # a length is that of all rows of an id
                v = x / np.sqrt(np.bincount(at[doc], x * x, minlength=len(ids)))[at[doc]]
                best = np.zeros(len(ids))
                by_source: dict = {}
                for k, s in enumerate(r["sources"]):
                    if s is not None:
                        by_source.setdefault(s, []).append(k)
                place = np.full(len(ids), -1)
                for rows in map(np.array, by_source.values()):
                    place[:] = -1
                    place[rows] = np.arange(len(rows))
                    mine = place[doc] >= 0
                    names, c = np.unique(codes[mine], return_inverse=True)
                    d, w, g = place[doc[mine]], v[mine], ids[rows]
                    order = np.argsort(c, kind="stable")
                    c, d, w = c[order], d[order], w[order]
                    starts = range(int(r["b"]) * width, (int(r["b"]) + 1) * width, band)
                    spans = [(np.searchsorted(g, a - band), np.searchsorted(g, a), np.searchsorted(g, a + band)) for a in starts]
                    sums = [np.zeros((z - m, z - a)) for a, m, z in spans]
                    for t in range(0, len(names), 4096):
                        e = slice(np.searchsorted(c, t), np.searchsorted(c, t + 4096))
                        block = np.zeros((len(rows), min(4096, len(names) - t)))
                        block[d[e], c[e] - t] = w[e]
                        for s, (a, m, z) in zip(sums, spans):
                            if z > m:
                                s += block[m:z] @ block[a:z].T
                    for s, (a, m, z) in zip(sums, spans):
                        if z > m:
                            gap = g[m:z, None] - g[None, a:z]
                            best[rows[m:z]] = np.where((gap > 0) & (gap <= band), s, 0.0).max(axis=1)
                own = ids // width == r["b"]
                out: dict[int, float] = {}
                for i, c in zip(ids[own].tolist(), best[own].tolist()):
                    out[i] = max(c, out.get(i, 0.0))
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.float64())], ["id", "c"])

    kinds = pa.schema([("b", pa.int64()), ("ids", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("codes", pa.binary()), ("tfs", pa.binary()), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int64()))])
    b = F.floor(F.col("id") / width).cast("long")
    dealt = docs.withColumn("b", F.explode(F.when(F.pmod("id", F.lit(width)) >= width - band, F.array(b, b + 1)).otherwise(F.array(b))))
    packed = dealt.groupBy("b").applyInArrow(pack, "b long, ids array<long>, sources array<string>, sizes array<long>, codes binary, tfs binary, terms array<string>, dfs array<long>")
    packed = stored(packed, "blocks")
    listed = packed.select("b", F.posexplode(F.arrays_zip("terms", "dfs")).alias("pos", "t")).select("b", "pos", F.col("t.terms").alias("term"), F.col("t.dfs").alias("own"))
    df = listed.groupBy("term").agg(F.sum("own").alias("df")).where(F.col("df") >= least)
    found = listed.select("b", "pos", "term").join(df, "term").groupBy("b").agg(F.collect_list(F.struct("pos", "df")).alias("found"))
    return packed.drop("terms").join(found, "b", "left").mapInArrow(score, "id long, c double")


def learners(seed: int = 7) -> dict[str, Callable]:
    """Learners by name. Boosted trees stand for gradient boosting libraries, a linear machine for kernel machines."""
    common = {"featuresCol": "x", "labelCol": "y"}
    return {
        "logistic": lambda: LogisticRegression(regParam=0.01, standardization=False, weightCol="w", **common),
        "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, **common),
        "boosted": lambda: GBTClassifier(maxIter=10, maxDepth=3, seed=seed, **common),
        "linear_svc": lambda: LinearSVC(regParam=0.01, **common),
        "bayes": lambda: NaiveBayes(modelType="gaussian", **common),
        "network": lambda: MultilayerPerceptronClassifier(maxIter=30, seed=seed, **common),
    }


def fitted(train: DataFrame, columns: list[str], learner, components: int | None = None):
    """A pipeline of assembling, scaling, components if asked for, and the learner, fitted to train (columns, y, w)."""
    stages = [VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="x" if components is None else "_scaled", withMean=True)]
    if components is not None:
        stages.append(PCA(k=components, inputCol="_scaled", outputCol="x"))
    if isinstance(learner, MultilayerPerceptronClassifier):
        learner = learner.setLayers([components or len(columns), 8, 2])
    return Pipeline(stages=[*stages, learner]).fit(train)


def chances(model, rows: DataFrame) -> DataFrame:
    """rows with p, the chance (or, without chances, the margin) of class 1."""
    out = model.transform(rows)
    source = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumn("p", vector_to_array(source)[1]).select(*rows.columns, "p")


def walk_forward(rows: DataFrame, folds: list[int], fold: str, columns: list[str], make: Callable, embargo: int, half_life: float = 250.0) -> DataFrame:
    """Chances for each test fold from a model of the folds before it, less `embargo` sessions, with weights that halve every
    half_life sessions. rows: fold, t (session), columns, y."""
    out = None
    for k in folds:
        test = rows.where(F.col(fold) == k)
        start = test.agg(F.min("t").alias("t0")).first()["t0"]
        if start is None:
            continue
        train = rows.where(F.col("y").isNotNull() & (F.col("t") < start - embargo)).withColumn("w", F.pow(F.lit(0.5), (F.lit(start) - F.col("t")) / half_life))
        labels = train.select("y").distinct().limit(2).count()
        part = chances(fitted(train, columns, make()), test) if labels == 2 else test.withColumn("p", F.lit(0.5))
        out = part if out is None else out.unionByName(part)
    return out


def permutation_importance(rows: DataFrame, model, groups: dict[str, list[str]], measure: Callable[[DataFrame], float], seed: int = 3) -> list[tuple[str, float]]:
    """(name, loss of the measure when the columns of a group are dealt anew). The new order is a join of row numbers by hash."""
    base = measure(chances(model, rows))
    every = sorted({c for g in groups.values() for c in g})
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(*rows.columns), F.lit(16))).orderBy(F.xxhash64(*rows.columns), *rows.columns))).withColumn("_b", F.pmod(F.xxhash64(*rows.columns), F.lit(16)))
    out = []
    for k, (name, columns) in enumerate(groups.items()):
        w = Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + k), *every, "_n"))
        dealt = numbered.select("_b", F.row_number().over(w).alias("_n"), *(F.col(c).alias(f"_p_{c}") for c in columns))
        mixed = numbered.join(dealt, ["_b", "_n"]).withColumns({c: F.col(f"_p_{c}") for c in columns}).select(*rows.columns)
        out.append((name, base - measure(chances(model, mixed))))
    return out
