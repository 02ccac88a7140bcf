"""Model queries; scores of iterative learners have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaylark.operators import models as M
from quaylark.operators import series as S
from quaylark.operators import stats as T
from quaylark.plans.registry import query
from quaylark.plans.tables import daily, table

COLUMNS = ["r1", "r5", "vol", "z"]


def frame(spark, d):
    """fold (quarter), t, features of the days before, y: whether the next five days' mean is above this one."""
    rows = daily(spark, d).withColumn("r", F.ln("level") - F.lag(F.ln("level")).over(S.by(None)))
    rows = rows.withColumns({
        "r1": F.col("r"),
        "r5": S.rolled(F.sum, "r", 5, member=None),
        "vol": S.rolled(F.stddev_samp, "r", 20, member=None),
        "z": S.z_score("volume", 20, member=None),
        "next": S.ahead("level", 1, 5, None) / 5,
        "fold": (F.year("date") * 4 + F.quarter("date")).cast("long"),
    })
    rows = rows.na.drop(subset=[*COLUMNS, "next"])
    return rows.select("fold", F.col("trading_index").alias("t"), "date", *COLUMNS, (F.col("next") > F.col("level")).cast("double").alias("y"))


def _cached(spark, d):
    from quaylark.session import stored

    return stored(frame(spark, d), "frame")


#: The six test quarters of folds_walk_forward, from 1998-01-01.
FOLDS = [1998 * 4 + 1 + k for k in range(6)]
#: Shares of the training rows in hundredths, and the seeds of their draws.
SHARES, SEEDS = (25, 50, 75, 100), (0, 1, 2)


@query()
def walk_forward_logreg(spark, d):
    p = M.walk_forward(_cached(spark, d), FOLDS, "fold", COLUMNS, M.learners()["logistic"], 10)
    return T.auc(p, "y", "p", ["fold"]).select("fold", F.round("auc", 4).alias("auc"))


@query()
def ensemble_vote(spark, d):
    """Rank-average of three learners' chances within each test quarter, and how many agree."""
    rows = _cached(spark, d)
    out = None
    for name in ("logistic", "forest", "bayes"):
        p = M.walk_forward(rows, FOLDS, "fold", COLUMNS, M.learners()[name], 10).select("fold", "t", "y", F.col("p").alias(name))
        out = p if out is None else out.join(p.drop("fold", "y"), "t")
    names = ["logistic", "forest", "bayes"]
    out = out.withColumns({f"{n}_r": S.rank_share(n, ["fold"]) for n in names})
    return out.select("t", F.round(sum(F.col(f"{n}_r") for n in names) / 3, 6).alias("score"), sum((F.col(n) > 0.5).cast("int") for n in names).alias("votes"))


@query()
def learner_comparison(spark, d):
    rows = _cached(spark, d)
    out = []
    for name in ("logistic", "forest", "boosted", "linear_svc", "bayes", "network"):
        p = M.walk_forward(rows, FOLDS, "fold", COLUMNS, M.learners()[name], 10)
        out.append((name, T.auc(p, "y", "p").first()["auc"]))
    return spark.createDataFrame([(n, round(a, 4)) for n, a in out], "learner string, auc double")


@query()
def permutation_importance(spark, d):
    """Loss of AUC in each test quarter when a group of features is dealt anew."""
    rows, out = _cached(spark, d), []
    for k in FOLDS:
        test = rows.where(F.col("fold") == k)
        start = test.agg(F.min("t")).first()[0]
        if start is None:
            continue
        model = M.fitted(rows.where(F.col("t") < start - 10).withColumn("w", F.lit(1.0)), COLUMNS, M.learners()["logistic"]())
        found = M.permutation_importance(test, model, {"returns": ["r1", "r5"], "volume": ["z"]}, lambda p: T.auc(p, "y", "p").first()["auc"])
        out += [(k, n, round(x, 6)) for n, x in found]
    return spark.createDataFrame(out, "fold long, name string, loss double")


@query()
def learning_curve(spark, d):
    """AUC over all test quarters by share of the training rows and seed of the draw; test rows are whole."""
    rows, out = _cached(spark, d), []
    for share in SHARES:
        for seed in SEEDS if share < 100 else SEEDS[:1]:
            p = None
            for k in FOLDS:
                part = rows.where((F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(100)) < share) | (F.col("fold") == k))
                q = M.walk_forward(part, [k], "fold", COLUMNS, M.learners()["logistic"], 10)
                p = q if p is None else p if q is None else p.unionByName(q)
            out.append((share, seed, round(T.auc(p, "y", "p").first()["auc"], 4)))
    return spark.createDataFrame(out, "share int, seed int, auc double")


@query()
def pca_embeddings(spark, d):
    """A classifier of vectors on their first components."""
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") < 5).cast("double").alias("y"), F.lit(1.0).alias("w"), *(F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(64)))
    model = M.fitted(rows.where("vec_id % 4 <> 0"), [f"e{k}" for k in range(64)], M.learners()["logistic"](), 16)
    return T.auc(M.chances(model, rows.where("vec_id % 4 = 0")), "y", "p").select(F.round("auc", 4).alias("auc"))
