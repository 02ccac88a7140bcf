"""Model queries give scores for all six test quarters of folds_walk_forward."""

from quaylark.plans import registry
from quaylark.plans.models import FOLDS

DIR = "/root/testdata/sf0.001"


def test_six_quarters(spark):
    days = registry.QUERIES["folds_walk_forward"](spark, DIR).where("part = 'test'").selectExpr("year(date) * 4 + quarter(date) AS q").distinct().collect()
    assert sorted(r.q for r in days) == FOLDS
    assert sorted(r.fold for r in registry.QUERIES["walk_forward_logreg"](spark, DIR).collect()) == FOLDS


def test_importance_of_each_quarter(spark):
    rows = registry.QUERIES["permutation_importance"](spark, DIR).collect()
    assert sorted((r.fold, r.name) for r in rows) == [(k, n) for k in FOLDS for n in ("returns", "volume")]
