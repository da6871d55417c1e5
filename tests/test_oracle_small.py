"""Every binding with an oracle: Spark result equals the DuckDB twin at sf0.001."""

import math

import pytest

import __spark_entry__ as E
from tessera.plans import registry
from tests.conftest import SF_SMALL

QUERIES, ORACLE = registry()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        return v.tolist()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(repr(_norm(r[c])) for c in cols) for r in pdf.to_dict("records")))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    s_cols, s_rows = _rows(QUERIES[name](spark, SF_SMALL).toPandas())
    d_cols, d_rows = _rows(duck.execute(ORACLE[name]).df())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


@pytest.fixture(scope="module")
def few_trees():
    """The model queries with a lower tree limit; the limit itself is tested in test_edge_cases."""
    from tessera.plans import ml_q

    old, ml_q.TREES, old_causes, ml_q.CAUSE_TREES = ml_q.TREES, 20, ml_q.CAUSE_TREES, 20
    yield
    ml_q.TREES, ml_q.CAUSE_TREES = old, old_causes


def test_ensemble_rows(spark, few_trees):
    got = {(r.split, r.model): r for r in QUERIES["ensemble_train"](spark, SF_SMALL).collect()}
    assert set(got) == {(s, m) for s in ("train", "holdout") for m in ("m1", "m2", "m3", "ensemble")}
    n = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    for m in ("m1", "m2", "m3", "ensemble"):
        assert got["train", m].n + got["holdout", m].n == n
        assert got["train", m].r2 > -0.01 and got["train", m].mape > 0
    assert got["train", "m3"].r2 > got["holdout", "m3"].r2


def test_importance_rows(spark, few_trees):
    got = QUERIES["rf_importance"](spark, SF_SMALL).toPandas()
    assert len(got) == 5 and got.importance.sum() == pytest.approx(1) and (got.importance >= 0).all()


def test_conformal_rows(spark, few_trees):
    got = QUERIES["conformal"](spark, SF_SMALL).first()
    assert got.rows > 400 and 0.84 < got.coverage < 0.96 and got.avg_width > 0


def test_cause_rows(spark, few_trees):
    got = QUERIES["causes_ranked"](spark, SF_SMALL).toPandas().sort_values("rank")
    assert got["rank"].tolist() == [1, 2, 3, 4, 5] and got.importance.is_monotonic_decreasing
    assert got.importance.sum() == pytest.approx(1)


def test_granger_rows(spark):
    got = QUERIES["granger"](spark, SF_SMALL).toPandas()
    assert len(got) == 20 and got.p_value.dropna().between(0, 1).all()


def test_entry(spark):
    out = E.entry(spark)
    assert out.columns == ["feature", "variance"]
    assert out.count() >= 1


def test_only_model_queries_lack_an_oracle():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only == {"causes_ranked", "conformal", "ensemble_train", "granger", "rf_importance"}, rows_only
    assert set(ORACLE) <= set(QUERIES)


def test_entry_registers_every_binding():
    assert set(QUERIES) <= set(E.queries())
    assert set(ORACLE) <= set(E.oracle_sql()) <= set(E.queries())
