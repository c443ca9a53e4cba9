import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.plans import many_targets as mt
from riskloom.plans import models as ml
from riskloom.plans import panel as pn


def coordinate_descent(x, y, alpha, rho, sweeps=4000):
    """Independent solver of MSE/2 + alpha*rho*|w|_1 + alpha*(1-rho)/2*|w|^2 with intercept."""
    x, y = x - x.mean(axis=0), y - y.mean()
    n, p = x.shape
    w = np.zeros(p)
    for _ in range(sweeps):
        for j in range(p):
            rest = y - x @ w + x[:, j] * w[j]
            g = x[:, j] @ rest / n
            w[j] = np.sign(g) * max(abs(g) - alpha * rho, 0) / (
                x[:, j] @ x[:, j] / n + alpha * (1 - rho)
            )
    return w


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(240, 6))
    y = 0.02 * x[:, 0] - 0.01 * x[:, 1] + rng.normal(scale=0.01, size=240)
    rows = [("t", i, float(y[i]), i < 180, *map(float, x[i])) for i in range(240)]
    names = [f"f{j}_ret" for j in range(6)]
    schema = "target string, date int, label double, is_train boolean, " + ", ".join(
        f"{n} double" for n in names
    )
    df = spark.createDataFrame(rows, schema)
    return pn.standardise(df, names).persist(), names, x, y


@pytest.mark.parametrize("alpha,rho", [(0.0005, 0.5), (0.002, 0.3), (0.001, 1.0)])
def test_elastic_net_matches_independent_solver(planted, alpha, rho):
    df, names, x, y = planted
    xt, yt = x[:180], y[:180]
    xs = (xt - xt.mean(axis=0)) / xt.std(axis=0)
    want = coordinate_descent(xs, yt, alpha, rho)
    model = ml.elastic_net(df.where("is_train"), names, alpha=alpha, l1_ratio=rho)
    np.testing.assert_allclose(model.coefficients.toArray(), want, atol=1e-10)
    assert model.intercept == pytest.approx(yt.mean())


def slopes(x, y, w, l2):
    """Slope of the smooth part of the loss, and what is left of it at the optimum."""
    x, y = x - x.mean(axis=0), y - y.mean()
    return x.T @ (y - x @ w) / len(x) - l2 * w


def test_elastic_net_is_optimal_for_collinear_features(spark):
    """One feature is the mean of others: every slope must lie within the penalty."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    x = np.c_[x, x.mean(axis=1), np.ones(300)]
    x[:, :5] = (x[:, :5] - x[:, :5].mean(0)) / x[:, :5].std(0)
    y = x @ [0.3, -0.2, 0.1, 0, 0, 0] + rng.normal(size=300)
    names = list("abcdef")
    rows = [(float(y[i]), *map(float, x[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "label double, " + ", ".join(f"{n} double" for n in names))
    w = ml.elastic_net(df, names).coefficients.toArray()
    g = slopes(x, y, w, 0.00025)
    zero = w == 0
    assert w[5] == 0 and np.abs(g[zero]).max() <= 0.00025 + 1e-6
    np.testing.assert_allclose(g[~zero], 0.00025 * np.sign(w[~zero]), atol=1e-6)


def many(rng, sizes, k=5):
    rows = []
    for t, n in sizes.items():
        x = rng.normal(size=(n, k)) + 0.1
        y = x @ rng.normal(size=k) * 0.1 + rng.normal(size=n)
        rows += [(t, i, float(y[i]), *map(float, x[i])) for i in range(n)]
    return rows


def test_many_targets_equal_single_fits(spark):
    """One target holds most rows; one has a single row, one only incomplete rows."""
    names = [f"f{j}" for j in range(5)]
    schema = "target string, date int, label double, " + ", ".join(f"{n} double" for n in names)
    rows = many(np.random.default_rng(6), {"hot": 6000, "a": 80, "b": 300, None: 50, "one": 1})
    rows += [("none", 0, None, *[1.0] * 5), ("a", 99, 1.0, None, *[1.0] * 4)]
    df = spark.createDataFrame(rows, schema).repartition(6)
    fits = {r.target: r for r in mt.fit_many_targets(df, names).collect()}
    assert set(fits) == {"hot", "a", "b", None, "one"}
    assert {t: r.n for t, r in fits.items()} == {"hot": 6000, "a": 80, "b": 300, None: 50, "one": 1}
    for t, r in fits.items():
        one = df.where(F.col("target").eqNullSafe(t))
        single = ml.elastic_net(one, names)
        np.testing.assert_allclose(r.coefs, single.coefficients.toArray(), atol=1e-8)
        x = np.array([q[3:] for q in rows if q[0] == t and None not in q[2:]])
        y = np.array([q[2] for q in rows if q[0] == t and None not in q[2:]])
        np.testing.assert_allclose(r.coefs, coordinate_descent(x, y, 0.0005, 0.5, 400), atol=1e-8)
        assert r.intercept == pytest.approx(y.mean() - x.mean(0) @ np.array(r.coefs))


def test_many_targets_forecasts_and_empty(spark):
    names = ["f0", "f1"]
    rows = many(np.random.default_rng(8), {"a": 40, "b": 30}, 2)
    df = spark.createDataFrame(rows, "target string, date int, label double, f0 double, f1 double")
    fits = mt.fit_many_targets(df, names).where("target = 'a'")
    fit = fits.first()
    done = mt.predict_many(df, fits, names).collect()
    assert len(done) == 40 and {r.target for r in done} == {"a"}
    for r in done:
        assert r.pred == pytest.approx(fit.intercept + fit.coefs[0] * r.f0 + fit.coefs[1] * r.f1)
    long = mt.coefficient_rows(fits, names).collect()
    assert {(r.feature, r.coef) for r in long} == set(zip(names, fit.coefs))
    assert mt.fit_many_targets(df.limit(0), names).collect() == []


def test_rows_do_not_reach_the_solver(spark):
    """The plan sums products before Python sees anything."""
    df = spark.createDataFrame(many(np.random.default_rng(1), {"a": 9}, 2), "target string, date int, label double, f0 double, f1 double")
    plan = mt.fit_many_targets(df, ["f0", "f1"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("Aggregate") < plan.index("Generate")


def test_fit_forecasts_and_coefficients(planted, spark, tmp_path):
    df, names, _, y = planted
    fit = ml.fit_models(df, names, [ml.ELASTIC_NET, ml.TREE])
    out = fit.predictions.toPandas()
    assert len(out) == 120 and set(out.model) == {ml.ELASTIC_NET, ml.TREE}
    for _, part in out.groupby("model"):
        error = ((part.pred - part.actual) ** 2).mean()
        assert error < 0.6 * ((y[:180].mean() - part.actual) ** 2).mean()
    coefs = ml.coefficients(fit, spark)
    assert {r.feature for r in coefs.collect()} == set(names)
    top = ml.top_coefficients(coefs, 2, 1).collect()
    assert top[-1].feature == "f0_ret" and top[-1].sign_class == "positive"
    assert top[0].feature == "f1_ret" and top[0].label == "f1" and top[0].coef < 0
    ml.save_models(fit, str(tmp_path))
    assert (tmp_path / "elastic_net").exists() and (tmp_path / "decision_tree").exists()
    importances = ml.coefficients(fit, spark, ml.TREE)
    assert importances.agg(F.sum("coef")).first()[0] == pytest.approx(1.0)


def test_ensembles_repeat_and_learn(planted):
    df, names, _, y = planted
    runs = []
    for _ in range(2):
        fit = ml.fit_models(df, names, [ml.BOOSTING, ml.FOREST], rounds=8, trees=12)
        runs.append(fit.predictions.orderBy("model", "date").toPandas())
    assert runs[0].equals(runs[1])
    forest = runs[0][runs[0].model == ml.FOREST]
    error = ((forest.pred - forest.actual) ** 2).mean()
    assert error < ((y[:180].mean() - forest.actual) ** 2).mean()
