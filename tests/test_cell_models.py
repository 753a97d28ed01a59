"""Regression from moments: against spark.ml, against refits without a row, over many chunks."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from innsight.operators import cell_models as cm
from innsight.operators import explain as ex
from innsight.operators import moments as mo

NUMBERS = ["a", "b", "flat", "none"]
SCHEMA = (
    "property_id string, a double, b double, flat double, none double, ratings double, kind string, amenities string, "
    "h3_3 string, h3_5 string, geo_bucket_res int, geo_bucket string"
)


def frame(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = round(float(rng.normal()), 2), round(float(rng.normal(5, 2)), 1)
        things = [t for t in ("pool", "wi-fi", "wi fi", "sauna") if rng.random() < 0.4]
        y = round(3 + a - 0.2 * b + ("pool" in things) + float(rng.normal(0, 0.3)), 1)
        cell = "hot" if i % 3 else f"c{i % 4}"
        items = ",".join(f'{{"name":"{t}","value":"x"}}' for t in things)
        rows.append((
            f"p{i}", None if i % 7 == 0 else a, None if i % 11 == 0 else b, 7.0, None, None if i % 13 == 0 else y,
            None if i % 17 == 0 else "xyz"[i % 3], f'[{{"group_name":"g","items":[{items}]}}]', "w", cell, 5, cell,
        ))
    rows.append(("lonely", 1.0, 1.0, 7.0, 1.0, 4.0, "x", None, "w", "alone", 5, "alone"))
    rows.append(("unrated", 1.0, 1.0, 7.0, 1.0, None, "x", None, "w", "silent", 5, "silent"))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def fitted(spark):
    return cm.fit_cells(frame(spark), NUMBERS, "kind", k=4, always=["Sauna"])


def test_coefficients_equal_spark_ml(spark, fitted):
    """The library's pipeline with a tighter tolerance, on the rows of one area."""
    got = {r["feature"]: r["coef"] for r in cm.coefficients(fitted).where("cell = 'hot'").collect()}
    assert {"a__imp", "amen_wi_fi__imp", "amen_wi_fi_2__imp", "amen_sauna__imp", "kind__ohe___unknown"} <= set(got)
    assert "none__imp" not in got and got["flat__imp"] == 0.0
    rows = frame(spark).where("geo_bucket = 'hot' and ratings is not null")
    flags = {"amen_pool": "pool", "amen_sauna": "sauna", "amen_wi_fi": "wi fi", "amen_wi_fi_2": "wi-fi"}
    rows = rows.withColumns({c: F.col("amenities").contains(f'"{n}"').cast("double") for c, n in flags.items()})
    numerics = ["a", "b", "flat", *flags]
    stages = ex.feature_stages(numerics, ["kind"], 1e-9)
    exact = LinearRegression(
        featuresCol="features_scaled", labelCol="ratings", maxIter=5000, tol=1e-14, regParam=mo.REG, elasticNetParam=mo.ALPHA
    )
    model = Pipeline(stages=[*stages, exact]).fit(rows)
    names = ex.vector_names(model.transform(rows))
    want = dict(zip(names, model.stages[-1].coefficients, strict=True))
    assert set(want) == set(got)
    for name, coef in want.items():
        assert got[name] == pytest.approx(coef, abs=1e-6), name


def test_insights_equal_the_model_over_one_area(spark, fitted):
    """Sum of impacts, shares and benchmark of the area, from the definitions."""
    rows = [r for r in frame(spark).where("geo_bucket = 'hot'").collect()]
    rated = [r for r in rows if r["ratings"] is not None]
    threshold = np.quantile([r["ratings"] for r in rated], mo.QUANTILE, method="inverted_cdf")
    top = [r for r in rated if r["ratings"] >= threshold]
    insights = cm.explain_members(fitted).where("cell = 'hot'").collect()
    assert len({r["property_id"] for r in insights}) == len(rows)
    b = next(r for r in insights if r["property_id"] == "p1" and r["name"] == "b__imp")
    assert b["market_avg"] == pytest.approx(np.mean([r["b"] for r in top if r["b"] is not None]))
    own = [r for r in insights if r["property_id"] == "p1"]
    assert sum(r["importance_pct"] for r in own) == pytest.approx(100)
    assert [r["position"] for r in sorted(own, key=lambda r: -abs(r["current_impact"]))] == list(range(1, len(own) + 1))


def _median(values):
    kept = sorted(v for v in values if not np.isnan(v))
    return kept[int(np.ceil(len(kept) / 2)) - 1] if kept else np.nan


def _refit(raw, labels, m, categories):
    known = ~np.isnan(labels)
    medians = np.array([_median(raw[known, j]) for j in range(m)])
    rated = sorted(labels[known])
    threshold = rated[int(np.ceil(mo.QUANTILE * len(rated))) - 1] if rated else np.nan
    layout = mo.Layout(m, raw.shape[1])
    state = mo.state_of(raw, medians, labels, threshold, layout)
    return state, medians, threshold, layout, mo.fit_whole(state, medians, layout, categories)


@pytest.mark.parametrize("n, seed", [(2, 0), (3, 1), (5, 2), (6, 3), (21, 4), (40, 5), (41, 6)])
def test_without_a_row_equals_a_refit(n, seed):
    """Medians, threshold, benchmark, used slots and coefficients, also with ties and gaps."""
    rng = np.random.default_rng(seed)
    m, categories = 3, 4
    numbers = np.round(rng.normal(size=(n, m)), 1)
    numbers[rng.random((n, m)) < 0.2] = np.nan
    flags = (rng.random((n, 2)) < 0.5).astype(float)
    kinds = np.eye(categories)[rng.integers(0, categories, n)]
    raw = np.hstack([numbers, flags, kinds])
    labels = np.round(numbers[:, 0] * 2 + flags[:, 0], 0) + np.round(rng.normal(size=n), 0)
    labels = np.where(np.isnan(labels), 1.0, labels)
    labels[rng.random(n) < 0.15] = np.nan
    state, medians, threshold, layout, whole = _refit(raw, labels, m, categories)
    got = mo.fit_without(state, medians, threshold, layout, categories, whole.beta[0], raw, labels)
    for i in range(n):
        rest = np.arange(n) != i
        want = _refit(raw[rest], labels[rest], m, categories)[-1]
        used = want.used[0]
        assert (got.used[i] == used).all() and got.n[i] == want.n[0]
        known = used[:m]
        np.testing.assert_allclose(got.fill[i][known], want.fill[0][known], atol=1e-9)
        np.testing.assert_allclose(got.coef[i][used], want.coef[0][used], atol=1e-8)
        np.testing.assert_allclose(got.std[i][used], want.std[0][used], atol=1e-8)
        if want.n[0]:
            np.testing.assert_allclose(got.mean[i][used], want.mean[0][used], atol=1e-9)
            np.testing.assert_allclose(got.top_value[i][used], want.top_value[0][used], atol=1e-9)
            np.testing.assert_allclose(got.top_scaled[i][used], want.top_scaled[0][used], atol=1e-6)


def test_states_merge_to_the_state_of_all_rows():
    rng = np.random.default_rng(8)
    raw = np.round(rng.normal(size=(500, 4)), 1)
    raw[rng.random(raw.shape) < 0.1] = np.nan
    raw[:, 2:] = raw[:, 2:] > 0
    labels = np.round(rng.normal(size=500), 1)
    labels[::9] = np.nan
    medians, layout = np.array([0.0, 0.1]), mo.Layout(2, 4)
    whole = mo.state_of(raw, medians, labels, 0.8, layout)
    parts = [mo.state_of(raw[i::7], medians, labels[i::7], 0.8, layout) for i in range(7)]
    parts.append(mo.state_of(raw[:0], medians, labels[:0], 0.8, layout))
    np.testing.assert_allclose(mo.merged(np.array(parts), layout), whole, atol=1e-9)


def test_chunks_do_not_change_results(spark, fitted, monkeypatch):
    monkeypatch.setattr(cm, "CHUNK_ROWS", 8)
    monkeypatch.setattr(cm, "MERGED", 3)
    cut = cm.fit_cells(frame(spark), NUMBERS, "kind", k=4, always=["Sauna"])
    assert cut.models.agg(F.max("chunks")).first()[0] > 9
    for of in (cm.explain_members, cm.explain_left_out):
        one, many = ({(r["property_id"], r["name"]): r for r in of(m).collect()} for m in (fitted, cut))
        assert set(one) == set(many)
        for key, r in one.items():
            assert many[key]["current_impact"] == pytest.approx(r["current_impact"], abs=1e-8)
            assert many[key]["opportunity"] == pytest.approx(r["opportunity"], abs=1e-8)
            assert many[key]["position"] == r["position"]


def test_areas_with_one_row_or_no_label(fitted):
    of = {r["cell"]: r["n"] for r in fitted.models.select("cell", "n").collect()}
    assert of["alone"] == 1 and of["silent"] == 0 and "w" not in of
    for insights in (cm.explain_members(fitted), cm.explain_left_out(fitted)):
        rows = insights.where("property_id in ('lonely', 'unrated')").collect()
        assert {r["property_id"] for r in rows} == {"lonely", "unrated"}
        assert all(r["current_impact"] == 0 and r["opportunity"] == 0 for r in rows)


def test_no_listings(spark):
    models = cm.fit_cells(frame(spark).limit(0), NUMBERS, "kind")
    assert models.models.count() == 0 and cm.explain_members(models).count() == 0 and cm.explain_left_out(models).count() == 0


def test_explaining_needs_no_python(fitted):
    plan = cm.explain_members(fitted)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
