"""The network's gradients and training, the forecast run, and inspection of raw tables."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, forecast, forecast_run, inspect, network
from tidemark.operators.base import TimeKey, load_model

KEY = TimeKey(("i",), ("k",))


@pytest.mark.parametrize("lags", [0, 2])
def test_gradients_are_those_of_finite_differences(lags):
    shape = network.Shape(3, 12, 4, 8, 2, 2, 16, 3, 2, lags, 2.0, 0.0)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 12, 3)), rng.normal(size=(5, 4))
    w = {n: network.Var(v) for n, v in network.initial(shape, 0).items()}
    prior = network.lag_prior(x, 2, lags)

    def value() -> network.Var:
        return network.loss(network.forward(shape, w, prior, x), y, np.linspace(0.1, 1, 4), 1.0)

    network.backward(value())
    for name, v in w.items():
        if v.g is None:
            assert name == "lag" and lags == 0
            continue
        i = tuple(rng.integers(0, n) for n in v.v.shape)
        old = v.v[i]
        v.v[i] = old + 1e-5
        up = float(value().v)
        v.v[i] = old - 1e-5
        down = float(value().v)
        v.v[i] = old
        assert v.g[i] == pytest.approx((up - down) / 2e-5, abs=1e-7)


def test_lag_prior_finds_the_shift():
    rng = np.random.default_rng(1)
    s = rng.normal(size=400)
    x = np.stack([np.stack([s[i + 3 : i + 33], s[i : i + 30]], axis=1) for i in range(300)])
    assert network.lag_prior(x, 1, 5)[0].argmax() == 3


@pytest.fixture(scope="module")
def waves(spark):
    i = F.col("id")
    return spark.range(600).select((i % 2).alias("k"), i.alias("i"), F.sin(i / 9).alias("a"), F.sin(i / 9 - 0.5).alias("b")).cache()


def test_network_forecaster_learns_saves_and_repeats(spark, waves, tmp_path):
    spec = forecast.NetworkForecaster(("a", "b"), KEY, 16, 4, d_model=16, nhead=2, num_layers=1, lag_max=4, epochs=12, batch_size=32, lr=0.02, dropout=0.0)
    model = spec.fit(waves)
    assert model.state["losses"][-1] < 0.2 * model.state["losses"][0]
    assert spec.fit(waves.repartition(7)).state["losses"] == pytest.approx(model.state["losses"], rel=1e-6)
    out = {(r.k, r.position): r.forecast_3 for r in model.run(waves).collect()}
    assert len(out) == 2 * (300 - 15)
    truth = {(r.k, r.n): r.b for r in waves.selectExpr("k", "b", "row_number() over (partition by k order by i) n").collect()}
    errors = [abs(v - truth[k, p + 4]) for (k, p), v in out.items() if (k, p + 4) in truth]
    assert np.mean(errors) < 0.15
    model.save(spark, f"{tmp_path}/m")
    again = {(r.k, r.position): r.forecast_3 for r in load_model(spark, f"{tmp_path}/m").run(waves).collect()}
    assert again == pytest.approx(out)


def test_network_forecaster_refuses(waves):
    with pytest.raises(ValueError, match="multiple"):
        forecast.NetworkForecaster(("a",), KEY, d_model=33, nhead=2)
    with pytest.raises(ValueError, match="whole window"):
        forecast.NetworkForecaster(("a",), KEY, 400, 20).fit(waves)
    with pytest.raises(ValueError, match="target_idx"):
        forecast.NetworkForecaster(("a",), KEY, target_idx=3)


def test_windows_with_nan_do_not_train(waves):
    holed = waves.withColumn("a", F.when(F.col("i") % 100 < 20, None).otherwise(F.col("a")))
    model = forecast.NetworkForecaster(("a", "b"), KEY, 8, 2, d_model=16, nhead=2, num_layers=1, epochs=1).fit(holed.na.fill(float("nan")))
    assert np.isfinite(model.state["losses"]).all()


def test_run_writes_its_results(spark, waves, tmp_path):
    run = forecast_run.forecast_run(waves, KEY, ["a", "b"], "b", 16, 4, "linear_forecaster", output=str(tmp_path))
    assert run.pairs.count() == 8 and run.scores["r2"] > 0.999 and run.scores["mase"] < 0.1
    saved = json.loads("\n".join(r[0] for r in spark.read.text(f"{tmp_path}/forecast_metrics.json").collect()))
    assert saved["mae"] == pytest.approx(run.scores["mae"])
    assert "# Forecast of b" in [r[0] for r in spark.read.text(f"{tmp_path}/report.md").collect()]
    real = {(r.k, r.place): r.y_true for r in run.pairs.collect()}
    last = {(r.k, 5 - r.n): r.b for r in waves.selectExpr("k", "b", "row_number() over (partition by k order by i desc) n").filter("n <= 4").collect()}
    assert real == pytest.approx(last)
    with pytest.raises(ValueError, match="target"):
        forecast_run.forecast_run(waves, KEY, ["a"], "b", 16, 4)


def test_settings_are_bounded():
    got = forecast_run.bounded({"d_model": 33, "nhead": 2, "epochs": 10_000, "lr": 5})
    assert (got["d_model"], got["epochs"], got["lr"], got["batch_size"]) == (32, 200, 0.1, 32)
    assert forecast_run.bounded({"d_model": 17, "nhead": 9})["d_model"] == 16
    assert forecast_run.bounded({"d_model": 1, "nhead": 7})["d_model"] == 112


@pytest.mark.parametrize("mode", ["compat", "standard"])
def test_areas_equal_a_single_sort(spark, mode):
    rng = np.random.default_rng(3)
    rows = [(int(t), float(np.round(s, 2))) for t, s in zip(rng.integers(0, 2, 500), rng.random(500), strict=True)]
    points = evaluate.curve_points(spark.createDataFrame(rows, "t int, s double"), "t", "s")
    got = evaluate.curve_summary(points, mode).first()
    p = points.toPandas()
    pr = p.sort_values(["recall", "place"])
    assert got.auc_pr == pytest.approx(np.trapezoid(pr.precision, pr.recall))
    if mode == "compat":
        roc = p.sort_values(["fpr", "place"])
        assert got.auc_roc == pytest.approx(np.trapezoid(roc.tpr, roc.fpr))
    else:
        s = p[np.isfinite(p.threshold)].sort_values("threshold", ascending=False)
        assert got.auc_roc == pytest.approx(np.trapezoid([0, *s.tpr, 1], [0, *s.fpr, 1]))


def test_cells(spark):
    cells = {"1,234.5": (1234.5, None), "3.0": (3.0, 3), "inf": (None, None), "nil": (None, None), " -7 ": (-7.0, -7), "9" * 30: (float("9" * 30), None), "": (None, None), "2+3j": (None, None)}
    df = spark.createDataFrame([(x,) for x in [*cells, None]], "x string")
    got = {r.x: (r.n, r.i) for r in df.select("x", inspect.number("x").alias("n"), inspect.integer("x").alias("i")).collect()}
    assert got == cells | {None: (None, None)}
    c = df.select("x", inspect.complex_number("x").alias("c")).filter("c is not null").collect()
    assert [(r.x, r.c.re, r.c.im) for r in c] == [("2+3j", 2.0, 3.0)]


def test_sizes_round_halves_to_even(spark):
    df = spark.createDataFrame([(0,), (1023,), (32000,), (1024**2,), (3 * 1024**3,)], "b long")
    assert [r[0] for r in df.select(inspect.size_text(F.col("b"))).collect()] == ["0 B", "1023 B", "31.2 KB", "1.0 MB", "3.00 GB"]


def test_zones():
    assert inspect.choose_zone([], "+03:00") == "+03:00"
    assert inspect.choose_zone([]) == inspect.choose_zone(["+01:00", None]) == inspect.choose_zone(["+01:00", "+08:00"]) == "+08:00"
    assert inspect.choose_zone(["+01:00", "+02:00", "+02:00"]) == "+02:00"


def test_unit_rows(spark):
    df = spark.createDataFrame([(0, "1", "2"), (1, "kPa", None), (2, "rpm", "V"), (3, "5", "6")], "i int, a string, b string")
    assert inspect.unit_row(df, ["a", "b"], ["i"]) == {"a": "rpm", "b": "V"}
    assert [r.i for r in inspect.drop_unit_row(df, ["a", "b"], ["i"]).collect()] == [3]
    plain = df.filter("i = 0 or i = 3")
    assert inspect.unit_row(plain, ["a", "b"], ["i"]) is None and inspect.drop_unit_row(plain, ["a", "b"], ["i"]).count() == 2


def test_time_columns(spark):
    df = spark.range(200).select("id", F.lit("x").alias("w"), F.col("id").cast("string").alias("n"), (F.col("id") % 3).cast("string").alias("time"))
    assert inspect.time_column(df, ["w", "time", "n"], "id") == ("n", "sequence")
    assert inspect.time_column(df, ["time", "w"], "id") == ("time", "sequence")
    assert inspect.time_column(df, ["w"], "id") is None and inspect.time_column(df.limit(0), ["n"], "id") is None
    assert inspect.monotone(df.limit(0), F.col("id"), "id").first()[0] is True
    assert inspect.monotone(df, -F.col("id"), "id").first()[0] is False
