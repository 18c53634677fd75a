"""Operators on tiny tables with hand values, and their contracts."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import spectral
from tidemark.operators import detect, evaluate, features, forecast, inspect, prep, select, tune
from tidemark.operators.base import REGISTRY, NotFitted, TimeKey, create, help_text, load_model
from tidemark.streaming import online


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate([2, 4, 6, 8, 10])], "i int, a double")


KEY = TimeKey(("i",))


@pytest.mark.parametrize(
    ("padding", "alignment", "want"),
    [(None, "right", [4, 6, 8]), (None, "left", [4, 6, 8]), ("edge", "right", [2, 8 / 3, 4, 6, 8]), ("edge", "left", [4, 6, 8, 28 / 3, 10]), ("reflect", "right", [4, 10 / 3, 4, 6, 8]), ("ring", "right", [20 / 3, 16 / 3, 4, 6, 8]), ("ring", "left", [4, 6, 8, 20 / 3, 16 / 3]), (0.0, "right", [2 / 3, 2, 4, 6, 8])],
)
def test_rolling_mean(series, padding, alignment, want):
    out = features.RollingMean(("a",), KEY, 3, padding, alignment).run(series).orderBy("i")
    assert column(out, "a_rolling_mean") == pytest.approx(want)


def test_rolling_mean_nan_and_limits(series):
    out = features.RollingMean(("a",), KEY, 3, "nan").run(series).orderBy("i")
    assert [math.isnan(v) for v in column(out, "a_rolling_mean")] == [True, True, False, False, False]
    with pytest.raises(ValueError, match="row order"):
        features.RollingMean(("a",)).run(series)
    with pytest.raises(Exception, match="shorter"):
        features.RollingMean(("a",), KEY, 9, "ring").run(series).collect()


CELLS = {"mean_square": ([1, 2, 3], 14 / 3), "rms": ([3.0], 3.0), "peak_peak": ([1, 5, 2], 4.0), "variance": ([1, 2, 3, 4], 5 / 3), "crest": ([1, -3], 3 / math.sqrt(5)), "gini_index": ([1, 1, 1], 0.0), "kurtosis": ([5.0, 5.0], 0.0)}


@pytest.mark.parametrize("name", CELLS)
def test_scalar_features(spark, name):
    cell, want = CELLS[name]
    df = spark.createDataFrame([([float(x) for x in cell],), ([],)], "s array<double>")
    assert column(REGISTRY[f"{name}_feature"](("s",)).run(df), f"s_{name}") == pytest.approx([want, 0.0])


def test_smooth_padding_is_circular(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],)], "s array<double>")
    for mode, want in (("backward", [2.5, 1.5, 2.5, 3.5]), ("forward", [1.5, 2.5, 3.5, 2.5])):
        out = column(REGISTRY["smooth_mean_feature"](("s",), 2, 1, mode).run(df), "s_smooth_mean_win2")
        assert out[0] == pytest.approx(want) and out[1] == []


def test_spectral_kernels():
    t = np.arange(4096) / 8000
    tone, noise = np.sin(2 * np.pi * 440 * t), np.random.default_rng(42).normal(size=4096)
    assert spectral.spectral_entropy(noise) > spectral.spectral_entropy(tone)
    assert spectral.hnr(tone) > spectral.hnr(noise)
    am = np.sin(2 * np.pi * 1000 * t) * (1 + 0.8 * np.sin(2 * np.pi * 70 * t))
    assert spectral.roughness(am, 8000) > spectral.roughness(np.sin(2 * np.pi * 1000 * t), 8000)
    rate, f0 = 1000.0, 25.0
    s = np.arange(2000) / rate
    x = sum(np.sin(2 * np.pi * f0 * h * s) / h for h in range(1, 6)) + 0.3 * np.random.default_rng(1).normal(size=2000)
    assert abs(spectral.speed_rpm(x, rate, 600, 3000) - 1500) < 30
    assert spectral.sharpness(np.sin(2 * np.pi * 3500 * t), 8000) > spectral.sharpness(tone, 8000)
    assert np.allclose(spectral.envelope(tone[None, :])[0, 100:-100], 1, atol=0.2)


def test_selectors(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (1.0, 2.0, 2.0), (1.0, 3.0, 2.0)], "a double, b double, c double")
    assert select.Columns(("c", "a")).run(df).columns == ["c", "a"]
    assert select.Columns((2, 0)).run(df).columns == ["c", "a"]
    model = select.VarianceThreshold().fit(df)
    assert model.run(df).columns == ["b"] and model.state["selected_indices"] == [1]
    with pytest.raises(ValueError, match="not found"):
        select.Columns(("x",)).run(df)
    with pytest.raises(NotFitted):
        select.VarianceThreshold().run(df)


def test_detectors_and_models(spark, tmp_path):
    rng = np.random.default_rng(42)
    train = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(100, 3))], "x double, y double, z double")
    odd = spark.createDataFrame([tuple(map(float, r)) for r in np.concatenate([rng.normal(size=(18, 3)), rng.normal(size=(2, 3)) + 10])], "x double, y double, z double")
    for name in ("zscore_detector", "pca_detector", "knn_detector"):
        model = create(name, {"input_columns": ["x", "y", "z"], **({"n_components": 1} if name == "pca_detector" else {})}).fit(train)
        labels = column(model.run(odd), "label")
        if name != "pca_detector":
            assert labels[-2:] == [1, 1]
    saved = detect.ZScore(("x", "y", "z")).fit(train)
    saved.save(spark, f"file://{tmp_path}/m")
    again = load_model(spark, f"file://{tmp_path}/m")
    assert column(again.run(odd), "score") == pytest.approx(column(saved.run(odd), "score"))
    for bad in (({"name": "zscore_scorer"},), ({"name": "threshold_decider"}, {"name": "zscore_scorer"}), ({"name": "zscore_scorer"}, {"name": "pca_predictor"})):
        with pytest.raises(ValueError, match="."):
            detect.CompositeDetector(bad)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("kind", ["plain", "copies", "far", "tiny", "huge", "missing", "whole", "one"])
def test_knn_block_equals_all_distances(kind, metric):
    """Two blocks by bounds, against every distance; few of them are computed exactly."""
    rng = np.random.default_rng(5)

    def points(n):
        x = rng.normal(size=(n, 8))
        if kind == "copies":
            x[: n // 2] = 0.5
        if kind == "missing":
            x[::7, 0], x[3, 1] = np.nan, np.inf
        if kind == "whole":
            x = rng.integers(0, 3, (n, 8)).astype(float)
        return {"far": x + 1e8, "tiny": x * 1e-160, "huge": x * 1e160, "one": x * 0 + 2.5}.get(kind, x)

    x, blocks = points(30), [points(200), points(200)]
    x[:3] = blocks[0][:3]
    near = want = [np.zeros(0)] * len(x)
    with np.errstate(all="ignore"):
        for b in blocks:
            near = detect._Block(b, 5, metric).update(near, x)
            want = [np.sort(np.concatenate([w, detect._distances(q, b, metric)]))[:5] for w, q in zip(want, x, strict=True)]
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(near, want, strict=True))


def test_knn_computes_few_distances(monkeypatch):
    rng = np.random.default_rng(6)
    seen = []
    exact = detect._distances
    monkeypatch.setattr(detect, "_distances", lambda x, p, m: seen.append(len(p)) or exact(x, p, m))
    near = [np.zeros(0)] * 100
    for _ in range(2):
        near = detect._Block(rng.normal(size=(5000, 32)), 5, "euclidean").update(near, rng.normal(size=(100, 32)))
    assert sum(seen) < 5000


def test_knn_deals_the_queries_of_one_file(spark, monkeypatch):
    monkeypatch.setattr(detect, "PARALLEL", 10)
    df = spark.range(50).selectExpr("id", "double(id) AS x").coalesce(1)
    out = detect.Knn(("x",), 2).fit(df).run(df)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and out.agg(F.max("score")).first()[0] == 1


def test_knn_in_blocks_equals_one_block(spark, monkeypatch):
    rows = [(i, float(i * i % 37), float(i % 11)) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, x double, y double")
    whole = {r.i: r.score for r in detect.Knn(("x", "y"), 4).fit(df).run(df).collect()}
    monkeypatch.setattr(detect, "BLOCK", 17)
    assert {r.i: r.score for r in detect.Knn(("x", "y"), 4).fit(df).run(df).collect()} == pytest.approx(whole)


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (0, 1), (1, 0)], "t int, p int")
    row = evaluate.binary(df, "t", "p").first()
    assert (row.tp, row.fp, row.tn, row.fn, row.f1, row.mcc) == (1, 1, 1, 1, 0.5, 0.0)
    perfect = spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.15), (1, 0.9), (1, 0.85), (1, 0.95)], "t int, s double")
    points = evaluate.curve_points(perfect, "t", "s")
    assert evaluate.curve_summary(points).first().auc_roc == pytest.approx(0.5)
    assert evaluate.curve_summary(points, "standard").first().auc_roc == pytest.approx(1.0)
    fc = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2), (4.0, 3.8), (5.0, 5.1)], "t double, p double")
    assert evaluate.forecasting(fc, "t", "p").first().mae == pytest.approx(0.14)
    a, b = np.array([1.0, 2, 3, 4]), np.array([1.0, 1, 2, 3, 4])
    assert evaluate.dtw_distance(a, b) == 0.0
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=12), rng.normal(size=9)
    slow = np.full((13, 10), np.inf)
    slow[0, 0] = 0
    for i in range(1, 13):
        for j in range(1, 10):
            slow[i, j] = abs(a[i - 1] - b[j - 1]) + min(slow[i - 1, j], slow[i, j - 1], slow[i - 1, j - 1])
    assert evaluate.dtw_distance(a, b) == pytest.approx(slow[-1, -1])


def test_prep(spark):
    assert prep.unit_of("speed (km/h)") == ("speed", "km/h") and prep.unit_of("current_amps")[1] == "amps"
    df = spark.createDataFrame([(1, "1"), (2, " NA "), (3, "2.5"), (4, "x"), (5, None), (6, "1+2j")], "i int, c string")
    assert column(df.select(prep.cell_type("c").alias("k"), "i").orderBy("i"), "k") == ["int", "none", "float", "str", "none", "complex"]
    with pytest.raises(ValueError, match="voltage"):
        prep.convert_unit(F.lit(1.0), "v", "kg")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=s), v, y) for s, v, y in ((0, 1.0, 0), (1, None, 1), (2, 3.0, 1), (5, 4.0, 0))]
    data = spark.createDataFrame(rows, "time timestamp_ntz, v double, y int")
    spec = prep.PrepSpec(time="time", columns=["v"], labels=["y"], seconds=1, mode="compat")
    out = prep.resample(data, spec).orderBy("time").collect()
    assert [r.v for r in out] == [1, 1, 3, 3, 3, 4] and [r.y for r in out] == [0, 1, 1, 1, 0, 0]
    assert prep.mode_interval(data, "time").first().mode_seconds == 1.0
    with pytest.raises(ValueError, match="positive"):
        prep.grid(data, "time", 0)
    clash = data.withColumn("v", F.lit(9.0))
    with pytest.raises(ValueError, match="contradict"):
        prep.merge_checked([data, clash], "time")


def test_forecaster(spark):
    rows = [(i, math.sin(i / 5) * 3 + i * 0.01) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, y double")
    model = forecast.LinearForecaster(("y",), KEY, 16, 4, ridge=0.01).fit(df)
    got = {r.position: r.forecast_0 for r in model.run(df).collect()}
    errors = [got[p] - rows[p][1] for p in range(250, 299)]
    assert np.mean(np.abs(errors)) < 0.1


def test_search():
    s = tune.Search(tune.space(detect.ZScoreDetector), {"score": "max"}, "tpe", seed=1)
    s.run(lambda p: {"score": -((p["threshold"] - 4) ** 2)}, 40)
    assert abs(s.best()[0].params["threshold"] - 4) < 0.5
    bad = tune.Search(tune.space(detect.ZScoreDetector), {"score": "max"})
    with pytest.warns(UserWarning, match="trial"):
        bad.run(lambda p: {"score": float("nan")}, 1)
    assert bad.trials[0].state == "pruned"


def test_search_prunes_by_the_median():
    rank = iter([1, 2, 3, 4, 5, 9, 0])
    reached = []

    def objective(p):
        cost = next(rank)
        for step in range(3):
            reached.append((cost, step))
            yield {"loss": float(cost)}

    s = tune.Search(tune.space(detect.ZScoreDetector), {"loss": "min"}, median=True)
    with pytest.warns(UserWarning, match="median at step 1"):
        s.run(objective, 7)
    assert [t.state for t in s.trials] == ["complete"] * 5 + ["pruned", "complete"]
    assert [r for r in reached if r[0] == 9] == [(9, 0)] and s.best()[0].number == 6


def test_search_ranks_several_goals_and_raises_faults():
    s = tune.Search(tune.space(detect.ZScoreDetector), {"a": "max", "b": "min"})
    s.trials = [tune.Trial(0, {}, {"a": 1.0, "b": 0.0}), tune.Trial(1, {}, {"a": 3.0, "b": 1.0}), tune.Trial(2, {}, {"a": 2.0, "b": 9.0}), tune.Trial(3, {}, {"a": 0.0, "b": 10.0})]
    assert [t.number for t in s.best(4)] == [1, 0, 2, 3]
    with pytest.raises(TypeError):
        tune.Search(tune.space(detect.ZScoreDetector), {"a": "max"}).run(lambda p: {"a": 1 + "x"}, 1)


def test_validation_strategies(spark):
    df = spark.range(1000)
    sizes = lambda train, test: {"train": train.count(), "test": test.count(), "common": train.join(test, "id").count()}
    assert tune.validate(df, sizes, ["id"], given=spark.range(1000, 1010), k=5) == {"train": 1000, "test": 10, "common": 0}
    assert tune.validate(df, sizes, ["id"], k=4, share=0.5) == {"train": 750, "test": 250, "common": 0}
    part = tune.validate(df, sizes, ["id"], share=0.2)
    assert part["train"] + part["test"] == 1000 and 150 < part["test"] < 250 and part["common"] == 0
    for bad in ({}, {"k": 1}, {"share": 1.0}):
        with pytest.raises(ValueError):
            tune.validate(df, sizes, ["id"], **bad)


def test_history(spark, tmp_path):
    h = tune.History("t", {"a": 1}, {"y": "max"})
    h.append({"a": 0.5}, {"y": 1.0})
    with pytest.raises(ValueError, match="exactly"):
        h.append({"b": 1}, {"y": 1})
    h.save(spark, f"file://{tmp_path}/h")
    assert tune.History.load(spark, f"file://{tmp_path}/h") == h


def test_registry():
    assert len(REGISTRY) > 50 and "knn_scorer" in help_text(kind="detection")
    with pytest.raises(KeyError, match="no operator"):
        create("nothing")
    with pytest.warns(UserWarning, match="unknown settings"):
        create("square_feature", {"input_columns": ["a"], "extra": 1})
    with pytest.raises(ValueError, match="out of bounds"):
        create("knn_scorer", {"input_columns": ["a"], "n_neighbors": 50})


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 2, t0 + dt.timedelta(seconds=i), float(i)) for i in range(40)]
    table = spark.createDataFrame(rows, "k int, t timestamp, v double")
    table.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    model = detect.ZScore(("v",)).fit(table)
    scored = online.drain(online.apply(stream, [model, detect.Threshold(1.0)]), "scored", f"{tmp_path}/c1")
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, detect.Threshold(1.0).run(model.run(table)).collect()))
    rolled = online.drain(online.rolling_mean(stream, "k", "t", "v", 3), "rolled", f"{tmp_path}/c2")
    want = features.RollingMean(("v",), TimeKey(("t",), ("k",)), 3).run(table)
    assert sorted(round(v, 9) for v in column(rolled, "v_rolling_mean")) == sorted(round(v, 9) for v in column(want, "v_rolling_mean"))
    even = online.drain(online.resample(stream, "t", "v", ["k"], "10 seconds", "0 seconds"), "even", f"{tmp_path}/c3")
    assert {r.n for r in even.collect()} == {5}
    with pytest.raises(NotFitted):
        online.apply(stream, [detect.ZScore(("v",))])


def test_missing_tokens_units_and_names(spark):
    cells = spark.createDataFrame([(v,) for v in (" NIL ", "#N/A", "--", "missing", "0", None, "")], "v string")
    assert column(prep.normalise_na(cells, ["v"]), "v") == [None, None, None, "missing", "0", None, None]
    assert prep.unit_of("温度（℃）") == ("温度", "℃") and prep.unit_of("压力（kPa)") == ("压力", "kPa")
    one = spark.createDataFrame([(212.0,)], "x double")
    convert = lambda a, b: one.select(prep.convert_unit(F.col("x"), a, b).alias("y")).first().y
    assert [convert("fahrenheit", "℃"), convert("mbar", "kpa"), convert("ua", "amp"), convert("mg", "g"), convert("us", "ms")] == pytest.approx([100.0, 21.2, 2.12e-4, 0.212, 0.212])
    for a, b in (("rpm", "hz"), ("psi", "pa"), ("v", "kg")):
        with pytest.raises(ValueError, match="unit|is"):
            prep.convert_unit(F.col("x"), a, b)


def test_precision_recovery_of_uneven_counts(spark):
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, m)) for m, n in ((0, 4), (1, 7)) for i in range(n)], "i int, t timestamp_ntz")
    out = prep.recover_precision(rows, "t", ["i"], uneven="null").filter("minute(t) = 0").orderBy("i")
    start = column(out, "recovered")[0]
    assert [v - start for v in column(out, "recovered")] == [0, 15_000_000, 30_000_000, 45_000_000]
    assert set(column(prep.recover_precision(rows, "t", ["i"], uneven="null").filter("minute(t) = 1"), "recovered")) == {None}
    with pytest.raises(Exception, match="evenly"):
        prep.recover_precision(rows, "t", ["i"]).collect()


def test_nearest_neighbour_models_load_again(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(40, 2)))] + [(100 + i, 9.0, 9.0) for i in range(30)]
    points = spark.createDataFrame(rows, "i int, a double, b double")
    for spec, value in ((detect.Knn(("a", "b"), 3), "score"), (detect.KnnDetector(("a", "b"), 3), "label")):
        model = spec.fit(points)
        path = str(tmp_path / spec.op_name)
        model.save(spark, path)
        want = column(model.run(points).orderBy("i"), value)
        assert column(load_model(spark, path).run(points).orderBy("i"), value) == want
    with pytest.raises(NotFitted):
        detect.Knn(("a", "b")).apply(points, {"rows": 1})


def test_clock_times_by_look_equal_every_pattern(spark):
    """What a pattern's look keeps from its parser is nothing that the parser reads."""
    cells = ["2024-01-02", "2024-1-2 3:4", "2024-01-02 03:04:05.123456", "2024-01-02T03:04", "2024-01-02t03:04:05", "2024/1/2 3:4:5", "20240102030405", "202401020304", "20240102", "3:4", "03:04:05.5", "+12024-01-02", "-2024-01-02", "+120240102", "+3:04", "2024-01-02 03:04:05+08:00", "2024-01-02 03:04Z", "2024-13-02", "29.27", "click", "1234567", "2024-01", "", " 2024-01-02 ", "2024-01-02x"]
    df = spark.createDataFrame([(c,) for c in cells], "x string")
    t = F.regexp_replace(F.trim("x"), r"(?<=\d:\d{2}|\.\d{1,6})\s*([+-]\d{2}:?\d{2}|Z)$", "")
    every = F.when(~prep.is_na("x"), F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in inspect.TIME_PATTERNS])).cast("timestamp_ntz")
    rows = df.select("x", inspect.clock_time("x").cast("string").alias("got"), every.cast("string").alias("want")).collect()
    assert [(r.x, r.got) for r in rows] == [(r.x, r.want) for r in rows] and sum(r.got is not None for r in rows) >= 14


def test_words_are_no_slower_to_judge_than_times(spark):
    def seconds(cell):
        rows = spark.range(40_000).select(F.concat(F.lit(cell), (F.col("id") % 10).cast("string")).alias("x"))
        start = dt.datetime.now()
        rows.agg(F.count(inspect.clock_time("x"))).first()
        return (dt.datetime.now() - start).total_seconds()

    seconds("2024-01-02 03:04:0")
    assert seconds("word") < 2 * seconds("2024-01-02 03:04:0") + 0.5


@pytest.mark.parametrize("share", [0.5, 0.95, 0.999])
def test_percentile_by_narrowing_equals_percentile(spark, share):
    """With a handful of values at a time, ties and nulls."""
    df = spark.range(5000).select(F.when(F.col("id") % 11 > 0, F.when(F.col("id") % 3 > 0, F.hash("id") / 1000).otherwise(F.lit(7.5))).alias("s"))
    want = df.agg(F.percentile("s", F.lit(share))).first()[0]
    assert detect.exact_percentile(df, "s", share, 30) == want == detect.exact_percentile(df, "s", share)
    assert detect.exact_percentile(df.filter("s is null"), "s", share) is None


def test_percentile_decider_holds_no_table_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(detect.F, "percentile", None)
    df = spark.range(101).select(F.col("id").cast("double").alias("score"))
    assert detect.Percentile(95.0).fit(df).state["threshold"] == 95
