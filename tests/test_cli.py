"""The command line end to end, over folders of csv files."""

from __future__ import annotations

import json

import pytest

from tidemark.cli import at_path, main
from tidemark.sources.io import folder_files, read_config, read_sections, read_table, scan_folder, write_table


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 5), i % 2, int(i % 3 == 0)) for i in range(30)], "a double, b double, t int, p int")
    write_table(df, f"{tmp_path}/in.csv", single=True)
    return tmp_path


def config(tmp_path, value) -> str:
    (tmp_path / "c.json").write_text(json.dumps(value))
    return str(tmp_path / "c.json")


def test_features(spark, table):
    c = config(table, {"operators": [{"name": "square_feature", "config": {"input_columns": ["a", "b"]}}], "keep_original": False})
    assert main(["feature_construction", "run", "-i", f"{table}/in.csv", "-c", c, "-o", f"{table}/out.csv"]) == 0
    out = read_table(spark, f"{table}/out.csv")
    assert out.columns == ["a_square", "b_square"] and out.count() == 30


def test_detection_fits_saves_and_runs(spark, table):
    c = config(table, {"name": "zscore_scorer", "config": {"input_columns": ["a", "b"]}})
    assert main(["detection", "fit", "-i", f"{table}/in.csv", "-c", c, "--model-dir", f"{table}/m"]) == 0
    assert main(["detection", "run", "-i", f"{table}/in.csv", "-c", c, "-o", f"{table}/out.parquet", "--model-dir", f"{table}/m"]) == 0
    assert "score" in read_table(spark, f"{table}/out.parquet").columns


def test_selection(spark, table):
    c = config(table, {"operator": {"name": "variance_threshold_selector", "config": {"input_columns": ["a", "b"], "threshold": 10.0}}})
    assert main(["feature_selection", "run", "-i", f"{table}/in.csv", "-c", c, "-o", f"{table}/out.tsv"]) == 0
    assert read_table(spark, f"{table}/out.tsv").columns == ["a"]


def test_evaluation(spark, table, capsys):
    c = config(table, {"operators": [{"name": "binary_classification", "truth": "t", "predict": "p", "key": "x"}, {"name": "forecasting_metrics", "truth": "a", "predict": "b"}]})
    assert main(["evaluation", "run", "-i", f"{table}/in.csv", "-c", c]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["results"]["x"]["result"][0]["tp"] == 5


def test_help_and_errors(table, capsys):
    assert main(["detection", "help", "knn_scorer"]) == 0
    assert "n_neighbors" in capsys.readouterr().out
    with pytest.raises(KeyError, match="no operator"):
        main(["detection", "help", "nothing"])


def test_sources(spark, table):
    assert {r.file.rsplit("/", 2)[-2] for r in scan_folder(spark, str(table)).select("file").distinct().collect()} == {"in.csv"}
    assert dict(read_table(spark, f"{table}/in.csv", typed=False).dtypes)["a"] == "string"
    (table / "c.yaml").write_text("a: [1, 2]\n")
    (table / "c.json5").write_text('{"a": [1, 2,], // two\n}')
    assert read_config(spark, f"{table}/c.yaml") == read_config(spark, f"{table}/c.json5") == {"a": [1, 2]}
    found = read_sections("## labels\n- y\n- z\n## ranges\n```json\n{\"a\": [0, 1]}\n```\n## columns\n| name | unit |\n|---|---|\n| a | v |\n")
    assert found == {"labels": ["y", "z"], "ranges": {"a": [0, 1]}, "columns": [["name", "unit"], ["a", "v"]]}
    with pytest.raises(ValueError, match="not supported"):
        read_table(spark, "x.mat")
    (table / "d.json5").write_text('{"u": "http://x/,}", /* a, ] */ "v": "// no",}')
    assert read_config(spark, f"{table}/d.json5") == {"u": "http://x/,}", "v": "// no"}


def test_folders_name_what_they_skip(spark, tmp_path):
    for name, text in {"b.csv": "x,y\n1,2\n", "A.csv": "x,y\n", "c d.csv": "x\n1\n", "e.csv": ""}.items():
        (tmp_path / name).write_text(text)
    got = [(r.file.rsplit("/", 1)[-1].replace("%20", " "), r.size, r.skipped) for r in folder_files(spark, str(tmp_path)).collect()]
    assert got == [("A.csv", 4, "header only"), ("b.csv", 8, None), ("c d.csv", 4, None), ("e.csv", 0, "empty")]


def test_main_scores_and_keys(spark, table, capsys):
    metric = {"name": "multi_classification", "truth": "t", "predict": "p", "main_scores": {"mean": "macro.f1", "one": "labels.1.recall"}}
    c = config(table, {"operators": [metric, metric, {"name": "binary_classification", "truth": "t", "predict": "p", "alias": "b", "main_scores": {"f": "f1"}}, {"name": "forecasting_metrics", "truth": "a", "predict": "b", "config": {"epsilon": 1e-6}}]})
    assert main(["evaluation", "run", "-i", f"{table}/in.csv", "-c", c]) == 0
    said = json.loads(capsys.readouterr().out)["results"]
    assert list(said) == ["multi_classification", "multi_classification_1", "b", "forecasting_metrics"]
    first = said["multi_classification"]
    assert first["main_scores"] == {"mean": first["macro"]["f1"], "one": first["result"][[r["label"] for r in first["result"]].index(1)]["recall"]}
    assert said["b"]["main_scores"] == {"f": said["b"]["result"][0]["f1"]} and said["forecasting_metrics"]["main_scores"] is None
    with pytest.raises(KeyError, match="nothing"):
        at_path({"macro": {"f1": 1.0}}, "macro.nothing")
    assert at_path(2.5, "_") == 2.5


def test_targets_and_extra_outputs(spark, table):
    c = config(table, {"name": "linear_forecaster", "config": {"input_columns": ["a", "b"], "key": {"order_by": ["a"], "partition_by": []}, "seq_len": 8, "pred_len": 2, "train_ratio": 1.0}})
    for target in ("a", "b"):
        assert main(["forecasting", "fit", "-i", f"{table}/in.csv", "-c", c, "--model-dir", f"{table}/{target}", "--target", target]) == 0
        assert main(["forecasting", "run", "-i", f"{table}/in.csv", "-c", c, "--model-dir", f"{table}/{target}", "--target", target, "-o", f"{table}/{target}.parquet", "--eo-output", f"{table}/{target}.json"]) == 0
    a, b = (read_table(spark, f"{table}/{t}.parquet").orderBy("position").first() for t in "ab")
    assert a.forecast_0 != b.forecast_0
    learned = read_config(spark, f"{table}/a.json")
    assert learned[0]["name"] == "linear_forecaster" and set(learned[0]["state"]) == {"mean", "std"}
    with pytest.raises(ValueError, match="target"):
        main(["forecasting", "fit", "-i", f"{table}/in.csv", "-c", c, "--model-dir", f"{table}/x", "--target", "zz"])


def test_a_run_without_models_says_so(spark, table):
    c = config(table, {"name": "zscore_scorer", "config": {"input_columns": ["a"]}})
    with pytest.warns(UserWarning, match="fitted on the input"):
        main(["detection", "run", "-i", f"{table}/in.csv", "-c", c, "-o", f"{table}/o.parquet"])


def test_encodings(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("n\nä\n".encode("latin-1"))
    assert [r.n for r in read_table(spark, f"{tmp_path}/l.csv", encoding="ISO-8859-1").collect()] == ["ä"]
