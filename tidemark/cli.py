"""Command line: ``python -m tidemark.cli MODULE help|fit|run ...`` over the operator registry.

Modules: feature_construction, feature_selection, detection, forecasting, evaluation.
"""

from __future__ import annotations

import argparse
import json
import sys
import warnings
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import detect, evaluate, features, forecast, select  # noqa: F401 - they register
from tidemark.operators.base import Fitted, Learnable, create, help_text, load_model
from tidemark.operators.detect import Chain
from tidemark.sources.io import read_config, read_table, write_json, write_table

MODULES = ("feature_construction", "feature_selection", "detection", "forecasting", "evaluation")


def _settings(metric: dict) -> dict:
    return {k: v for k, v in metric.get("config", {}).items() if k != "main_scores"}


METRICS = {
    "binary_classification": lambda df, c: evaluate.binary(df, c["truth"], c["predict"], **_settings(c)),
    "multi_classification": lambda df, c: evaluate.multi(df, c["truth"], c["predict"], **_settings(c)),
    "binary_classification_curve": lambda df, c: evaluate.curve_summary(evaluate.curve_points(df, c["truth"], c["predict"], **_settings(c))),
    "forecasting_metrics": lambda df, c: evaluate.forecasting(df, c["truth"], c["predict"], **_settings(c)),
    "self_evaluation": lambda df, c: evaluate.self_evaluation(df, c["input"]),
}


def _listed(config: dict) -> list[dict]:
    items = config.get("operators") or [config.get("operator", config)]
    return [{"name": o} if isinstance(o, str) else o for o in items]


def _key(spec: dict, used: set[str]) -> str:
    """A metric's key in the results: its alias, else its name, with _1, _2, ... where that is taken."""
    wanted = key = spec.get("alias", spec.get("key", spec["name"]))
    n = 0
    while key in used:
        n += 1
        key = f"{wanted}_{n}"
    used.add(key)
    return key


def at_path(value: Any, path: str) -> Any:
    """What a dotted path leads to; ``_`` is the value itself, and a list of one is that one."""
    for part in [] if path == "_" else path.split("."):
        if isinstance(value, list):
            value = value[0] if len(value) == 1 and not part.isdigit() else value[int(part)]
            if part.isdigit():
                continue
        if part not in value:
            raise KeyError(f"no {part!r} of {path!r}; there are {sorted(value)}")
        value = value[part]
    return value


def evaluate_all(df: DataFrame, config: dict) -> dict:
    """{key: result, main_scores} of every listed metric. Paths of main scores lead through the result;
    of a metric by label, ``macro`` has the means and ``labels`` each label's scores."""
    out: dict[str, Any] = {}
    used: set[str] = set()
    for o in _listed(config):
        if o["name"] not in METRICS:
            raise KeyError(f"no metric {o['name']!r}; there are {sorted(METRICS)}")
        found = METRICS[o["name"]](df, o)
        rows = [r.asDict(recursive=True) for r in found.collect()]
        entry: dict[str, Any] = {"result": rows}
        wide: Any = rows
        if "label" in found.columns:
            entry["macro"] = evaluate.macro(found).first().asDict()
            wide = {"macro": entry["macro"], "labels": {str(r["label"]): r for r in rows}}
        scores = o.get("main_scores", o.get("config", {}).get("main_scores"))
        entry["main_scores"] = {n: float(at_path(wide, p)) for n, p in scores.items()} if scores else None
        out[_key(o, used)] = entry
    return {"results": out}


def extra_output(op: Any) -> dict | None:
    """What an operator learned, without bulky weights; None for one that learns nothing. Chains list their parts'."""
    if not isinstance(op, Fitted):
        return None
    state = {k: v for k, v in op.state.items() if k not in ("weights", "train")}
    if isinstance(op, Chain):
        state["parts"] = [extra_output(s) for s in op.steps]
    return {"name": op.spec.op_name, "state": state}


def _targeted(spec: dict, target: str | None) -> dict | None:
    """A forecaster's settings with the index of its target column, if one is named."""
    config = spec.get("config")
    if target is None or config is None:
        return config
    if target not in config.get("input_columns", []):
        raise ValueError(f"target {target!r} is none of {config.get('input_columns')}")
    return config | {"target_idx": config["input_columns"].index(target)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("module", choices=MODULES)
    p.add_argument("action", choices=("help", "fit", "run"))
    p.add_argument("name", nargs="?")
    p.add_argument("-i", "--input")
    p.add_argument("-c", "--config")
    p.add_argument("-o", "--output")
    p.add_argument("--model-dir")
    p.add_argument("--target", help="the column to forecast, unless the configuration has target_column")
    p.add_argument("--eo-output", help="a JSON file of what the operators learned")
    p.add_argument("--encoding", default="UTF-8", help="of csv and tsv input")
    a = p.parse_args(argv)
    if a.action == "help":
        if a.module == "evaluation":
            print("\n".join(f"- `{m}`" for m in sorted(METRICS)))
        else:
            print(help_text(a.name, a.module))
        return 0
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    df, config = read_table(spark, a.input, encoding=a.encoding), read_config(spark, a.config)
    if a.module == "evaluation":
        result = evaluate_all(df, config)
        print(json.dumps(result, indent=2, default=str))
        if a.output:
            write_json(spark, result, a.output)
        return 0
    operators = [create(o["name"], _targeted(o, config.get("target_column", a.target)) if a.module == "forecasting" else o.get("config")) for o in _listed(config)]
    if a.action == "fit":
        if not a.model_dir:
            p.error("fit needs --model-dir")
        for i, op in enumerate(operators):
            if isinstance(op, Learnable):
                op.fit(df).save(spark, f"{a.model_dir}/{i}_{op.op_name}")
            else:
                print(f"{op.op_name} has nothing to learn")
        return 0
    if not a.output:
        p.error("run needs --output")
    if not a.model_dir:
        for op in operators:
            if isinstance(op, Learnable):
                warnings.warn(f"{op.op_name} is fitted on the input itself: there is no --model-dir", stacklevel=2)
    fitted = [load_model(spark, f"{a.model_dir}/{i}_{op.op_name}") if isinstance(op, Learnable) and a.model_dir else op.fit(df) if isinstance(op, Learnable) else op for i, op in enumerate(operators)]
    if a.module == "feature_construction":
        plain = [op for op in fitted if isinstance(op, features.Feature)]
        out = features.build(df, plain, config.get("keep_original", True)) if plain else df
        for op in fitted:
            if not isinstance(op, features.Feature):
                out = op.run(out)
    else:
        out = df
        for op in fitted:
            out = op.run(out)
    write_table(out, a.output)
    if a.eo_output:
        write_json(spark, [extra_output(op) for op in fitted], a.eo_output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
