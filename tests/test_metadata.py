"""Metadata documents, and the chain that they ask for."""

from __future__ import annotations

import datetime as dt

import pytest

from tidemark.operators import prep
from tidemark.sources.metadata import FileFacts, prep_spec, read_metadata

CLEAN = """# 元信息
## 列清单
| 列名 | 数据类型 | 单位 | 角色 |
|---|:---:|---|---|
| `time` | timestamp | - | 时间 |
| p | numeric_float | kPa | 特征 |
| mode | category_str | - | 类别 |
| y | label | - | 标注 |

## 目标单位
p: pa

## 类别映射
```json
{"mode": {"off": 0, "on": 1}}
```
## 有效值域
{"p": [0, 5000]}
## 哨兵值
{"p": [4999]}
## 目标网格间隔
60 秒
## 区间缺失阈值
K = 5
"""


def test_settings_of_the_cleaner_and_the_resampler():
    spec = prep_spec(read_metadata(CLEAN))
    assert (spec.time, spec.columns, spec.labels, spec.categories) == ("time", ["p", "mode", "y"], ["y"], ["mode"])
    assert spec.units == {"p": ("kPa", "pa")} and spec.ranges == {"p": (0.0, 5000.0)} and spec.sentinels == {"p": [4999.0]}
    assert (spec.seconds, spec.k, spec.maps) == (60, 5, {"mode": {"off": 0, "on": 1}})


def test_hints_of_the_profiler():
    m = read_metadata("## 时间列\n`ts`\n\n## 标注列\ny, `z`\n## 类别列\n- a\n* b\n## 跳过的文件\nx.csv，w.csv\n")
    assert (m.time, m.labels, m.categories, m.skipped) == ("ts", ["y", "z"], ["a", "b"], ["x.csv", "w.csv"])


def test_files_of_the_merger():
    m = read_metadata("## 分片形态\nC\n## 文件：a.csv\n- **时间列**：`t`\n- 时间类型: timestamp\n| 列名 | 数据类型 | 单位 |\n|---|---|---|\n| v | numeric_int | - |\n## 文件: b.csv\n- 时间列: n\n")
    assert m.pattern == "C"
    assert m.files == {"a.csv": FileFacts("t", "timestamp", {"v": {"type": "numeric_int", "unit": None}}), "b.csv": FileFacts("n", None, {})}


def test_summary_of_the_exporter():
    m = read_metadata("## 列清单\n| 列名 | 角色 | 来源 |\n|---|---|---|\n| t | 时间 | a.csv |\n| y | label | b.csv |\n## 全流程摘要\n| 步骤 | 技能 | 结果 |\n|---|---|---|\n| 1 | merge | ok |\n## 备注\ntwo\nlines\n")
    assert list(m.columns) == ["t", "y"] and m.columns["y"]["source"] == "b.csv" and m.labels == ["y"]
    assert [r["步骤"] for r in m.summary] == ["1"] and m.notes == "two\nlines"


def test_faults_are_named():
    assert read_metadata("") == read_metadata("# only a title\n")
    with pytest.raises(ValueError, match="no time column"):
        prep_spec(read_metadata(""))
    with pytest.raises(ValueError, match="no columns"):
        prep_spec(read_metadata("## 时间列\nt\n"))
    with pytest.raises(ValueError, match="no JSON"):
        read_metadata("## 有效值域\nnot json\n")
    with pytest.raises(ValueError, match="has no unit"):
        prep_spec(read_metadata("## 时间列\nt\n## 目标单位\np: pa\n"), ["t", "p"])


def test_a_document_runs_the_chain(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=i), {3: "4999", 7: "NA"}.get(i, "1.5"), "on" if i % 2 else "off", str(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, p string, mode string, y string")
    spec = prep_spec(read_metadata(CLEAN.replace('"p": [4999]', '"p": [4999000]').replace("[0, 5000]", "[0, 9000000]")))
    out = prep.run_chain([df.withColumn("y", df.y.cast("int"))], spec).orderBy("time").collect()
    assert len(out) == 20 and {r.p for r in out} == {1500.0} and [r.mode for r in out[:2]] == ["0", "1"] and [r.y for r in out[:2]] == [0, 1]


def test_series_are_resampled_apart(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(minutes=i + 1000 * k), float(i)) for k in (0, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, v double")
    out = prep.run_chain([df], prep.PrepSpec(time="t", columns=["v"], partition_by=["k"])).orderBy("k", "t").collect()
    assert [(r.k, r.t, r.v) for r in out] == rows and {r.segment for r in out} == {1}
