"""Metadata documents of the preparation stages: Markdown sections to settings, and to a ``PrepSpec``.

All stages write sections of the same kinds (a table by its header, a list, one value, a JSON block),
so one reader serves them; a stage takes the parts that it knows.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from tidemark.operators.prep import PrepSpec, canonical

#: Heads of sections.
TIME, LABELS, CATEGORIES, SKIPPED = "时间列", "标注列", "类别列", "跳过的文件"
COLUMNS, TARGET_UNITS, MAPS, RANGES, SENTINELS = "列清单", "目标单位", "类别映射", "有效值域", "哨兵值"
PATTERN, FILE, INTERVAL, MISSING = "分片形态", "文件", "目标网格间隔", "区间缺失阈值"
SUMMARY, NOTES = "全流程摘要", "备注"
#: Heads of table columns, and a setting within a file's section.
NAME, TYPE, UNIT, ROLE, SOURCE, STEP, TIME_TYPE = "列名", "数据类型", "单位", "角色", "来源", "步骤", "时间类型"
#: Other heads of the same columns.
SAME = {"类型": TYPE}


@dataclass(frozen=True)
class FileFacts:
    """What a document says of one input file."""

    time: str | None = None
    time_type: str | None = None
    columns: dict[str, dict[str, str | None]] = field(default_factory=dict)


@dataclass(frozen=True)
class Metadata:
    """Everything that a document says; what it leaves out is empty."""

    time: str | None = None
    labels: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    columns: dict[str, dict[str, str | None]] = field(default_factory=dict)
    target_units: dict[str, str] = field(default_factory=dict)
    maps: dict[str, dict[str, int]] = field(default_factory=dict)
    ranges: dict[str, list[float]] = field(default_factory=dict)
    sentinels: dict[str, list[float]] = field(default_factory=dict)
    pattern: str | None = None
    files: dict[str, FileFacts] = field(default_factory=dict)
    interval: float | None = None
    missing: int | None = None
    summary: list[dict[str, str | None]] = field(default_factory=list)
    notes: str = ""


def _bare(cell: str) -> str:
    return cell.strip().strip("`\"").strip()


def _sections(text: str) -> list[tuple[str, str]]:
    parts = re.split(r"^##\s+(.+?)\s*$", text.lstrip("﻿"), flags=re.M)
    return list(zip(parts[1::2], parts[2::2], strict=True))


def _table(body: str) -> list[dict[str, str | None]]:
    """Rows by the names of the header; - is an empty cell."""
    rows = [[_bare(c) for c in line.strip().strip("|").split("|")] for line in body.splitlines() if line.strip().startswith("|")]
    rows = [r for r in rows if not all(set(c) <= set("-: ") for c in r)]
    if not rows:
        return []
    head = [SAME.get(c, c) for c in rows[0]]
    return [{h: None if c in ("", "-") else c for h, c in zip(head, r, strict=False)} for r in rows[1:]]


def _list(body: str) -> list[str]:
    """Items by line, by bullet or by comma."""
    lines = [re.sub(r"^[-*]\s+", "", line.strip()) for line in body.splitlines()]
    return [b for line in lines for b in (_bare(x) for x in re.split("[,，]", line)) if b]


def _block(body: str, head: str) -> dict[str, Any]:
    text = re.sub(r"^```\w*\s*$", "", body, flags=re.M).strip()
    if not text:
        return {}
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"section {head} is no JSON: {e}") from e


def _number(body: str) -> float | None:
    m = re.search(r"\d+(?:\.\d+)?", body)
    return float(m[0]) if m else None


def _named(body: str) -> dict[str, str]:
    """``name: value`` lines, with or without bullets and stars."""
    pairs = (re.match(r"^[-*]?\s*\**`?([^:：*`]+?)`?\**\s*[:：]\s*(.+)$", line.strip()) for line in body.splitlines() if not line.strip().startswith("|"))
    return {_bare(m[1]): _bare(m[2]) for m in pairs if m}


def read_metadata(text: str) -> Metadata:
    """A document's settings. Later sections of a head add to earlier ones' lists and tables."""
    out: dict[str, Any] = {"labels": [], "categories": [], "skipped": [], "columns": {}, "files": {}, "summary": []}
    for head, body in _sections(text):
        if m := re.match(rf"{FILE}\s*[:：]\s*(.+)", head):
            said = _named(body)
            table = {r[NAME]: {"type": r.get(TYPE), "unit": r.get(UNIT)} for r in _table(body) if r.get(NAME)}
            out["files"][_bare(m[1])] = FileFacts(said.get(TIME), said.get(TIME_TYPE), table)
        elif head == COLUMNS:
            out["columns"] |= {r[NAME]: {"type": r.get(TYPE), "unit": r.get(UNIT), "role": r.get(ROLE), "source": r.get(SOURCE)} for r in _table(body) if r.get(NAME)}
        elif head in (LABELS, CATEGORIES, SKIPPED):
            kind = {LABELS: "labels", CATEGORIES: "categories", SKIPPED: "skipped"}[head]
            out[kind] += [c for c in _list(body) if c not in out[kind]]
        elif head in (MAPS, RANGES, SENTINELS):
            out[{MAPS: "maps", RANGES: "ranges", SENTINELS: "sentinels"}[head]] = _block(body, head)
        elif head == TIME:
            out["time"] = next(iter(_list(body)), None)
        elif head == TARGET_UNITS:
            out["target_units"] = _named(body)
        elif head == PATTERN:
            m = re.match(r"\s*([A-F])\b", body)
            out["pattern"] = m[1] if m else None
        elif head == INTERVAL:
            out["interval"] = _number(body)
        elif head == MISSING:
            out["missing"] = int(_number(body)) if _number(body) is not None else None
        elif head == SUMMARY:
            out["summary"] += [r for r in _table(body) if r.get(STEP)]
        elif head == NOTES:
            out["notes"] = body.strip()
    for name, facts in out["columns"].items():
        role = (facts["role"] or "").lower()
        if ("标注" in role or "label" in role) and name not in out["labels"]:
            out["labels"].append(name)
        if ("类别" in role or "category" in role) and name not in out["categories"]:
            out["categories"].append(name)
        if out.get("time") is None and ("时间" in role or role == "time"):
            out["time"] = name
    return Metadata(**out)


def prep_spec(m: Metadata, columns: list[str] | None = None, partition_by: list[str] | None = None) -> PrepSpec:
    """The chain that a document asks for. ``columns`` where it lists none; a column with a target unit needs one of its own."""
    if m.time is None:
        raise ValueError(f"no time column: neither a section {TIME} nor a role names one")
    listed = [c for c in (m.columns or columns or []) if c != m.time]
    if not listed:
        raise ValueError(f"no columns: the section {COLUMNS} is missing")
    units = {}
    for c, target in m.target_units.items():
        own = m.columns.get(c, {}).get("unit")
        if own is None:
            raise ValueError(f"{c} is to become {target}, but has no unit")
        if canonical(own) != canonical(target):
            units[c] = (own, target)
    return PrepSpec(
        time=m.time,
        columns=listed,
        labels=[c for c in m.labels if c in listed],
        categories=[c for c in dict.fromkeys([*m.categories, *m.maps]) if c in listed],
        units=units,
        ranges={c: (float(r[0]), float(r[1])) for c, r in m.ranges.items()},
        sentinels={c: [float(v) for v in (s if isinstance(s, list) else [s])] for c, s in m.sentinels.items()},
        seconds=int(m.interval) if m.interval else None,
        k=m.missing if m.missing is not None else PrepSpec.k,
        maps=m.maps,
        partition_by=partition_by or [],
    )
