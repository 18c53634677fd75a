"""Tables in and out: csv, tsv, parquet, json; configurations; scans of whole folders."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = {".csv": ",", ".tsv": "\t"}
RESERVED = (".mat", ".h5", ".hdf5")


def read_table(spark: SparkSession, path: str, typed: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """A table by its suffix. ``typed`` False reads every csv cell as it stands, as text."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in RESERVED:
        raise ValueError(f"{suffix} is not supported")
    if suffix in SEPARATORS:
        reader = spark.read.option("header", True).option("sep", SEPARATORS[suffix]).option("encoding", encoding)
        return reader.option("inferSchema", True).csv(path) if typed else reader.option("inferSchema", False).option("nullValue", "\0").option("emptyValue", "").csv(path)
    if suffix == ".json":
        return spark.read.json(path)
    if suffix == ".orc":
        return spark.read.orc(path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, single: bool = False, partition_by: list[str] | None = None) -> None:
    """A table by the suffix of its path; one file for ``single``."""
    suffix = PurePosixPath(path).suffix.lower()
    out = (df.coalesce(1) if single else df).write.mode("overwrite").partitionBy(*(partition_by or []))
    if suffix in SEPARATORS:
        out.option("header", True).option("sep", SEPARATORS[suffix]).csv(path)
    elif suffix == ".json":
        out.json(path)
    elif suffix == ".orc":
        out.orc(path)
    else:
        out.parquet(path)


def scan_folder(spark: SparkSession, path: str, skip: list[str] | None = None) -> DataFrame:
    """All csv files under a folder as text cells with their ``file``; listed file names are left out."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("header", True).option("inferSchema", False).csv(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    out = df.withColumn("file", F.col("_metadata.file_path"))
    return out.filter(~name.isin(*skip)) if skip else out


def folder_files(spark: SparkSession, path: str) -> DataFrame:
    """The csv files under a folder: ``file``, ``size`` in bytes, ``skipped`` (empty, header only) or null; in lower-case order.

    Names and sizes are listed by the driver, as for any scan; Spark's own listing leaves empty files out.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, rows = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        f = found.next()
        if f.getPath().getName().lower().endswith(".csv"):
            rows.append((f.getPath().toUri().getPath(), f.getLen()))
    files = spark.createDataFrame(rows, "file string, size long")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path).filter(F.trim("value") != "")
    # URIs come escaped, with or without an authority; a plus sign in them is one.
    clear = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z0-9+.-]+:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    counted = lines.groupBy(clear.alias("file")).agg(F.count("*").alias("_n"))
    why = F.when(F.col("size") == 0, "empty").when(F.coalesce("_n", F.lit(0)) <= 1, "header only")
    return files.join(counted, "file", "left").select("file", "size", why.alias("skipped")).orderBy(F.lower("file"))


def _plain_json(text: str) -> str:
    """JSON without the comments and closing commas, which strings keep."""
    tokens = re.findall(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|[^"/]+|.', text, re.S)
    kept = [x for x in tokens if not x.startswith(("//", "/*"))]
    out: list[str] = []
    for x in re.findall(r'"(?:\\.|[^"\\])*"|[^"]+', "".join(kept)):
        out.append(x if x.startswith('"') else re.sub(r",(\s*[}\]])", r"\1", x))
    return "".join(out)


def read_config(spark: SparkSession, path: str) -> dict[str, Any]:
    """JSON, YAML or JSON with comments, by the suffix."""
    text = spark.read.text(path, wholetext=True).first()[0]
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(text)
    if suffix == ".json5":
        text = _plain_json(text)
    return json.loads(text)


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, indent=2, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_sections(text: str) -> dict[str, Any]:
    """A metadata document: ``## section`` heads, lists, two-column tables and fenced JSON blocks."""
    out: dict[str, Any] = {}
    name, block = "", None
    for line in text.splitlines():
        if block is not None:
            if line.strip().startswith("```"):
                out[name] = json.loads("\n".join(block))
                block = None
            else:
                block.append(line)
        elif line.startswith("## "):
            name = line[3:].strip()
            out[name] = []
        elif line.strip().startswith("```"):
            block = []
        elif line.strip().startswith(("- ", "* ")) and isinstance(out.get(name), list):
            out[name].append(line.strip()[2:].strip())
        elif line.strip().startswith("|") and isinstance(out.get(name), list):
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if not all(set(c) <= {"-", ":", " "} for c in cells):
                out[name].append(cells)
    return out


def report(title: str, tables: dict[str, DataFrame], rows: int = 200) -> str:
    """Markdown of small report tables."""
    parts = [f"# {title}"]
    for name, df in tables.items():
        found = df.limit(rows).collect()
        parts += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        parts += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found]
    return "\n".join(parts)
