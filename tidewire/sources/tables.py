"""Text and table sources: labelled flow datasets, feature tables, flow labels."""

from __future__ import annotations

import csv
import io
import logging
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.scalar import norm_label
from tidewire.operators.features import all_finite
from tidewire.schemas import FEATURE_NAMES, FEATURE_TABLE, FLOW_LABELS

log = logging.getLogger(__name__)

#: More files than this have their headers read by tasks.
FEW_FILES = 64

# fixed values: the columns of a binetflow file
BINETFLOW_COLUMNS = [
    "StartTime", "Dur", "Proto", "SrcAddr", "Sport", "Dir", "DstAddr", "Dport",
    "State", "sTos", "dTos", "TotPkts", "TotBytes", "SrcBytes", "Label",
]
# the dataset is packed under one of these folder names and cited under the other
CIC_FOLDERS = ("MachineLearningCSV", "MachineLearningCVE")
SCENARIO_PATTERN = r"/(\d{1,2})/[^/]+\.binetflow(?:/[^/]*)?$"


def _hadoop(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted data files that match; a folder stands for the files in it."""
    fs, jpath = _hadoop(spark, pattern)
    found = []
    for status in fs.globStatus(jpath) or []:
        if status.isDirectory():
            inside = fs.listStatus(status.getPath())
            found += [s.getPath().toString() for s in inside
                      if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
        else:
            found.append(status.getPath().toString())
    return sorted(found)


def resolve_inputs(spark: SparkSession, pattern: str) -> list[str]:
    """Files of a pattern; where nothing matches, the other spelling of the dataset folder is tried."""
    matches = glob_paths(spark, pattern)
    for name, other in (CIC_FOLDERS, CIC_FOLDERS[::-1]):
        if not matches and name in pattern:
            matches = glob_paths(spark, pattern.replace(name, other))
            if matches:
                log.info("using %s instead of %s", other, name)
    if not matches:
        raise FileNotFoundError(f"nothing found under {pattern}")
    return matches


def normalise_headers(names: list[str]) -> list[str]:
    """Blanks trimmed and runs of blanks collapsed; a repeated name gets a number."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        clean = " ".join(name.replace("﻿", "").split())
        seen[clean] = seen.get(clean, 0) + 1
        out.append(clean if seen[clean] == 1 else f"{clean}_{seen[clean] - 1}")
    return out


def read_header(spark: SparkSession, path: str) -> list[str]:
    fs, jpath = _hadoop(spark, path)
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(jpath), "UTF-8"))
    try:
        line = reader.readLine()
    finally:
        reader.close()
    return next(csv.reader([line])) if line else []


def read_headers(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """The header of each file: a few files from here, many by tasks (and those that tasks cannot open from here)."""
    found: dict[str, list[str] | None] = {}
    if len(paths) > FEW_FILES:
        def first_lines(batches):
            for batch in batches:
                yield batch.assign(header=[_first_line(p) for p in batch["path"]])

        listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(-(-len(paths) // FEW_FILES))
        for row in listed.mapInPandas(first_lines, "path string, header string").collect():      # a line per listed file
            found[row["path"]] = None if row["header"] is None else next(csv.reader([row["header"]]), [])
    left = [p for p in paths if found.get(p) is None]
    with ThreadPoolExecutor(8) as pool:
        found.update(zip(left, pool.map(lambda p: read_header(spark, p), left)))
    return [found[p] for p in paths]


def _first_line(path: str) -> str | None:
    from tidewire.sources.capture import open_file

    try:
        with io.BufferedReader(open_file(path), 1 << 16) as f:
            return f.readline().decode("utf-8", "replace").rstrip("\r\n")
    except Exception:  # noqa: BLE001  a store that Arrow does not know
        return None


def union_files(frames: list[DataFrame]) -> DataFrame:
    """All rows; a column that some inputs lack is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def scan_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files, every column as text, headers normalised, plus `file_path` and `block_start`.

    Files with the same header are one scan, however many they are; different headers meet in a union.
    """
    headers = [tuple(normalise_headers(h)) for h in read_headers(spark, paths)]
    groups: dict[tuple, list[str]] = {}
    for path, header in zip(paths, headers):
        if header:
            groups.setdefault(header, []).append(path)
    frames = []
    for header, members in groups.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        frames.append(
            spark.read.schema(schema).option("header", True).option("enforceSchema", True)
            .csv(members).select("*", F.col("_metadata.file_path").alias("file_path"),
                                 F.col("_metadata.file_block_start").alias("block_start"))
        )
    return union_files(frames)


def cic_scan(spark: SparkSession, pattern: str) -> DataFrame:
    return scan_text(spark, resolve_inputs(spark, pattern)).drop("file_path", "block_start")


def scenario_of(path: Column) -> Column:
    """Scenario number in a path like `<number>/<name>.binetflow`, else 0."""
    return F.coalesce(F.regexp_extract(path, SCENARIO_PATTERN, 1).try_cast("int"), F.lit(0))


def binetflow_scan(spark: SparkSession, pattern: str) -> DataFrame:
    raw = scan_text(spark, resolve_inputs(spark, pattern))
    lacking = missing_columns(raw, BINETFLOW_COLUMNS)
    if lacking:
        log.warning("binetflow input lacks columns: %s", lacking)
    return raw.withColumn("scenario", scenario_of(F.col("file_path"))).drop("file_path", "block_start")


def unknown_labels(table: DataFrame) -> DataFrame:
    """The label words outside the vocabulary, each once."""
    word = F.lower(F.trim(F.col("label").cast("string")))
    return table.filter(norm_label(F.col("label")).isNull()).select(word.alias("label")).distinct()


def check_labels(table: DataFrame) -> DataFrame:
    """The table itself with `label` as 0/1, after a check for unknown words."""
    unknown = unknown_labels(table)
    if not unknown.isEmpty():
        n, words = unknown.count(), [str(r[0]) for r in unknown.orderBy("label").take(100)]
        raise ValueError(f"{n} label words outside the vocabulary (unknown_labels() has all of them): {words}")
    return table.withColumn("label", norm_label(F.col("label")))


def load_features(table: DataFrame, check: bool = True) -> DataFrame:
    """A feature table made safe for training: columns checked, labels 0/1, non-finite rows dropped."""
    if "label" not in table.columns:
        raise ValueError("table lacks the 'label' column")
    lacking = missing_columns(table, FEATURE_NAMES)
    if lacking:
        raise ValueError(f"table lacks {len(lacking)} feature columns: {lacking[:5]}")
    labelled = check_labels(table) if check else table.withColumn("label", norm_label(F.col("label")))
    return finite_features(labelled)


def finite_features(table: DataFrame) -> DataFrame:
    return table.filter(all_finite())


def feature_table_scan(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Reads a stored feature table. CSV columns are taken by name from the header."""
    if fmt == "parquet":
        return load_features(spark.read.parquet(path))
    raw = scan_text(spark, resolve_inputs(spark, path)).drop("file_path", "block_start")
    types = {f.name: f.dataType for f in FEATURE_TABLE.fields if f.name != "label"}
    return load_features(raw.withColumns({n: F.col(n).try_cast(t) for n, t in types.items() if n in raw.columns}))


def label_table_scan(spark: SparkSession, path: str) -> DataFrame:
    """Flow labels with `label` 0/1 and `row_no`, which orders rows by file path, then by position within the file.

    Files may be read in any order and in blocks, so `row_no` is (path, start of the block, place among the rows of one task).
    """
    raw = scan_text(spark, resolve_inputs(spark, path))
    lacking = missing_columns(raw, FLOW_LABELS.names)
    if lacking:
        raise ValueError(f"labels lack columns: {lacking}")
    numbered = raw.withColumn("row_no", F.struct("file_path", "block_start", F.monotonically_increasing_id().alias("place")))
    return check_labels(numbered.select("flow_id", "label", "row_no"))


def write_features(table: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Parquet partitioned by scenario where there is one, or CSV with a header."""
    writer = table.write.mode(mode)
    if fmt == "parquet":
        if "scenario" in table.columns:
            writer = writer.partitionBy("scenario")
        writer.parquet(path)
    else:
        writer.option("header", True).csv(path)
