"""Table sources and sinks: text tables, drifting schemas, resumable appends, manifests, books."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of column names that tell of labels; decision plans must not use such columns.
FORBIDDEN = ("actual", "label", "truth", "ground", "annotation", "review")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark reads it from."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_text_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header, every column text unless a schema says otherwise; a byte-order mark on
    the first name goes, and empty cells are null."""
    reader = spark.read.option("header", True).option("nullValue", "").option("mode", "PERMISSIVE")
    frame = reader.schema(schema).csv(path) if schema else reader.csv(path)
    first = frame.columns[0] if frame.columns else ""
    return frame.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else frame


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table, or an empty one of that schema where there is none."""
    return read_text_table(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def resolve(frame: DataFrame, aliases: list[str]) -> str | None:
    """First alias that is a column: exact, then in any case."""
    low = {c.lower(): c for c in frame.columns}
    return next((a for a in aliases if a in frame.columns), None) or next((low[a.lower()] for a in aliases if a.lower() in low), None)


def renamed(frame: DataFrame, names: dict[str, list[str]], required: bool = True) -> DataFrame:
    """Columns under their canonical names; a missing one is null, or an error if required."""
    out = []
    for name, aliases in names.items():
        found = resolve(frame, [name, *aliases])
        if found is None and required:
            raise ValueError(f"no column for {name} among {frame.columns}")
        out.append((F.col(f"`{found}`") if found else F.lit(None)).alias(name))
    return frame.select(*out)


def forbidden(columns: list[str]) -> list[str]:
    """Names that match a pattern, or hold `gt` as a word of their own."""
    return [c for c in columns if any(p in c.lower() for p in FORBIDDEN) or "gt" in re.split(r"[^a-z0-9]+", c.lower())]


def is_forbidden(name: Column | str) -> Column:
    """The same for names that are data, in any case; a missing name is not forbidden."""
    words = "|".join((*FORBIDDEN, "(^|[^a-z0-9])gt([^a-z0-9]|$)"))
    return F.coalesce(F.lower(F.col(name) if isinstance(name, str) else name).rlike(words), F.lit(False))


def guarded(frame: DataFrame) -> DataFrame:
    """The frame, if no column tells of labels."""
    if bad := forbidden(frame.columns):
        raise ValueError(f"decision plan uses label columns: {bad}")
    return frame


def only_splits(frame: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows of allowed splits; any other makes the query fail."""
    ok = F.col(column).isin(*allowed)
    return frame.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("split not allowed: "), F.coalesce(F.col(column), F.lit("null"))))))


def json_list(cell: Column | str) -> Column:
    """Array of text from a JSON array in a cell; unreadable or missing is empty."""
    c = F.col(cell) if isinstance(cell, str) else cell
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def split_list(cell: Column | str) -> Column:
    """Items between semicolons, commas or bars, trimmed, empty ones dropped."""
    c = F.col(cell) if isinstance(cell, str) else cell
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,|]"), lambda x: F.trim(x)), lambda x: x != "")


def write_text_table(frame: DataFrame, path: str, columns: list[str]) -> None:
    """CSV of declared columns in their order, fractions with six decimals, missing ones empty."""
    have = dict(frame.dtypes)
    out = [(F.format_string("%.6f", F.col(c)) if have[c] in ("double", "float") else F.col(c)).alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]
    out = [F.when(F.col(c).isNotNull(), x).alias(c) if have.get(c) in ("double", "float") else x for c, x in zip(columns, out, strict=True)]
    frame.select(*out).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def append_new(frame: DataFrame, path: str, key: str) -> DataFrame:
    """Appends rows whose key the table at path does not hold, and returns the whole table: a
    rerun after a failure does only what is missing. Parquet's commit makes a try whole or void.
    Of rows that repeat a key the one of the smallest hash is appended, in any layout."""
    spark = frame.sparkSession
    first = Window.partitionBy(F.col(f"`{key}`")).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in frame.columns]))
    once = frame.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    if exists(spark, path):
        once = once.join(spark.read.parquet(path).select(key), key, "left_anti")
    once.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_manifest(frame: DataFrame, path: str, key: str, parts: list[str]) -> None:
    """One JSON object a key with its ordered parts."""
    frame.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("parts")).write.mode("overwrite").json(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """One-row frame of a nested JSON configuration."""
    return spark.read.option("multiLine", True).json(path)


def overlay(base: dict, changes: dict) -> dict:
    """base with changes merged in at every level."""
    return base | {k: overlay(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in changes.items()}


def overlaid(base: Column | str, changes: Column | str, depth: int = 1) -> Column:
    """Maps of maps with changes merged in at every level, the last of which is at `depth` below.
    A key of the changes wins even with a null; a missing map stands for an empty one."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (base, changes))
    inner = (lambda k, x, y: F.when(F.map_contains_key(b, k), y).otherwise(x)) if depth == 0 else (lambda k, x, y: F.when(x.isNull(), y).when(y.isNull() & ~F.map_contains_key(b, k), x).when(y.isNull(), y).otherwise(overlaid(x, y, depth - 1)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_zip_with(a, b, inner))


def inventory(spark: SparkSession, pattern: str) -> DataFrame:
    """Files under a pattern: path, bytes, time of change, extension, without their content."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime")
    return files.withColumn("kind", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))


def term_usage(spark: SparkSession, pattern: str, terms: list[str]) -> DataFrame:
    """Occurrences of terms per file."""
    files = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", *[F.regexp_count("value", F.lit(re.escape(t))).alias(t) for t in terms])


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def sheet_rows(content: bytes, sheet: int = 1) -> list[list[str | None]]:
    """Cells of a sheet of an XLSX file, from its XML parts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        tree = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    out = []
    for row in tree.iter(f"{_SHEET}row"):
        cells: dict[int, str | None] = {}
        for cell in row.iter(f"{_SHEET}c"):
            letters = re.match(r"[A-Z]+", cell.get("r", "A")).group()
            at = 0
            for c in letters:
                at = at * 26 + ord(c) - 64
            value = cell.find(f"{_SHEET}v")
            text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t")) if cell.get("t") == "inlineStr" else None if value is None else value.text
            cells[at - 1] = shared[int(text)] if cell.get("t") == "s" and text is not None else text
        out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return out


def sheet_numbers(content: bytes) -> list[int]:
    """Numbers of a book's sheet parts, in the order of the book where it tells one."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        have = sorted(int(m.group(1)) for m in (re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n) for n in z.namelist()) if m)
        if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(z.namelist()):
            return have
        targets = {r.get("Id"): re.search(r"worksheets/sheet(\d+)\.xml$", r.get("Target", "")) for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        told = [targets.get(s.get(f"{_REL}id")) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")]
    first = [int(m.group(1)) for m in told if m and int(m.group(1)) in have]
    return first + [k for k in have if k not in first]


def header_of(rows: list[list[str | None]], names: dict[str, list[str]]) -> tuple[int, dict[str, int]]:
    """(row number, name to column) of the row that names most of the wanted columns."""
    best: tuple[int, dict[str, int]] = (0, {})
    for k, row in enumerate(rows[:20]):
        cells = [(c or "").strip().lower() for c in row]
        found = {n: cells.index(a) for n, aliases in names.items() for a in [n, *aliases] if a in cells}
        if len(found) > len(best[1]):
            best = (k, found)
    return best


def read_book(spark: SparkSession, path: str, names: dict[str, list[str]], sheet: int | None = None) -> DataFrame:
    """Rows of XLSX files with columns found by their header, all text, one task a file. Without
    a sheet number, the sheet whose header names most of the columns is read, the first of equals."""
    wanted = list(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"], strict=True):
                sheets = [sheet_rows(content, k) for k in (sheet_numbers(content) if sheet is None else [sheet])]
                rows = max(sheets, key=lambda s: len(header_of(s, names)[1]), default=[])
                at, columns = header_of(rows, names)
                body = [[where, *((r[columns[n]] if n in columns and columns[n] < len(r) else None) for n in wanted)] for r in rows[at + 1 :]]
                yield pd.DataFrame(body, columns=["path", *wanted], dtype=object)

    schema = ", ".join(f"`{c}` string" for c in ["path", *wanted])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
