"""Sources: string CSV with checks, unions of unlike files, workbooks, delimited tables, event logs, vectors."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylark.session import ship


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str], **tags: str) -> DataFrame:
    """A CSV with a header, every column a string, quotes doubled, line breaks inside quotes; tags become literal columns.

    Columns are taken by name; those that the file lacks are null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    names = {c.lstrip("\ufeff").strip('"'): c for c in raw.columns}
    return raw.select(*((F.col(f"`{names[c]}`") if c in names else F.lit(None).cast("string")).alias(c) for c in columns), *(F.lit(v).alias(k) for k, v in tags.items()))


def read_files(spark: SparkSession, files: list[tuple[str, dict]], columns: list[str]) -> DataFrame:
    """Several CSVs under one another, each with its tags and its place in the list (file_order)."""
    out = None
    for k, (path, tags) in enumerate(files):
        part = read_csv(spark, path, columns, **tags).withColumn("file_order", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def check_csv(spark: SparkSession, path: str, columns: list[str], key: str, payload: list[str], hash_column: str) -> dict:
    """What is wrong with an appended CSV: missing or foreign columns, repeated keys, rows whose hash isn't their payload's."""
    header = [c.lstrip("\ufeff") for c in spark.read.option("header", True).csv(path).columns]
    if set(header) != set(columns):
        return {"missing": sorted(set(columns) - set(header)), "foreign": sorted(set(header) - set(columns)), "repeated": 0, "changed": 0}
    rows = read_csv(spark, path, columns)
    right = F.sha2(F.to_json(F.struct(*sorted(payload)), {"ignoreNullFields": "false"}), 256)
    found = rows.agg((F.count("*") - F.count_distinct(key)).alias("repeated"), F.count_if(right != F.col(hash_column)).alias("changed")).first()
    return {"missing": [], "foreign": [], **found.asDict()}


def column_number(reference: str) -> int:
    """0 for A1, 27 for AB3."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_cells(data: bytes, sheets: list[str] | None = None) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a workbook: shared, inline and plain values; missing cells are None."""
    tag = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ET.fromstring(book.read("xl/sharedStrings.xml")) if tag(si) == "si"]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (e for e in ET.fromstring(book.read("xl/workbook.xml")).iter() if tag(e) == "sheet"):
            name = sheet.get("name")
            if sheets and name not in sheets:
                continue
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for number, row in enumerate(e for e in ET.fromstring(book.read(path)).iter() if tag(e) == "row"):
                cells: dict[int, str | None] = {}
                for at, cell in enumerate(c for c in row if tag(c) == "c"):
                    k = column_number(cell.get("r")) if cell.get("r") else at
                    if cell.get("t") == "inlineStr":
                        cells[k] = "".join(t.text or "" for t in cell.iter() if tag(t) == "t")
                    else:
                        v = next((x.text for x in cell if tag(x) == "v"), None)
                        cells[k] = shared[int(v)] if v is not None and cell.get("t") == "s" else v
                yield name, number, [cells.get(k) for k in range(max(cells, default=-1) + 1)]


def read_workbooks(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """path, sheet, row, cells (array of strings) of workbooks, one task a file."""
    ship(spark)

    def run(batches):
        for pdf in batches:
            rows = [(p, s, r, c) for p, data in zip(pdf.path, pdf.content) for s, r, c in workbook_cells(data, sheets)]
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells array<string>")


def sheet_table(cells: DataFrame, columns: list[str], header_row: int = 0) -> DataFrame:
    """Rows below the header as named string columns (by the header's text); rows without any value are dropped."""
    header = cells.where(F.col("row") == header_row).select("path", "sheet", F.col("cells").alias("_h"))
    rows = cells.where(F.col("row") > header_row).join(F.broadcast(header), ["path", "sheet"])
    pick = lambda c: F.get(F.col("cells"), F.array_position(F.transform("_h", lambda x: F.trim(x)), c).cast("int") - 1)
    return rows.select("path", "sheet", "row", *(F.when(F.array_contains(F.transform("_h", lambda x: F.trim(x)), c), pick(c)).alias(c) for c in columns)).na.drop("all", subset=columns)


def price_rows(table: DataFrame, names: dict[str, str]) -> DataFrame:
    """date, ticker, close, volume, value_bn from a string table; rows without a date, ticker or close are dropped."""
    t = table.select(*(F.trim(F.col(old)).alias(new) for old, new in names.items()))
    t = t.withColumns({"date": F.coalesce(F.col("date").try_cast("date"), F.try_to_timestamp("date", F.lit("dd/MM/yyyy")).cast("date")), "close": F.col("close").try_cast("double"), "volume": F.col("volume").try_cast("double")})
    return t.na.drop(subset=["date", "ticker", "close"]).withColumn("value_bn", F.col("close") * F.col("volume") * 1000 / 1e9)


def embedded_table(spark: SparkSession, text: str, columns: list[str], key: str, rows: int | None = None, sep: str = "|") -> DataFrame:
    """A delimited constant as a table of strings; a wrong number of fields or rows, or a repeated key, is an error."""
    cut = [[c.strip() for c in line.split(sep)] for line in text.strip().splitlines()]
    if bad := [k for k, r in enumerate(cut) if len(r) != len(columns)]:
        raise ValueError(f"rows {bad} have another number of fields than {len(columns)}")
    keys = [r[columns.index(key)] for r in cut]
    if len(set(keys)) != len(keys) or rows not in (None, len(cut)):
        raise ValueError("repeated keys or another number of rows")
    return spark.createDataFrame(cut, strings(columns))


def read_log(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """The last state of each key in an append-only log of lines {"key", "saved", "sum", "data"}; a line that is torn or
    whose sum isn't its data's SHA-256 is left out."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    rows = lines.withColumn("r", F.from_json("value", "key string, saved string, sum string, data string")).select("r.*", "line")
    good = rows.where(F.col("key").isNotNull() & (F.sha2("data", 256) == F.col("sum")))
    last = good.groupBy("key").agg(F.max_by(F.struct("saved", "data"), F.struct("saved", "line")).alias("l"))
    return last.select("key", "l.saved", F.from_json("l.data", payload).alias("data"))


def read_vectors(spark: SparkSession, path: str, ids: DataFrame, order: str, key: str) -> DataFrame:
    """key, vec of a NumPy matrix of as many rows as ids, row k for the k-th id in order. Vectors are kept as Parquet
    thereafter; the matrix is read by one task, as a file without parts must be."""
    import numpy as np
    from pyspark.sql import Window

    def run(batches):
        for pdf in batches:
            for data in pdf.content:
                m = np.load(io.BytesIO(data), allow_pickle=False)
                for a in range(0, len(m), 1000):
                    part = m[a : a + 1000].astype("float32")
                    yield pd.DataFrame({"row": np.arange(a, a + len(part)), "vec": list(part)})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, vec array<float>")
    numbered = ids.select(key, (F.row_number().over(Window.orderBy(order)) - 1).cast("long").alias("row"))
    return numbered.join(rows, "row").select(key, "vec")
