"""Sinks: Parquet, CSV with a byte order mark, Markdown, keyed appends, routed outputs, dashboard payloads."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylark.session import stored


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replace the table at path; by: partition columns."""
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str, most: int = 10_000) -> int:
    """One CSV file with a byte order mark, for spreadsheets: a report, `most` rows at most, else an error."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows; use write_csv")
    rows.to_csv(path, index=False, encoding="utf-8-sig")
    return len(rows)


def small(df: DataFrame, most: int) -> list:
    """The rows of a table that a report shows whole: more than `most` are an error, none is left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report shows at most {most} rows")
    return rows


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A table as Markdown; more than `most` rows are an error."""
    cell = lambda x: "" if x is None else f"{x:.4f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in small(df, most)])


#: Parts by key hash of a table that keyed writers keep.
PARTS = 64


def _parted(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))


def _existing(df: DataFrame, path: str, parts: list[int]) -> DataFrame | None:
    """The parts of the table at path; None if there is no table yet."""
    try:
        return df.sparkSession.read.parquet(path).where(F.col("_part").isin(parts))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key the table at path doesn't have: writing the same rows again changes nothing. The table is dealt
    into folders by a hash of the key, and only the folders that the batch falls into are read."""
    rows = stored(_parted(df.dropDuplicates(keys), keys), "batch")
    old = _existing(rows, path, [r["_part"] for r in rows.select("_part").distinct().collect()])  # PARTS numbers at most
    if old is not None:
        rows = stored(rows.join(old.select("_part", *keys), ["_part", *keys], "left_anti"), "batch")
    n = rows.count()
    if n:
        rows.write.mode("append").partitionBy("_part").parquet(path)
    return n


def upsert(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the rows of the table at path that have a key of df, and add the others; the folders of other keys stay as they
    are. df: one row a key."""
    rows = stored(_parted(df, keys), "batch")
    old = _existing(rows, path, [r["_part"] for r in rows.select("_part").distinct().collect()])
    if old is not None:
        rows = stored(rows.unionByName(old.join(rows, ["_part", *keys], "left_anti")), "merged")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)


def read_keyed(spark, path: str) -> DataFrame:
    """A table of append_new or upsert."""
    return spark.read.parquet(path).drop("_part")


def write_half(df: DataFrame, column: str, path: str) -> None:
    """df with an array of numbers as bytes of half-precision floats, two each, little-endian."""

    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, np.float32).astype("<f2").tobytes())

    df.withColumn(column, F.pandas_udf(packed, "binary")(column)).write.mode("overwrite").parquet(path)


def read_half(spark, path: str, column: str) -> DataFrame:
    def unpacked(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.frombuffer(v, "<f2").astype(np.float32))

    rows = spark.read.parquet(path)
    return rows.withColumn(column, F.pandas_udf(unpacked, "array<float>")(column))


def write_workbook(df: DataFrame, path: str, choices: dict[str, list[str]] | None = None, most: int = 10_000) -> int:
    """One sheet with a header row and inline strings; choices: the values that a column's drop-down list allows. A sheet for
    people to fill in: more than `most` rows are an error."""
    rows = small(df, most)
    letter = lambda k: (letter(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)
    cell = lambda x: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>' if x is not None else "<c/>"
    lines = ["".join(map(cell, r)) for r in [df.columns, *rows]]
    lists = [f'<dataValidation type="list" allowBlank="1" sqref="{letter(k)}2:{letter(k)}{len(rows) + 1}"><formula1>"{escape(",".join(choices[c]))}"</formula1></dataValidation>' for k, c in enumerate(df.columns) if c in (choices or {})]
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind, package = "application/vnd.openxmlformats-officedocument.spreadsheetml", "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="labels" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{main}"><sheetData>{"".join(f"<row>{line}</row>" for line in lines)}</sheetData>{f"""<dataValidations count="{len(lists)}">{"".join(lists)}</dataValidations>""" if lists else ""}</worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, said in files.items():
            out.writestr(name, said)
    return len(rows)


def package(folders: list[str], path: str, suffixes: tuple[str, ...] = ()) -> list[str]:
    """A ZIP archive of the files of some folders (with some suffixes, if named); their names in it."""
    names = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder in map(Path, folders):
            for file in sorted(f for f in folder.rglob("*") if f.is_file() and "__pycache__" not in f.parts and (not suffixes or f.suffix in suffixes)):
                names.append(str(file.relative_to(folder.parent)))
                out.write(file, names[-1])
    return names


def write_routed(df: DataFrame, route: Column, path: str) -> None:
    """One folder for each value of route (related, irrelevant, failed)."""
    df.withColumn("route", route).write.mode("overwrite").partitionBy("route").parquet(path)


def dashboard(template: str, payload: dict[str, DataFrame], path: str, most: int = 5000) -> None:
    """A page: the template with /*DATA*/ replaced by the JSON of tables of at most `most` rows; more are an error."""
    data = {name: [json.loads(r[0]) for r in small(df.select(F.to_json(F.struct("*"))), most)] for name, df in payload.items()}
    Path(path).write_text(template.replace("/*DATA*/", json.dumps(data, ensure_ascii=False).replace("</", "<\\/")), encoding="utf-8")
