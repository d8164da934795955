"""Reading and writing files by format.

``csv``, ``json`` (whole documents, such as an array of objects, or one object a line), ``parquet``, ``orc``, ``xlsx``
and, if pandas finds an engine for it, ``xls``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _csv(spark: SparkSession, path: str, schema: T.StructType | str | None, dates_as_strings: bool) -> DataFrame:
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", True).option("preferDate", True).csv(path)
    if not dates_as_strings:
        return df
    dated = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    ]
    # Inferred dates are read again as they stand in the file: a cast back could change how they are written.
    fields = [T.StructField(f.name, T.StringType() if f.name in dated else f.dataType) for f in df.schema.fields]
    return reader.schema(T.StructType(fields)).csv(path) if dated else df


def _json(spark: SparkSession, path: str, schema: T.StructType | str | None, dates_as_strings: bool) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook_rows(content: bytes) -> list[list[str | float | int | bool | None]]:
    """The cells of a workbook's first sheet, row by row: texts, numbers and booleans; empty cells are None. Dates are
    the numbers that stand in the file."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            items = ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")
            shared = ["".join(t.text or "" for t in i.iter(f"{SHEET}t")) for i in items]
        sheets = [n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]
        first = min(sheets, key=lambda n: (len(n), n))
        rows = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{SHEET}row"):
            cells: list = []
            for c in row.iter(f"{SHEET}c"):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                place = len(cells)
                if letters:
                    place = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1
                cells += [None] * (place + 1 - len(cells))
                v, kind = c.findtext(f"{SHEET}v"), c.get("t", "n")
                if kind == "inlineStr":
                    cells[place] = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                elif v is not None:
                    number = float(v) if kind == "n" else 0.0
                    cells[place] = (
                        shared[int(v)]
                        if kind == "s"
                        else v == "1"
                        if kind == "b"
                        else (int(number) if number.is_integer() and "." not in v else number)
                        if kind == "n"
                        else v
                    )
            rows.append(cells)
    return rows


def _excel(spark: SparkSession, path: str, schema: T.StructType | str | None, dates_as_strings: bool) -> DataFrame:
    """The first sheet, of a million rows at most by the format, with names in its first row; read through Spark, so from
    wherever it lies, and taken apart on the driver. Old binary workbooks need pandas' engine for them."""
    if path.endswith(".xls"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path), schema)
    head, *rows = workbook_rows(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])) or [[]]
    rows = [tuple((r + [None] * len(head))[: len(head)]) for r in rows]

    def kind(values: list) -> T.DataType:
        kinds = {type(v) for v in values if v is not None}
        if kinds == {bool}:
            return T.BooleanType()
        if kinds <= {int} and kinds:
            return T.LongType()
        return T.DoubleType() if kinds and kinds <= {int, float} else T.StringType()

    if schema is None:
        schema = T.StructType(
            [T.StructField(str(name), kind([r[i] for r in rows])) for i, name in enumerate(head)]
        )
        makes = {T.DoubleType(): float, T.StringType(): str}
        kinds = [makes.get(f.dataType, lambda v: v) for f in schema.fields]
        rows = [tuple(None if v is None else make(v) for v, make in zip(r, kinds, strict=True)) for r in rows]
    return spark.createDataFrame(rows, schema)


def _columnar(kind: str):
    def read(spark: SparkSession, path: str, schema: T.StructType | str | None, dates_as_strings: bool) -> DataFrame:
        reader = spark.read.format(kind)
        return (reader.schema(schema) if schema is not None else reader).load(path)

    return read


READERS = {
    "csv": _csv,
    "json": _json,
    "xlsx": _excel,
    "xls": _excel,
    "parquet": _columnar("parquet"),
    "orc": _columnar("orc"),
}


def scan(
    spark: SparkSession,
    path: str,
    file_format: str,
    schema: T.StructType | str | None = None,
    dates_as_strings: bool = True,
) -> DataFrame:
    """A lazy table over a file or folder.

    Without a schema, types are inferred where the format has none; CSV dates and times then stay strings unless
    ``dates_as_strings`` is off, so they count as categories. Give a schema in production: inference reads all rows.
    """
    if file_format not in READERS:
        raise ValueError(f"unknown format {file_format!r}; known: {', '.join(sorted(READERS))}")
    return READERS[file_format](spark, path, schema, dates_as_strings)


def extract_columns(spark: SparkSession, path: str, file_format: str) -> list[str]:
    """Column names of a file, without reading rows where the format allows; none if there is no such path."""
    try:
        if file_format == "csv":
            return spark.read.option("header", True).csv(path).columns
        return scan(spark, path, file_format).columns
    except (AnalysisException, FileNotFoundError) as e:
        if isinstance(e, FileNotFoundError) or e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def schema_table(df: DataFrame) -> DataFrame:
    """``position, column, dtype`` of a table."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def sink(df: DataFrame, path: str, file_format: str = "csv", mode: str = "errorifexists") -> None:
    """Write a folder of files, one for each partition; nothing passes through the driver."""
    if file_format == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif file_format in ("parquet", "orc", "json"):
        df.write.mode(mode).format(file_format).save(path)
    else:
        raise ValueError(f"can't write {file_format!r}")

