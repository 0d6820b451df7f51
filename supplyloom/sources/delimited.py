"""Delimited-text source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


# A quote inside a quoted cell is doubled, as spreadsheet exports and R write it.
QUOTING = {"quote": '"', "escape": '"'}


def csv_scan(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True,
    positional: bool = False, multi_line: bool = False, mode: str = "FAILFAST",
) -> DataFrame:
    """Read delimited text; both ``NA`` and empty cells are missing.

    Pass a schema for anything large: inferring one costs an extra pass.  Every
    file's header is checked against it; ``positional`` binds by place instead,
    for headers with blank cells.  Cells that do not fit their type are an error
    unless ``mode`` says otherwise.  ``multi_line`` allows line breaks inside
    quoted cells, but then a file is read by one task.
    """
    reader = spark.read.options(**QUOTING).option("header", header).option("nullValue", "NA")
    reader = reader.option("mode", mode).option("multiLine", multi_line)
    reader = reader.option("enforceSchema", positional or not header)
    if schema is None:
        reader = reader.option("inferSchema", True)
    else:
        reader = reader.schema(schema)
    df = reader.csv(path)
    blanks = {
        f.name: F.nullif(F.col(f"`{f.name}`"), F.lit(""))
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
    }
    return df.withColumns(blanks) if blanks else df


#: Columns that :func:`with_source_order` adds, in the order they sort by.
SOURCE_ORDER = ["_file", "_block", "_place"]


def with_source_order(df: DataFrame) -> DataFrame:
    """Add the place of every row in its source: file, block of the file, place in the task.

    ``df`` is a scan of files, or only columns and filters on one.  A file cut into
    blocks is read by several tasks, each from its first row on, so sorting by the three
    gives the order of the lines, and files come by name.  The values are good for one
    reading: store the rows before they are read twice.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
    )


def header_repair(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename blank or positional headers; an unknown header is an error."""
    unknown = sorted(set(names) - set(df.columns))
    if unknown:
        raise ValueError(f"no such column(s): {unknown}")
    return df.withColumnsRenamed(names)


def csv_sink(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write a result table with a header and ``NA`` for missing cells.

    One file per task: the result is never pulled into a single writer.
    """
    writer = df.write.mode(mode).options(**QUOTING)
    writer.option("header", True).option("nullValue", "NA").csv(path)
    return path
