"""CSV and Parquet input, CSV and JSON output, file metadata and previews."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import cells
from plumbline.operators.profile import null_counts
from plumbline.operators.repeats import repeat_counts

# ---- fixed values ----------------------------------------------------------------------------
SEPARATORS = (",", "\t", ";", "|")
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
PREVIEW_ROWS = 50

_INTEGER = r"\A[ \t]*[+-]?[0-9]+[ \t]*\z"
_TRUE, _FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")


WINDOWS = "windows-1252"
# What windows-1252 has in the place of Latin-1's control characters from 0x80 to 0x9F.
_C1 = tuple(map("".join, zip(*[(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)])))
# Lines with such bytes, and with those that it leaves open, in hexadecimal digits.
_WINDOWS, _OPEN = r"\A(?:..)*(?:8|9)", r"\A(?:..)*(?:81|8D|8F|90|9D)"


@dataclass(frozen=True)
class CsvFormat:
    """How the files of an input are written; `groups` holds (encoding, multiline, files) where they differ."""

    separator: str
    encoding: str
    multiline: bool
    groups: tuple[tuple[str, bool, tuple[str, ...]], ...] = ()


def file_formats(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: (file_path, file_name, file_size_bytes, lines, encoding, multiline), from one distributed scan.

    A file that is not UTF-8 throughout is windows-1252 if it has bytes from 0x80 to 0x9F and all of them are defined
    there, else Latin-1, in which every byte means something. `multiline` says that some line has an odd number of
    quotes, so that values may hold line breaks. Files without lines have no row.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_name", "_metadata.file_size")
    valid = F.is_valid_utf8("value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # Only lines that are no UTF-8 are spelt out in hexadecimal digits.
    raw = F.when(~valid, F.hex(F.col("value").cast("binary")))
    seen = lines.groupBy("file_path", "file_name", "file_size").agg(
        F.count(F.lit(1)).alias("lines"), F.bool_and(valid).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("multiline"),
        F.bool_or(F.coalesce(raw.rlike(_WINDOWS), F.lit(False))).alias("windows"), F.bool_or(F.coalesce(raw.rlike(_OPEN), F.lit(False))).alias("open"),
    )
    encoding = F.when(F.col("utf8"), "UTF-8").when(F.col("windows") & ~F.col("open"), WINDOWS).otherwise("ISO-8859-1")
    return seen.select("file_path", "file_name", F.col("file_size").alias("file_size_bytes"), "lines", encoding.alias("encoding"), "multiline")


def detect_csv(
    spark: SparkSession,
    path: str,
    separator: str | None = None,
    encoding: str | None = None,
    multiline: bool | None = None,
) -> CsvFormat:
    """Find the separator from the header line, and the rest file by file (`file_formats`).

    Files that may hold line breaks in values are read whole, one task each; all others can be split over many tasks.
    Give `encoding` and `multiline` to save the scan.
    """
    first = spark.read.text(path).filter(F.length("value") > 0).select("value").first()
    if first is None:
        raise ValueError("The CSV file is empty.")
    groups: dict[tuple[str, bool], list[str]] = {}
    if encoding is None or multiline is None:
        # One row a file, as many as Spark lists for the scan itself.
        for row in file_formats(spark, path).select("file_path", "encoding", "multiline").collect():
            kind = encoding or row["encoding"], row["multiline"] if multiline is None else multiline
            groups.setdefault(kind, []).append(row["file_path"])
    if separator is None:
        header = first["value"].lstrip("\ufeff")
        for candidate in SEPARATORS:
            if len(next(csv.reader(io.StringIO(header), delimiter=candidate))) > 1:
                separator = candidate
                break
        else:
            raise ValueError("No separator gives more than one column; pass `separator` for one-column files.")
    if not groups:
        return CsvFormat(separator, encoding, multiline)
    kinds = sorted(groups, key=lambda k: len(groups[k]), reverse=True)
    split = tuple((*k, tuple(sorted(groups[k]))) for k in kinds) if len(kinds) > 1 else ()
    return CsvFormat(separator, kinds[0][0], any(m for _, m in kinds), split)


def null_tokens_to_null(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS, except_for: Sequence[str] = ()) -> DataFrame:
    """The usual spellings of "no value" in text columns become null."""
    return df.select(
        *[
            F.when(~F.col(f"`{f.name}`").isin(list(tokens)), F.col(f"`{f.name}`")).alias(f.name)
            if cells.is_string(f.dataType) and f.name not in except_for
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def _candidates(c: Column) -> dict[str, Column]:
    """Per candidate type, whether one value fits it."""
    return {
        "bigint": c.rlike(_INTEGER) & F.trim(c).try_cast("bigint").isNotNull(),
        "double": cells.number(c, T.StringType()).isNotNull(),
        "boolean": c.isin(*_TRUE, *_FALSE),
    }


def infer_types(df: DataFrame) -> T.StructType:
    """The narrowest type per text column, from one aggregate: integer, float, boolean, else text."""
    measures = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        for kind, fits in _candidates(c).items():
            measures.append(cells.count_where(c.isNotNull() & ~F.coalesce(fits, F.lit(False))).alias(f"{kind}{i}"))
        measures.append(F.count(c).alias(f"known{i}"))
    row = df.agg(*measures).first()
    types = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    fields = []
    for i, name in enumerate(df.columns):
        fitting = [kind for kind in types if row[f"{kind}{i}"] == 0]
        if not row[f"known{i}"]:
            dtype = T.DoubleType()  # a column without values
        else:
            dtype = types[fitting[0]] if fitting else T.StringType()
        fields.append(T.StructField(name, dtype))
    return T.StructType(fields)


def cast_to(df: DataFrame, schema: T.StructType, *others: Column) -> DataFrame:
    """The text columns in the types of `schema`, and other columns behind them."""

    def convert(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            return c
        if isinstance(f.dataType, T.BooleanType):
            return F.when(c.isin(*_TRUE), True).when(c.isin(*_FALSE), False).alias(f.name)
        if isinstance(f.dataType, T.DoubleType):
            return cells.number(c, T.StringType()).alias(f.name)
        return F.trim(c).try_cast(f.dataType).alias(f.name)

    return df.select(*[convert(f) for f in schema], *others)


def read_csv(
    spark: SparkSession,
    path: str,
    separator: str | None = None,
    encoding: str | None = None,
    schema: T.StructType | None = None,
    null_tokens: Sequence[str] = NULL_TOKENS,
    multiline: bool | None = None,
    malformed_column: str | None = None,
) -> DataFrame:
    """Read CSV with a header; what is not given is detected. Give a schema to save the type scan too.

    Every file is read in its own encoding; all must have the same columns. With `malformed_column`, a column of that
    name holds the whole line of a row that has more or fewer values than the header, and null for all others, so that
    a rule on it reports such rows as violations.
    """
    found = detect_csv(spark, path, separator, encoding, multiline)
    parts = [_csv_rows(spark, found.separator, *group, malformed_column) for group in found.groups or [(found.encoding, found.multiline, (path,))]]
    for part in parts[1:]:
        if sorted(part.columns) != sorted(parts[0].columns):
            raise ValueError(f"Files have different columns: {parts[0].columns} and {part.columns}")
    raw = reduce(DataFrame.unionByName, parts)
    others = [] if malformed_column is None else [malformed_column]
    known = null_tokens_to_null(raw, null_tokens, others)
    types = schema or infer_types(known.drop(*others))
    return cast_to(known, types, *[F.col(f"`{c}`") for c in others])


def _csv_rows(spark: SparkSession, separator: str, encoding: str, multiline: bool, files: Sequence[str], malformed_column: str | None) -> DataFrame:
    """All values as text. Spark reads no windows-1252, so such files are read as Latin-1 and their control characters replaced."""
    charset = "ISO-8859-1" if encoding == WINDOWS else encoding
    reader = spark.read.option("header", True).option("sep", separator).option("encoding", charset).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    rows = reader.csv(list(files))
    if malformed_column is not None:
        fields = [*rows.schema.fields, T.StructField(malformed_column, T.StringType())]
        # Whether a line fits is only seen when all its values are parsed, so no column may be left out.
        reader = reader.schema(T.StructType(fields)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", malformed_column).option("columnPruning", False)
        rows = reader.csv(list(files))
        # Spark does not read this column alone, so it is joined with nothing of another one.
        nothing = F.coalesce(F.substring(F.col(f"`{rows.columns[0]}`"), 1, 0), F.lit(""))
        rows = rows.withColumn(malformed_column, F.concat(F.col(f"`{malformed_column}`"), nothing))
    return rows if encoding != WINDOWS else rows.select(*[F.translate(F.col(f"`{c}`"), *_C1).alias(c.translate(str.maketrans(*_C1))) for c in rows.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read Parquet; an input without rows, or that is not Parquet, is an error."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise ValueError(f"Not a readable Parquet input: {path}") from e
    if df.isEmpty():
        raise ValueError("The Parquet file has no rows.")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header line, UTF-8."""
    (
        df.write.option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object per line."""
    report.write.option("ignoreNullFields", False).json(path)


def dataset_metadata(df: DataFrame) -> DataFrame:
    """One row: rows, columns, names, types, nulls in total and per column, repeated rows."""
    names = df.columns
    counts = [c.cast("bigint").alias(f"n{i}") for i, c in enumerate(null_counts(df, names))]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    nulls = [F.col(f"n{i}") for i in range(len(names))]
    return row.select(
        "rows",
        F.lit(len(names)).alias("columns"),
        F.array(*[F.lit(n) for n in names]).alias("column_names"),
        F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema]).alias("dtypes"),
        reduce(lambda a, b: a + b, nulls).alias("null_count"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*nulls)).alias("null_per_column"),
        repeat_counts(df, names).select("repeats").scalar().alias("duplicated_rows"),
    )


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: name and size. Only the listing is read, no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size_bytes"))


def preview(df: DataFrame, row_key: Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows by row key: a top-k, not a sort of the table."""
    return df.orderBy(*[F.col(f"`{k}`") for k in row_key]).limit(n)


def safe_sample(df: DataFrame, row_key: Sequence[str], n: int = 5) -> DataFrame:
    return preview(df, row_key, n)
