"""Raw CSV scans, one dialect per data set."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinel.functions.cols import normalize_name
from sentinel.functions.storage import first_line, list_dir, path_exists
from sentinel.schema import DIALECTS, Dialect

CORRUPT = "_corrupt_record"


def list_raw_files(spark: SparkSession, raw_dir: str, dataset: str) -> list[str]:
    """Sorted CSV paths of a data set; an error if the folder or its files are missing."""
    folder = f"{raw_dir.rstrip('/')}/{dataset}"
    if not path_exists(spark, folder):
        raise FileNotFoundError(f"raw data folder not found: {folder}")
    files = [f"{folder}/{n}" for n in list_dir(spark, folder) if n.endswith(".csv")]
    if not files:
        raise FileNotFoundError(f"no CSV files in {folder}")
    return files


def header_names(spark: SparkSession, file: str, dialect: Dialect) -> tuple[str, ...]:
    """Normalised column names of one file; two that become equal are an error."""
    line = first_line(spark, file, dialect.encoding)
    if line is None:
        raise ValueError(f"{file} is empty")
    names = tuple(normalize_name(n) for n in next(csv.reader(io.StringIO(line.lstrip("\ufeff")), delimiter=dialect.sep)))
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names of {file} collide after normalisation: {clashes}")
    return names


def layouts(spark: SparkSession, files: list[str], dialect: Dialect) -> dict[tuple[str, ...], list[str]]:
    """Files by their column names in file order; only first lines are read."""
    if dialect.columns:
        return {tuple(normalize_name(c) for c in dialect.columns): list(files)}
    found: dict[tuple[str, ...], list[str]] = {}
    for file in files:
        found.setdefault(header_names(spark, file, dialect), []).append(file)
    return found


def reader_options(dialect: Dialect) -> dict[str, str]:
    return {
        "encoding": dialect.encoding, "sep": dialect.sep, "header": str(dialect.header).lower(),
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "enforceSchema": "true",
        "columnPruning": "false",  # a pruned parse would not see that a row is too long
        "quote": '"', "escape": '"',  # a quote in a quoted field is doubled; a backslash is a character like any other
    }


def _whole_quotes(text: Column, sep: str) -> Column:
    """The text without its complete quoted fields; doubled quotes go first."""
    return F.regexp_replace(F.replace(text, F.lit('""'), F.lit("")), f'(^|[{sep}])"[^"]*"', "$1")


def over_long(columns: list[str], sep: str = ",") -> Column:
    """Is the row malformed by having more fields than its schema? Separators and line breaks in quotes do not count.

    Spark refuses a scan of nothing but the corrupt record, as a plain count would make, so the first column is read, too.
    """
    names = [c for c in columns if c != CORRUPT]
    bare = _whole_quotes(F.col(CORRUPT), sep)
    read = F.length(F.concat(F.col(CORRUPT), F.coalesce(F.col(names[0]), F.lit("")))) > 0
    return F.col(CORRUPT).isNotNull() & read & (F.size(F.split(bare, f"[{sep}]")) > len(names))


def _base_name(path: str) -> str:
    return unquote(path.rsplit("/", 1)[-1])


def files_with_spanning_records(spark: SparkSession, files: list[str], dialect: Dialect) -> set[str]:
    """Those of ``files`` in which a quoted field runs over the end of a line.

    One scan over the lines that hold a quote. The first such record of a file begins on a line of its own, so it is found; only file names come
    to the driver. The files of one call lie in one folder.
    """
    lines = spark.read.option("encoding", dialect.encoding).text(files)  # quotes and separators are ASCII in every encoding used here
    opens = _whole_quotes(F.col("value"), dialect.sep).rlike(f'(^|[{dialect.sep}])"')
    found = lines.where(F.col("value").contains('"')).where(opens).select(F.col("_metadata.file_path").alias("path")).distinct()
    names = {_base_name(r["path"]) for r in found.collect()}
    return {f for f in files if _base_name(f) in names}


def read_files(spark: SparkSession, files: list[str], dataset: str) -> DataFrame:
    """Files of a data set as text columns, aligned by normalised name; a column that a file lacks is NULL.

    There is one scan per distinct header. Rows with fewer fields than their own file's header are padded
    with NULL; rows with more are left out, see :func:`count_malformed`.
    """
    sep = _dialect(dataset).sep
    parts = [df.where(~over_long(df.columns, sep)).drop(CORRUPT) for df in _scans(spark, files, dataset)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_raw(spark: SparkSession, raw_dir: str, dataset: str) -> DataFrame:
    """All files of a data set, see :func:`read_files`."""
    _dialect(dataset)
    return read_files(spark, list_raw_files(spark, raw_dir, dataset), dataset)


def count_malformed(spark: SparkSession, raw_dir: str, dataset: str) -> DataFrame:
    """(file, n_malformed, n_filled): rows that :func:`read_raw` leaves out, and all rows whose first
    field is not empty."""
    sep = _dialect(dataset).sep
    parts = [df.select(F.col("_metadata.file_name").alias("file"), over_long(df.columns, sep).alias("_bad"), F.col(df.columns[0]).alias("_first"))
             for df in _scans(spark, list_raw_files(spark, raw_dir, dataset), dataset)]
    return reduce(DataFrame.union, parts).groupBy("file").agg(
        F.count_if("_bad").alias("n_malformed"), F.count("_first").alias("n_filled"))


def _dialect(dataset: str) -> Dialect:
    if dataset not in DIALECTS:
        raise ValueError(f"unknown data set '{dataset}'")
    return DIALECTS[dataset]


def _scans(spark: SparkSession, files: list[str], dataset: str) -> list[DataFrame]:
    """One scan per layout, and one more for its files whose records span lines: those cannot be split, all others can."""
    dialect = _dialect(dataset)
    spanning = files_with_spanning_records(spark, files, dialect)
    out = []
    for names, same in layouts(spark, files, dialect).items():
        reader = spark.read.options(**reader_options(dialect)).schema(text_schema(names))
        for whole in (False, True):
            part = [f for f in same if (f in spanning) == whole]
            if part:
                out.append(reader.option("multiLine", whole).csv(part))
    return out


def text_schema(names: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
