"""Files in and out: whole texts by extension, candidates by age, dictionaries with defaults, stamped sinks, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 16 << 20
TEXTS, PAGES = ("txt", "md"), ("pdf",)


def files(spark: SparkSession, paths: list[str], extensions: list[str] | None = None, most: int = MOST_BYTES) -> DataFrame:
    """path, name, extension, length, modified of files with an allowed extension and at most `most` bytes; contents aren't read.

    paths may hold globs; folders are searched with all that is below them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    rows = found.select("path", name.alias("name"), F.lower(F.regexp_extract(name, "[.]([^.]+)$", 1)).alias("extension"), "length", F.col("modificationTime").alias("modified"))
    rows = rows.where(F.col("length") <= most)
    return rows.where(F.col("extension").isin(extensions)) if extensions is not None else rows


def newest(found: DataFrame, n: int = 1) -> DataFrame:
    """The n files changed last; by name where times are equal."""
    return found.orderBy(F.col("modified").desc(), "name").limit(n)


def texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, text, error: whole UTF-8 texts of text files; other kinds have an error that names them instead of a text."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    kind = F.lower(F.regexp_extract("path", "[.]([^./]+)$", 1))
    readable = kind.isin(*TEXTS)
    said = F.when(kind.isin(*PAGES), "pages need a reader: ").otherwise("unsupported file type: ")
    text = F.when(readable, F.decode("content", "UTF-8"))
    return found.select("path", text.alias("text"), F.when(~readable, F.concat(said, kind)).alias("error"))


def dictionary(spark: SparkSession, path: str, default: list[str]) -> list[str]:
    """Names in a file, one a line without blank ones; the default where the file can't be read or has none."""
    try:
        found = [r.value.strip() for r in spark.read.text(path).limit(10_000).collect()]  # a dictionary, not a corpus
    except Exception:  # noqa: BLE001  whatever the store says about a missing file
        return default
    return [x for x in found if x] or default


def write_texts(df: DataFrame, folder: str, stamp: str, text: str = "text") -> str:
    """Writes texts under a folder with a stamp in its name; returns the folder."""
    path = f"{folder.rstrip('/')}/texts_{stamp}"
    df.select(text).write.option("lineSep", "\n").text(path)
    return path


def write_sessions(df: DataFrame, path: str) -> None:
    """Sessions as JSON, one a line: all columns, nested ones too."""
    df.write.json(path)


def read_sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Sessions that are whole; lines that aren't JSON are left out."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where(F.col("_broken").isNull()).drop("_broken")


def case_file(df: DataFrame, title: str, text: str, expected: str) -> DataFrame:
    """value: a case as Markdown, with its title, the text and what is expected."""
    return df.select(F.concat(F.lit("## "), F.col(title), F.lit("\n\n```\n"), F.col(text), F.lit("\n```\n\nExpected:\n\n```\n"), F.col(expected), F.lit("\n```\n")).alias("value"))
